"""Cues from timed words: where they break, when they show, and the files they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.text import LINE, bind, clock, collapse, ends_sentence, join_tokens, speaker_prefix, wrap_lines

LINES, LONGEST, SILENCE = 2, 7.0, 0.8
#: Shortest show, reading speed in characters a second, and the least distance between cues.
SHORTEST, READ, APART = 0.7, 20.0, 0.001
#: Far over the rounding errors of sums of APART, in seconds.
SLACK = 1e-6


def cue_ranges(words: DataFrame, line: int = LINE, lines: int = LINES, longest: float = LONGEST, silence: float = SILENCE) -> DataFrame:
    """job_id, word_start, word_end, first_start, last_end, speaker, text of each cue.

    words: job_id, idx, text, start, end, speaker. What a word and its neighbour decide alone (another speaker, silence, the
    end of a sentence) cuts a job into islands; inside one, a fold closes a cue once it is too long in time, or would be in
    letters with the next word.
    """
    order = Window.partitionBy("job_id").orderBy("idx")
    after = lambda c: F.lead(c).over(order)
    hard = after("idx").isNull() | ~after("speaker").eqNullSafe(F.col("speaker")) | (after("start") - F.col("end") >= silence) | ends_sentence(F.col("text"))
    marked = words.select("job_id", "idx", "text", "start", "end", "speaker", hard.alias("hard"), F.coalesce(F.length(after("text")), F.lit(0)).alias("coming"))
    island = F.coalesce(F.sum(F.col("hard").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = marked.select("job_id", island.alias("island"), F.struct("idx", "text", "start", "end", "speaker", "coming").alias("w")).groupBy("job_id", "island").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    begin = F.struct(F.lit(0).alias("chars"), F.lit(0.0).alias("since"), F.lit(0).alias("n"), F.array(F.lit(0)).alias("cuts"))

    def step(a: Column, w: Column) -> Column:
        chars = a["chars"] + F.length(w["text"]) + F.when(a["chars"] > 0, 1).otherwise(0)
        fresh = F.element_at(a["cuts"], -1) == a["n"]
        since = F.when(fresh, w["start"]).otherwise(a["since"])
        full = (w["end"] - since >= longest) | (chars + 1 + w["coming"] > line * lines)
        return F.struct(F.when(full, 0).otherwise(chars).alias("chars"), since.alias("since"), (a["n"] + 1).alias("n"), F.when(full, F.concat(a["cuts"], F.array(a["n"] + 1))).otherwise(a["cuts"]).alias("cuts"))

    def cut(cuts: Column) -> Column:
        ends = F.filter(F.transform(cuts, lambda c, i: F.struct(c.alias("a"), F.coalesce(F.get(cuts, i + 1), F.size("ws")).alias("b"))), lambda x: x["a"] < x["b"])
        return F.transform(ends, lambda x: bind(F.slice("ws", x["a"] + 1, x["b"] - x["a"]), lambda ws: F.struct(ws[0]["idx"].alias("word_start"), (F.element_at(ws, -1)["idx"] + 1).alias("word_end"), ws[0]["start"].alias("first_start"), F.element_at(ws, -1)["end"].alias("last_end"), ws[0]["speaker"].alias("speaker"), F.trim(join_tokens(F.transform(ws, lambda w: w["text"]))).alias("text"))))

    return rows.select("job_id", F.inline(bind(F.aggregate("ws", begin, step, lambda a: a["cuts"]), cut)))


def timed(ranges: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """job_id, cue, text (not wrapped), start, end, speaker, word_start, word_end.

    A cue starts with its first word, after the cue before; it stays for its words, SHORTEST and reading time, but ends
    before the next one's first word and with the media. Only an end that APART moved past the next first word delays that
    one, so a cue whose first word comes later than all earlier starts and APART for each cue since begins an island: it
    starts on its own. Starts are folded inside islands, which hold one cue each unless words of several share a moment.
    durations: job_id, duration (seconds or null).
    """
    lasting = F.lit(None).cast("double")
    joined = ranges.withColumn("duration", lasting) if durations is None else ranges.join(durations.groupBy("job_id").agg(F.max("duration").alias("duration")), "job_id", "left")
    order = Window.partitionBy("job_id").orderBy("word_start", "word_end", "first_start", "last_end", "speaker", "text")
    numbered = joined.withColumns({"cue": F.row_number().over(order) - 1, "coming": F.lead("first_start").over(order)})
    pushed = F.max(F.greatest("first_start", F.lit(0.0)) - F.col("cue") * APART).over(order.rowsBetween(Window.unboundedPreceding, -1)) + F.col("cue") * APART
    alone = F.coalesce(F.col("first_start") >= pushed + SLACK, F.lit(False))
    cs = F.struct("cue", "text", "first_start", "last_end", "coming", "speaker", "word_start", "word_end")
    rows = numbered.withColumn("alone", alone).withColumn("island", F.sum(F.col("alone").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy("job_id", "island").agg(F.max("duration").alias("duration"), F.sort_array(F.collect_list(cs)).alias("cs"))
    empty = F.array().cast("array<struct<start:double,end:double>>")

    def place(a: Column, c: Column) -> Column:
        start = F.greatest(c["first_start"], a["past"])
        wanted = F.greatest(c["last_end"], start + SHORTEST, start + F.length(c["text"]) / READ)
        end = F.greatest(F.least(wanted, c["coming"] - APART, F.col("duration")), start + APART)  # least() leaves out nulls
        return bind(F.struct(start.alias("start"), end.alias("end")), lambda t: F.struct(t["end"].alias("past"), F.concat(a["times"], F.array(t)).alias("times")))

    times = F.aggregate("cs", F.struct(F.lit(0.0).alias("past"), empty.alias("times")), place, lambda a: a["times"])
    shown = F.transform(F.arrays_zip("cs", "ts"), lambda x: F.struct(x["cs"]["cue"].alias("cue"), x["cs"]["text"].alias("text"), x["ts"]["start"].alias("start"), x["ts"]["end"].alias("end"), x["cs"]["speaker"].alias("speaker"), x["cs"]["word_start"].alias("word_start"), x["cs"]["word_end"].alias("word_end")))
    return islands.withColumn("ts", times).select("job_id", F.inline(shown))


def build_cues(words: DataFrame, durations: DataFrame | None = None, line: int = LINE, lines: int = LINES, longest: float = LONGEST, silence: float = SILENCE) -> DataFrame:
    """Cues of each job, with wrapped text."""
    return timed(cue_ranges(words, line, lines, longest, silence), durations).withColumn("text", wrap_lines(F.col("text"), line))


def _document(cues: DataFrame, block: Column, order: str = "cue") -> DataFrame:
    return cues.select("job_id", F.struct(F.col(order), block.alias("block")).alias("b")).groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["block"]), "\n\n").alias("body"))


def _shown(mark: str) -> Column:
    return F.concat(clock(F.col("start"), mark), F.lit(" --> "), clock(F.col("end"), mark), F.lit("\n"), speaker_prefix(F.col("speaker")), wrap_lines(collapse(F.col("text"))))


def render_srt(cues: DataFrame) -> DataFrame:
    """job_id, content: numbered blocks with blank lines between them. Jobs without cues have no row."""
    return _document(cues, F.concat((F.col("cue") + 1).cast("string"), F.lit("\n"), _shown(","))).select("job_id", F.concat("body", F.lit("\n")).alias("content"))


def render_vtt(cues: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """job_id, content. jobs: those that get a file with nothing but the header if they have no cues."""
    made = _document(cues, _shown("."))
    if jobs is not None:
        made = jobs.select("job_id").join(made, "job_id", "left")
    return made.select("job_id", F.concat(F.lit("WEBVTT\n\n"), F.coalesce(F.concat("body", F.lit("\n")), F.lit(""))).alias("content"))


def render_text(words: DataFrame, transcripts: DataFrame) -> DataFrame:
    """job_id, content: the transcript's text, or a line for each run of one speaker if any speaker is known.

    A run without speaker in between is named None, the last one unknown. transcripts: job_id, text.
    """
    order = Window.partitionBy("job_id").orderBy("idx")
    change = (~F.lag("speaker").over(order).eqNullSafe(F.col("speaker"))) & F.lag("idx").over(order).isNotNull()
    runs = words.select("job_id", "idx", "text", "speaker", change.cast("int").alias("change")).withColumn("run", F.sum("change").over(order))
    lines = runs.groupBy("job_id", "run").agg(F.first("speaker").alias("speaker"), F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("tokens"))
    last = F.max("run").over(Window.partitionBy("job_id"))
    label = F.coalesce("speaker", F.when(F.col("run") == last, "unknown").otherwise("None"))
    told = lines.select("job_id", "run", "speaker", F.concat(F.lit("Speaker "), label, F.lit(": "), join_tokens(F.col("tokens"))).alias("line"))
    by_job = told.groupBy("job_id").agg(F.bool_or(F.col("speaker").isNotNull()).alias("spoken"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return transcripts.select("job_id", "text").join(by_job, "job_id", "left").select("job_id", F.concat(F.when(F.coalesce("spoken", F.lit(False)), F.col("lines")).otherwise(F.trim("text")), F.lit("\n")).alias("content"))


def subtitle_files(cues: DataFrame, names: dict[str, str], jobs: DataFrame | None = None) -> DataFrame:
    """job_id, name, content of several kinds of subtitles ("srt", "vtt") under their names, as render_srt() and render_vtt() give
    them; a job's cues are wrapped and gathered once for all kinds. jobs: those that get a vtt file, if not those with cues."""
    times = F.concat(clock(F.col("start")), F.lit(" --> "), clock(F.col("end")))
    body = F.concat(F.lit("\n"), speaker_prefix(F.col("speaker")), wrap_lines(collapse(F.col("text"))))
    cs = F.struct(F.col("cue").cast("bigint").alias("cue"), times.alias("times"), body.alias("body"))
    rows = cues.select("job_id", cs.alias("c"), F.lit(0).alias("listed"))
    if jobs is not None:
        rows = rows.unionByName(jobs.select("job_id", F.lit(1).alias("listed")), allowMissingColumns=True)
    by_job = rows.groupBy("job_id").agg(F.sort_array(F.collect_list("c")).alias("cs"), F.sum("listed").cast("int").alias("listed"))
    full = F.size("cs") > 0
    blocks = {
        "srt": F.transform("cs", lambda c: F.concat((c["cue"] + 1).cast("string"), F.lit("\n"), c["times"], c["body"])),
        "vtt": F.transform("cs", lambda c: F.concat(F.translate(c["times"], ",", "."), c["body"])),
    }
    copies = {"srt": full.cast("int"), "vtt": F.lit(1) if jobs is None else F.col("listed")}
    head = {"srt": "", "vtt": "WEBVTT\n\n"}
    made = [F.array_repeat(F.struct(F.lit(name).alias("name"), F.concat(F.lit(head[kind]), F.array_join(blocks[kind], "\n\n"), F.when(full, "\n").otherwise("")).alias("content")), copies[kind]) for kind, name in names.items()]
    return by_job.select("job_id", F.inline(F.concat(*made)))


def render_segments(segments: DataFrame, order: str = "cue") -> DataFrame:
    """job_id, content: texts in a row, or a line each with the speaker (or unknown) if any is known."""
    text = collapse(F.col("text"))
    by_job = segments.select("job_id", F.struct(F.col(order), text.alias("text"), F.concat(F.lit("Speaker "), F.coalesce("speaker", F.lit("unknown")), F.lit(": "), text).alias("line")).alias("s"), F.col("speaker")).groupBy("job_id").agg(F.bool_or(F.col("speaker").isNotNull()).alias("spoken"), F.sort_array(F.collect_list("s")).alias("ss"))
    return by_job.select("job_id", F.concat(F.when(F.col("spoken"), F.array_join(F.transform("ss", lambda s: s["line"]), "\n")).otherwise(F.array_join(F.transform("ss", lambda s: s["text"]), " ")), F.lit("\n")).alias("content"))


def current_rows(positions: DataFrame, cues: DataFrame, linger: float = 2.0) -> DataFrame:
    """job_id, at, cue: the last cue that has started at a position and ended no more than linger before it, else -1.

    An as-of join as one sorted union: the latest cue carries on to the positions after it. positions: job_id, at.
    """
    marks = cues.select("job_id", F.col("start").alias("at"), F.struct("start", "cue", "end").alias("mark"), F.lit(None).cast("bigint").alias("n")).unionByName(positions.select("job_id", "at", F.lit(None).cast("struct<start:double,cue:int,end:double>").alias("mark"), F.lit(1).cast("bigint").alias("n")))
    # At one time cues come before positions; of cues that start together the last one counts.
    order = Window.partitionBy("job_id").orderBy("at", F.col("n").isNotNull(), F.col("mark.cue")).rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.withColumn("last", F.last("mark", ignorenulls=True).over(order)).where("n is not null")
    return seen.select("job_id", "at", F.when(F.col("at") <= F.col("last.end") + linger, F.col("last.cue")).otherwise(-1).alias("cue"))


def found_rows(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows that hold the needle in any of the columns, whatever the case; all rows for a blank needle."""
    wanted = needle.strip().lower()
    if not wanted:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
    return rows.where(hit)
