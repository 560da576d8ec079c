"""Edits over segments: merging, overlay, and the editor's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions.text import collapse, speaker_label
from cuemill.operators.ordinals import with_base

KEYS = ["job_id", "idx"]
#: Fixed value: what is said of a translation that doesn't line up.
UNEVEN = "The translation has %d lines and the transcript has %d, so translations can’t be shown beside each line. Download the translation to read it."


def merged_edits(earlier: DataFrame, later: DataFrame, merge: bool = True) -> DataFrame:
    """job_id, idx, text: the edits that hold. A later edit wins; a null text takes an edit back. Without merge, only
    later ones count for the jobs that have any. Both: job_id, idx, text."""
    if not merge:
        kept = earlier.join(later.select("job_id").distinct(), "job_id", "left_anti")
    else:
        kept = earlier.join(later.select(*KEYS), KEYS, "left_anti")
    return kept.unionByName(later).where("text is not null").select(*KEYS, "text")


def current_edits(documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """job_id, idx, text of edits made against the present transcript. documents: job_id, schema_version, source_sha,
    edited_indices, segments (array of index, text); hashes: job_id, sha."""
    rows = documents.join(hashes, "job_id").where((F.col("schema_version") == 1) & (F.col("source_sha") == F.col("sha")))
    return rows.select("job_id", "edited_indices", F.explode("segments").alias("s")).where(F.array_contains("edited_indices", F.col("s.index")) & F.col("s.text").isNotNull()).select("job_id", F.col("s.index").alias("idx"), F.col("s.text").alias("text")).dropDuplicates(KEYS)


def overlay(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """segments with the edits' texts, others collapsed, and edited: is there an edit?"""
    e = edits.select(*KEYS, F.col("text").alias("new"))
    joined = segments.join(e, KEYS, "left")
    return joined.select(*[F.coalesce("new", collapse(F.col("text"))).alias("text") if c == "text" else F.col(c) for c in segments.columns], F.col("new").isNotNull().alias("edited"))


def edit_faults(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """job_id, idx, fault of edits that can't be saved: of no segment, or of one twice."""
    counts = segments.groupBy("job_id").agg(F.count("*").alias("segments"))
    rows = edits.groupBy(*KEYS).agg(F.count("*").alias("n")).join(counts, "job_id", "left")
    return rows.select(*KEYS, F.when(F.col("idx") >= F.coalesce("segments", F.lit(0)), "missing").when(F.col("n") > 1, "twice").alias("fault")).where("fault is not null")


def invalid_lines(lines: DataFrame) -> DataFrame:
    """job_id, invalid: how many lines of each job can't be saved. lines: job_id, idx, kind (as of rules.judged_edit())."""
    return lines.groupBy("job_id").agg(F.count_if(F.col("kind") == "invalid").alias("invalid"))


def edit_summary(edits: DataFrame) -> DataFrame:
    return edits.groupBy("job_id").agg(F.count("*").alias("edited_segments"), F.array_sort(F.collect_list("idx")).alias("edited_indices"))


def editor_rows(segments: DataFrame, edits: DataFrame, translations: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """job_id, idx, start, end, speaker, original, text, edited, translation, note.

    A translation is shown only if it has as many lines as the transcript; note says so if not. translations: job_id, idx,
    text; documents: job_id of all translations, also of those without any line.
    """
    ours = segments.groupBy("job_id").agg(F.count("*").alias("lines"))
    theirs = translations.groupBy("job_id").agg(F.count("*").alias("others"))
    if documents is not None:
        theirs = documents.select("job_id").distinct().join(theirs, "job_id", "left").select("job_id", F.coalesce("others", F.lit(0)).alias("others"))
    gate = ours.join(theirs, "job_id", "left")
    rows = segments.join(edits.select(*KEYS, F.col("text").alias("new")), KEYS, "left").join(gate, "job_id").join(translations.select(*KEYS, F.col("text").alias("other")), KEYS, "left")
    original = collapse(F.col("text"))
    text = F.coalesce("new", original)
    fits = F.col("others") == F.col("lines")
    note = F.when(F.col("others").isNotNull() & ~fits, F.format_string(UNEVEN, "others", "lines"))
    return rows.select("job_id", "idx", "start", "end", speaker_label(F.col("speaker")).alias("speaker"), original.alias("original"), text.alias("text"), (text != original).alias("edited"), F.when(fits, F.col("other")).alias("translation"), note.alias("note"))


def translated(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Translations put back to their segments by place in one batch over all jobs. results: ordinal, text.

    segments: job_id, job_pos, idx, text. The ordinal is a sum over jobs' counts, a row a job, plus the place in the job.
    """
    base = with_base(segments.groupBy("job_pos").agg(F.count("*").alias("n")), "job_pos", "n").drop("n")
    placed = segments.join(base, "job_pos").withColumn("ordinal", F.col("base") + F.col("idx"))
    return placed.join(results.select("ordinal", F.col("text").alias("translation")), "ordinal", "left").select("job_id", "idx", "text", F.col("translation"))


def visible(shown: Column) -> tuple[Column, Column]:
    """Counts for "shown of total"."""
    return F.count_if(shown), F.count("*")


def debounced(changes: DataFrame, delay: float = 0.8) -> DataFrame:
    """job_id, save, idx, text: what each save sends. A save goes out delay seconds after the last change; the last text of
    each line counts. changes: job_id, at (seconds), seq, idx, text."""
    from pyspark.sql import Window

    order = Window.partitionBy("job_id").orderBy("at", "seq")
    # The timer fires at exactly the delay, before a change at that moment.
    new = (F.col("at") - F.lag("at").over(order) >= delay).cast("int")
    saves = changes.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("save", F.sum("new").over(order))
    return saves.groupBy("job_id", "save", "idx").agg(F.max_by("text", F.struct("at", "seq")).alias("text"))
