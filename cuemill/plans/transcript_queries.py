"""Queries on transcripts: words, cues, text, edits and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions import rules, text
from cuemill.operators import cues, edits, validate
from cuemill.plans import views
from cuemill.plans.registry import Queries
from cuemill.plans.views import table
from cuemill.sources import ingest, sinks

query = Queries()

_CLOSING = r"'^(?:[.,!?;:%)\]}…]|$)'"
_TERMINAL = r"""regexp_matches(text, '[.!?…]["''”’)]*$')"""
#: Cues by a walk over each job's words; a cue's number rises after a word that breaks.
_CUES = f"""WITH RECURSIVE {views.WORDS},
w AS (SELECT *, lead("start") OVER j AS ns, lead(speaker) OVER j AS nsp, lead(idx) OVER j AS ni, coalesce(length(lead(text) OVER j), 0) AS nl FROM words WINDOW j AS (PARTITION BY job_id ORDER BY idx)),
h AS (SELECT *, ni IS NULL OR nsp IS DISTINCT FROM speaker OR ns - "end" >= 0.8::DOUBLE OR {_TERMINAL} AS hard FROM w),
walk AS (
  SELECT job_id, idx, "start" AS since, length(text) AS chars, 0 AS cue, hard OR "end" - "start" >= 7 OR length(text) + 1 + nl > 84 AS brk FROM h WHERE idx = 0
  UNION ALL
  SELECT x.job_id, x.idx, x.since, x.chars, x.cue, x.hard OR x."end" - x.since >= 7 OR x.chars + 1 + x.nl > 84
  FROM (SELECT h.job_id, h.idx, h.hard, h."end", h.nl, CASE WHEN p.brk THEN h."start" ELSE p.since END AS since, CASE WHEN p.brk THEN length(h.text) ELSE p.chars + 1 + length(h.text) END AS chars, CASE WHEN p.brk THEN p.cue + 1 ELSE p.cue END AS cue
        FROM walk p JOIN h ON h.job_id = p.job_id AND h.idx = p.idx + 1) x),
ranges AS (
  SELECT job_id, cue, min(idx) AS word_start, max(idx) + 1 AS word_end, min("start") AS first_start, max("end") AS last_end, min(speaker) AS speaker,
         trim(string_agg(CASE WHEN first OR regexp_matches(text, {_CLOSING}) THEN text ELSE ' ' || text END, '' ORDER BY idx)) AS text
  FROM (SELECT words.*, walk.cue, row_number() OVER (PARTITION BY words.job_id, walk.cue ORDER BY words.idx) = 1 AS first FROM words JOIN walk USING (job_id, idx)) GROUP BY job_id, cue)"""
_TIMES = """,
r AS (SELECT *, lead(first_start) OVER (PARTITION BY job_id ORDER BY cue) AS coming FROM ranges),
timed AS (
  SELECT job_id, cue, "start", greatest(least(greatest(last_end, "start" + 0.7::DOUBLE, "start" + length(text) / 20.0::DOUBLE), coming - 0.001::DOUBLE), "start" + 0.001::DOUBLE) AS "end"
  FROM (SELECT *, first_start AS "start" FROM r) WHERE cue = 0
  UNION ALL
  SELECT job_id, cue, "start", greatest(least(greatest(last_end, "start" + 0.7::DOUBLE, "start" + length(text) / 20.0::DOUBLE), coming - 0.001::DOUBLE), "start" + 0.001::DOUBLE)
  FROM (SELECT r.*, greatest(r.first_start, t."end") AS "start" FROM timed t JOIN r ON r.job_id = t.job_id AND r.cue = t.cue + 1))"""

#: Lines of words: as many as fit, one at least; texts that need a third are cut at the space nearest to the middle.
_WRAPPED = """,
filled AS (SELECT *, list_slice(ws, k + 1, len(ws)) AS tail FROM (SELECT *, greatest(1, len(list_filter(generate_series(1, len(ws)), lambda n: length(array_to_string(list_slice(ws, 1, n), ' ')) <= 42))) AS k FROM (SELECT *, string_split(text, ' ') AS ws FROM ranges))),
halved AS (SELECT *, CASE WHEN later - middle < middle - earlier OR earlier IS NULL THEN later ELSE earlier END AS place FROM (SELECT *, list_max(list_filter(spaces, lambda i: i <= middle)) AS earlier, list_min(list_filter(spaces, lambda i: i > middle)) AS later FROM (
  SELECT *, length(text) // 2 AS middle, list_filter(generate_series(0, length(text) - 1), lambda i: substr(text, i + 1, 1) = ' ') AS spaces FROM filled))),
wrapped AS (SELECT job_id, cue, speaker, word_start, word_end, CASE WHEN length(text) <= 42 OR len(tail) = 0 THEN text WHEN len(tail) = 1 OR length(array_to_string(tail, ' ')) <= 42 THEN array_to_string(list_slice(ws, 1, k), ' ') || chr(10) || array_to_string(tail, ' ')
  WHEN place IS NULL THEN text ELSE trim(substr(text, 1, place)) || chr(10) || trim(substr(text, place + 1)) END AS text FROM halved),
shown AS (SELECT job_id, cue, word_start, word_end, wrapped.speaker, wrapped.text, "start", "end" FROM wrapped JOIN timed USING (job_id, cue)),
ms AS (SELECT *, CAST(floor("start" * 1000 + 0.5::DOUBLE) AS BIGINT) AS a, CAST(floor("end" * 1000 + 0.5::DOUBLE) AS BIGINT) AS b FROM shown)"""
_SHOWN = _CUES + _TIMES + _WRAPPED


def _blocks(mark: str) -> str:
    clock = lambda x: f"printf('%02d:%02d:%02d{mark}%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"
    return f"{clock('a')} || ' --> ' || {clock('b')} || chr(10) || coalesce('[Speaker ' || speaker || '] ', '') || text"


def _cues(spark: SparkSession, d: str) -> DataFrame:
    return cues.build_cues(views.words(spark, d))


@query(_CUES + " SELECT job_id, word_start, word_end, first_start, last_end, speaker, text FROM ranges")
def w1_cue_ranges(spark, d):
    return cues.cue_ranges(views.words(spark, d))


@query(_CUES + _TIMES + ' SELECT timed.job_id, timed.cue, "start", "end", word_start, word_end, speaker, text FROM timed JOIN ranges USING (job_id, cue)')
def w2_cue_times(spark, d):
    return cues.timed(cues.cue_ranges(views.words(spark, d))).select("job_id", "cue", "start", "end", "word_start", "word_end", "speaker", "text")


@query()
def w1_documents(spark, d):
    """Whole documents as one speaker's words on a 350 ms grid."""
    docs = views.dealt(table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), "text"), "job_id")
    words = docs.select("job_id", F.posexplode(text.split_words(F.col("text"))).alias("idx", "text"))
    ms = (350 * F.col("idx")).cast("double")
    return cues.cue_ranges(words.select("job_id", "idx", "text", (ms / 1000).alias("start"), ((ms + 300) / 1000).alias("end"), F.lit(None).cast("string").alias("speaker")))


@query(_SHOWN + ' SELECT job_id, cue, text, "start", "end", speaker, word_start, word_end FROM shown')
def t3_wrapped_cues(spark, d):
    return _cues(spark, d)


@query(_SHOWN + f" SELECT job_id, string_agg((cue + 1) || chr(10) || {_blocks(',')}, chr(10) || chr(10) ORDER BY cue) || chr(10) AS content FROM ms GROUP BY job_id")
def k3_srt(spark, d):
    return cues.render_srt(_cues(spark, d))


@query(_SHOWN + f" SELECT job_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_blocks('.')}, chr(10) || chr(10) ORDER BY cue) || chr(10) AS content FROM ms GROUP BY job_id")
def k4_vtt(spark, d):
    return cues.render_vtt(_cues(spark, d))


#: A line for each run of one speaker.
_SPOKEN = f"""runs AS (SELECT *, sum(change) OVER (PARTITION BY job_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN lag(idx) OVER j IS NOT NULL AND lag(speaker) OVER j IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS change FROM words WINDOW j AS (PARTITION BY job_id ORDER BY idx))),
spoken AS (SELECT job_id, string_agg(line, chr(10) ORDER BY run) || chr(10) AS content FROM (
  SELECT job_id, run, 'Speaker ' || min(speaker) || ': ' || string_agg(CASE WHEN first OR regexp_matches(text, {_CLOSING}) THEN text ELSE ' ' || text END, '' ORDER BY idx) AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, run ORDER BY idx) = 1 AS first FROM runs) GROUP BY job_id, run) GROUP BY job_id)"""


@query(f"WITH {views.WORDS}, {_SPOKEN} SELECT job_id, content FROM spoken")
def t10_speaker_text(spark, d):
    words = views.words(spark, d)
    return cues.render_text(words, words.select("job_id").distinct().withColumn("text", F.lit("")))


@query(rf"""WITH {views.SEGMENTS}, s AS (SELECT job_id, idx, speaker, trim(regexp_replace(text, '[\x09-\x0d\x1c-\x20]+', ' ', 'g')) AS text, bool_or(speaker IS NOT NULL) OVER (PARTITION BY job_id) AS spoken FROM segments)
SELECT job_id, CASE WHEN bool_or(spoken) THEN string_agg('Speaker ' || coalesce(speaker, 'unknown') || ': ' || text, chr(10) ORDER BY idx) ELSE string_agg(text, ' ' ORDER BY idx) END || chr(10) AS content FROM s GROUP BY job_id""")
def t12_segment_text(spark, d):
    return cues.render_segments(views.segments(spark, d), "idx")


@query(rf"""SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '[\x09-\x0d\x1c-\x20]+', ' ', 'g')) AS c FROM documents)""")
def t2_collapse(spark, d):
    c = text.collapse(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(c).cast("bigint").alias("n"), F.md5(c).alias("digest"))


@query(rf"""SELECT conv_id, turn, CASE WHEN l[1] = '' THEN '' ELSE string_agg(t, '' ORDER BY pos) END AS joined FROM (
  SELECT conv_id, turn, l, pos, CASE WHEN pos = 1 OR regexp_matches(w, {_CLOSING}) THEN w ELSE ' ' || w END AS t FROM (
    SELECT conv_id, turn, l, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT *, list_filter(string_split_regex(text, '[\x09-\x0d\x1c-\x20]+'), lambda x: x <> '') AS l FROM conversations))) GROUP BY conv_id, turn, l""")
def t1_join_tokens(spark, d):
    return table(spark, d, "conversations").withColumn("ws", text.split_words(F.col("text"))).where(F.size("ws") > 0).select("conv_id", "turn", text.join_tokens(F.col("ws")).alias("joined"))


@query("""SELECT o_orderkey, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock FROM (SELECT o_orderkey, CAST(greatest(0, floor(o_totalprice * 1000 + 0.5::DOUBLE)) AS BIGINT) AS ms FROM orders)""")
def t4_clock(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.clock(F.col("o_totalprice")).alias("clock"))


@query("""SELECT conv_id, turn, '[Speaker ' || role || '] ' AS prefix, 'Speaker ' || role AS label FROM conversations""")
def t5_t6_speaker_labels(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.speaker_prefix(F.col("role")).alias("prefix"), text.speaker_label(F.col("role")).alias("label"))


@query(f"WITH {views.WORDS} SELECT job_id, count(*) FILTER (WHERE {_TERMINAL}) AS ends, count(*) AS words FROM words GROUP BY job_id")
def t7_terminal_words(spark, d):
    return views.words(spark, d).groupBy("job_id").agg(F.count_if(text.ends_sentence(F.col("text"))).alias("ends"), F.count("*").alias("words"))


@query("""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(stem, '[^\\w.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'media') AS stem FROM (SELECT page_id, regexp_replace(url, '^(.+)\\.[^.]*$', '\\1') AS stem FROM pages)""")
def t13_safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_stem(F.col("url")).alias("stem"))


@query("SELECT doc_id, length(text) AS letters, right(text, 20) AS tail, contains(lower(text), 'the ') AS found FROM documents")
def t20_t21_length_and_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("letters"), text.tail(F.col("text"), 20).alias("tail"), F.contains(F.lower("text"), F.lit("the ")).alias("found"))


@query("SELECT doc_id, text FROM documents WHERE contains(lower(text), 'token')")
def p26_find(spark, d):
    return cues.found_rows(table(spark, d, "documents"), "  TOKEN ", "text").select("doc_id", "text")


@query("""SELECT c_custkey, CASE WHEN h > 0 THEN printf('%d:%02d:%02d', h, m, s) ELSE printf('%d:%02d', m, s) END AS label FROM (SELECT c_custkey, t // 3600 AS h, t % 3600 // 60 AS m, t % 60 AS s FROM (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS t FROM customer WHERE c_acctbal >= 0)) UNION ALL SELECT c_custkey, '–' FROM customer WHERE c_acctbal < 0""")
def t16_durations(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.duration_label(F.col("c_acctbal")).alias("label"))


@query("""SELECT n_chars, CAST(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' document' ELSE ' documents' END AS label FROM documents GROUP BY n_chars""")
def t18_plurals(spark, d):
    return table(spark, d, "documents").groupBy("n_chars").agg(F.count("*").alias("n")).select("n_chars", text.plural(F.col("n"), "document").alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(least(1, greatest(0, l_discount * 9)) * 100 + 0.5::DOUBLE) AS BIGINT) || ' %' AS label FROM lineitem")
def t17_percents(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.percent_label(F.col("l_discount") * 9).alias("label"))


_FAULTY = f"""{views.WORDS}, bad AS (SELECT job_id, idx, CASE WHEN (job_id * 31 + idx) % 97 = 0 THEN ' ' ELSE text END AS text, CASE WHEN (job_id + idx) % 89 = 0 THEN "start" - 2 ELSE "start" END AS "start", "end" FROM words)"""


@query(f"""WITH {_FAULTY} SELECT job_id, min(idx) AS at, arg_min(fault, idx) AS fault FROM (
  SELECT job_id, idx, CASE WHEN trim(text) = '' THEN 'text' WHEN "start" < 0 OR "end" < "start" THEN 'times' WHEN "start" < lag("start") OVER (PARTITION BY job_id ORDER BY idx) THEN 'order' END AS fault FROM bad) WHERE fault IS NOT NULL GROUP BY job_id""")
def v1_word_faults(spark, d):
    w = views.words(spark, d)
    n = F.col("job_id") * 31 + F.col("idx")
    return validate.word_faults(w.withColumn("text", F.when(n % 97 == 0, " ").otherwise(F.col("text"))).withColumn("start", F.when((F.col("job_id") + F.col("idx")) % 89 == 0, F.col("start") - 2).otherwise(F.col("start"))))


@query("""SELECT job_id, min(cue) AS at, arg_min(fault, cue) AS fault FROM (SELECT job_id, cue, CASE WHEN "start" < 0 OR "end" <= "start" THEN 'times' WHEN "start" < lag("end") OVER (PARTITION BY job_id ORDER BY cue) - 0.001::DOUBLE THEN 'overlap' END AS fault
  FROM (SELECT conv_id AS job_id, turn AS cue, CAST(turn AS DOUBLE) AS "start", turn + 0.5::DOUBLE + turn % 4 AS "end" FROM conversations)) WHERE fault IS NOT NULL GROUP BY job_id""")
def v3_cue_faults(spark, d):
    t = F.col("turn")
    return validate.cue_faults(table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), t.alias("cue"), t.cast("double").alias("start"), (t + F.lit(0.5) + t % 4).alias("end")))


@query("""SELECT job_id, min(idx) AS at, arg_min(fault, idx) AS fault FROM (SELECT job_id, idx, CASE WHEN trim(source_text) = '' OR trim(text) = '' THEN 'text' WHEN "start" < 0 OR "end" <= "start" THEN 'times' WHEN "start" < lag("end") OVER (PARTITION BY job_id ORDER BY idx) - 0.001::DOUBLE THEN 'overlap' END AS fault
  FROM (SELECT conv_id AS job_id, turn AS idx, text AS source_text, CASE WHEN turn % 5 = 4 THEN ' ' ELSE role END AS text, CAST(turn AS DOUBLE) AS "start", turn + 1.0::DOUBLE AS "end" FROM conversations)) WHERE fault IS NOT NULL GROUP BY job_id""")
def v2_translation_faults(spark, d):
    t = F.col("turn")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), t.alias("idx"), F.col("text").alias("source_text"), F.when(t % 5 == 4, " ").otherwise(F.col("role")).alias("text"), t.cast("double").alias("start"), (t + F.lit(1.0)).alias("end"))
    return validate.translation_faults(rows)


@query(f"""WITH {views.SEGMENTS}, positions AS (SELECT DISTINCT conv_id AS job_id, turn * 1.75::DOUBLE - 0.5 AS at FROM conversations),
hit AS (SELECT p.job_id, p.at, max(s.idx) AS idx FROM positions p LEFT JOIN segments s ON s.job_id = p.job_id AND s."start" <= p.at GROUP BY p.job_id, p.at)
SELECT hit.job_id, hit.at, CASE WHEN hit.at <= s."end" + 2 THEN hit.idx ELSE -1 END AS cue FROM hit LEFT JOIN segments s ON s.job_id = hit.job_id AND s.idx = hit.idx""")
def j8_current_rows(spark, d):
    at = table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), (F.col("turn") * F.lit(1.75) - 0.5).alias("at")).distinct()
    rows = views.segments(spark, d).select("job_id", F.col("idx").cast("int").alias("cue"), "start", "end")
    return cues.current_rows(at, rows).select("job_id", "at", F.col("cue").cast("bigint").alias("cue"))


_MERGED = f"WITH {views.EDITS}, {views.EARLIER}, merged AS (SELECT * FROM edits WHERE text IS NOT NULL UNION ALL SELECT e.* FROM earlier e ANTI JOIN edits n ON n.job_id = e.job_id AND n.idx = e.idx)"


@query(_MERGED + " SELECT job_id, idx, text FROM merged")
def j5_merged_edits(spark, d):
    return edits.merged_edits(views.earlier_edits(spark, d), views.edits(spark, d))


@query(f"WITH {views.EDITS}, {views.EARLIER} SELECT job_id, idx, text FROM edits WHERE text IS NOT NULL UNION ALL SELECT * FROM earlier WHERE job_id NOT IN (SELECT job_id FROM edits)")
def j5_replaced_edits(spark, d):
    return edits.merged_edits(views.earlier_edits(spark, d), views.edits(spark, d), merge=False)


@query(_MERGED + rf""", {views.SEGMENTS} SELECT s.job_id, s.idx, coalesce(m.text, trim(regexp_replace(s.text, '[\x09-\x0d\x1c-\x20]+', ' ', 'g'))) AS text, s."start", s."end", s.speaker, m.text IS NOT NULL AS edited FROM segments s LEFT JOIN merged m ON m.job_id = s.job_id AND m.idx = s.idx""")
def j4_edited_segments(spark, d):
    return edits.overlay(views.segments(spark, d), j5_merged_edits(spark, d))


@query(_MERGED + " SELECT job_id, count(*) AS edited_segments, list(idx ORDER BY idx)::VARCHAR AS edited_indices FROM merged GROUP BY job_id")
def a13_edit_summary(spark, d):
    s = edits.edit_summary(j5_merged_edits(spark, d))
    return s.select("job_id", "edited_segments", F.concat(F.lit("["), F.array_join("edited_indices", ", "), F.lit("]")).alias("edited_indices"))


@query(_MERGED + rf""", {views.SEGMENTS}, other AS (SELECT job_id, idx, 'tr ' || idx AS text FROM segments WHERE job_id % 3 <> 0 AND (job_id % 3 = 1 OR idx > 0)),
n AS (SELECT job_id, count(*) AS lines FROM segments GROUP BY job_id), o AS (SELECT s.job_id, count(DISTINCT other.idx) AS others FROM segments s LEFT JOIN other USING (job_id) WHERE s.job_id % 9 = 0 OR s.job_id % 3 <> 0 GROUP BY s.job_id),
r AS (SELECT s.job_id, s.idx, s."start", s."end", coalesce('Speaker ' || s.speaker, '') AS speaker, trim(regexp_replace(s.text, '[\x09-\x0d\x1c-\x20]+', ' ', 'g')) AS original, m.text AS new, t.text AS tr, lines, others FROM segments s JOIN n USING (job_id) LEFT JOIN o USING (job_id) LEFT JOIN merged m ON m.job_id = s.job_id AND m.idx = s.idx LEFT JOIN other t ON t.job_id = s.job_id AND t.idx = s.idx)
SELECT job_id, idx, "start", "end", speaker, original, coalesce(new, original) AS text, coalesce(new, original) <> original AS edited, CASE WHEN others = lines THEN tr END AS translation, CASE WHEN others <> lines THEN printf('{edits.UNEVEN}', others, lines) END AS note FROM r""")
def j6_editor_rows(spark, d):
    s = views.segments(spark, d)
    j, i = F.col("job_id"), F.col("idx")
    other = s.where((j % 3 != 0) & ((j % 3 == 1) | (i > 0))).select("job_id", "idx", F.concat(F.lit("tr "), i).alias("text"))
    return edits.editor_rows(s, j5_merged_edits(spark, d), other, s.where((j % 9 == 0) | (j % 3 != 0)).select("job_id"))


@query(rf"""SELECT conv_id, turn, CASE WHEN t = o THEN 'restore' WHEN length(t) = 0 OR length(t) > 1000 THEN 'invalid' ELSE 'set' END AS kind, CASE WHEN t = o OR length(t) BETWEEN 1 AND 1000 THEN t END AS text FROM (
  SELECT conv_id, turn, trim(regexp_replace(text, '[\x09-\x0d\x1c-\x20]+', ' ', 'g')) AS o, CASE turn % 4 WHEN 0 THEN trim(regexp_replace(text, '[\x09-\x0d\x1c-\x20]+', ' ', 'g')) WHEN 1 THEN '' WHEN 2 THEN repeat('x', 1001) ELSE 'a b' END AS t FROM conversations)""")
def p27_judged_edits(spark, d):
    k = F.col("turn") % 4
    typed = F.when(k == 0, F.col("text")).when(k == 1, "  ").when(k == 2, "x" * 1001).otherwise(" a   b ")
    return table(spark, d, "conversations").select("conv_id", "turn", rules.judged_edit(typed, text.collapse(F.col("text"))).alias("e")).select("conv_id", "turn", "e.kind", "e.text")


@query(f"""WITH {views.SEGMENTS}, m AS (SELECT job_id, idx + job_id % 2 AS idx FROM segments UNION ALL SELECT job_id, idx FROM segments WHERE idx = 1)
SELECT m.job_id, m.idx, CASE WHEN m.idx >= s.n THEN 'missing' ELSE 'twice' END AS fault FROM (SELECT job_id, idx, count(*) AS k FROM m GROUP BY ALL) m JOIN (SELECT job_id, count(*) AS n FROM segments GROUP BY job_id) s USING (job_id) WHERE m.idx >= s.n OR k > 1""")
def j4_edit_faults(spark, d):
    s = views.segments(spark, d)
    wanted = s.select("job_id", (F.col("idx") + F.col("job_id") % 2).alias("idx")).unionByName(s.where("idx = 1").select("job_id", "idx"))
    return edits.edit_faults(wanted, s)


@query(f"""WITH {views.SEGMENTS} SELECT job_id, idx, text, 'tr ' || (row_number() OVER (ORDER BY job_id, idx) - 1) AS translation FROM segments""")
def j2_positional_translations(spark, d):
    s = views.segments(spark, d)
    from pyspark.sql import Window

    # A batch of texts over all jobs gets its translations by place; places inside jobs are dense.
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("idx")) - 1
    rows = s.select("job_id", F.col("job_id").alias("job_pos"), place.alias("idx"), "text")
    total = rows.count()
    answers = spark.range(total).select(F.col("id").alias("ordinal"), F.concat(F.lit("tr "), "id").alias("text"))
    return edits.translated(rows, answers).withColumn("idx", F.col("idx").cast("bigint"))


@query("""SELECT job_id, save, idx, arg_max(text, t) AS text FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY job_id ORDER BY t) AS BIGINT) AS save FROM (
  SELECT user_id AS job_id, event_id AS t, event_id % 3 AS idx, event_type AS text, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) >= 40 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY job_id, save, idx""")
def st11_debounced_saves(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("at"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("idx"), F.col("event_type").alias("text"))
    return edits.debounced(e, 40)


@query(f"""WITH {views.WORDS} SELECT job_id, idx, text, "start", "end", speaker FROM words""")
def p6_recogniser_json(spark, d):
    """Words written as recogniser output under other names, and read again."""
    w = views.words(spark, d)
    item = F.struct(F.col("text").alias("token"), F.col("start").cast("string").alias("begin"), F.col("end").alias("finish"), F.col("speaker").alias("speaker_id"))
    whole = w.groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", item.alias("w")))), lambda x: x["w"]).alias("tokens"))
    raw = whole.select("job_id", F.to_json(F.struct(F.array(F.struct(F.struct("tokens").alias("result"))).alias("results"))).alias("payload"), F.lit(None).cast("double").alias("duration"))
    return ingest.transcripts(raw).select("job_id", F.inline(ingest.rows_of("words"))).select("job_id", F.col("idx").cast("bigint").alias("idx"), "text", "start", "end", "speaker")


@query(_SHOWN + f""", {_SPOKEN}, doc AS (SELECT job_id, to_json(struct_pack(job_id := job_id, "text" := '', words := list(struct_pack(idx := CAST(idx AS INT), "text" := text, "start" := "start", "end" := "end", speaker := speaker) ORDER BY idx))) AS content FROM words GROUP BY job_id)
SELECT job_id, 'transcript.json' AS name, CAST(content AS VARCHAR) AS content FROM doc UNION ALL SELECT job_id, 'transcript.txt', content FROM spoken
UNION ALL SELECT job_id, 'subtitles.srt', string_agg((cue + 1) || chr(10) || {_blocks(',')}, chr(10) || chr(10) ORDER BY cue) || chr(10) FROM ms GROUP BY job_id
UNION ALL SELECT job_id, 'subtitles.vtt', 'WEBVTT' || chr(10) || chr(10) || string_agg({_blocks('.')}, chr(10) || chr(10) ORDER BY cue) || chr(10) FROM ms GROUP BY job_id""")
def k6_artifacts(spark, d):
    w = views.words(spark, d)
    texts = w.select("job_id").distinct().withColumn("text", F.lit(""))
    return sinks.artifacts(w, texts, _cues(spark, d), ("txt", "srt", "vtt"))


#: Turns as segments of a translation, shown as cues are.
_TRANSLATED = f"""WITH {views.SEGMENTS}, ranges AS (SELECT job_id, idx AS cue, trim(regexp_replace(text, '[\\x09-\\x0d\\x1c-\\x20]+', ' ', 'g')) AS text, speaker, 0 AS word_start, 0 AS word_end FROM segments), timed AS (SELECT job_id, idx AS cue, "start", "end" FROM segments)""" + _WRAPPED


@query(_TRANSLATED + f""", doc AS (SELECT job_id, to_json(struct_pack(job_id := job_id, segments := list(struct_pack(cue := idx, "text" := text, "start" := "start", "end" := "end", speaker := speaker) ORDER BY idx))) AS content FROM segments GROUP BY job_id)
SELECT job_id, 'translation.de.json' AS name, CAST(content AS VARCHAR) AS content FROM doc
UNION ALL SELECT job_id, 'translation.de.txt', CASE WHEN bool_or(speaker IS NOT NULL) THEN string_agg('Speaker ' || coalesce(speaker, 'unknown') || ': ' || text, chr(10) ORDER BY cue) ELSE string_agg(text, ' ' ORDER BY cue) END || chr(10) FROM ranges GROUP BY job_id
UNION ALL SELECT job_id, 'subtitles.de.srt', string_agg((cue + 1) || chr(10) || {_blocks(',')}, chr(10) || chr(10) ORDER BY cue) || chr(10) FROM ms GROUP BY job_id
UNION ALL SELECT job_id, 'subtitles.de.vtt', 'WEBVTT' || chr(10) || chr(10) || string_agg({_blocks('.')}, chr(10) || chr(10) ORDER BY cue) || chr(10) FROM ms GROUP BY job_id""")
def k7_translation_artifacts(spark, d):
    s = views.segments(spark, d).withColumnRenamed("idx", "cue")
    return sinks.translation_artifacts(s, "de", ("txt", "srt", "vtt"))
