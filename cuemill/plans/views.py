"""The driver's tables seen as transcripts, jobs, files and events, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.functions.text import split_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Letters of texts whose words one task holds.
SHARE = 2_000_000


def dealt(rows: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """rows (key, text), all of a key in one partition, and about share letters in each: what a task holds doesn't grow with the
    table. Whole texts are moved, and what is made of their words stays where it is while it is told apart by the key."""
    letters = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-letters // share)), key)


#: Words of conversations: 350 ms apart and 300 long, with 950 ms of silence between turns.
WORDS = r"""words AS (
  SELECT job_id, idx, text, CAST(350 * idx + 900 * turn AS DOUBLE) / 1000 AS "start", CAST(350 * idx + 900 * turn + 300 AS DOUBLE) / 1000 AS "end", speaker, turn
  FROM (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY turn, pos) - 1 AS idx, turn, speaker, text
        FROM (SELECT conv_id AS job_id, turn, role AS speaker, unnest(l) AS text, generate_subscripts(l, 1) AS pos
              FROM (SELECT *, list_filter(string_split_regex(text, '[\x09-\x0d\x1c-\x20]+'), lambda x: x <> '') AS l FROM conversations))))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, idx, text, start, end, speaker, turn."""
    turns = dealt(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), "turn", F.col("role").alias("speaker"), "text"), "job_id")
    tokens = turns.select("job_id", "turn", "speaker", F.posexplode(split_words(F.col("text"))).alias("pos", "text"))
    idx = F.row_number().over(Window.partitionBy("job_id").orderBy("turn", "pos")) - 1
    rows = tokens.withColumn("idx", idx)
    ms = 350 * F.col("idx") + 900 * F.col("turn")
    return rows.select("job_id", "idx", "text", (ms.cast("double") / 1000).alias("start"), ((ms + 300).cast("double") / 1000).alias("end"), "speaker", "turn")


#: A segment for each turn.
SEGMENTS = """segments AS (SELECT conv_id AS job_id, turn AS idx, text, CAST(turn AS DOUBLE) AS "start", CAST(turn AS DOUBLE) + 0.5 AS "end", CASE WHEN role <> 'system' THEN role END AS speaker FROM conversations)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("idx"), "text", F.col("turn").cast("double").alias("start"), (F.col("turn").cast("double") + 0.5).alias("end"), F.when(F.col("role") != "system", F.col("role")).alias("speaker"))


EDITS = """edits AS (SELECT conv_id AS job_id, turn AS idx, CASE WHEN turn % 2 = 1 THEN 'edit ' || turn END AS text FROM conversations WHERE turn % 3 = 0 OR conv_id % 7 = 0)"""
EARLIER = """earlier AS (SELECT conv_id AS job_id, turn AS idx, 'old ' || turn AS text FROM conversations WHERE turn % 2 = 0)"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where((F.col("turn") % 3 == 0) | (F.col("conv_id") % 7 == 0))
    return c.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("idx"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("edit "), F.col("turn"))).alias("text"))


def earlier_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("turn") % 2 == 0)
    return c.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("idx"), F.concat(F.lit("old "), F.col("turn")).alias("text"))


JOBS = """jobs AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS state, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS submitted_at, o_totalprice AS media, o_custkey AS owner FROM orders)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("failed")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), state.alias("state"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("submitted_at"), F.col("o_totalprice").alias("media"), F.col("o_custkey").alias("owner"))


#: Results of jobs; keys of lineitem aren't unique, so positions come from all that tells rows apart.
RESULTS = """results AS (SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS pos, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'cancelled' ELSE 'completed' END AS state, CASE WHEN l_returnflag = 'R' THEN 'line ' || l_linenumber END AS error, l_partkey, l_quantity FROM lineitem)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "job_id")
    pos = F.row_number().over(Window.partitionBy("job_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"))
    state = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "cancelled").otherwise("completed")
    return li.select("job_id", pos.alias("pos"), state.alias("state"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("line "), F.col("l_linenumber"))).alias("error"), "l_partkey", "l_quantity")


#: Events of jobs: stages by number, of a few files a user.
STAGE_EVENTS = """stage_events AS (
  SELECT user_id AS job_id, event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'file' || (event_id % 3) END AS source,
         CASE event_id % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'validating' WHEN 2 THEN 'probing' WHEN 3 THEN 'transcribing' WHEN 4 THEN 'transcribing' WHEN 5 THEN 'rendering' WHEN 6 THEN 'translating' ELSE CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'completed' ELSE 'rendering' END END AS stage,
         CASE WHEN event_id % 16 < 8 THEN 'started' ELSE 'completed' END AS status, event_type AS message, value
  FROM events)"""


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    k = n % 8
    stage = F.when(k == 0, "queued").when(k == 1, "validating").when(k == 2, "probing").when(k.isin(3, 4), "transcribing").when(k == 5, "rendering").when(k == 6, "translating").when(n % 5 == 0, "failed").when(n % 7 == 0, "completed").otherwise("rendering")
    source = F.when(n % 11 != 0, F.concat(F.lit("file"), n % 3))
    return e.select(F.col("user_id").alias("job_id"), "event_id", source.alias("source"), stage.alias("stage"), F.when(n % 16 < 8, "started").otherwise("completed").alias("status"), F.col("event_type").alias("message"), "value")


#: Files of documents in folders by source.
FILES = """files AS (SELECT '/data/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars AS size, doc_id % 10 = 0 AS is_symlink, source, lang, doc_id FROM (SELECT doc_id, coalesce(source, 'src0') AS source, coalesce(lang, 'none') AS lang, coalesce(n_chars, 0) AS n_chars FROM documents))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", *[F.coalesce(c, F.lit(x)).alias(c) for c, x in (("source", "src0"), ("lang", "none"), ("n_chars", 0))])
    return d.select(F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 10 == 0).alias("is_symlink"), "source", "lang", "doc_id")


#: Folders that jobs list: one job a source; every second one lists the folder of all, and odd ones a language's too.
FOLDERS = """folders AS (
  SELECT DISTINCT source AS job_id, 'output' AS kind, 1 AS pos, '/data/' || source AS path FROM files
  UNION ALL SELECT DISTINCT source, 'upload', 1, '/data/' || source || '/en' FROM files WHERE CAST(substr(source, 4) AS INT) % 2 = 1
  UNION ALL SELECT DISTINCT source, 'output', 2, '/data/src3' FROM files WHERE CAST(substr(source, 4) AS INT) % 5 = 0)"""


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = files(spark, sf_dir).select(F.col("source").alias("job_id")).distinct()
    number = F.substring("job_id", 4, 9).cast("int")
    own = s.select("job_id", F.lit("output").alias("kind"), F.lit(1).alias("pos"), F.concat(F.lit("/data/"), "job_id").alias("path"))
    up = s.where(number % 2 == 1).select("job_id", F.lit("upload").alias("kind"), F.lit(1).alias("pos"), F.concat(F.lit("/data/"), "job_id", F.lit("/en")).alias("path"))
    other = s.where(number % 5 == 0).select("job_id", F.lit("output").alias("kind"), F.lit(2).alias("pos"), F.lit("/data/src3").alias("path"))
    return own.unionByName(up).unionByName(other)
