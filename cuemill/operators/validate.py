"""Checks of words, translations and cues: the first fault of each job, or of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 0.001


def _first(rows: DataFrame, fault: Column, order: str) -> DataFrame:
    found = rows.select("job_id", F.col(order).alias("at"), fault.alias("fault")).where("fault is not null")
    return found.groupBy("job_id").agg(F.min(F.struct("at", "fault")).alias("f")).select("job_id", "f.at", "f.fault")


def word_faults(words: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """job_id, at, fault: the first word that breaks a rule, for jobs that have one."""
    rows = words if durations is None else words.join(durations.select("job_id", "duration"), "job_id", "left")
    before = F.lag("start").over(Window.partitionBy("job_id").orderBy("idx"))
    late = F.lit(False) if durations is None else F.col("end") > F.col("duration") + 1.0
    return _first(rows.withColumn("before", before), F.when(F.trim("text") == "", "text").when((F.col("start") < 0) | (F.col("end") < F.col("start")), "times").when(F.col("start") < F.col("before"), "order").when(late, "duration"), "idx")


def translation_faults(segments: DataFrame) -> DataFrame:
    """job_id, at, fault. segments: job_id, idx, source_text, text, start, end."""
    before = F.lag("end").over(Window.partitionBy("job_id").orderBy("idx"))
    return _first(segments.withColumn("before", before), F.when((F.trim("source_text") == "") | (F.trim("text") == ""), "text").when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "times").when(F.col("start") < F.col("before") - SLACK, "overlap"), "idx")


def cue_faults(cues: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """job_id, at, fault. cues: job_id, cue, start, end."""
    rows = cues if durations is None else cues.join(durations.select("job_id", "duration"), "job_id", "left")
    before = F.lag("end").over(Window.partitionBy("job_id").orderBy("cue"))
    late = F.lit(False) if durations is None else F.col("end") > F.col("duration") + SLACK
    return _first(rows.withColumn("before", before), F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "times").when(F.col("start") < F.col("before") - SLACK, "overlap").when(late, "duration"), "cue")


def registry_faults(models: DataFrame, archives: DataFrame) -> DataFrame:
    """kind, id, fault of registry rows. models: id, kind, revision, sha256, url; archives: backend, system, architecture,
    features, filename, url, sha256."""
    digest = lambda c: ~F.col(c).rlike("^[0-9a-f]{64}$")
    https = F.col("url").isNotNull() & ~F.col("url").startswith("https://")
    m = models.select(F.lit("model").alias("kind"), "id", F.when(F.count("*").over(Window.partitionBy("id")) > 1, "duplicate").when(~F.col("revision").rlike("^[0-9a-f]{40}$"), "revision").when(F.col("sha256").isNotNull() & digest("sha256"), "digest").when(https, "url").alias("fault"))
    unsafe = F.col("filename").isin("", ".", "..") | F.col("filename").rlike(r"[/\\]")
    profile = ["backend", "system", "architecture", "features"]
    a = archives.select(F.lit("archive").alias("kind"), F.col("filename").alias("id"), F.when(F.count("*").over(Window.partitionBy(*profile)) > 1, "duplicate").when(digest("sha256"), "digest").when(unsafe, "filename").when(https | F.col("url").isNull(), "url").alias("fault"))
    return m.unionByName(a).where("fault is not null")
