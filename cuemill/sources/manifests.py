"""Manifests as files: canonical JSON, and recovery that rewrites only what it changes."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cuemill.operators import jobs
from cuemill.sources import ingest

NAME = "manifest.json"


def _written(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _written(json.loads(t)))


@F.pandas_udf(StringType())
def _interrupted(texts: pd.Series, now: pd.Series) -> pd.Series:
    return pd.Series([_written(json.loads(t) | {"state": "interrupted", "updated_at": at}) for t, at in zip(texts, now, strict=True)], dtype=object)


def canonical_json(value: Column) -> Column:
    """A document as it is written to files: keys sorted at every depth, two spaces a level, characters as they are, a line
    feed at the end. value: JSON text, or a variant by to_json(), which writes 1.0 as 1. Null stays null; text that isn't JSON is
    an error."""
    return _canonical(value)


def recover(spark: SparkSession, root: str, now: str | None = None, staging: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The jobs that manifests below a folder tell of, and an event for each; manifests of work in progress are rewritten as
    interrupted, others aren't touched.

    What changes is first written whole to a staging folder, then put in place file by file, each by one rename. Staging is
    there until all is in place: recover() with the same folder finishes what an earlier call began, and a manifest that is
    interrupted already isn't work in progress, so nothing is done twice.
    """
    now = now or datetime.now(UTC).isoformat()
    staging = staging or f"{root.rstrip('/')}/.recovery-{uuid.uuid4().hex}"
    if not _there(spark, f"{staging}/_SUCCESS"):
        found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", NAME).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
        working = found.where(ingest.at(F.try_parse_json("value"), "state", "string") == "processing")
        working.select("path", _interrupted("value", F.lit(now)).alias("content")).write.mode("overwrite").parquet(staging)
    _publish(spark, spark.read.schema("path string, content string").parquet(staging))
    _path(spark, staging)[0].delete(_path(spark, staging)[1], True)
    rows = jobs.recovered(ingest.manifests(ingest.documents(spark, root, NAME)))
    return rows, jobs.recovery_events(rows)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _there(spark: SparkSession, name: str) -> bool:
    files, path = _path(spark, name)
    return files.exists(path)


def _publish(spark: SparkSession, rows: DataFrame) -> None:
    """Files with these contents, each written beside its place and renamed over it. Rows come a partition at a time; they
    are the jobs that were at work when the last run ended."""
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    for r in rows.toLocalIterator():
        files, path = _path(spark, r["path"])
        beside = path.suffix(".new")
        out = files.create(beside, True)
        out.write(bytearray(r["content"].encode()))
        out.close()
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, path, overwrite)
