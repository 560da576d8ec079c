"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters that are none of these.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a local session may lack one, as in tests, and gets a new one:
    elsewhere executors and the driver would each see their own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cuemill-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def stage_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cuemill-{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Deletes what this application has staged; results that still read it are to be written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, gather: bool = False) -> DataFrame:
    """df, written as a table to the shared folder and read again: lineage ends there and a lost executor loses nothing.

    An application's tables lie in one folder, which may go when it has ended, or earlier by drop_staged(). gather: rows are
    few or small beside what they are made from, so they are first moved to fewer tasks and don't leave many small files.
    """
    df = df.hint("rebalance") if gather else df
    path = f"{stage_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: they go when the write ends, not when the driver next cleans up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(df: DataFrame, size: int = 16 << 20) -> DataFrame:
    """df; from now on its session sends rows to Python in batches of about size bytes, however long they are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def unused(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def text_key(doc_id: Column, text: Column) -> Column:
    """A key for rows whose doc_id may be null or repeated: rows that share it are the same document with the same text."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def running_sums(lengths: Column, block: int = 64) -> Column:
    """Sums of all earlier elements, for each element of a bigint array: sums of whole blocks, then of the rest of one block."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / block).cast("int")), lambda b: total(F.slice(a, b * block + 1, block)))
    before = lambda s: F.transform(s, lambda _, i: total(F.slice(s, F.lit(1), i)))
    return let(lengths, lambda a: let(let(blocks(a), before), lambda base: F.transform(a, lambda _, i: F.get(base, F.floor(i / block).cast("int")) + total(F.slice(a, F.floor(i / block).cast("int") * block + 1, i % block)))))


def matches_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches, as structs (start, end, text) in code points. Texts without any match cost one search."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("len"), m.alias("text")))
        return let(steps, lambda s: let(running_sums(F.transform(s, lambda x: x["gap"] + x["len"])), lambda at: F.zip_with(s, at, lambda x, a: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + x["len"]).alias("end"), x["text"].alias("text")))))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def written(spans: Column) -> Column:
    """kind:start:end of structs (start, rank, kind, end), by start and then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ranked(spans: Column, kind: str, rank: int) -> Column:
    """matches_of() as the structs that written() takes."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
