"""Bytes on disk by job, and which folders may go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folders_above(path, itself: bool = True):
    """A path's ancestors, as an array, with the path itself."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return up if itself else F.slice(up, F.lit(1), F.size(up) - 1)


def folder_bytes(files: DataFrame, folders: DataFrame) -> DataFrame:
    """path, bytes of each folder with all below it; symbolic links don't count. files: path, size, is_symlink.

    A file belongs to each of its ancestors: joined by equality of paths, not by prefix.
    """
    owned = files.where(~F.col("is_symlink")).select("size", F.explode(folders_above(F.col("path"), itself=False)).alias("path"))
    sums = owned.groupBy("path").agg(F.sum("size").alias("bytes"))
    return folders.select("path").distinct().join(sums, "path", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def counted_folders(folders: DataFrame) -> DataFrame:
    """The folders whose bytes count: not those equal to or below one that was listed earlier. folders: job_id, kind, rank
    (order of listing), path."""
    first = folders.groupBy("path").agg(F.min("rank").alias("seen"))
    above = folders.select("job_id", "kind", "rank", "path", F.explode(folders_above(F.col("path"))).alias("upper"))
    hidden = above.join(first.select(F.col("path").alias("upper"), "seen"), "upper").where(F.col("seen") < F.col("rank")).select("rank").distinct()
    return folders.join(hidden, "rank", "left_anti")


def storage_report(jobs: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """id, upload_bytes, output_bytes, total_bytes, share: largest first, then in the order of jobs.

    jobs: id, pos (newest first); folders: job_id, kind (upload or output), pos, path. A folder that several list counts for
    the newest job, uploads before outputs.
    """
    ranked = folders.join(jobs.select(F.col("id").alias("job_id"), F.col("pos").alias("job_pos")), "job_id").select("job_id", "kind", "path", F.struct("job_pos", F.when(F.col("kind") == "upload", 0).otherwise(1).alias("k"), "pos", "path").alias("rank"))
    kept = counted_folders(ranked)
    sums = kept.join(folder_bytes(files, folders), "path").groupBy("job_id").agg(F.coalesce(F.sum(F.when(F.col("kind") == "upload", F.col("bytes"))), F.lit(0)).alias("upload_bytes"), F.coalesce(F.sum(F.when(F.col("kind") == "output", F.col("bytes"))), F.lit(0)).alias("output_bytes"))
    rows = jobs.select("id", "pos").join(sums.withColumnRenamed("job_id", "id"), "id", "left").select("id", "pos", F.coalesce("upload_bytes", F.lit(0)).alias("upload_bytes"), F.coalesce("output_bytes", F.lit(0)).alias("output_bytes")).withColumn("total_bytes", F.col("upload_bytes") + F.col("output_bytes"))
    total = rows.agg(F.sum("total_bytes").alias("all"))  # one row
    shared = rows.join(F.broadcast(total), F.lit(True)).withColumn("share", F.coalesce(F.bround(F.try_divide(F.col("total_bytes").cast("double"), F.col("all").cast("double")), 4), F.lit(0.0)))
    return shared.orderBy(F.desc("total_bytes"), "pos").select("id", "upload_bytes", "output_bytes", "total_bytes", "share")


def storage_totals(report: DataFrame) -> DataFrame:
    """One row: total_bytes, upload_bytes, output_bytes over all jobs of storage_report()."""
    return report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_bytes", "upload_bytes", "output_bytes")])


def retained_caches(folders: DataFrame, files: DataFrame) -> DataFrame:
    """path: the folders that hold anything. Both: path."""
    held = files.select(F.explode(folders_above(F.col("path"), itself=False)).alias("path")).distinct()
    return folders.select("path").distinct().join(held, "path", "left_semi")


def removable(folders: DataFrame, job_id: str) -> DataFrame:
    """path: folders of a job that no other job uses. folders: job_id, path."""
    mine, others = folders.where(F.col("job_id") == job_id), folders.where(F.col("job_id") != job_id)
    return mine.select("path").distinct().join(others.select("path"), "path", "left_anti")


def stale_uploads(found: DataFrame, kept: DataFrame) -> DataFrame:
    return found.join(kept, "path", "left_anti")


def running_total(parts: DataFrame, limit: int) -> DataFrame:
    """parts with total so far and whether it is over the limit. parts: upload_id, seq, size."""
    from pyspark.sql import Window

    so_far = F.sum("size").over(Window.partitionBy("upload_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("total", so_far).withColumn("over", F.col("total") > limit)


def added_files(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming media files that aren't listed, the first of equal ones. Both: pos, name, size, modified."""
    from pyspark.sql import Window

    from cuemill.functions.rules import is_media

    key = ["name", "size", "modified"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("pos"))
    return incoming.where(is_media(F.col("name"))).withColumn("__n", first).where("__n = 1").drop("__n").join(current.select(*key), key, "left_anti")
