"""Names by content: hashes, ids, cached fingerprints, and registries matched by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.rules import FILES, bundled_library
from cuemill.functions.text import safe_stem

DIGEST = "^[0-9a-f]{64}$"
#: Edited files by key.
EDITED = {"edited.json": "transcript.edited.json", "edited.txt": "transcript.edited.txt", "edited.srt": "subtitles.edited.srt", "edited.vtt": "subtitles.edited.vtt"}


def json_text(text: Column) -> Column:
    """A JSON string in ASCII: letters beyond it as \\uXXXX, in surrogate pairs beyond 16 bits."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    # Marks that JSON names, control characters and non-ASCII units are written out; the rest are themselves.
    named = F.create_map(*[F.lit(x) for x in ("0022", '\\"', "005C", "\\\\", "000A", "\\n", "000D", "\\r", "0009", "\\t", "0008", "\\b", "000C", "\\f")])
    each = F.transform(units, lambda u: F.coalesce(named[u], F.when((u >= "0020") & (u <= "007E"), F.decode(F.unhex(F.substring(u, 3, 2)), "UTF-8")).otherwise(F.concat(F.lit("\\u"), F.lower(u)))))
    plain = text.rlike(r"\A[ !#-\[\]-~]*\z")
    return F.when(text.isNull(), "null").when(plain, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit('"'), F.array_join(each, ""), F.lit('"')))


def json_object(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; values are JSON texts."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]), F.lit("}"))


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def content_id(source_sha: Column, options: dict[str, Column]) -> Column:
    """A job's id: the hash of its source's hash and its options, which are JSON texts by name."""
    return F.sha2(json_object({"source": json_text(source_sha), "options": json_object(options)}), 256)


def path_identity(path: Column, size: Column, modified_ns: Column) -> Column:
    """JSON of a path as it is found: with its size and time, or as missing if there is no size."""
    there = json_object({"path": json_text(path), "size": json_number(size), "modified_ns": json_number(modified_ns)})
    return F.when(size.isNull(), json_object({"path": json_text(path), "missing": F.lit("true")})).otherwise(there)


def request_id(inputs: Column, options: dict[str, Column]) -> Column:
    """A request's id: the hash of its options, JSON texts by name, with the identities of its inputs in their order."""
    return F.sha2(json_object({**options, "inputs": F.concat(F.lit("["), F.array_join(inputs, ","), F.lit("]"))}), 256)


def mutation_key(path: Column, output: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("\0"), F.coalesce(output, F.lit("<default-output>"))), 256)


def path_id(path: Column) -> Column:
    return F.sha2(path, 256)


def job_folder(path: Column, job_id: Column) -> Column:
    return F.concat_ws("-", safe_stem(F.element_at(F.split(path, "/"), -1)), F.substring(job_id, 1, 10), F.substring(F.sha2(path, 256), 1, 8))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def known_hashes(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files with the cached sha256 of the same path, size and time, null where it must be made. Invalid entries miss."""
    good = cache.where(F.col("sha256").rlike(DIGEST)).select("path", "size", "mtime_ns", "sha256")
    return files.join(good, ["path", "size", "mtime_ns"], "left")


def kept_hashes(cache: DataFrame, most: int = 1000) -> DataFrame:
    """The newest entries; ties go by path."""
    return cache.orderBy(F.desc("recorded_ns"), "path").limit(most)


def hashed_files(files: DataFrame) -> DataFrame:
    """path, size, sha256 of rows of the binaryFile source."""
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def artifact_manifest(files: DataFrame) -> DataFrame:
    """job_id, artifacts: a map of key to path, size, sha256. files: job_id, name, size, sha256. Plain and edited files have
    fixed keys, translated ones are named by file, others are left out."""
    plain = {v: k for k, v in (FILES | EDITED).items()}
    key = F.coalesce(F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])[F.col("name")], F.when(F.col("name").rlike(r"^(translation\..*\.(json|txt)|subtitles\..*\.(srt|vtt))$"), F.col("name")))
    rows = files.select("job_id", key.alias("key"), F.struct(F.col("name").alias("path"), "size", "sha256").alias("value")).where("key is not null")
    return rows.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("artifacts"))


def valid_artifacts(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """recorded with valid: is the file there with the same size and hash? Both: path, size, sha256."""
    there = actual.select("path", F.col("size").alias("s2"), F.col("sha256").alias("h2"))
    return recorded.join(there, "path", "left").select(*recorded.columns, F.coalesce((F.col("size") == F.col("s2")) & (F.col("sha256") == F.col("h2")), F.lit(False)).alias("valid"))


def matching_archives(requests: DataFrame, archives: DataFrame) -> DataFrame:
    """request_id, matches, filename: archives for the same backend, system and machine with all the features asked for,
    and "asr". A filename is given if there is just one. requests: request_id, backend, system, architecture, features."""
    keys = ["backend", "system", "architecture"]
    wanted = requests.select("request_id", "backend", F.lower("system").alias("system"), F.lower("architecture").alias("architecture"), F.array_union("features", F.array(F.lit("asr"))).alias("wanted"))
    fits = wanted.join(archives.select(*keys, "filename", "features"), keys).where(F.size(F.array_except("wanted", "features")) == 0)
    counts = fits.groupBy("request_id").agg(F.count("*").alias("matches"), F.min("filename").alias("filename"))
    return requests.select("request_id").join(counts, "request_id", "left").select("request_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("filename")).alias("filename"))


def reusable(installed: DataFrame, registry: DataFrame) -> DataFrame:
    """Installed artifacts that the registry still names. Both: id, kind, sha256."""
    return installed.join(registry.select("id", "kind", "sha256"), ["id", "kind", "sha256"], "left_semi")


#: Libraries that an archive brings along, those of the host's driver, and what an archive without any is told.
REDISTRIBUTABLE = ("libcublas", "libcublasLt", "libcudart", "libcufft", "libcurand", "libcusolver", "libcusparse", "libnccl", "libnpp", "libnvJitLink", "libnvrtc", "libnvToolsExt")
HOST_DRIVER = ("libcuda.so.1", "libnvidia-ml.so.1")
NO_FILES = "archive contains no ELF runtime files"


def dependency_issues(edges: DataFrame, folder: str, host_driver: bool = False) -> DataFrame:
    """issues: sorted names of libraries that are missing, except those of the host's driver if it may be there, and of
    redistributable ones that are found outside the folder. An archive without files is an issue by itself.

    edges: file, name (null for a file that needs none), target.
    """
    missing = F.col("name").isNotNull() & F.col("target").isNull()
    if host_driver:
        missing = missing & ~F.col("name").isin(*HOST_DRIVER)
    outside = bundled_library(F.col("name"), list(REDISTRIBUTABLE)) & ~F.col("target").startswith(folder.rstrip("/") + "/")
    names = F.array_sort(F.collect_set(F.when(missing | outside, F.col("name"))))
    return edges.agg(F.when(F.count("file") == 0, F.array(F.lit(NO_FILES))).otherwise(names).alias("issues"))


def archive_rows(files: DataFrame) -> DataFrame:
    """filename, sha256, minimum_free_bytes: three times the archive, 512 MiB at least. files: filename, size, sha256."""
    return files.select("filename", "sha256", F.greatest(3 * F.col("size"), F.lit(512 * 1024 * 1024)).alias("minimum_free_bytes")).orderBy("filename")


def union_of(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def missing_from(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def one_root(paths: DataFrame) -> DataFrame:
    """ok: do all archive paths share their first part?"""
    return paths.agg((F.count_distinct(F.split("path", "/")[0]) == 1).alias("ok"))
