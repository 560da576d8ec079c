"""JSON documents as columns: recogniser output, media probes, manifests, translations, edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.rules import blank_to_null
from cuemill.functions.text import bind, join_tokens

#: The names under which recognisers give things, the first present one counting.
WORDS = ("words", "word_timestamps", "word_times", "tokens")
TEXT, START, END = ("word", "text", "token"), ("start", "start_time", "start_sec", "begin"), ("end", "end_time", "end_sec", "finish")
CONFIDENCE, SPEAKER = ("confidence", "probability", "score"), ("speaker", "speaker_tag", "speaker_id")
LANGUAGE, DOCUMENT_LANGUAGE, DOCUMENT_TEXT = ("language", "language_code"), ("language", "language_code", "detected_language"), ("text", "transcript", "transcription")

WORD = "struct<idx:int,text:string,start:double,end:double,confidence:double,speaker:string,language:string>"


def documents(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """path, doc (variant, null where it isn't JSON) of whole files below a folder, of one name if given."""
    reader = spark.read.option("recursiveFileLookup", True)
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))


def media_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, size, modified of media files below a folder, by lower-case path; contents aren't read. Spark leaves out
    files without a byte."""
    from cuemill.functions.rules import is_media

    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.where(is_media(F.col("path"))).dropDuplicates(["path"]).orderBy(F.lower("path"), "path")


def empty_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path of media files without a byte, which Spark's file sources leave out. The file system lists the folder to the
    driver, which keeps the empty ones alone."""
    from cuemill.functions.rules import is_media

    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, recursive), []
    while listed.hasNext():
        file = listed.next()
        if file.getLen() == 0:
            found.append((file.getPath().toString(),))
    return spark.createDataFrame(found, "path string").where(is_media(F.col("path")))


def discovered(spark: SparkSession, files: list[str], folders: list[str], recursive: bool = False) -> DataFrame:
    """path of the files that are named, whatever they are, and of media files in the folders, empty ones too; each once, by
    lower-case path. Nothing found is an error."""
    named = spark.createDataFrame([(f,) for f in files], "path string")
    for folder in folders:
        named = named.unionByName(media_files(spark, folder, recursive).select("path")).unionByName(empty_files(spark, folder, recursive))
    found = named.dropDuplicates(["path"]).orderBy(F.lower("path"), "path")
    if found.isEmpty():
        raise ValueError("no media files found")
    return found


def transcript_documents(docs: DataFrame) -> DataFrame:
    """path, text, duration, language, words, segments of canonical transcripts of version 1 (default). docs: path, doc."""
    v = F.col("doc")
    words = F.transform(F.try_variant_get(v, "$.words", "array<variant>"), lambda w, i: F.struct(i.alias("idx"), at(w, "text", "string").alias("text"), at(w, "start", "string").cast("double").alias("start"), at(w, "end", "string").cast("double").alias("end"), blank_to_null(at(w, "confidence", "string")).cast("double").alias("confidence"), at(w, "speaker", "string").alias("speaker"), blank_to_null(at(w, "language", "string")).alias("language")))
    segments = F.transform(F.try_variant_get(v, "$.segments", "array<variant>"), lambda w, i: F.struct(i.alias("cue"), at(w, "text", "string").alias("text"), at(w, "start", "string").cast("double").alias("start"), at(w, "end", "string").cast("double").alias("end"), at(w, "speaker", "string").alias("speaker"), F.coalesce(at(w, "word_start", "int"), F.lit(0)).alias("word_start"), F.coalesce(at(w, "word_end", "int"), F.lit(0)).alias("word_end")))
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    return docs.where(is_object(v) & (F.coalesce(F.try_variant_get(v, "$.schema_version", "int"), F.lit(1)) == 1)).select("path", F.coalesce(text("text"), F.lit("")).alias("text"), blank_to_null(text("duration")).cast("double").alias("duration"), blank_to_null(text("language")).alias("language"), F.coalesce(words, F.array()).alias("words"), F.coalesce(segments, F.array()).alias("segments"))


def translation_documents(docs: DataFrame) -> DataFrame:
    """path, source_language, target_language, segments of translations of version 1. docs: path, doc."""
    v = F.col("doc")
    segments = F.transform(F.try_variant_get(v, "$.segments", "array<variant>"), lambda w, i: F.struct(i.alias("idx"), at(w, "source_text", "string").alias("source_text"), at(w, "text", "string").alias("text"), at(w, "start", "string").cast("double").alias("start"), at(w, "end", "string").cast("double").alias("end"), at(w, "speaker", "string").alias("speaker")))
    return docs.where(is_object(v) & (F.coalesce(F.try_variant_get(v, "$.schema_version", "int"), F.lit(1)) == 1)).select("path", at(v, "source_language", "string").alias("source_language"), at(v, "target_language", "string").alias("target_language"), segments.alias("segments"))


def refused_manifests(docs: DataFrame) -> DataFrame:
    """path, fault of manifests that work must not resume from: unreadable ones, and those of another version."""
    version = F.try_variant_get("doc", "$.schema_version", "int")
    return docs.select("path", F.when(~is_object(F.col("doc")) | F.col("doc").isNull(), "unreadable").when(~version.eqNullSafe(F.lit(1)), "version").alias("fault")).where("fault is not null")


def is_object(v: Column) -> Column:
    """Only an object can be read as a struct; the names of its own fields are looked at, not what they hold."""
    return F.try_variant_get(v, "$", "struct<`_`:boolean>").isNotNull()


def at(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def first_of(v: Column, names: tuple[str, ...], kind: str = "string") -> Column:
    """The first of the names that is there and not null; the empty string counts."""
    return F.coalesce(*[at(v, n, kind) for n in names])


def _deeper(v: Column) -> Column:
    """Where the search for the result goes on: inside "result", else in the last of "results"; null where it ends."""
    object_or_null = lambda x: bind(x, lambda y: F.when(is_object(y), y))
    last = F.try_element_at(at(v, "results", "array<variant>"), F.lit(-1))
    return F.coalesce(object_or_null(at(v, "result")), object_or_null(last))


def container(v: Column, steps: Column) -> Column:
    """Where the result is: inside "result", else the last of "results", again and again, then the first of "alternatives".
    steps: how often the search can go on, at most."""
    found = bind(steps, lambda n: F.when(n == 0, v).otherwise(F.aggregate(F.sequence(F.lit(1), n), v, lambda x, _: F.coalesce(_deeper(x), x))))
    first = F.get(at(found, "alternatives", "array<variant>"), F.lit(0))
    return bind(F.struct(found.alias("v"), first.alias("first")), lambda x: F.when(is_object(x["first"]), x["first"]).otherwise(x["v"]))


def _steps(payload: Column) -> Column:
    """No search goes on oftener than the text has a key that begins with result, or an escape that may spell one."""
    return F.regexp_count(payload, F.lit(r'"result|\\u'))


def _nested(payload: Column) -> Column:
    """Whether the result may be inside the document: else it is the document itself, which needn't be read a second time."""
    return payload.rlike(r'"result|"alternatives|\\u')


def items_of(v: Column, path: str, **kinds: str) -> Column:
    """The list at a path, its objects as structs of the fields that are named: all are read in one pass over the list, and not
    one by one for each. What isn't an object is null."""
    return F.try_variant_get(v, f"$.{path}", f"array<struct<{','.join(f'`{n}`:{kind}' for n, kind in kinds.items())}>>")


def rows_of(name: str) -> Column:
    """A column's list, to be exploded. Of a bare column Spark would first ask whether the list is empty, with all of the reading
    that made it put into that question again, at every place where it is used."""
    return F.filter(name, lambda _: F.lit(True))


def word_list(v: Column) -> Column:
    """The first list of objects under a known name, with their fields as text. An empty list counts, and hides those after it."""
    fields = {n: "string" for names in (TEXT, START, END, CONFIDENCE, SPEAKER, LANGUAGE) for n in names}
    objects = lambda x: F.when(F.forall(x, lambda w: w.isNotNull()), x)
    return F.coalesce(*[bind(items_of(v, path, **fields), objects) for path in (*WORDS, "words_info.words")])


def _words(items: Column) -> Column:
    first = lambda w, names: F.coalesce(*[w[n] for n in names])
    number = lambda w, names: first(w, names).cast("double")
    return F.transform(items, lambda w, i: F.struct(i.alias("idx"), F.trim(first(w, TEXT)).alias("text"), number(w, START).alias("start"), number(w, END).alias("end"), number(w, CONFIDENCE).alias("confidence"), first(w, SPEAKER).alias("speaker"), blank_to_null(first(w, LANGUAGE)).alias("language")))


def transcripts(raw: DataFrame) -> DataFrame:
    """job_id, text, language, duration, words, fault of recogniser output. raw: job_id, payload (JSON text), duration.

    fault is null, or says what is missing: an object, words, or a word's text or times. Values of the wrong kind fail the
    query, as they do where they come from.
    """
    # What is said of the whole document, read in one pass; null where it isn't an object.
    said = lambda v: F.try_variant_get(v, "$", f"struct<{','.join(f'{n}:string' for n in dict.fromkeys(DOCUMENT_TEXT + DOCUMENT_LANGUAGE))}>")
    first = lambda names: F.coalesce(*[F.col(v)[n] for v in ("c_said", "p_said") for n in names])
    filled = lambda v, names: bind(F.coalesce(*[F.col(v)[n] for n in names]), blank_to_null)
    parsed = raw.select("job_id", "duration", "payload", F.try_parse_json("payload").alias("p")).withColumn("p_said", said(F.col("p")))
    whole = parsed.withColumn("c", F.when(F.col("p_said").isNotNull() & _nested(F.col("payload")), container(F.col("p"), _steps(F.col("payload")))))
    found = whole.withColumns({"c_said": said(F.col("c")), "items": F.coalesce(word_list(F.col("c")), word_list(F.col("p")))})
    words = found.withColumn("words", _words(F.col("items")))
    fault = F.when(F.col("p_said").isNull(), "object").when(F.coalesce(F.size("items"), F.lit(0)) < 1, "words").when(F.exists("words", lambda w: w["text"].isNull() | w["start"].isNull() | w["end"].isNull()), "word")
    text = F.coalesce(filled("c_said", DOCUMENT_TEXT), filled("p_said", DOCUMENT_TEXT), join_tokens(F.transform("words", lambda w: w["text"])))
    return words.select("job_id", F.trim(text).alias("text"), blank_to_null(first(DOCUMENT_LANGUAGE)).alias("language"), "duration", "words", fault.alias("fault"))


def printed_json(stdout: Column) -> Column:
    """The JSON that a tool printed: all of it, else its last line that is JSON."""
    lines = F.transform(F.split(stdout, r"\r\n|\r|\n"), lambda x: F.try_parse_json(x))
    return F.coalesce(F.try_parse_json(F.trim(stdout)), F.try_element_at(F.filter(lines, lambda x: x.isNotNull()), F.lit(-1)))


def probes(raw: DataFrame) -> DataFrame:
    """path, duration, streams (index, codec, sample_rate, channels of audio ones). raw: path, payload."""
    v = F.try_parse_json("payload")
    streams = F.filter(F.try_variant_get(v, "$.streams", "array<variant>"), lambda s: at(s, "codec_type", "string") == "audio")
    made = F.transform(streams, lambda s: F.struct(at(s, "index", "int").alias("index"), F.coalesce(at(s, "codec_name", "string"), F.lit("unknown")).alias("codec"), blank_to_null(at(s, "sample_rate", "string")).cast("int").alias("sample_rate"), blank_to_null(at(s, "channels", "string")).cast("int").alias("channels")))
    return raw.select("path", blank_to_null(F.try_variant_get(v, "$.format.duration", "string")).cast("double").alias("duration"), made.alias("streams"))


def manifests(docs: DataFrame) -> DataFrame:
    """One row per readable manifest of version 1, typed; docs: path, doc."""
    v = F.col("doc")
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    state = F.coalesce(text("state"), F.lit("unknown"))
    return docs.where(is_object(v) & (F.try_variant_get(v, "$.schema_version", "int") == 1)).select(
        "path", text("job_id").alias("job_id"), state.alias("state"), F.coalesce(text("state_detail"), state).alias("state_detail"), text("created_at").alias("created_at"), text("updated_at").alias("updated_at"), text("source.path").alias("source_path"), text("error.message").alias("error"),
        F.try_variant_get(v, "$.media.duration", "double").alias("media_seconds"), F.try_variant_get(v, "$.timings", "map<string,double>").alias("timings"), F.try_variant_get(v, "$.warnings", "array<string>").alias("warnings"), F.try_variant_get(v, "$.artifacts", "map<string,variant>").alias("artifacts"),
    )


def manifest_artifacts(rows: DataFrame) -> DataFrame:
    """path, name, file, size, sha256: the artifacts of manifests() that are objects."""
    return rows.select("path", F.explode("artifacts").alias("name", "v")).where(is_object(F.col("v"))).select("path", "name", at(F.col("v"), "path", "string").alias("file"), at(F.col("v"), "size", "bigint").alias("size"), at(F.col("v"), "sha256", "string").alias("sha256"))


def edit_documents(docs: DataFrame) -> DataFrame:
    """path, schema_version, source_sha, edited_indices, segments (index, text). docs: path, doc."""
    v = F.col("doc")
    segments = F.transform(F.try_variant_get(v, "$.segments", "array<variant>"), lambda s: F.struct(at(s, "index", "int").alias("index"), at(s, "text", "string").alias("text")))
    return docs.where(is_object(v)).select("path", F.try_variant_get(v, "$.schema_version", "int").alias("schema_version"), F.try_variant_get(v, "$.source_transcript_sha256", "string").alias("source_sha"), F.try_variant_get(v, "$.edited_indices", "array<int>").alias("edited_indices"), segments.alias("segments"))


def translation_batch(raw: DataFrame) -> DataFrame:
    """ordinal, text: a translator's list of objects, in order. raw: payload (one row a batch, with its first ordinal)."""
    items = F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>")
    return raw.select("first", F.posexplode(items).alias("i", "v")).select((F.col("first") + F.col("i")).alias("ordinal"), at(F.col("v"), "text", "string").alias("text"))


def cached_hashes(docs: DataFrame, version: int = 1) -> DataFrame:
    """path, size, mtime_ns, sha256, recorded_ns of a fingerprint document; none of another version. docs: doc."""
    entries = F.explode(F.try_variant_get("doc", "$.entries", "map<string,variant>"))
    rows = docs.where(F.try_variant_get("doc", "$.version", "int") == version).select(entries.alias("path", "v"))
    made = rows.select("path", at(F.col("v"), "size", "bigint").alias("size"), at(F.col("v"), "mtime_ns", "bigint").alias("mtime_ns"), at(F.col("v"), "sha256", "string").alias("sha256"), at(F.col("v"), "recorded_ns", "bigint").alias("recorded_ns"))
    return made.dropna()


def recognised(audio: DataFrame, adapter, schema: str = "job_id string, payload string, duration double") -> DataFrame:
    """Recogniser output by an adapter over partitions: a function from an iterator of pandas frames to one. A model is
    loaded once a partition. audio: what the adapter reads."""
    return audio.mapInPandas(adapter, schema)


MODEL = ("id", "kind", "upstream_id", "revision", "filename", "sha256", "url", "install_script", "license")
ARCHIVE = ("backend", "system", "architecture", "filename", "url", "sha256")
RUNTIME = ("id", "repository", "revision", "build_script", "executable", "license")


def _fields(v: Column, names: tuple[str, ...]) -> list[Column]:
    return [at(v, n, "string").alias(n) for n in names]


def registry(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """runtimes, models and archives of registry documents of version 1, each with the document's path, as
    validate.registry_faults() takes them. docs: path, doc."""
    rows = docs.where(is_object(F.col("doc")) & (F.try_variant_get("doc", "$.schema_version", "int") == 1))
    listed = lambda v, n: F.coalesce(F.try_variant_get(v, f"$.{n}", "array<string>"), F.array().cast("array<string>"))
    runtime = rows.select("path", at(F.col("doc"), "runtime").alias("v"))
    runtimes = runtime.select("path", *_fields(F.col("v"), RUNTIME), *[listed(F.col("v"), n).alias(n) for n in ("backends", "features")])
    models = rows.select("path", F.explode(F.try_variant_get("doc", "$.models", "array<variant>")).alias("v")).select("path", *_fields(F.col("v"), MODEL), at(F.col("v"), "minimum_free_bytes", "bigint").alias("minimum_free_bytes"))
    archives = runtime.select("path", F.explode(F.try_variant_get("v", "$.archives", "array<variant>")).alias("v")).select("path", *_fields(F.col("v"), ARCHIVE), F.array_sort(listed(F.col("v"), "features")).alias("features"), at(F.col("v"), "minimum_free_bytes", "bigint").alias("minimum_free_bytes"))
    return runtimes, models, archives


def unread_registries(docs: DataFrame) -> DataFrame:
    """path, fault of registry documents that nothing can be installed from: unreadable, of another version, incomplete."""
    v = F.col("doc")
    whole = lambda x, names: reduce(lambda a, n: a & at(x, n, "string").isNotNull(), names, F.lit(True))
    models = F.try_variant_get(v, "$.models", "array<variant>")
    # A model may have no digest and no address of its own.
    complete = whole(at(v, "runtime"), RUNTIME) & models.isNotNull() & F.forall(models, lambda m: whole(m, tuple(n for n in MODEL if n not in ("sha256", "url"))))
    fault = F.when(v.isNull() | ~is_object(v), "unreadable").when(~F.try_variant_get(v, "$.schema_version", "int").eqNullSafe(F.lit(1)), "version").when(~F.coalesce(complete, F.lit(False)), "incomplete")
    return docs.select("path", fault.alias("fault")).where("fault IS NOT NULL")


def uneven_batches(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """first, asked, answered of batches whose answer hasn't a line for each line asked for. asked: first, lines; answered:
    first, payload (JSON, null where there is none)."""
    size = F.size(F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>"))
    both = asked.join(answered.select("first", F.coalesce(size, F.lit(-1)).alias("answered")), "first", "left")
    return both.select("first", F.col("lines").alias("asked"), F.greatest(F.coalesce("answered", F.lit(-1)), F.lit(-1)).alias("answered")).where("asked <> answered")


def batch_results(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, payload, duration: what transcripts() takes, of a batch that wrote <stem>.json for each input. A job without a
    file has a null payload. docs: path, value (text); jobs: stem, job_id, duration."""
    name = F.substring_index("path", "/", -1)
    found = docs.where(name.endswith(".json")).select(F.left(name, F.length(name) - 5).alias("stem"), F.col("value").alias("payload"))
    return jobs.join(found, "stem", "left").select("job_id", "payload", "duration")


STATE = ("backend", "config_path", "created_at", "updated_at", "installer_version")
INSTALLED = ("id", "kind", "path", "revision", "sha256", "source", "license")


def install_states(docs: DataFrame) -> DataFrame:
    """path, STATE, features, completed_stages, retained_cache, and artifacts: the runtime, then the models. docs: path, doc of
    install states of version 1; what refused_install_states() names isn't read."""
    v = F.col("doc")
    listed = lambda n: F.coalesce(F.try_variant_get(v, f"$.{n}", "array<string>"), F.array().cast("array<string>"))
    runtime = F.filter(F.array(at(v, "runtime")), is_object)
    models = F.coalesce(F.try_variant_get(v, "$.models", "array<variant>"), F.array().cast("array<variant>"))
    made = F.transform(F.concat(runtime, models), lambda a: F.struct(*_fields(a, INSTALLED), at(a, "size", "bigint").alias("size")))
    good = docs.join(refused_install_states(docs).select("path"), "path", "left_anti")
    return good.select("path", *_fields(v, STATE), *[listed(n).alias(n) for n in ("features", "completed_stages", "retained_cache")], made.alias("artifacts"))


def refused_install_states(docs: DataFrame) -> DataFrame:
    """path, fault of install states that can't be used: unreadable, of another version, incomplete."""
    v = F.col("doc")
    complete = reduce(lambda a, n: a & at(v, n, "string").isNotNull(), STATE, F.lit(True))
    fault = F.when(v.isNull() | ~is_object(v), "unreadable").when(~F.try_variant_get(v, "$.schema_version", "int").eqNullSafe(F.lit(1)), "version").when(~complete, "incomplete")
    return docs.select("path", fault.alias("fault")).where("fault IS NOT NULL")
