"""Steps of a job as tables: what is committed, what an edit writes, how sources end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.rules import FORMATS
from cuemill.operators.cues import build_cues, render_segments, render_srt, render_vtt
from cuemill.operators.edits import edit_faults, edit_summary, merged_edits, overlay

#: Languages that the recogniser and the translator know.
ASR_LANGUAGES = ("bg", "cs", "da", "de", "el", "en", "es", "et", "fi", "fr", "hr", "hu", "it", "lt", "lv", "mt", "nl", "pl", "pt", "ro", "ru", "sk", "sl", "sv", "uk")
TRANSLATION_LANGUAGES = ("ar", "bg", "cs", "da", "de", "el", "en", "es-es", "es-us", "et", "fi", "fr", "hi", "hr", "hu", "id", "it", "ja", "ko", "lt", "lv", "nl", "no", "pl", "pt-br", "pt-pt", "ro", "ru", "sk", "sl", "sv", "th", "tr", "uk", "vi", "zh-cn", "zh-tw")
FEATURES = ("transcription", "translation", "diarization")


def committed(transcripts: DataFrame, words: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transcripts with provenance that names the source and the models, and their cues.

    transcripts: job_id, text, duration, provenance (map of text); identities: job_id, source_sha, model_sha, diar_sha.
    """
    known = F.map_filter(F.create_map(F.lit("source_sha256"), F.col("source_sha"), F.lit("model_sha256"), F.col("model_sha"), F.lit("diar_model_sha256"), F.col("diar_sha")), lambda _, v: v.isNotNull())
    # A later entry replaces an earlier one.
    old = F.map_filter("provenance", lambda k, _: ~F.map_contains_key(known, k))
    rows = transcripts.join(identities, "job_id").withColumn("provenance", F.map_concat(old, known)).drop("source_sha", "model_sha", "diar_sha")
    return rows, build_cues(words, transcripts.select("job_id", "duration"))


def saved_edits(segments: DataFrame, earlier: DataFrame, later: DataFrame, formats: tuple[str, ...] = FORMATS, merge: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """faults, summary and files (job_id, name, content) of saving edits. Jobs with a fault save nothing; jobs with no edit
    left have no files: theirs are to be removed. segments: job_id, idx, text, start, end, speaker."""
    faults = edit_faults(later, segments)
    good = later.join(faults.select("job_id").distinct(), "job_id", "left_anti")
    held = merged_edits(earlier, good, merge)
    touched = held.join(good.select("job_id").distinct(), "job_id", "left_semi")
    changed = overlay(segments.join(touched.select("job_id").distinct(), "job_id", "left_semi"), touched)
    cues = changed.withColumnRenamed("idx", "cue")
    made = {"txt": ("transcript.edited.txt", render_segments), "srt": ("subtitles.edited.srt", render_srt), "vtt": ("subtitles.edited.vtt", render_vtt)}
    one = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.array_sort(F.collect_list(F.when(F.col("edited"), F.col("idx")))).alias("edited_indices"), F.array_sort(F.collect_list(F.struct(F.col("idx").alias("index"), "text", "start", "end", "speaker"))).alias("segments")), {"ignoreNullFields": "false"})
    files = changed.groupBy("job_id").agg(one.alias("content")).select("job_id", F.lit("transcript.edited.json").alias("name"), "content")
    for f in formats:
        if f in made:
            files = files.unionByName(made[f][1](cues).select("job_id", F.lit(made[f][0]).alias("name"), "content"))
    return faults, edit_summary(touched), files


def ended(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Each source with how it ended: its result's state, cancelled if it was asked to stop before, interrupted if neither.

    sources: job_id, pos, source, stopped; results: job_id, source, state, error.
    """
    joined = sources.join(results.select("job_id", "source", "state", "error"), ["job_id", "source"], "left")
    state = F.coalesce("state", F.when(F.col("stopped"), "cancelled").otherwise("interrupted"))
    return joined.select("job_id", "pos", "source", state.alias("state"), "error")


def later_wins(*tables: DataFrame, key: str = "source") -> DataFrame:
    """Rows of all tables; of one key that of the last table counts."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.select(key), key, "left_anti").unionByName(t)
    return out


def job_rows(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs as clients see them: names without folders, results nested in order. jobs: id, state, inputs; results: job_id,
    pos, source, state, error."""
    name = lambda p: F.element_at(F.split(p, "/"), -1)
    nested = results.groupBy(F.col("job_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", name(F.col("source")).alias("source"), "state", "error"))), lambda r: r.dropFields("pos")).alias("results"))
    return jobs.join(nested, "id", "left").select("id", "state", F.transform("inputs", name).alias("inputs"), F.coalesce("results", F.array()).alias("results"))


def capabilities(hosts: DataFrame) -> DataFrame:
    """host, kind, value: formats, languages and features of each host. hosts: host, transcription, translation, diarization
    (booleans). Languages to translate into are only told where there is a translator."""
    each = lambda kind, values: F.transform(F.array(*[F.lit(x) for x in values]), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    on = F.filter(F.array(*[F.when(F.col(f), F.struct(F.lit("feature").alias("kind"), F.lit(f).alias("value"))) for f in FEATURES]), lambda x: x.isNotNull())
    told = F.concat(each("format", FORMATS), each("asr_language", ASR_LANGUAGES), F.when(F.col("translation"), each("translation_language", TRANSLATION_LANGUAGES)).otherwise(F.array().cast("array<struct<kind:string,value:string>>")), on)
    return hosts.select("host", F.inline(told))


def checks(spark: SparkSession, probes: dict[str, tuple[str, str]]) -> DataFrame:
    """name, status, message of what the host was asked."""
    return spark.createDataFrame([(k, *v) for k, v in probes.items()], "name string, status string, message string")


def benchmark_ok(results: DataFrame, device: str) -> DataFrame:
    """run, ok: just one result, completed, made and without error, on the device. results: run, state, skipped, error,
    device."""
    good: Column = (F.col("state") == "completed") & ~F.col("skipped") & F.col("error").isNull() & (F.col("device") == device)
    return results.groupBy("run").agg(((F.count("*") == 1) & F.bool_and(F.coalesce(good, F.lit(False)))).alias("ok"))
