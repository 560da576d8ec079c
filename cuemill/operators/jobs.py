"""Jobs: lists, outcomes, learned speeds, recovery, results and their artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.rules import ENDED, setup_end
from cuemill.operators.ordinals import medians

NEWEST, HISTORY = 5, 1000
#: Fixed value: what is said of a job that only its manifest tells of.
RECOVERED = "Recovered from manifest"


def listed(jobs: DataFrame, offset: int = 0, limit: int = 100, state: str | None = None) -> DataFrame:
    """A page of jobs, newest first (by text of the time, then id). jobs: id, state, submitted_at."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative and limit must be positive")
    rows = jobs if state is None else jobs.where(F.col("state") == state)
    return rows.orderBy(F.desc("submitted_at"), F.desc("id")).offset(offset).limit(limit)


def counted(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("n"))


def page_offset(offset: int, rows: int, total: int, step: int = 20) -> int:
    """Where a page starts: one back if it turned out empty."""
    return max(0, offset - step) if rows == 0 and offset > 0 and total > 0 else offset


def outcomes(results: DataFrame) -> DataFrame:
    """job_id, state, error: cancelled beats failed beats completed; the first error by position. results: job_id, pos,
    state, error."""
    wrong = F.col("error").isNotNull() & (F.col("error") != "")
    state = F.when(F.bool_or(F.col("state") == "cancelled"), "cancelled").when(F.bool_or(wrong), "failed").otherwise("completed")
    return results.groupBy("job_id").agg(state.alias("state"), F.min_by("error", F.when(wrong, F.col("pos"))).alias("error"))


def speed(media: Column, timings: Column) -> Column:
    """Media seconds a second of work; of a batch, by its share. Null unless finite and positive. timings: a map; a key that
    is there decides, even without a value."""
    own = F.map_contains_key(timings, F.lit("inference_seconds"))
    work = F.when(own, timings["inference_seconds"]).otherwise(F.try_divide(timings["batch_inference_seconds"], timings["batch_size"]))
    x = F.try_divide(media, work)
    return F.when((x > 0) & (x < float("inf")) & ~F.isnan(x), x)


def rounded(x: Column, digits: int) -> Column:
    """Half-even on the decimal text of a double; ties that the binary value breaks otherwise aren't told apart."""
    return F.bround(x, digits)


def median_speed(samples: DataFrame) -> DataFrame:
    """One row: the median of the newest samples by (updated_at, value). samples: updated_at, value."""
    return samples.where("value is not null").orderBy(F.desc("updated_at"), F.desc("value")).limit(NEWEST).agg(F.median("value").alias("speed"))


def estimates(events: DataFrame, samples: DataFrame) -> DataFrame:
    """events with estimated_seconds, where transcribing starts on media of known length. events: stage, status,
    media_seconds."""
    fits = (F.col("stage") == "transcribing") & (F.col("status") == "started") & (F.col("media_seconds") > 0)
    est = F.when(fits & F.col("speed").isNotNull(), F.greatest(F.lit(0.1), rounded(F.col("media_seconds") / F.col("speed"), 1)))
    return events.join(F.broadcast(median_speed(samples)), F.lit(True), "left").select(*events.columns, est.alias("estimated_seconds"))  # one row


def recovered(manifests: DataFrame) -> DataFrame:
    """id, state, source, inputs, job_dir, error, submitted_at, started_at, finished_at: the jobs that manifests tell of. Work
    in progress was interrupted; what has no end isn't listed; of manifests of one job the first path counts. manifests: path,
    job_id, state, source_path, error, created_at, updated_at."""
    state = F.when(F.col("state") == "processing", "interrupted").otherwise(F.coalesce("state", F.lit("unknown")))
    rows = manifests.withColumn("state", state).where(F.col("state").isin(*ENDED))
    key = F.coalesce(F.nullif("job_id", F.lit("")), F.sha2("path", 256))
    source = F.nullif("source_path", F.lit(""))
    inputs = F.filter(F.array(source), lambda x: x.isNotNull())
    named = rows.select(key.alias("id"), "path", F.struct("state", F.coalesce(source, F.lit("")).alias("source"), inputs.alias("inputs"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("job_dir"), F.nullif("error", F.lit("")).alias("error"), F.col("created_at").alias("submitted_at"), F.nullif("created_at", F.lit("")).alias("started_at"), F.nullif("updated_at", F.lit("")).alias("finished_at")).alias("r"))
    return named.groupBy("id").agg(F.min_by("r", "path").alias("r")).select("id", "r.*")


def recovery_events(rows: DataFrame) -> DataFrame:
    """job_id, event_id, source, stage, status, message: the one event that each of recovered() begins with."""
    return rows.select(F.col("id").alias("job_id"), F.lit(1).cast("bigint").alias("event_id"), F.get("inputs", F.lit(0)).alias("source"), F.col("state").alias("stage"), F.col("state").alias("status"), F.lit(RECOVERED).alias("message"))


def ordered_results(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Results in the order of the request. sources: pos, source; results: source, ..."""
    return sources.join(results, "source").orderBy("pos")


def batch_results(staged: DataFrame, found: DataFrame) -> DataFrame:
    """Every staged input with its result, failed where there is none. staged: stem, job_id; found: stem, state, error."""
    return staged.join(found, "stem", "left").select("stem", "job_id", F.coalesce("state", F.lit("failed")).alias("state"), F.when(F.col("state").isNull(), "no result").otherwise(F.col("error")).alias("error"))


def batch_stems(jobs: DataFrame) -> DataFrame:
    """stem, job_id: the place in the batch in six digits, and the id. jobs: pos, job_id; a batch fits in one run."""
    return jobs.select(F.format_string("%06d-%s", F.col("pos"), F.col("job_id")).alias("stem"), "job_id")


def until_failure(results: DataFrame) -> DataFrame:
    """Results of each request up to its first error. results: job_id, pos, error."""
    failed = F.coalesce(F.sum(F.when(F.col("error").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("job_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return results.withColumn("__failed", failed).where("__failed = 0").drop("__failed")


def artifact_catalog(results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """job_id, name, filename, size, sha256. In jobs of several results names start with the result's position, which
    doesn't change where a manifest is missing. results: job_id, pos (from 1), job_dir; artifacts: job_dir, name, path, size,
    sha256."""
    several = F.count("*").over(Window.partitionBy("job_id")) > 1
    rows = results.withColumn("several", several).join(artifacts, "job_dir")
    inside = ~F.col("path").rlike(r"(^|/)\.\.(/|$)") & ~F.col("path").startswith("/")
    return rows.where(inside).select("job_id", F.when(F.col("several"), F.concat_ws(".", F.col("pos").cast("string"), F.col("name"))).otherwise(F.col("name")).alias("name"), F.element_at(F.split("path", "/"), -1).alias("filename"), "size", "sha256")


def artifact_groups(items: DataFrame, counts: DataFrame) -> DataFrame:
    """job_id, result, name, label: a row for each result of a job, also without artifacts; names out of range are left
    out. items: job_id, name; counts: job_id, results."""
    slots = counts.select("job_id", F.col("results"), F.explode(F.sequence(F.lit(1), F.greatest("results", F.lit(1)))).alias("result"))
    parsed = items.select("job_id", "name", F.regexp_extract("name", r"^(\d+)\.(.+)$", 1).try_cast("int").alias("place"), F.regexp_extract("name", r"^(\d+)\.(.+)$", 2).alias("rest"))
    joined = slots.join(parsed.withColumnRenamed("job_id", "j"), (F.col("job_id") == F.col("j")) & ((F.col("results") <= 1) | (F.col("place") == F.col("result"))), "left")
    return joined.select("job_id", "result", "name", F.when(F.col("results") <= 1, F.col("name")).otherwise(F.col("rest")).alias("label"))


def numbered_events(events: DataFrame, most: int = HISTORY) -> DataFrame:
    """events with event_id, rising from 1 in each job, of which the newest are kept. events: job_id, seq, ..."""
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))
    last = F.count("*").over(Window.partitionBy("job_id"))
    return events.withColumn("event_id", n).withColumn("__last", last).where(F.col("__last") - F.col("event_id") < most).drop("__last")


def numbered_runs(events: DataFrame, most: int = HISTORY) -> DataFrame:
    """events with event_id, rising over all runs of a stream, of which those of its last run are kept, the newest ones.
    events: stream_id, run, seq, ..."""
    everything = Window.partitionBy("stream_id")
    n = F.row_number().over(everything.orderBy("run", "seq"))
    kept = events.withColumns({"event_id": n, "__run": F.max("run").over(everything), "__last": F.count("*").over(everything)})
    return kept.where((F.col("run") == F.col("__run")) & (F.col("__last") - F.col("event_id") < most)).drop("__run", "__last")


def relayed(events: DataFrame) -> DataFrame:
    """What a setup run passes on while it works: its end is published by itself, once settings are loaded again."""
    return events.where(~setup_end(F.col("stage")))


def looked_up(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, state, error of each id that is asked for: the error of missing jobs is missing_job. wanted: id."""
    found = jobs.select("id", "state")
    return wanted.select("id").join(found, "id", "left").select("id", "state", F.when(F.col("state").isNull(), "missing_job").alias("error"))


def payloads(events: DataFrame) -> DataFrame:
    """Events as clients see them: sources by their names. events: job_id, event_id, source, stage, status, message,
    completed, total, timestamp, media_seconds, estimated_seconds."""
    return events.select("job_id", "event_id", F.element_at(F.split("source", "/"), -1).alias("source"), "stage", "status", "message", "completed", "total", "timestamp", "media_seconds", "estimated_seconds")


def batch_routes(jobs: DataFrame) -> DataFrame:
    """pos, job_id, route: jobs share a loaded model where there are several in a request that may, else each is alone.
    jobs: request_id, pos, job_id, shared (may they)."""
    several = F.count_if("shared").over(Window.partitionBy("request_id")) > 1
    return jobs.select("request_id", "pos", "job_id", F.when(F.col("shared") & several, "shared").otherwise("isolated").alias("route"))


def replayed(events: DataFrame, after: int) -> DataFrame:
    return events.where(F.col("event_id") > after)


def conflicting(keys: DataFrame, active: DataFrame) -> DataFrame:
    """Mutation keys that another job holds. keys: job_id, key; active: key, holder."""
    return keys.join(active, "key").where(F.col("holder") != F.col("job_id")).select(keys["job_id"], "key").distinct()


def released(active: DataFrame, finished: DataFrame) -> DataFrame:
    """The keys still held once jobs have finished: a key goes only with its own holder. finished: key, holder."""
    return active.join(finished, ["key", "holder"], "left_anti")


def benchmark_summary(runs: DataFrame, audio_seconds: float) -> DataFrame:
    """Exact medians of runs (total, inference), a row of both, and media seconds a second."""
    return medians(runs, "total", "inference").withColumn("speed", F.try_divide(F.lit(audio_seconds), F.col("total")))


def speed_text(x: Column) -> Column:
    return F.when(x >= 10, F.format_string("%.0f", x)).otherwise(F.format_string("%.1f", x))


def benchmark_labels(summary: DataFrame, audio_seconds: float) -> DataFrame:
    """summary with speed_label, and ten_minutes_label: seconds for ten minutes of media, as text."""
    return summary.withColumns({"speed_label": speed_text(F.col("speed")), "ten_minutes_label": F.format_string("%.0f", F.col("total") * 600 / audio_seconds)})


def peak_growth(samples: DataFrame) -> DataFrame:
    """run, peak: how far memory rose over its first sample. samples: run, at, used."""
    return samples.groupBy("run").agg((F.max("used") - F.min_by("used", "at")).alias("peak"))


def ready(checks: DataFrame, *by: str) -> DataFrame:
    """ready, over all checks or for each group of them: none is an error. checks: status, and the columns of by."""
    return checks.groupBy(*by).agg((~F.coalesce(F.bool_or(F.col("status") == "error"), F.lit(False))).alias("ready"))
