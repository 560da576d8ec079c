"""Queries on jobs, their results and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import rules
from cuemill.operators import jobs
from cuemill.plans import views
from cuemill.plans.registry import Queries
from cuemill.plans.views import table
from cuemill.sources import sinks
from cuemill.streaming import progress, sse

query = Queries()


@query(f"WITH {views.JOBS} SELECT id, state, submitted_at FROM jobs WHERE state = 'completed' ORDER BY submitted_at DESC, id DESC LIMIT 100 OFFSET 20")
def l1_job_page(spark, d):
    return jobs.listed(views.jobs(spark, d).select("id", "state", "submitted_at"), offset=20, limit=100, state="completed")


@query(f"WITH {views.JOBS} SELECT state, count(*) AS n FROM jobs GROUP BY state")
def a1_job_counts(spark, d):
    return jobs.counted(views.jobs(spark, d))


@query(f"""WITH {views.RESULTS} SELECT job_id, CASE WHEN bool_or(state = 'cancelled') THEN 'cancelled' WHEN bool_or(error IS NOT NULL) THEN 'failed' ELSE 'completed' END AS state, arg_min(error, pos) FILTER (WHERE error IS NOT NULL) AS error FROM results GROUP BY job_id""")
def a2_outcomes(spark, d):
    return jobs.outcomes(views.results(spark, d))


#: Timings of jobs: some by themselves, some of a batch, some without a value or zero.
_MANIFESTS = f"""{views.JOBS}, work AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
m AS (SELECT j.*, CASE WHEN j.owner % 5 = 0 THEN NULL ELSE w.q END AS own, j.owner % 3 <> 0 AS has_own, w.q AS batch, CAST(j.owner % 4 AS DOUBLE) AS size FROM jobs j JOIN work w USING (id)),
speeds AS (SELECT id, submitted_at AS updated_at, CASE WHEN has_own THEN media / nullif(own, 0) ELSE CASE WHEN size = 0 THEN NULL ELSE media / nullif(batch / size, 0) END END AS value FROM m)"""


def _samples(spark, d):
    work = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.sum("l_quantity").alias("q"))
    m = views.jobs(spark, d).join(work, "id")
    own = F.create_map(F.lit("inference_seconds"), F.when(F.col("owner") % 5 != 0, F.col("q")))
    batch = F.create_map(F.lit("batch_inference_seconds"), F.col("q"), F.lit("batch_size"), (F.col("owner") % 4).cast("double"))
    return m.withColumn("timings", F.when(F.col("owner") % 3 != 0, own).otherwise(batch)).select("id", F.col("submitted_at").alias("updated_at"), jobs.speed(F.col("media"), F.col("timings")).alias("value"))


@query(f"WITH {_MANIFESTS} SELECT id, updated_at, CASE WHEN value > 0 THEN value END AS value FROM speeds")
def a3_learned_speeds(spark, d):
    return _samples(spark, d)


@query(f"WITH {_MANIFESTS} SELECT median(value) AS speed FROM (SELECT value FROM speeds WHERE value > 0 ORDER BY updated_at DESC, value DESC LIMIT 5)")
def a4_median_speed(spark, d):
    return jobs.median_speed(_samples(spark, d))


@query(f"""WITH {_MANIFESTS}, {views.STAGE_EVENTS}, speed AS (SELECT median(value) AS speed FROM (SELECT value FROM speeds WHERE value > 0 ORDER BY updated_at DESC, value DESC LIMIT 5))
SELECT e.*, value * 10 AS media_seconds, CASE WHEN stage = 'transcribing' AND status = 'started' AND value > 0 AND speed IS NOT NULL THEN greatest(0.1::DOUBLE, round_even(value * 10 / speed, 1)) END AS estimated_seconds FROM stage_events e, speed""")
def a4_estimates(spark, d):
    e = views.stage_events(spark, d).withColumn("media_seconds", F.col("value") * 10)
    return jobs.estimates(e, _samples(spark, d))


@query("SELECT median(l_extendedprice) AS total, median(l_quantity) AS inference, 600 / median(l_extendedprice) AS speed FROM lineitem")
def a5_benchmark_summary(spark, d):
    return jobs.benchmark_summary(table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("total"), F.col("l_quantity").alias("inference")), 600.0)


@query("""WITH s AS (SELECT median(l_extendedprice) AS total, 9000000 / median(l_extendedprice) AS speed FROM lineitem) SELECT total, speed, CASE WHEN speed >= 10 THEN CAST(CAST(floor(speed + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) ELSE CAST(floor(speed * 10 + 0.5::DOUBLE) / 10 AS VARCHAR) END AS speed_label, CAST(CAST(floor(total * 600 / 9000000 + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) AS ten_minutes_label FROM s""")
def a6_benchmark_labels(spark, d):
    runs = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("total"), F.col("l_quantity").alias("inference"))
    return jobs.benchmark_labels(jobs.benchmark_summary(runs, 9_000_000.0), 9_000_000.0).drop("inference")


@query("SELECT user_id AS run, max(value) - arg_min(value, event_id) AS peak FROM events GROUP BY user_id")
def a7_peak_growth(spark, d):
    return jobs.peak_growth(table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), F.col("value").alias("used")))


@query(f"WITH {views.STAGE_EVENTS} SELECT job_id, seq, stage, event_id FROM (SELECT job_id, event_id AS seq, stage, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS event_id, count(*) OVER (PARTITION BY job_id) AS last FROM stage_events) WHERE last - event_id < 5")
def w7_numbered_events(spark, d):
    return jobs.numbered_events(views.stage_events(spark, d).select("job_id", F.col("event_id").alias("seq"), "stage"), 5).withColumn("event_id", F.col("event_id").cast("bigint"))


@query("SELECT event_id, event_type FROM events WHERE event_id > 900")
def st2_replay(spark, d):
    return jobs.replayed(table(spark, d, "events").select("event_id", "event_type"), 900)


@query(f"WITH {views.RESULTS} SELECT printf('%06d-%d', pos, job_id) AS stem, job_id, CASE WHEN state = 'cancelled' THEN 'failed' ELSE state END AS state, CASE WHEN state = 'cancelled' THEN 'no result' ELSE error END AS error FROM results")
def j1_batch_results(spark, d):
    """A batch of all results, of which nothing is found of the cancelled ones."""
    r = views.results(spark, d).withColumn("stem", F.format_string("%06d-%d", "pos", "job_id"))
    return jobs.batch_results(r.select("stem", "job_id"), r.where("state <> 'cancelled'").select("stem", "state", "error"))


@query("SELECT printf('%06d-%d', o_orderkey, o_custkey) AS stem, o_custkey AS job_id FROM orders")
def w8_batch_stems(spark, d):
    return jobs.batch_stems(table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("job_id")))


@query(f"WITH {views.RESULTS} SELECT job_id || '-' || pos AS source, l_partkey AS pos, state FROM results")
def j3_ordered_results(spark, d):
    r = views.results(spark, d).withColumn("source", F.concat_ws("-", "job_id", "pos"))
    return jobs.ordered_results(r.select(F.col("l_partkey").alias("pos"), "source"), r.select("source", "state"))


@query(f"WITH {views.RESULTS} SELECT job_id, pos, error FROM results r WHERE NOT EXISTS (SELECT 1 FROM results x WHERE x.job_id = r.job_id AND x.pos < r.pos AND x.error IS NOT NULL)")
def l6_until_failure(spark, d):
    return jobs.until_failure(views.results(spark, d).select("job_id", "pos", "error")).withColumn("pos", F.col("pos").cast("bigint"))


_CATALOG = f"""{views.RESULTS}, dirs AS (SELECT job_id, pos, l_partkey AS job_dir, count(*) OVER (PARTITION BY job_id) > 1 AS several FROM results),
artifacts AS (SELECT p_partkey AS job_dir, n AS name, CASE WHEN p_size = 7 THEN '../' ELSE '' END || 'out/' || n || '.bin' AS path, p_size AS size, p_brand AS sha256 FROM part, (VALUES ('srt'), ('txt')) AS t(n) WHERE p_partkey % 4 <> 0),
catalog AS (SELECT job_id, CASE WHEN several THEN pos || '.' || name ELSE name END AS name, name || '.bin' AS filename, size, sha256 FROM dirs JOIN artifacts USING (job_dir) WHERE NOT starts_with(path, '../'))"""


@query(f"WITH {_CATALOG} SELECT * FROM catalog")
def j7_artifact_catalog(spark, d):
    dirs = views.results(spark, d).select("job_id", "pos", F.col("l_partkey").alias("job_dir"))
    up = F.when(F.col("p_size") == 7, "../").otherwise("")
    made = table(spark, d, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("job_dir"), F.explode(F.array(F.lit("srt"), F.lit("txt"))).alias("name"), up.alias("up"), F.col("p_size").alias("size"), F.col("p_brand").alias("sha256"))
    return jobs.artifact_catalog(dirs, made.select("job_dir", "name", F.concat("up", F.lit("out/"), "name", F.lit(".bin")).alias("path"), "size", "sha256"))


@query(f"""WITH {views.RESULTS}, counts AS (SELECT job_id, least(count(*), 3) AS results FROM results GROUP BY job_id), items AS (SELECT job_id, CASE WHEN pos % 5 = 0 THEN 'srt' ELSE pos || '.srt' END AS name FROM results),
slots AS (SELECT job_id, results, unnest(generate_series(1, results)) AS result FROM counts)
SELECT s.job_id, result, name, CASE WHEN results <= 1 THEN name ELSE regexp_extract(name, '^(\\d+)\\.(.+)$', 2) END AS label FROM slots s LEFT JOIN items i ON i.job_id = s.job_id AND (results <= 1 OR TRY_CAST(regexp_extract(name, '^(\\d+)\\.(.+)$', 1) AS INT) = result)""")
def j17_artifact_groups(spark, d):
    r = views.results(spark, d)
    counts = r.groupBy("job_id").agg(F.least(F.count("*"), F.lit(3)).alias("results"))
    items = r.select("job_id", F.when(F.col("pos") % 5 == 0, "srt").otherwise(F.concat("pos", F.lit(".srt"))).alias("name"))
    return jobs.artifact_groups(items, counts)


_RECOVERED = f"""WITH {views.JOBS}, m AS (SELECT '/out/' || id || '/manifest.json' AS path, CASE WHEN owner % 6 = 0 THEN '' ELSE CAST(owner AS VARCHAR) END AS job_id, CASE WHEN owner % 9 = 0 THEN 'queued' ELSE state END AS state, CASE WHEN owner % 4 <> 0 THEN '/media/' || id END AS source, submitted_at FROM jobs),
r AS (SELECT coalesce(nullif(job_id, ''), sha256(path)) AS id, path, CASE state WHEN 'processing' THEN 'interrupted' ELSE state END AS state, source, submitted_at FROM m WHERE state <> 'queued'),
f AS (SELECT id, unnest(arg_min(struct_pack(state := state, source := source, path := path, submitted_at := submitted_at), path)) FROM r GROUP BY id)"""


def _recovered(spark, d):
    j = views.jobs(spark, d)
    source = F.when(F.col("owner") % 4 != 0, F.concat(F.lit("/media/"), "id"))
    m = j.select(F.concat(F.lit("/out/"), "id", F.lit("/manifest.json")).alias("path"), F.when(F.col("owner") % 6 == 0, "").otherwise(F.col("owner").cast("string")).alias("job_id"), F.when(F.col("owner") % 9 == 0, "queued").otherwise(F.col("state")).alias("state"), source.alias("source_path"), F.lit("").alias("error"), F.col("submitted_at").alias("created_at"), F.col("submitted_at").alias("updated_at"))
    return jobs.recovered(m)


@query(_RECOVERED + " SELECT id, state, coalesce(source, '') AS source, coalesce(source, '') AS inputs, replace(path, '/manifest.json', '') AS job_dir, CAST(NULL AS VARCHAR) AS error, submitted_at, submitted_at AS started_at, submitted_at AS finished_at FROM f")
def r1_recovered_jobs(spark, d):
    return _recovered(spark, d).withColumn("inputs", F.array_join("inputs", "|"))


@query(_RECOVERED + " SELECT id AS job_id, CAST(1 AS BIGINT) AS event_id, source, state AS stage, state AS status, 'Recovered from manifest' AS message FROM f")
def r1_recovery_events(spark, d):
    return jobs.recovery_events(_recovered(spark, d))


@query(f"WITH {views.JOBS} SELECT DISTINCT j.id AS job_id, j.owner AS key FROM jobs j JOIN jobs a ON a.owner = j.owner AND a.id <> j.id WHERE j.state = 'failed' AND a.state = 'processing'")
def j12_conflicting_keys(spark, d):
    j = views.jobs(spark, d)
    return jobs.conflicting(j.where("state = 'failed'").select(F.col("id").alias("job_id"), F.col("owner").alias("key")), j.where("state = 'processing'").select(F.col("owner").alias("key"), F.col("id").alias("holder")))


@query(f"WITH {views.JOBS} SELECT owner AS key, id AS holder FROM jobs WHERE state = 'processing' AND NOT (CAST(id AS BIGINT) % 2 = 0)")
def j18_released_keys(spark, d):
    held = views.jobs(spark, d).where("state = 'processing'").select(F.col("owner").alias("key"), F.col("id").alias("holder"))
    return jobs.released(held, held.where(F.col("holder").cast("bigint") % 2 == 0))


@query(f"""WITH {views.JOBS}, k AS (SELECT id, owner, CASE WHEN CAST(id AS BIGINT) % 13 <> 0 THEN state END AS state, CAST(id AS BIGINT) % 2 = 0 AS wanted, CAST(id AS BIGINT) % 7 < 4 AS made, CAST(id AS BIGINT) % 11 < 5 AS matches, CAST(id AS BIGINT) % 17 < 12 AS there FROM jobs)
SELECT id, CASE WHEN state IS NULL OR owner % 5 = 0 THEN 'new' WHEN owner % 3 = 0 THEN 'conflict' WHEN state <> 'completed' THEN 'resume' WHEN owner % 2 = 0 AND NOT (wanted AND NOT (matches AND there)) THEN 'skip' WHEN wanted AND made AND NOT matches THEN 'translation conflict' ELSE 'resume' END AS action FROM k""")
def p20_actions(spark, d):
    n, owner = F.col("id").cast("bigint"), F.col("owner")
    action = rules.action(F.when(n % 13 != 0, F.col("state")), owner % 3 != 0, owner % 5 == 0, owner % 2 == 0, n % 2 == 0, n % 7 < 4, n % 11 < 5, n % 17 < 12)
    return views.jobs(spark, d).select("id", action.alias("action"))


_STATES = f"""WITH {views.STAGE_EVENTS}, e AS (SELECT * FROM stage_events WHERE source IS NOT NULL),
t AS (SELECT job_id, source, event_id, stage, status, stage IN ('failed', 'completed') AS over FROM e WHERE stage <> 'queued'),
cur AS (SELECT t.job_id, t.source, t.stage FROM t JOIN (SELECT job_id, source, max(event_id) AS event_id FROM t WHERE NOT over AND status = 'started' GROUP BY ALL) USING (job_id, source, event_id)
        WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.job_id = t.job_id AND x.source = t.source AND x.event_id > t.event_id AND (x.over OR (x.status = 'completed' AND x.stage = t.stage)))),
states AS (SELECT s.*, cur.stage AS current FROM (SELECT job_id, source, coalesce(arg_max(stage, event_id) FILTER (WHERE stage IN ('failed', 'completed')), 'running') AS state, coalesce(arg_max(message, event_id), '') AS message, arg_max(message, event_id) FILTER (WHERE stage = 'failed') AS error,
  coalesce(array_to_string(list_sort(list(DISTINCT stage) FILTER (WHERE stage NOT IN ('queued', 'failed', 'completed') AND status = 'completed')), ','), '') AS done FROM e GROUP BY job_id, source) s LEFT JOIN cur USING (job_id, source))"""


@query(_STATES + " SELECT * FROM states")
def st6_file_states(spark, d):
    return progress.file_states(views.stage_events(spark, d)).withColumn("done", F.array_join("done", ","))


@query(_STATES + """, rows AS (SELECT job_id, source, state, current, string_split(done, ',') AS done, unnest(range(6)) AS place, unnest(['validating', 'probing', 'normalizing', 'transcribing', 'translating', 'rendering']) AS stage FROM states)
SELECT job_id, source, place, stage, CASE WHEN list_contains(done, stage) THEN 'done' WHEN current = stage THEN CASE state WHEN 'running' THEN 'active' ELSE state END ELSE 'pending' END AS status FROM rows WHERE stage <> 'translating' OR list_contains(done, stage) OR current = stage""")
def st6_stage_rows(spark, d):
    return progress.stage_rows(progress.file_states(views.stage_events(spark, d)))


@query(f"""WITH {views.STAGE_EVENTS}, e AS (SELECT job_id, event_id, source, CAST(event_id AS DOUBLE) AS at, CASE WHEN event_id % 4 <> 0 THEN 30.0::DOUBLE END AS est,
  CASE WHEN source IS NULL THEN NULL WHEN stage IN ('failed', 'completed') OR (stage = 'transcribing' AND status = 'completed') THEN 0 WHEN stage = 'transcribing' AND status = 'started' THEN 1 END AS busy FROM stage_events),
s AS (SELECT *, coalesce(busy - coalesce(last_value(busy IGNORE NULLS) OVER (PARTITION BY job_id, source ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS step FROM e),
l AS (SELECT *, sum(step) OVER (PARTITION BY job_id ORDER BY event_id) AS n FROM s),
o AS (SELECT job_id, max(event_id) AS now, max(event_id) FILTER (WHERE step < 0 AND n = 0) AS closed FROM l GROUP BY job_id),
m AS (SELECT job_id, source, min(event_id) AS first, arg_max(est, event_id) AS est, bool_or(est IS NULL AND last) AS unknown, any_value(now) AS now FROM (SELECT l.job_id, source, event_id, est, now, event_id = max(event_id) OVER (PARTITION BY l.job_id, source) AS last FROM l JOIN o USING (job_id) WHERE busy = 1 AND event_id > coalesce(closed, -1)) GROUP BY job_id, source),
b AS (SELECT CAST(job_id AS VARCHAR) AS job_id, CAST(count(*) AS INT) AS files, CAST(min(first) AS DOUBLE) AS started_at, CAST(any_value(now) - min(first) AS DOUBLE) AS elapsed, CASE WHEN NOT bool_or(unknown) THEN sum(est) END AS estimate FROM m GROUP BY job_id)
SELECT *, estimate IS NULL AS indeterminate, CASE WHEN estimate IS NULL THEN NULL WHEN elapsed >= estimate THEN 0.99::DOUBLE ELSE least(0.99::DOUBLE, elapsed / estimate) END AS fraction, coalesce(elapsed >= estimate, false) AS overdue FROM (SELECT * REPLACE (CAST(estimate AS DOUBLE) AS estimate) FROM b)""")
def st6_progress_bars(spark, d):
    e = views.stage_events(spark, d)
    return progress.bars(e.select("job_id", "event_id", "source", "stage", "status", F.col("event_id").cast("double").alias("at"), F.when(F.col("event_id") % 4 != 0, F.lit(30.0)).alias("estimated_seconds")).withColumn("job_id", F.col("job_id").cast("string")))


@query(f"""WITH {views.STAGE_EVENTS} SELECT job_id, event_id, job_end, setup_end, coalesce(status = 'started', false) OR stage IN ('failed', 'completed') AS shown FROM (SELECT *, source IS NULL AND stage IN ('failed', 'completed') AS job_end, stage IN ('failed', 'completed') AS setup_end FROM stage_events)""")
def p31_terminal_events(spark, d):
    e = views.stage_events(spark, d)
    return e.select("job_id", "event_id", rules.job_end(F.col("source"), F.col("stage")).alias("job_end"), rules.setup_end(F.col("stage")).alias("setup_end"), rules.progress_shown(F.col("stage"), F.col("status")).alias("shown"))


@query("SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, CAST(event_id AS VARCHAR) AS id, event_type AS event, props AS data FROM events")
def st7_parsed_event_stream(spark, d):
    """Events written as frames, cut into chunks at awkward places, and read again."""
    e = table(spark, d, "events")
    frames = e.select("user_id", "event_id", F.concat(F.lit(": ping\r\nid: "), "event_id", F.lit("\r\nevent:"), "event_type", F.lit("\r\ndata: "), "props", F.lit("\r\n\r\n")).alias("t"))
    cut = frames.select(F.col("user_id").alias("stream_id"), "event_id", F.posexplode(F.array(F.substring("t", F.lit(1), F.length("t") - 1), F.right("t", F.lit(1)))).alias("part", "text"))
    out = sse.events(cut.select("stream_id", (F.col("event_id") * 2 + F.col("part")).alias("seq"), "text"))
    return out.withColumn("n", F.col("n").cast("bigint"))


@query("""SELECT user_id AS job_id, event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: {"job_id":' || user_id || ',"stage":"' || event_type || '"}' || chr(10) || chr(10) AS frame FROM events""")
def k8_event_frames(spark, d):
    return sinks.event_lines(table(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("event_type").alias("stage")))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'installing_runtime' WHEN 1 THEN 'installing_models' WHEN 2 THEN 'configuring' WHEN 3 THEN 'installing_runtime' ELSE 'validating' END AS stage, CASE p_size % 6 WHEN 3 THEN 'model' WHEN 4 THEN 'unsupported' WHEN 0 THEN NULL ELSE 'inference' END AS failure FROM part""")
def p32_p33_classes(spark, d):
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, " runtime").when(k == 1, " the model").when(k == 2, " configuration").when(k == 3, " runtime and model").otherwise("")
    return table(spark, d, "part").select("p_partkey", rules.setup_stage(F.concat("p_name", said)).alias("stage"), rules.failure_kind(F.col("p_size") % 6).alias("failure"))


@query("SELECT n_regionkey, NOT bool_or(n_nationkey = 7) AS ready FROM nation GROUP BY n_regionkey")
def a11_ready(spark, d):
    status = F.when(F.col("n_nationkey") == 7, "error").otherwise("warn")
    return jobs.ready(table(spark, d, "nation").select("n_regionkey", status.alias("status")), "n_regionkey")
