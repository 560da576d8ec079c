"""Queries on the stages of batches: requests made of orders, sources of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.operators import stages
from cuemill.plans import views
from cuemill.plans.registry import Queries
from cuemill.plans.views import table

query = Queries()

_PLAN = f"""WITH {views.JOBS}, q AS (SELECT CAST(id AS BIGINT) AS job_id, md5(CAST(owner AS VARCHAR)) AS source_sha, owner % 2 AS stream, CASE WHEN CAST(id AS BIGINT) % 13 <> 0 THEN state END AS state,
  CASE CAST(floor(media) AS BIGINT) % 3 WHEN 0 THEN 'normalized' WHEN 1 THEN 'transcribed' ELSE 'probed' END AS state_detail, owner % 3 <> 0 AS resume, owner % 5 = 0 AS force, owner % 2 = 0 AS ready, CAST(id AS BIGINT) % 2 = 0 AS wanted, CAST(id AS BIGINT) % 7 < 4 AS made,
  CAST(id AS BIGINT) % 11 < 5 AS matches, CAST(id AS BIGINT) % 17 < 12 AS there, CAST(floor(media) AS BIGINT) % 5 < 2 AS canonical, CAST(floor(media) AS BIGINT) % 7 < 4 AS audio, CAST(floor(media) AS BIGINT) % 4 = 0 AS direct FROM jobs),
a AS (SELECT *, CASE WHEN state IS NULL OR force THEN 'new' WHEN state = 'completed' AND resume AND ready AND (NOT wanted OR (matches AND there)) THEN 'skip' WHEN state = 'completed' AND resume AND wanted AND made AND NOT matches THEN 'translation conflict' WHEN resume THEN 'resume' ELSE 'conflict' END AS action FROM q),
k AS (SELECT *, action IN ('new', 'resume') AS works, action IN ('new', 'resume') AND state IS NOT NULL AND NOT force AND canonical AS kept FROM a),
plan AS (SELECT job_id, source_sha, stream, action, kept, works AND NOT kept AS probe, works AND NOT kept AND NOT direct AND NOT (NOT force AND audio AND state_detail IN ('normalized', 'transcribed')) AS normalize, works AND NOT kept AS transcribe,
  works AND wanted AND NOT (kept AND matches AND made) AS translate, works AS render, works AND NOT kept AND NOT direct AS own_audio, works AND force AS drop_edits FROM k)"""


def _plan(spark, d):
    n, owner, media = F.col("id").cast("bigint"), F.col("owner"), F.floor("media")
    detail = F.when(media % 3 == 0, "normalized").when(media % 3 == 1, "transcribed").otherwise("probed")
    made = views.jobs(spark, d).select(n.alias("job_id"), F.md5(owner.cast("string")).alias("source_sha"), (owner % 2).alias("stream"), F.when(n % 13 != 0, F.col("state")).alias("state"), detail.alias("state_detail"), (owner % 3 != 0).alias("resume"), (owner % 5 == 0).alias("force"), (owner % 2 == 0).alias("ready"), (n % 2 == 0).alias("wanted"), (n % 7 < 4).alias("made"), (n % 11 < 5).alias("matches"), (n % 17 < 12).alias("there"), (media % 5 < 2).alias("canonical"), (media % 7 < 4).alias("audio"), (media % 4 == 0).alias("direct"))
    return stages.planned(made)


@query(_PLAN + " SELECT * FROM plan")
def r3_planned_steps(spark, d):
    return _plan(spark, d)


@query(_PLAN + """, hand AS (SELECT md5(CAST(c_custkey AS VARCHAR)) AS source_sha, 0 AS stream FROM customer WHERE c_nationkey < 8)
SELECT source_sha, stream, min(job_id) AS job_id, count(*) AS jobs FROM plan p WHERE normalize AND NOT EXISTS (SELECT 1 FROM hand h WHERE h.source_sha = p.source_sha AND h.stream = p.stream) GROUP BY source_sha, stream""")
def r3_normalisations(spark, d):
    """Audio of the customers of some nations is there."""
    hand = table(spark, d, "customer").where("c_nationkey < 8").select(F.md5(F.col("c_custkey").cast("string")).alias("source_sha"), F.lit(0).alias("stream"))
    return stages.normalisations(_plan(spark, d), hand)


@query(_PLAN + """, made AS (SELECT l_orderkey AS job_id, bool_or(l_returnflag <> 'R') AS transcript, bool_or(l_linenumber > 3) AS translation, max(CASE WHEN l_quantity >= 50 THEN 'line ' || l_linenumber END) AS error FROM lineitem GROUP BY 1),
e AS (SELECT p.*, CASE WHEN action = 'skip' THEN NULL WHEN NOT render THEN action ELSE coalesce(error, CASE WHEN transcribe AND NOT coalesce(transcript, false) THEN 'Cannot complete a job without a transcript' WHEN translate AND NOT coalesce(translation, false) THEN 'Cannot complete a translated job without translated segments' END) END AS wrong FROM plan p LEFT JOIN made USING (job_id))
SELECT job_id, CASE WHEN wrong IS NULL THEN 'completed' ELSE 'failed' END AS state, wrong AS error, action = 'skip' AS skipped, own_audio AND wrong IS NULL AS drop_audio FROM e""")
def r6_completed_jobs(spark, d):
    li = table(spark, d, "lineitem")
    made = li.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.bool_or(F.col("l_returnflag") != "R").alias("transcript"), F.bool_or(F.col("l_linenumber") > 3).alias("translation"), F.max(F.when(F.col("l_quantity") >= 50, F.concat(F.lit("line "), "l_linenumber"))).alias("error"))
    return stages.completed(_plan(spark, d), made)
