"""The stages of a batch as tables: what each source still needs, which audio is made once for all that share it, and how
each job ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions.rules import action

STEPS = ("probe", "normalize", "transcribe", "translate", "render")
#: What has to be known already for audio to be taken up again, and what is said of jobs that can't end well.
HEARD = ("normalized", "transcribed")
NO_TRANSCRIPT = "Cannot complete a job without a transcript"
NO_TRANSLATION = "Cannot complete a translated job without translated segments"


def planned(requests: DataFrame) -> DataFrame:
    """job_id, source_sha, stream, action, kept, STEPS, own_audio and drop_edits: what is to be done for each request.

    requests: job_id, source_sha, stream, state and state_detail (of the manifest, null without), resume, force, ready (are
    the files of the formats there?), wanted, made, matches, there (of the translation, as rules.action() takes them),
    canonical (is the transcript there?), audio (is normalised audio there?), direct (does the media need none?). A transcript
    that is there is kept, with its translation if that fits; only sources without one are probed and transcribed.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    acts = requests.withColumn("action", action(F.col("state"), flag("resume"), flag("force"), flag("ready"), F.col("wanted"), F.col("made"), F.col("matches"), F.col("there")))
    works = F.col("action").isin("new", "resume")
    rows = acts.withColumn("kept", works & F.col("state").isNotNull() & ~flag("force") & flag("canonical"))
    fresh = works & ~F.col("kept")
    heard = ~flag("force") & flag("audio") & F.coalesce(F.col("state_detail").isin(*HEARD), F.lit(False))
    done = F.col("kept") & flag("matches") & flag("made")
    steps = {"probe": fresh, "normalize": fresh & ~flag("direct") & ~heard, "transcribe": fresh, "translate": works & flag("wanted") & ~done, "render": works}
    return rows.select("job_id", "source_sha", "stream", "action", "kept", *[steps[s].alias(s) for s in STEPS], (fresh & ~flag("direct")).alias("own_audio"), (works & flag("force")).alias("drop_edits"))


def normalisations(plan: DataFrame, at_hand: DataFrame) -> DataFrame:
    """source_sha, stream, job_id, jobs: audio that is still to be made, once for all jobs that need it; job_id is the least
    of them. at_hand: source_sha, stream of audio that is there. Audio without a hash is nobody else's."""
    need = plan.where("normalize").select("job_id", "source_sha", "stream")
    alone = need.where("source_sha IS NULL").select("source_sha", "stream", "job_id", F.lit(1).cast("bigint").alias("jobs"))
    there = at_hand.select("source_sha", F.col("stream").alias("of")).distinct()
    missing = need.join(there, (need["source_sha"] == there["source_sha"]) & need["stream"].eqNullSafe(there["of"]), "left_anti")
    shared = missing.where("source_sha IS NOT NULL").groupBy("source_sha", "stream").agg(F.min("job_id").alias("job_id"), F.count("*").alias("jobs"))
    return shared.unionByName(alone)


def completed(plan: DataFrame, produced: DataFrame, keep_audio: bool = False) -> DataFrame:
    """job_id, state, error, skipped, drop_audio: how the jobs of a plan end. produced: job_id, transcript, translation (what
    the stages have made), error (of the stage that failed).

    What is complete already is skipped; a conflict fails. A job that works is completed if it has a transcript, kept or made,
    and if it is to be translated, a translation; its normalised audio, made now or before, then goes, unless it is to be kept.
    """
    rows = plan.join(produced, "job_id", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    works = F.col("action").isin("new", "resume")
    error = F.when(F.col("action") == "skip", None).when(~works, F.col("action")).otherwise(F.coalesce("error", F.when(F.col("transcribe") & ~has("transcript"), NO_TRANSCRIPT), F.when(F.col("translate") & ~has("translation"), NO_TRANSLATION)))
    ended = rows.select("job_id", "own_audio", error.alias("error"), (F.col("action") == "skip").alias("skipped"))
    state = F.when(F.col("error").isNull(), "completed").otherwise("failed")
    return ended.select("job_id", state.alias("state"), "error", "skipped", (F.col("own_audio") & F.col("error").isNull() & ~F.lit(keep_audio)).alias("drop_audio"))
