"""Progress of jobs from their events, as a stream and as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuemill.streaming.state import IDLE_MS, in_order, stateful

#: The stages of a file; a translation is only shown once it is seen.
STAGES = ("validating", "probing", "normalizing", "transcribing", "translating", "rendering")
ENDED = ("completed", "failed", "cancelled", "interrupted")
FULL = 0.99
BAR = "job_id string, files int, started_at double, elapsed double, estimate double, indeterminate boolean, fraction double, overdue boolean"
FILE = "job_id string, source string, state string, message string, error string, current string, done array<string>"


def file_states(events: DataFrame) -> DataFrame:
    """job_id, source, state, message, error, current, done of each file. events: job_id, event_id, source, stage, status,
    message."""
    rows = events.where("source is not null")
    over = F.col("stage").isin(*ENDED)
    work = ~over & (F.col("stage") != "queued")
    last = lambda value, when: F.max_by(value, F.when(when, F.col("event_id")))
    # A stage is at work from its start until it completes or the file ends.
    turn = work & F.col("status").isin("started", "completed") | over
    states = rows.groupBy("job_id", "source").agg(
        last(F.col("stage"), over).alias("ended"), F.max_by("message", "event_id").alias("message"), last(F.col("message"), over & (F.col("stage") != "completed")).alias("error"),
        F.array_sort(F.collect_set(F.when(work & (F.col("status") == "completed"), F.col("stage")))).alias("done"),
        F.array_sort(F.collect_list(F.when(turn, F.struct("event_id", "stage", "status", over.alias("over"))))).alias("turns"),
    )
    current = F.aggregate("turns", F.lit(None).cast("string"), lambda a, t: F.when(t["over"], F.lit(None)).when(t["status"] == "started", t["stage"]).when(t["stage"] == a, F.lit(None)).otherwise(a))
    return states.select("job_id", "source", F.coalesce("ended", F.lit("running")).alias("state"), F.coalesce("message", F.lit("")).alias("message"), "error", current.alias("current"), "done")


def stage_rows(states: DataFrame) -> DataFrame:
    """job_id, source, place, stage, status (done, active, pending or how the file ended) of what file_states() returns."""
    rows = states.select("job_id", "source", "state", "current", "done", F.posexplode(F.array(*[F.lit(s) for s in STAGES])).alias("place", "stage"))
    done, now = F.array_contains("done", F.col("stage")), F.coalesce(F.col("current") == F.col("stage"), F.lit(False))
    shown = rows.where((F.col("stage") != "translating") | done | now)
    return shown.select("job_id", "source", "place", "stage", F.when(done, "done").when(now, F.when(F.col("state") == "running", "active").otherwise(F.col("state"))).otherwise("pending").alias("status"))


def _marks(stage: Column, status: Column) -> Column:
    """True where a file begins to transcribe, false where it no longer does, else null."""
    ends = stage.isin(*ENDED) | ((stage == "transcribing") & (status == "completed"))
    return F.when(ends, False).when((stage == "transcribing") & (status == "started"), True)


def bars(events: DataFrame) -> DataFrame:
    """The bar of each job after all its events, as of the last one: files that transcribe at once share it, from the first
    that begins until none is left. events: job_id, event_id, source, stage, status, at (seconds), estimated_seconds.

    Files at work are a running sum of steps, +1 where an idle file begins and -1 where one at work ends; a bar ends where the
    sum comes back to zero. The last bar is shown if it hasn't ended. A job's events are sorted once, in its task.
    """
    job, file = Window.partitionBy("job_id"), Window.partitionBy("job_id", "source").orderBy("event_id")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.repartition("job_id").withColumn("busy", F.when(F.col("source").isNotNull(), _marks(F.col("stage"), F.col("status"))))
    was = F.coalesce(F.last("busy", ignorenulls=True).over(before(file)), F.lit(False))
    steps = rows.withColumn("step", F.coalesce(F.col("busy").cast("int") - was.cast("int"), F.lit(0)))
    left = steps.withColumn("left", F.sum("step").over(job.orderBy("event_id")))
    ended = ((F.col("step") < 0) & (F.col("left") == 0)).cast("int")
    spans = left.withColumn("ended", ended).withColumn("bar", F.coalesce(F.sum("ended").over(before(job.orderBy("event_id"))), F.lit(0)))
    last = spans.select("job_id", "event_id", "source", "busy", "at", "estimated_seconds", "bar", F.sum("ended").over(job).alias("open"), F.max_by("at", "event_id").over(job).alias("now"))
    members = last.where("bar = open AND busy").groupBy("job_id", "source").agg(F.min("event_id").alias("first"), F.min_by("at", "event_id").alias("since"), F.max_by("estimated_seconds", "event_id").alias("estimate"), F.first("now").alias("now"))
    made = members.groupBy("job_id").agg(F.count("*").cast("int").alias("files"), F.min_by("since", "first").alias("started_at"), F.first("now").alias("now"), F.sum("estimate").alias("total"), F.count_if(F.col("estimate").isNull()).alias("unknown"))
    elapsed, known = F.greatest(F.col("now") - F.col("started_at"), F.lit(0.0)), F.col("unknown") == 0
    shown = made.select("job_id", "files", "started_at", elapsed.alias("elapsed"), F.when(known, F.col("total")).alias("estimate"), (~known).alias("indeterminate"))
    over = ~F.col("indeterminate") & (F.col("elapsed") >= F.col("estimate"))
    return shown.select("*", F.when(over, FULL).when(~F.col("indeterminate"), F.least(F.lit(FULL), F.col("elapsed") / F.col("estimate"))).alias("fraction"), over.alias("overdue"))


class Bars(StatefulProcessor):
    """Keeps the events of each job's present bar, and none when it has ended: what bars() counts over all events."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("bar", "event_id bigint, source string, busy boolean, at double, estimate double", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = in_order(rows, "event_id")
        new = [(r["event_id"], r["source"], r["busy"], r["at"], r["estimated_seconds"]) for r in rows if r["busy"] is not None]
        bar = pd.DataFrame([*self.kept.get(), *new], columns=["event_id", "source", "busy", "at", "estimate"])
        busy = bar["busy"].astype(bool).astype(int)
        step = busy - busy.groupby(bar["source"]).shift(fill_value=0)
        ends = np.flatnonzero((step < 0) & (step.cumsum() == 0))
        bar = bar[ends[-1] + 1 :] if len(ends) else bar
        # What comes before a file of the bar begins to transcribe is of no bar.
        bar = bar[bar["busy"].astype(bool).cummax()]
        if bar.empty or any(r["over"] for r in rows):
            self.kept.clear()
        else:
            self.kept.put([(int(r.event_id), r.source, bool(r.busy), float(r.at), None if pd.isna(r.estimate) else float(r.estimate)) for r in bar.itertuples()])
        if len(bar):
            estimates = bar[bar["busy"].astype(bool)].groupby("source")["estimate"].agg(lambda e: e.iloc[-1]).astype(float)
            since, now = float(bar["at"].iloc[0]), float(rows[-1]["at"])
            elapsed, total = max(0.0, now - since), None if estimates.isna().any() else float(estimates.sum())
            overdue = total is not None and elapsed >= total
            part = None if total is None else FULL if overdue else min(FULL, elapsed / total)
            yield Row(job_id=key[0], files=len(estimates), started_at=since, elapsed=elapsed, estimate=total, indeterminate=total is None, fraction=part, overdue=overdue)


def bar_stream(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """The bar of each job after each batch of a stream of events. A job's own end ends its state."""
    named = F.col("source").isNotNull()
    marked = events.select("job_id", "event_id", "source", F.when(named, _marks(F.col("stage"), F.col("status"))).alias("busy"), (~named & F.col("stage").isin(*ENDED)).alias("over"), "at", "estimated_seconds")
    return stateful(marked, "job_id", Bars(idle_ms), BAR)


class FileStates(StatefulProcessor):
    """Keeps of each file the last event of each kind that its state is read from, under the file's name."""

    FACTS = ("said", "over", "failed", "started")

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fact = "struct<event_id:bigint,value:string>"
        self.files = handle.getMapState("files", "source string", ", ".join(f"{f} {fact}" for f in self.FACTS) + f", completed array<{fact}>", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held: dict[str, dict] = {}
        ended = False
        for r in rows:
            if r["source"] is None:
                ended |= r["stage"] in ENDED
                continue
            if r["source"] not in held:
                held[r["source"]] = self._held(r["source"])
            facts, last = held[r["source"]], lambda of, name, value: of.update({name: max(of.get(name) or (-1, None), (r["event_id"], value), key=lambda f: f[0])})  # noqa: B023,E731
            last(facts, "said", r["message"])
            if r["stage"] in ENDED:
                last(facts, "over", r["stage"])
                if r["stage"] != "completed":
                    last(facts, "failed", r["message"])
            elif r["stage"] != "queued" and r["status"] == "started":
                last(facts, "started", r["stage"])
            elif r["stage"] != "queued" and r["status"] == "completed":
                last(facts["completed"], r["stage"], None)
        for source, facts in held.items():
            if not ended:
                self.files.updateValue((source,), (*(facts.get(f) for f in self.FACTS), [(n, stage) for stage, (n, _) in facts["completed"].items()]))
            yield self._row(key[0], source, facts)
        if ended:
            self.files.clear()

    def _held(self, source: str) -> dict:
        found = self.files.getValue((source,)) if self.files.exists() and self.files.containsKey((source,)) else None
        if found is None:
            return {"completed": {}}
        *facts, completed = found
        return {name: tuple(f) for name, f in zip(self.FACTS, facts, strict=True) if f is not None} | {"completed": {stage: (n, None) for n, stage in completed}}

    @staticmethod
    def _row(job_id, source: str, facts: dict) -> Row:
        value = lambda name: facts.get(name, (-1, None))
        at, stage = value("started")
        # At work is the stage that started last, unless it completed since or the file ended.
        working = at > value("over")[0] and at > facts["completed"].get(stage, (-1, None))[0]
        return Row(job_id=job_id, source=source, state=value("over")[1] or "running", message=value("said")[1] or "", error=value("failed")[1], current=stage if working else None, done=sorted(facts["completed"]))


def file_state_stream(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """The rows of file_states() that a batch of a stream of events changes, in whatever order events come; stage_rows()
    takes them. The end of a job ends the state of its files; a job that never ends loses it after idle_ms without events."""
    return stateful(events.select("job_id", "event_id", "source", "stage", "status", "message"), "job_id", FileStates(idle_ms), FILE)


def fresh_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of events without repetitions of (job_id, event_id). events: ts is a timestamp (not NTZ)."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "event_id"])


def estimated_stream(events: DataFrame, speeds: DataFrame) -> DataFrame:
    """A stream of events with estimates from a table of one learned speed."""
    fits = (F.col("stage") == "transcribing") & (F.col("status") == "started") & (F.col("media_seconds") > 0)
    return events.join(F.broadcast(speeds), F.lit(True), "left").withColumn("estimated_seconds", F.when(fits, F.greatest(F.lit(0.1), F.bround(F.col("media_seconds") / F.col("speed"), 1)))).drop("speed")
