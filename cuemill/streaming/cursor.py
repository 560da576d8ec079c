"""A job's events behind a cursor: a stream source whose offset is the event's id, and frames with keep-alives.

The source reads a folder of Parquet files with the columns of EVENTS, to which whatever runs the job adds files. Its offset
is the id of the last event read, so a restart from a checkpoint goes on behind it, whatever files hold what, and a client
that knows the last id it saw starts behind that one. A batch is read in spans of SPAN ids. The source ends at the job's end:
events behind it are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuemill.streaming.progress import ENDED
from cuemill.streaming.state import IDLE_MS, in_order, stateful

EVENTS = "job_id string, event_id bigint, source string, stage string, status string, message string"
FRAME = "job_id string, event_id bigint, frame string"
SPAN = 10_000
#: What is sent when nothing has happened for so long.
KEEP_ALIVE, SILENCE_MS = ": keep-alive\n\n", 15_000


class Span(InputPartition):
    """Events with ids in (after, upto]."""

    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.job, self.after = options["path"], options["job"], int(options.get("after", 0))
        self.at = self.after

    def _found(self, after: int, columns: list[str], upto: int | None = None):
        own = (pads.field("job_id") == self.job) & (pads.field("event_id") > after)
        found = pads.dataset(self.path, format="parquet")
        return found.to_table(columns=columns, filter=own if upto is None else own & (pads.field("event_id") <= upto))

    def initialOffset(self) -> dict:
        return {"event_id": self.after}

    def latestOffset(self) -> dict:
        """The job's end, or its last event so far. It doesn't depend on what was read, which only the checkpoint knows after
        a restart; at saves looking at the same events again."""
        rows = self._found(self.at, ["event_id", "source", "stage"]).to_pylist()
        ends = [r["event_id"] for r in rows if r["source"] is None and r["stage"] in ENDED]
        last = min(ends) if ends else max((r["event_id"] for r in rows), default=self.at)
        self.at = self.at if ends else last
        return {"event_id": last}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        cuts = [*range(start["event_id"], end["event_id"], SPAN), end["event_id"]]
        return [Span(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: Span) -> Iterator[tuple]:
        names = [c.split()[0] for c in EVENTS.split(", ")]
        found = self._found(partition.after, names, partition.upto).sort_by("event_id")
        yield from (tuple(r[n] for n in names) for r in found.to_pylist())


class JobEvents(DataSource):
    """Options: path, job, after (0: from the start)."""

    @classmethod
    def name(cls) -> str:
        return "job_events"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def job_events(spark: SparkSession, path: str, job: str, after: int = 0) -> DataFrame:
    """The stream of a job's events with ids above after."""
    spark.dataSource.register(JobEvents)
    return spark.readStream.format("job_events").option("path", path).option("job", job).option("after", after).load()


class Frames(StatefulProcessor):
    """Keeps of each job when its next keep-alive is due, until the job ends."""

    def __init__(self, silence_ms: int, idle_ms: int):
        self.silence_ms, self.idle_ms = silence_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at bigint", self.idle_ms)

    def _again(self, timerValues) -> None:
        at = timerValues.getCurrentProcessingTimeInMs() + self.silence_ms
        self.handle.registerTimer(at)
        self.due.update((at,))

    def _stop(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._stop()
        over = False
        for r in in_order(rows, "event_id"):
            over |= r["over"]
            yield Row(job_id=key[0], event_id=r["event_id"], frame=r["frame"])
        if not over:
            self._again(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # State that was idle for too long is gone, and with it the reason to go on.
        if self.due.exists():
            self._again(timerValues)
            yield Row(job_id=key[0], event_id=None, frame=KEEP_ALIVE)


def frames(events: DataFrame, silence_ms: int = SILENCE_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """job_id, event_id, frame: server-sent events of a stream of events, and a comment without an id each time a job has been
    silent for silence_ms. After a job's end nothing more comes of it."""
    payload = F.to_json(F.struct("job_id", "source", "stage", "status", "message"), {"ignoreNullFields": "false"})
    frame = F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), F.col("stage"), F.lit("\ndata: "), payload, F.lit("\n\n"))
    made = events.select("job_id", "event_id", frame.alias("frame"), (F.col("source").isNull() & F.col("stage").isin(*ENDED)).alias("over"))
    return stateful(made, "job_id", Frames(silence_ms, idle_ms), FRAME, "append")
