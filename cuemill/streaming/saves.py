"""The save queue of an editor: changes wait for a pause, one save is under way at a time, and what a failed save held goes
back under newer changes of the same lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuemill.streaming.state import IDLE_MS, in_order, stateful

SAVE = "job_id string, save bigint, at bigint, changes array<struct<idx:int,text:string>>"
DELAY_MS = 800
#: What the rows of a queue can be: a line's new text (null: the original again), a line that holds nothing to save, a wish to
#: save now, and how the save under way ended.
SET, DROP, NOW, SAVED, FAILED = "set", "drop", "now", "saved", "failed"


@dataclass
class Queue:
    """One job's queue at a moment. step() returns what to send, if anything."""

    waiting: dict[int, str | None] = field(default_factory=dict)
    sent: dict[int, str | None] | None = None
    due: int | None = None
    #: Was a save asked for while one was under way? Did the last one fail?
    asked: bool = False
    failed: bool = False

    def step(self, kind: str, at: int, idx: int | None = None, text: str | None = None, delay: int = DELAY_MS) -> dict | None:
        if kind == SET:
            self.waiting[idx] = text
            self.due = at + delay
        elif kind == DROP:
            self.waiting.pop(idx, None)
            self.due = self.due if self.waiting else None
        elif kind == NOW:
            self.due = None
            return self._send()
        elif self.sent is not None:
            return self._ended(kind == FAILED)
        return None

    def _send(self) -> dict | None:
        if self.sent is not None:
            self.asked = True
        elif self.waiting:
            self.sent, self.waiting, self.failed = self.waiting, {}, False
            return self.sent
        return None

    def _ended(self, failed: bool) -> dict | None:
        # A failed batch waits for the next wish; otherwise go on if asked to, or if changes wait that no pause is due for.
        if failed:
            self.waiting = {**self.sent, **self.waiting}
        more = not failed and (self.asked or self.due is None)
        self.sent, self.asked, self.failed = None, False, failed
        return self.step(NOW, 0) if more and self.waiting else None


class Saves(StatefulProcessor):
    """Keeps each job's queue and the number of its saves. The pause is a timer of the stream's clock."""

    def __init__(self, delay: int, clock: str, idle_ms: int | None):
        self.delay, self.clock, self.idle_ms = delay, clock, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        line = "array<struct<idx:int,text:string>>"
        self.kept = handle.getValueState("queue", f"saves bigint, waiting {line}, sent {line}, due bigint, asked boolean, failed boolean", self.idle_ms)

    def _load(self) -> tuple[int, Queue]:
        if not self.kept.exists():
            return 0, Queue()
        saves, waiting, sent, due, asked, failed = self.kept.get()
        lines = lambda x: None if x is None else {i: t for i, t in x}
        return saves, Queue(lines(waiting), lines(sent), due, asked, failed)

    def _store(self, saves: int, q: Queue, was: int | None) -> None:
        if was != q.due:
            if was is not None:
                self.handle.deleteTimer(was)
            if q.due is not None:
                self.handle.registerTimer(q.due)
        lines = lambda x: None if x is None else list(x.items())
        self.kept.update((saves, lines(q.waiting), lines(q.sent), q.due, q.asked, q.failed))

    def _row(self, job: str, saves: int, at: int, sent: dict) -> Row:
        return Row(job_id=job, save=saves, at=at, changes=[Row(idx=i, text=t) for i, t in sorted(sent.items())])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        saves, q = self._load()
        was = q.due
        for r in in_order(rows, "at", "seq"):
            at = r["at"] if self.clock == "EventTime" else timerValues.getCurrentProcessingTimeInMs()
            steps = [(r["kind"], at, r["idx"], r["text"])]
            if q.due is not None and q.due <= at:  # the pause ended before this row
                steps.insert(0, (NOW, q.due, None, None))
            for kind, when, idx, text in steps:
                sent = q.step(kind, when, idx, text, self.delay)
                if sent is not None:
                    saves += 1
                    yield self._row(key[0], saves, when, sent)
        self._store(saves, q, was)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        saves, q = self._load()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if q.due == at:
            sent = q.step(NOW, at)
            if sent is not None:
                saves += 1
                yield self._row(key[0], saves, at, sent)
            self._store(saves, q, None)


def saves(changes: DataFrame, delay: int = DELAY_MS, clock: str = "ProcessingTime", idle_ms: int = IDLE_MS) -> DataFrame:
    """job_id, save (from 1 in a job), at (ms), changes by line: what each save of a stream of changes sends.

    changes: job_id, at (ms), seq, kind, idx, text; rows saved and failed tell how the save under way ended. By processing
    time, a row counts from when it comes and timers end the pauses. With clock EventTime, which needs a watermark, at counts,
    and a pause ends at the first row behind it or when the watermark passes it.
    """
    return stateful(changes, "job_id", Saves(delay, clock, idle_ms if clock == "ProcessingTime" else None), SAVE, "append", clock)
