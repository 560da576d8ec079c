"""Streams with state give what batches over all their rows give, however they are cut, and end their state."""

import json
import os
import random
import re
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cuemill.streaming import cursor, progress, saves, sse

EVENTS = "job_id string, event_id bigint, source string, stage string, status string, message string, at double, estimated_seconds double"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def stream(spark, schema, files, query, mode, tmp_path):
    """Rows of a streaming query over JSON files that come one at a time."""
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for i, lines in enumerate(files):
        (tmp_path / f"in/{i}.json").write_text("\n".join(map(json.dumps, lines)))
        os.utime(tmp_path / f"in/{i}.json", (i, i))
    out = []
    run = query(source).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="50 milliseconds").foreachBatch(lambda df, _: out.extend(df.collect())).start()
    try:
        # With timers a stream has batches without rows too, so processAllAvailable() would wait for ever.
        for _ in range(1200):
            ends = [str(p["sources"][0]["endOffset"]) for p in run.recentProgress]
            if any(re.search(rf"logOffset\W+{len(files) - 1}\b", end) for end in ends) or run.exception():
                break
            time.sleep(0.1)
        assert run.exception() is None
    finally:
        run.stop()
    return out


def test_streams_equal_batches(spark, tmp_path):
    names = [c.split()[0] for c in EVENTS.split(", ")]
    e = [("j", 1, "a", "transcribing", "started", "", 0.0, 10.0), ("j", 2, "b", "transcribing", "started", "", 5.0, 30.0), ("j", 3, "a", "transcribing", "completed", "", 12.0, None), ("k", 1, "c", "transcribing", "started", "", 1.0, None)]
    (tmp_path / "bars").mkdir()
    got = stream(spark, EVENTS, [[dict(zip(names, x, strict=True))] for x in e], progress.bar_stream, "update", tmp_path / "bars")
    last = {r["job_id"]: tuple(r) for r in got}
    want = {r["job_id"]: tuple(r) for r in progress.bars(spark.createDataFrame(e, EVENTS)).collect()}
    assert last == want
    (tmp_path / "sse").mkdir()
    frames = "id: 1\r\ndata: x\r\n\r\nevent: b\ndata: y\n\ndata: tail"
    chunks = [[{"stream_id": "s", "seq": i, "text": frames[i * 7 : i * 7 + 7]}] for i in range(7)]
    got = stream(spark, "stream_id string, seq bigint, text string", chunks, sse.event_stream, "append", tmp_path / "sse")
    assert [(r["n"], r["id"], r["event"], r["data"]) for r in got] == [(0, "1", "message", "x"), (1, "1", "b", "y")]


def test_repeated_events_come_once(spark, tmp_path):
    line = {"job_id": "j", "event_id": 1, "ts": "2024-01-01T00:00:00.000Z"}
    got = stream(spark, "job_id string, event_id bigint, ts timestamp", [[line, line], [line]], progress.fresh_events, "append", tmp_path)
    assert len(got) == 1




def event_log(rng, jobs=4, size=120, ends=()):
    """Events of jobs with files that start, end and start again; jobs in ends get an end of their own, last."""
    names = [c.split()[0] for c in EVENTS.split(", ")]
    log, at = [], dict.fromkeys(range(jobs), 0)

    def add(job, source, stage, status):
        at[job] += 1
        log.append(dict(zip(names, (f"j{job}", at[job], source, stage, status, rng.choice(["", "m1", "m2", None]), at[job] * 1.5, rng.choice([None, 10.0, 40.0])), strict=True)))

    for _ in range(size):
        stage = rng.choice(["queued", "validating", "transcribing", "transcribing", "transcribing", "translating", "rendering", "completed", "failed", "cancelled", "own"])
        add(rng.randrange(jobs), rng.choice(["a", "b", "c", None]) if stage != "cancelled" else "a", stage, rng.choice(["started", "started", "completed", "running"]))
    log = [e for e in log if e["source"] is not None or e["stage"] not in progress.ENDED]
    for job in ends:
        add(job, None, "completed", "completed")
    return log


def cut(rng, log):
    """The log in micro-batches; inside one, rows come in any order."""
    files, i = [], 0
    while i < len(log):
        n = rng.randrange(1, 30)
        files.append(rng.sample(log[i : i + n], len(log[i : i + n])))
        i += n
    return files


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_file_states_as_a_stream(spark, tmp_path, seed):
    rng = random.Random(seed)
    log = event_log(rng, ends=(1, 3))
    got = stream(spark, EVENTS, cut(rng, log), progress.file_state_stream, "update", tmp_path)
    last = {(r["job_id"], r["source"]): r for r in got}
    made = spark.createDataFrame(list(last.values()), progress.FILE)
    want = progress.file_states(spark.createDataFrame(log, EVENTS))
    columns = [c.split()[0] for c in progress.FILE.split(", ")]
    assert sorted(map(str, rows(made, *columns))) == sorted(map(str, rows(want, *columns)))
    assert sorted(rows(progress.stage_rows(made), "*")) == sorted(rows(progress.stage_rows(want), "*"))
    # What is left in the state belongs to jobs that go on.
    left = spark.read.format("statestore").option("stateVarName", "files").option("path", str(tmp_path / "check")).load()
    assert {r["key"]["job_id"] for r in left.collect()} == {"j0", "j2"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bars_as_a_stream(spark, tmp_path, seed):
    rng = random.Random(seed)
    log = event_log(rng, ends=(2,))
    got = stream(spark, EVENTS, cut(rng, log), progress.bar_stream, "update", tmp_path)
    last = {r["job_id"]: r for r in got}
    want = {r["job_id"]: r for r in progress.bars(spark.createDataFrame(log, EVENTS)).collect()}
    assert want and all(tuple(last[j]) == tuple(r) for j, r in want.items())
    left = spark.read.format("statestore").option("stateVarName", "bar").option("path", str(tmp_path / "check")).load()
    assert {r["key"]["job_id"] for r in left.collect()} == set(want) - {"j2"}


class PlainBar:
    """The shared bar by its description: who is at work, since when the present group has been, and what each expects."""

    def __init__(self):
        self.group, self.since = {}, None

    def see(self, e):
        if e["source"] is None:
            return
        if e["stage"] == "transcribing" and e["status"] == "started":
            self.since = e["at"] if not self.group else self.since
            self.group[e["source"]] = SimpleNamespace(works=True, estimate=e["estimated_seconds"])
        elif e["stage"] in progress.ENDED or (e["stage"], e["status"]) == ("transcribing", "completed"):
            if e["source"] in self.group:
                self.group[e["source"]].works = False
            if not any(f.works for f in self.group.values()):
                self.group = {}

    def row(self, job, now):
        known = [f.estimate for f in self.group.values()]
        elapsed, total = now - self.since, None if None in known else sum(known)
        return (job, len(known), self.since, elapsed, total, total is None, None if total is None else min(0.99, elapsed / total), total is not None and elapsed >= total)


@pytest.mark.parametrize("seed", range(4))
def test_bars_by_their_description(spark, seed):
    log = event_log(random.Random(seed), jobs=12, size=400)
    want = []
    for job in {e["job_id"] for e in log}:
        bar, own = PlainBar(), sorted((e for e in log if e["job_id"] == job), key=lambda e: e["event_id"])
        for e in own:
            bar.see(e)
        if bar.group:
            want.append(bar.row(job, own[-1]["at"]))
    columns = [c.split()[0] for c in progress.BAR.split(", ")]
    assert sorted(rows(progress.bars(spark.createDataFrame(log, EVENTS)), *columns)) == sorted(want)


def test_event_streams_cut_anywhere(spark):
    """Windows over chunks, of one character or more, give what the whole text gives."""
    rng = random.Random(11)
    texts, chunks = {}, []
    for k in range(120):
        text = "".join(rng.choice(["data: a", "data", "data:", "id: 1", "id:x\0", "id", "\r", "\n", "\r\n", "\n\n", "event: e", ": c", "data: ", "x", "data:b: c", "é"]) for _ in range(rng.randrange(1, 40)))
        size, i, seq = rng.choice([1, 1, 2, 5, 50]), 0, 0
        while i < len(text):
            chunks.append((f"s{k}", seq, text[i : i + size]))
            if rng.random() < 0.2:
                seq += 1
                chunks.append((f"s{k}", seq, rng.choice(["", None])))
            i, seq = i + size, seq + 1
        texts[f"s{k}"] = text
    got = rows(sse.events(spark.createDataFrame(rng.sample(chunks, len(chunks)), "stream_id string, seq int, text string")), "stream_id", "n", "id", "event", "data")
    assert sorted(map(str, got)) == sorted(str((k, *e)) for k, text in texts.items() for e in sse.Reader().feed(text))


def test_long_event_stream(spark):
    """A stream of many chunks is never one value, nor is any but an event longer than a chunk."""
    size, n = 4096, 5000
    body = F.concat(F.lit("id: "), F.col("id"), F.lit("\ndata: "), F.repeat(F.lit("x"), 70), F.lit("\n\n"))
    text = spark.range(n * size // 100).select((F.col("id") * 100 / size).cast("bigint").alias("seq"), "id", F.rpad(body, 100, "\n").alias("t")).groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]), "").alias("text"))
    made = sse.events(text.select(F.lit("s").alias("stream_id"), "seq", "text"))
    total, ids, longest = made.agg(F.count("*"), F.count_distinct("id"), F.max(F.length("data"))).first()
    assert total == ids == n * size // 100 and longest == 70


class PlainQueue:
    """The queue as a schedule in time: what happens when, with a pause as an event of its own."""

    def __init__(self, delay):
        self.delay, self.pending, self.flying, self.timer, self.rerun, self.error, self.out = delay, {}, None, None, False, False, []

    def run(self, at):
        self.timer = None
        if self.flying is not None:
            self.rerun = True
        elif self.pending:
            self.flying, self.pending, self.error = self.pending, {}, False
            self.out.append((len(self.out) + 1, at, sorted(self.flying.items())))

    def until(self, at):
        if self.timer is not None and self.timer <= at:
            self.run(self.timer)

    def see(self, kind, at, idx, text):
        self.until(at)
        if kind == saves.SET:
            self.pending[idx], self.timer = text, at + self.delay
        elif kind == saves.DROP:
            self.pending.pop(idx, None)
            self.timer = self.timer if self.pending else None
        elif kind == saves.NOW:
            self.run(at)
        elif self.flying is not None:
            old, self.flying = self.flying, None
            if kind == saves.FAILED:
                self.error = True
                for i, t in old.items():
                    self.pending.setdefault(i, t)
            again = self.rerun or (bool(self.pending) and self.timer is None and not self.error)
            self.rerun = False
            if again and not self.error and self.pending:
                self.run(at)


def schedule(rng, size=60):
    """Random changes and outcomes, with pauses longer and shorter than the delay."""
    rows, at = [], 0
    for seq in range(size):
        at += rng.choice([0, 50, 300, 799, 800, 801, 2500])
        kind = rng.choice([saves.SET] * 6 + [saves.DROP, saves.NOW, saves.SAVED, saves.SAVED, saves.FAILED, saves.FAILED])
        rows.append({"at": at, "seq": seq, "kind": kind, "idx": rng.randrange(4), "text": rng.choice([None, "a", "b", "c"])})
    return rows


def test_save_queue_equals_the_plain_one():
    """Thousands of schedules, without a stream."""
    for seed in range(3000):
        rows_ = schedule(random.Random(seed))
        plain, q, out = PlainQueue(800), saves.Queue(), []
        for r in rows_:
            plain.see(r["kind"], r["at"], r["idx"], r["text"])
            steps = [(saves.NOW, q.due, None, None)] if q.due is not None and q.due <= r["at"] else []
            for kind, at, idx, text in [*steps, (r["kind"], r["at"], r["idx"], r["text"])]:
                sent = q.step(kind, at, idx, text)
                if sent is not None:
                    out.append((len(out) + 1, at, sorted(sent.items())))
        assert out == plain.out, seed


def test_saves_as_a_stream(spark, tmp_path):
    """Timers of event time; jobs at once, in micro-batches with rows in any order."""
    rng = random.Random(5)
    log, want = [], {}
    for job in ("a", "b", "c"):
        own = schedule(rng)
        plain = PlainQueue(800)
        for r in own:
            plain.see(r["kind"], r["at"], r["idx"], r["text"])
        plain.until(10**9)
        want[job] = plain.out
        log += [{"job_id": job, **r} for r in own]
    log.sort(key=lambda r: r["at"])
    files = cut(rng, log)
    # A later row of another job lets the watermark pass the last pauses.
    files += [[{"job_id": "z", "at": 10**8 + i, "seq": i, "kind": saves.SAVED, "idx": 0, "text": None}] for i in range(2)]
    made = lambda df: saves.saves(df.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", "0 seconds"), clock="EventTime")
    got = stream(spark, "job_id string, at bigint, seq int, kind string, idx int, text string", files, made, "append", tmp_path)
    found = {job: sorted((r["save"], r["at"], [tuple(c) for c in r["changes"]]) for r in got if r["job_id"] == job) for job in want}
    assert found == want and all(want.values())


def test_saves_by_the_clock(spark, tmp_path):
    """A pause of processing time ends by its timer, without another row."""
    files = [[{"job_id": "j", "at": 0, "seq": i, "kind": saves.SET, "idx": i, "text": "x"} for i in range(3)]]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("job_id string, at bigint, seq int, kind string, idx int, text string").json(str(tmp_path / "in"))
    (tmp_path / "in/0.json").write_text("\n".join(map(json.dumps, files[0])))
    out = []
    run = saves.saves(source, delay=300).writeStream.option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="100 milliseconds").foreachBatch(lambda df, _: out.extend(df.collect())).start()
    try:
        assert wait(lambda: out)
    finally:
        run.stop()
    assert [[tuple(c) for c in r["changes"]] for r in out] == [[(0, "x"), (1, "x"), (2, "x")]]


def wait(until, seconds=60):
    end = time.time() + seconds
    while not until() and time.time() < end:
        time.sleep(0.1)
    return until()


def test_cursor_after_a_restart(spark, tmp_path):
    """Nothing is lost or repeated, an id says where to start, and the job's end is the end."""
    path, n = str(tmp_path / "events"), 0

    def add(*stages, job="j"):
        nonlocal n
        rows_ = [(job, n + i + 1, None if s in progress.ENDED else "f", s, "started", "") for i, s in enumerate(stages)]
        n += len(rows_)
        spark.createDataFrame(rows_, cursor.EVENTS).coalesce(1).write.mode("append").parquet(path)

    def read(check, after=0, enough=0):
        out = []
        run = cursor.job_events(spark, path, "j", after).writeStream.option("checkpointLocation", str(tmp_path / check)).trigger(processingTime="50 milliseconds").foreachBatch(lambda df, _: out.extend(r["event_id"] for r in df.collect())).start()
        try:
            wait(lambda: len(out) >= enough or run.exception())
            time.sleep(1)
            assert run.exception() is None
        finally:
            run.stop()
        return sorted(out)

    add("validating", "probing", "transcribing")
    add("validating", job="other")
    assert read("a", enough=3) == [1, 2, 3]
    add("rendering")
    add("completed", "queued", "queued")
    assert read("a", enough=2) == [5, 6]
    assert read("a") == [] and read("b", after=3, enough=2) == [5, 6] and read("c", after=6, enough=2) == [7, 8]


def test_frames_and_keep_alives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = lambda job, n, stage: json.dumps({"job_id": job, "event_id": n, "source": None if stage in progress.ENDED else "f", "stage": stage, "status": "s", "message": "m"})
    (tmp_path / "in/0.json").write_text("\n".join([event("over", 1, "probing"), event("over", 2, "completed"), event("on", 1, "probing")]))
    out = []
    events = spark.readStream.schema(cursor.EVENTS).json(str(tmp_path / "in"))
    run = cursor.frames(events, silence_ms=400).writeStream.option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="100 milliseconds").foreachBatch(lambda df, _: out.extend(df.collect())).start()
    try:
        assert wait(lambda: len(out) >= 6)
        (tmp_path / "in/1.json").write_text(event("on", 2, "failed"))
        assert wait(lambda: any(r["event_id"] == 2 and r["job_id"] == "on" for r in out))
        time.sleep(1.5)
        alive = [r["job_id"] for r in out if r["frame"] == cursor.KEEP_ALIVE]
        assert len(alive) >= 3 and set(alive) == {"on"} and out[-1]["event_id"] == 2
    finally:
        run.stop()
    assert [r["frame"] for r in out if r["job_id"] == "over"] == ['id: %d\nevent: %s\ndata: {"job_id":"over","source":%s,"stage":"%s","status":"s","message":"m"}\n\n' % (n, s, f, s) for n, s, f in ((1, "probing", '"f"'), (2, "completed", "null"))]
