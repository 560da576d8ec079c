"""Jobs, storage, identity, JSON sources and streams on small hand-written cases."""

import hashlib
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuemill.functions import rules
from cuemill.operators import edits, identity, jobs, storage, validate
from cuemill.sources import ingest, sinks
from cuemill.streaming import progress, sse


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


def test_recogniser_shapes(spark):
    payloads = {
        "aliases": {"transcript": "Hi there", "words_info": {"words": [{"word": "Hi", "start_time": 0, "end_time": "0.5"}, {"word": "there", "start_time": 1, "end_time": 2, "confidence": 0.9, "speaker_tag": 2}]}},
        "nested": {"results": [{"x": 1}, {"result": {"alternatives": [{"text": "", "tokens": [{"token": " a ", "begin": 0, "finish": 1, "language_code": ""}]}, {}]}}], "language": "en"},
        "empty words": {"words": [], "tokens": [{"token": "a", "start": 0, "end": 1}]},
        "no words": {"text": "x"},
        "no time": {"words": [{"word": "a", "start": 0}]},
        "list": [1],
    }
    raw = spark.createDataFrame([(k, json.dumps(v), None) for k, v in payloads.items()] + [("bad", "{", None)], "job_id string, payload string, duration double")
    got = {r["job_id"]: r for r in ingest.transcripts(raw).collect()}
    assert {k: r["fault"] for k, r in got.items()} == {"aliases": None, "nested": None, "empty words": "words", "no words": "words", "no time": "word", "list": "object", "bad": "object"}
    assert got["aliases"]["text"] == "Hi there" and [(w["text"], w["start"], w["end"], w["confidence"], w["speaker"], w["language"]) for w in got["aliases"]["words"]] == [("Hi", 0.0, 0.5, None, None, None), ("there", 1.0, 2.0, 0.9, "2", None)]
    assert (got["nested"]["text"], got["nested"]["language"]) == ("a", "en") and got["nested"]["words"][0]["language"] is None


def test_probe_and_printed_json(spark):
    payload = json.dumps({"format": {"duration": "3.0"}, "streams": [{"index": 0, "codec_type": "video"}, {"index": 1, "codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2}, {"index": 2, "codec_type": "audio", "sample_rate": ""}]})
    r = ingest.probes(spark.createDataFrame([("a", payload)], "path string, payload string")).first()
    assert r["duration"] == 3.0 and [tuple(s) for s in r["streams"]] == [(1, "aac", 48000, 2), (2, "unknown", None, None)]
    assert one(spark, F.to_json(ingest.printed_json(F.lit('log\n{"a":1}\nmore\n')))) == '{"a":1}'
    assert one(spark, rules.pick_stream(F.lit(None).cast("array<struct<index:int>>"), F.lit(1))) is None


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/manifest.json").write_text(json.dumps({"schema_version": 1, "job_id": "j", "state": "completed", "source": {"path": "/x.wav"}, "timings": {"inference_seconds": 2.0}, "media": {"duration": 20.0}, "artifacts": {"srt": {"path": "s.srt", "size": 3, "sha256": "h"}, "odd": 5}}))
    (tmp_path / "manifest.json").write_text("{broken")
    (tmp_path / "b").mkdir()
    (tmp_path / "b/manifest.json").write_text(json.dumps({"schema_version": 2, "state": "completed"}))
    m = ingest.manifests(ingest.documents(spark, str(tmp_path), "manifest.json"))
    assert rows(m, "job_id", "state", "state_detail", "source_path", "media_seconds") == [("j", "completed", "completed", "/x.wav", 20.0)]
    assert rows(ingest.manifest_artifacts(m), "name", "file", "size", "sha256") == [("srt", "s.srt", 3, "h")]
    (tmp_path / "x.WAV").write_bytes(b"1")
    (tmp_path / "y.txt").write_bytes(b"2")
    found = ingest.media_files(spark, str(tmp_path), recursive=True)
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["x.WAV"]
    hashes = identity.hashed_files(spark.read.format("binaryFile").load(str(tmp_path / "x.WAV")))
    assert rows(hashes, "size", "sha256") == [(1, hashlib.sha256(b"1").hexdigest())]


def test_translations_edits_and_hash_documents(spark):
    docs = spark.createDataFrame([("p", json.dumps({"schema_version": 1, "source_transcript_sha256": "s", "edited_indices": [1, 2], "segments": [{"index": 0, "text": "a"}, {"index": 1, "text": "b"}, {"index": 2}]}))], "path string, doc string").withColumn("doc", F.parse_json("doc"))
    made = ingest.edit_documents(docs).withColumn("job_id", F.lit("j"))
    for sha, want in (("s", [("j", 1, "b")]), ("old", [])):
        assert rows(edits.current_edits(made, spark.createDataFrame([("j", sha)], "job_id string, sha string")), "job_id", "idx", "text") == want
    batch = spark.createDataFrame([(10, '[{"text":"x"},{"text":"y"}]')], "first int, payload string")
    assert rows(ingest.translation_batch(batch), "ordinal", "text") == [(10, "x"), (11, "y")]
    cache = spark.createDataFrame([(json.dumps({"version": 1, "entries": {"/a": {"size": 1, "mtime_ns": 2, "sha256": "h", "recorded_ns": 3}, "/b": {"size": 1}}}),)], "doc string").withColumn("doc", F.parse_json("doc"))
    assert rows(ingest.cached_hashes(cache), "path", "recorded_ns") == [("/a", 3)]
    assert ingest.cached_hashes(cache, 2).count() == 0


def test_adapter(spark):
    def fake(frames):
        for f in frames:
            yield pd.DataFrame({"job_id": f["job_id"], "payload": '{"words":[{"word":"a","start":0,"end":1}]}', "duration": 1.0})

    audio = spark.createDataFrame([("a",), ("b",)], "job_id string")
    assert sorted(rows(ingest.transcripts(ingest.recognised(audio, fake)), "job_id", "text")) == [("a", "a"), ("b", "a")]


def test_speeds_and_estimates(spark):
    timing = lambda **k: F.create_map(*[F.lit(x) if not isinstance(x, type(None)) else F.lit(None).cast("double") for p in k.items() for x in p]).cast("map<string,double>")
    cases = [(20.0, timing(inference_seconds=10.0), 2.0), (40.0, timing(batch_inference_seconds=40.0, batch_size=4.0), 4.0), (20.0, timing(inference_seconds=0.0), None), (20.0, timing(inference_seconds=-1.0), None), (0.0, timing(inference_seconds=1.0), None), (None, timing(inference_seconds=1.0), None), (20.0, timing(inference_seconds=None, batch_inference_seconds=4.0, batch_size=1.0), None), (20.0, timing(batch_inference_seconds=4.0), None), (20.0, timing(batch_inference_seconds=4.0, batch_size=0.0), None)]
    for media, timings, want in cases:
        assert one(spark, jobs.speed(F.lit(media).cast("double"), timings)) == want
    samples = spark.createDataFrame([(f"t{i}", 20.0 / x) for i, x in enumerate((0.2, 20, 10, 10, 5, 4))], "updated_at string, value double")
    events = spark.createDataFrame([("transcribing", "started", 30.0), ("transcribing", "started", 0.001), ("transcribing", "completed", 30.0), ("probing", "started", 30.0), ("transcribing", "started", None)], "stage string, status string, media_seconds double")
    assert sorted(rows(jobs.estimates(events, samples), "estimated_seconds"), key=str) == sorted([(15.0,), (0.1,), (None,), (None,), (None,)], key=str)
    assert rows(jobs.estimates(events, samples.limit(0)), "estimated_seconds") == [(None,)] * 5
    runs = spark.createDataFrame([(5.0, 2.0), (4.0, 1.0), (6.0, 3.0)], "total double, inference double")
    assert rows(jobs.benchmark_summary(runs, 600.0), "total", "inference", "speed") == [(5.0, 2.0, 120.0)]
    assert [one(spark, jobs.speed_text(F.lit(x))) for x in (157.43, 10.0, 3.24)] == ["157", "10", "3.2"]
    assert rows(sinks.benchmark_table(spark.createDataFrame([("cpu", 5.0, 2.0, 3.24)], "device string, total double, inference double, speed double")), "line") == [("| cpu | 5.00 s | 2.00 s | 3.2× |",)]


def test_outcomes_and_pages(spark):
    r = spark.createDataFrame([("a", 1, "completed", None), ("a", 2, "failed", "bad"), ("a", 3, "failed", "worse"), ("b", 1, "cancelled", None), ("b", 2, "failed", "x"), ("c", 1, "completed", "")], "job_id string, pos int, state string, error string")
    assert sorted(rows(jobs.outcomes(r), "job_id", "state", "error")) == [("a", "failed", "bad"), ("b", "cancelled", "x"), ("c", "completed", None)]
    j = spark.createDataFrame([(str(i), "completed" if i % 2 else "failed", f"2024-01-0{1 + i // 4}") for i in range(8)], "id string, state string, submitted_at string")
    assert [x for (x,) in rows(jobs.listed(j, 1, 3), "id")] == ["6", "5", "4"]
    assert [x for (x,) in rows(jobs.listed(j, 0, 2, "failed"), "id")] == ["6", "4"]
    for bad in ((-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            jobs.listed(j, *bad)
    assert jobs.page_offset(40, 0, 30) == 20 and jobs.page_offset(0, 0, 0) == 0


def test_storage(spark):
    j = spark.createDataFrame([("new", 0), ("old", 1), ("none", 2)], "id string, pos int")
    folders = spark.createDataFrame([("new", "upload", 0, "/s/u1"), ("new", "output", 0, "/o/a/deep"), ("old", "output", 0, "/o/a/deep"), ("old", "output", 1, "/o/a")], "job_id string, kind string, pos int, path string")
    files = spark.createDataFrame([("/s/u1/x", 10, False), ("/o/a/deep/y", 5, False), ("/o/a/z", 2, False), ("/o/a/link", 99, True), ("/o/ab", 50, False)], "path string, size bigint, is_symlink boolean")
    # A parent that comes after its child counts in full, as its own folder.
    assert rows(storage.storage_report(j, folders, files), "id", "upload_bytes", "output_bytes", "total_bytes", "share") == [("new", 10, 5, 15, 0.6818), ("old", 0, 7, 7, 0.3182), ("none", 0, 0, 0, 0.0)]
    assert rows(storage.storage_report(j.limit(1), folders.limit(0), files), "total_bytes", "share") == [(0, 0.0)]


def test_catalog_and_groups(spark):
    results = spark.createDataFrame([("a", 1, "/1"), ("a", 2, "/2"), ("a", 3, "/3"), ("b", 1, "/4")], "job_id string, pos int, job_dir string")
    made = spark.createDataFrame([("/1", "srt", "s.srt"), ("/3", "txt", "t.txt"), ("/4", "srt", "x/s.srt"), ("/4", "bad", "../s")], "job_dir string, name string, path string").withColumns({"size": F.lit(1), "sha256": F.lit("h")})
    assert sorted(rows(jobs.artifact_catalog(results, made), "job_id", "name", "filename")) == [("a", "1.srt", "s.srt"), ("a", "3.txt", "t.txt"), ("b", "srt", "s.srt")]
    groups = jobs.artifact_groups(spark.createDataFrame([("a", "1.srt"), ("a", "3.edited.txt"), ("a", "9.srt"), ("a", "srt"), ("b", "srt")], "job_id string, name string"), spark.createDataFrame([("a", 3), ("b", 1)], "job_id string, results int"))
    assert sorted(rows(groups, "job_id", "result", "label"), key=str) == [("a", 1, "srt"), ("a", 2, None), ("a", 3, "edited.txt"), ("b", 1, "srt")]


def test_ids_equal_canonical_json(spark):
    rng = random.Random(3)
    for text in ['a"\\/\n\t\x01é😀Ж', "", "plain", "".join(chr(rng.randrange(1, 0xD000)) for _ in range(50))]:
        assert one(spark, identity.json_text(F.lit(text))) == json.dumps(text)
    options = {"b": None, "a": True, "n": 3, "s": "é"}
    want = hashlib.sha256(json.dumps({"source": "abc", "options": options}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    got = identity.content_id(F.lit("abc"), {"b": F.lit("null"), "a": F.lit("true"), "n": identity.json_number(F.lit(3)), "s": identity.json_text(F.lit("é"))})
    assert one(spark, got) == want
    assert one(spark, identity.mutation_key(F.lit("/a"), F.lit(None).cast("string"))) == hashlib.sha256(b"/a\0<default-output>").hexdigest()


def test_archives(spark):
    archives = spark.createDataFrame([("cpu", "linux", "x86_64", "a.zip", ["asr"]), ("cpu", "linux", "x86_64", "b.zip", ["asr", "diarize"])], "backend string, system string, architecture string, filename string, features array<string>")
    asked = spark.createDataFrame([(1, "cpu", "Linux", "X86_64", []), (2, "cpu", "Linux", "x86_64", ["diarize"]), (3, "cuda", "Linux", "x86_64", [])], "request_id int, backend string, system string, architecture string, features array<string>")
    assert sorted(rows(identity.matching_archives(asked, archives), "request_id", "matches", "filename")) == [(1, 2, None), (2, 1, "b.zip"), (3, 0, None)]
    models = spark.createDataFrame([("m", "0" * 40, None, None), ("m", "x", "y", "http://a")], "id string, revision string, sha256 string, url string")
    plain = archives.withColumns({"url": F.lit("https://a"), "sha256": F.lit("a" * 64)})
    assert sorted(rows(validate.registry_faults(models, plain), "kind", "id", "fault")) == [("model", "m", "duplicate"), ("model", "m", "duplicate")]


def test_rules(spark):
    assert [one(spark, rules.flag(F.lit(x))) for x in (" YES", "off", "maybe")] == [True, False, None]
    assert [one(spark, rules.language_code(F.lit(x))) for x in (" EN-us ", "e", "de_DE")] == ["en-us", None, None]
    assert [one(spark, rules.tool_ok(F.lit(x))) for x in ("cmake version 3.26.1", "cmake version 3.9", "cmake version 4.1", "none")] == [True, False, False, False]
    assert one(spark, rules.upload_folder(F.lit(f"/s/{'0' * 32}/a.wav"), "/s")) == f"/s/{'0' * 32}" and one(spark, rules.upload_folder(F.lit("/s/x/a.wav"), "/s")) is None
    assert [one(spark, rules.bundled_library(F.lit(x), ["libcu"])) for x in ("libcu.so", "libcu.so.12", "libcu.sox", "libx.so")] == [True, True, False, False]
    null = F.lit(None).cast("string")
    assert one(spark, rules.backend(F.lit("auto"), null, null, F.lit("cuda"), null)) == "cuda" and one(spark, rules.backend(F.lit("auto"), null, null, null, null)) == "cpu"
    assert one(spark, rules.path_list(F.lit(" a \r\n\n b"))) == ["a", "b"]
    assert [one(spark, rules.failure_kind(F.lit(x))) for x in (0, 3, 4, 9)] == [None, "model", "unsupported", "inference"]
    assert [one(spark, rules.languages_ok(F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b in ((None, None), ("en", "de"), ("en", "en"), ("en", None))] == [True, True, False, False]
    assert [one(spark, rules.valid_edit(F.lit(i), F.lit(t).cast("string"))) for i, t in ((0, "a"), (-1, "a"), (0, "  "), (0, None), (0, "x" * 1001))] == [True, False, False, True, False]


def test_library_issues(spark):
    edges = [("f", "libcudart.so.12", "/usr/lib/x"), ("f", "libc.so.6", "/usr/lib/c"), ("f", "libnccl.so.2", "/app/lib/n"), ("f", "libcuda.so.1", None), ("g", "libz.so", None), ("h", None, None)]
    table = spark.createDataFrame(edges, "file string, name string, target string")
    issues = lambda t, **k: identity.dependency_issues(t, "/app/lib/", **k).first()["issues"]
    assert issues(table) == ["libcuda.so.1", "libcudart.so.12", "libz.so"] and issues(table, host_driver=True) == ["libcudart.so.12", "libz.so"]
    assert issues(table.where("file = 'h'")) == [] and issues(table.limit(0)) == [identity.NO_FILES]


def test_event_streams_in_any_chunks(spark):
    """A stream cut anywhere gives what the whole text gives."""
    rng = random.Random(7)
    whole = lambda text: [e for e in sse.Reader().feed(text)]
    assert [e[3] for e in sse.Reader().feed("data: a\r\n\ndata: b\n\n")] == ["a", "b"]
    for _ in range(300):
        text = "".join(rng.choice(["data: a", "id: 1", "\r", "\n", "\r\n", "\n\n", "event: e", ": c", "data:"]) for _ in range(rng.randrange(1, 30)))
        for size in (1, 2, 5):
            reader, got = sse.Reader(), []
            for i in range(0, len(text), size):
                got += reader.feed(text[i : i + size])
                reader = sse.Reader(reader.kept())
            assert got == whole(text), text


def test_event_stream_text(spark):
    frames = ": note\r\nid: 1\r\nevent: a\r\ndata: x\r\n\r\nid: 2\ndata: one\ndata:two\n\ndata\n\nid: b\0ad\ndata: {\"k\": 1}\n\n\n\nevent: lost\n\ndata: tail"
    want = [("1", "a", "x"), ("2", "message", "one\ntwo"), ("2", "message", ""), ("2", "message", '{"k": 1}')]
    for size in (1, 2, 3, 7, 500):
        parts = [frames[i : i + size] for i in range(0, len(frames), size)]
        reader = sse.Reader()
        got = []
        for p in parts:
            got += reader.feed(p)
            reader = sse.Reader(reader.kept())
        assert [e[1:] for e in got] == want
        if size in (3, 500):
            table = spark.createDataFrame([("s", i, p) for i, p in enumerate(parts)], "stream_id string, seq int, text string")
            assert [r[1:] for r in sorted(rows(sse.events(table), "n", "id", "event", "data"))] == want


EVENTS = "job_id string, event_id bigint, source string, stage string, status string, message string, at double, estimated_seconds double"


def test_progress(spark):
    e = [("j", 1, "a", "transcribing", "started", "m1", 0.0, 10.0), ("j", 2, "b", "transcribing", "started", "m2", 5.0, 30.0), ("j", 3, None, "queued", "queued", "", 20.0, None)]
    assert rows(progress.bars(spark.createDataFrame(e, EVENTS)), "files", "elapsed", "estimate", "fraction", "overdue") == [(2, 20.0, 40.0, 0.5, False)]
    late = [*e[:1], ("j", 9, None, "queued", "queued", "", 99.0, None)]
    assert rows(progress.bars(spark.createDataFrame(late, EVENTS)), "fraction", "overdue") == [(0.99, True)]
    unknown = [*e[:1], ("j", 2, "b", "transcribing", "started", "", 1.0, None)]
    assert rows(progress.bars(spark.createDataFrame(unknown, EVENTS)), "indeterminate", "fraction") == [(True, None)]
    over = [*e[:1], ("j", 2, "a", "failed", "failed", "no", 3.0, None)]
    assert progress.bars(spark.createDataFrame(over, EVENTS)).count() == 0
    again = [*e[:1], ("j", 2, "a", "transcribing", "completed", "", 3.0, None), ("j", 3, "b", "transcribing", "started", "", 8.0, 4.0)]
    assert rows(progress.bars(spark.createDataFrame(again, EVENTS)), "files", "started_at") == [(1, 8.0)]
    states = progress.file_states(spark.createDataFrame([*e, ("j", 4, "a", "transcribing", "completed", "ok", 6.0, None), ("j", 5, "a", "translating", "started", "t", 7.0, None), ("j", 6, "b", "failed", "failed", "boom", 8.0, None)], EVENTS))
    assert sorted(rows(states, "source", "state", "message", "error", "current", "done")) == [("a", "running", "t", None, "translating", ["transcribing"]), ("b", "failed", "boom", "boom", None, [])]
    shown = {(r["source"], r["stage"]): r["status"] for r in progress.stage_rows(states).collect()}
    assert shown["a", "transcribing"] == "done" and shown["a", "translating"] == "active" and shown["b", "rendering"] == "pending" and ("b", "translating") not in shown


def test_files_to_write(spark, tmp_path):
    made = spark.createDataFrame([("j", "a.txt", "one\ntwo\n"), ("k", "b.srt", "x")], "job_id string, name string, content string")
    sinks.write_artifacts(made, str(tmp_path / "out"))
    found = {p.parent.name: p.read_text() for p in (tmp_path / "out").rglob("part-*")}
    assert found == {"name=a.txt": "one\ntwo\n", "name=b.srt": "x\n"}


def test_more_documents(spark, tmp_path):
    docs = spark.createDataFrame([("t", json.dumps({"text": "Hi", "duration": "2.5", "language": "", "words": [{"text": "Hi", "start": "0", "end": 1, "speaker": 1}], "segments": [{"text": "Hi", "start": 0, "end": 1}]})), ("v2", '{"schema_version": 2}'), ("bad", "nope")], "path string, s string").select("path", F.try_parse_json("s").alias("doc"))
    t = ingest.transcript_documents(docs).first()
    assert (t["path"], t["text"], t["duration"], t["language"]) == ("t", "Hi", 2.5, None)
    assert tuple(t["words"][0]) == (0, "Hi", 0.0, 1.0, None, "1", None) and tuple(t["segments"][0]) == (0, "Hi", 0.0, 1.0, None, 0, 0)
    assert sorted(rows(ingest.refused_manifests(docs), "path", "fault")) == [("bad", "unreadable"), ("t", "version"), ("v2", "version")]
    other = spark.createDataFrame([("x", '{"source_language":"en","target_language":"de","segments":[{"source_text":"a","text":"b","start":0,"end":1}]}')], "path string, s string").select("path", F.try_parse_json("s").alias("doc"))
    assert ingest.translation_documents(other).first()["segments"][0]["text"] == "b"
    (tmp_path / "b.wav").write_bytes(b"1")
    (tmp_path / "c.txt").write_bytes(b"1")
    got = [p.rsplit("/", 1)[-1] for (p,) in rows(ingest.discovered(spark, ["/z/A.bin"], [str(tmp_path)]), "path")]
    assert sorted(got) == ["A.bin", "b.wav"]
    with pytest.raises(ValueError):
        ingest.discovered(spark, [], [])


def test_workflow(spark):
    from cuemill.operators import workflow

    segments = spark.createDataFrame([("j", 0, "One.", 0.0, 0.4, None), ("j", 1, "Two.", 2.0, 2.4, None), ("k", 0, "x", 0.0, 1.0, None)], "job_id string, idx int, text string, start double, end double, speaker string")
    earlier = spark.createDataFrame([("j", 1, "Old")], "job_id string, idx int, text string")
    later = spark.createDataFrame([("j", 0, "Hello, world!"), ("k", 5, "y")], "job_id string, idx int, text string")
    for merge, text, indices in ((True, "Hello, world! Old\n", [0, 1]), (False, "Hello, world! Two.\n", [0])):
        faults, summary, files = workflow.saved_edits(segments, earlier, later, ("txt", "srt"), merge)
        assert rows(faults, "job_id", "idx", "fault") == [("k", 5, "missing")]
        assert rows(summary, "job_id", "edited_segments", "edited_indices") == [("j", len(indices), indices)]
        made = {n: c for n, c in rows(files, "name", "content")}
        assert set(made) == {"transcript.edited.json", "transcript.edited.txt", "subtitles.edited.srt"} and made["transcript.edited.txt"] == text
        assert json.loads(made["transcript.edited.json"])["edited_indices"] == indices
    undo = spark.createDataFrame([("j", 1, None)], "job_id string, idx int, text string")
    assert workflow.saved_edits(segments, earlier, undo, merge=True)[2].count() == 0
    sources = spark.createDataFrame([("j", 1, "a", False), ("j", 2, "b", True), ("j", 3, "c", False)], "job_id string, pos int, source string, stopped boolean")
    results = spark.createDataFrame([("j", "a", "failed", "no")], "job_id string, source string, state string, error string")
    assert sorted(rows(workflow.ended(sources, results), "pos", "state", "error")) == [(1, "failed", "no"), (2, "cancelled", None), (3, "interrupted", None)]
    assert sorted(rows(workflow.later_wins(results, results.withColumn("state", F.lit("completed")), results.limit(0)), "state")) == [("completed",)]
    listed = workflow.job_rows(spark.createDataFrame([("j", "failed", ["/x/a"])], "id string, state string, inputs array<string>"), results.withColumn("pos", F.lit(1)))
    assert listed.first().asDict(recursive=True) == {"id": "j", "state": "failed", "inputs": ["a"], "results": [{"source": "a", "state": "failed", "error": "no"}]}
    words = spark.createDataFrame([("j", 0, "Hi", 0.0, 1.0, None)], "job_id string, idx int, text string, start double, end double, speaker string")
    t = spark.createDataFrame([("j", "Hi", 2.0, {"adapter": "1", "model_sha256": "old"})], "job_id string, text string, duration double, provenance map<string,string>")
    ids = spark.createDataFrame([("j", "s", "m", None)], "job_id string, source_sha string, model_sha string, diar_sha string")
    made, cues = workflow.committed(t, words, ids)
    assert made.first()["provenance"] == {"adapter": "1", "source_sha256": "s", "model_sha256": "m"} and cues.count() == 1
    told = workflow.capabilities(spark.createDataFrame([("h", True, False, True), ("t", None, True, False)], "host string, transcription boolean, translation boolean, diarization boolean"))
    assert told.where("host = 'h' AND kind = 'translation_language'").count() == 0 and told.where("host = 't' AND kind = 'translation_language'").count() == len(workflow.TRANSLATION_LANGUAGES)
    assert sorted(rows(told.where("kind = 'feature'"), "host", "value")) == [("h", "diarization"), ("h", "transcription"), ("t", "translation")]
    runs = spark.createDataFrame([(1, "completed", False, None, "cpu"), (2, "completed", True, None, "cpu"), (3, "completed", False, None, "cpu"), (3, "completed", False, None, "cpu")], "run int, state string, skipped boolean, error string, device string")
    assert sorted(rows(workflow.benchmark_ok(runs, "cpu"), "run", "ok")) == [(1, True), (2, False), (3, False)]


def test_more_rules(spark):
    assert one(spark, rules.kept_lines(F.lit("# a\nmodel = /m\ndevice=cpu \nother = 1"), {"model": F.lit("/m"), "device": F.lit("cuda")})) == "# a\ndevice=cpu \nother = 1"
    assert [tuple(one(spark, rules.route(F.lit(x)))) for x in ("", "#/jobs", "#/jobs/a%20b?x=1", "#/jobs/a/b", "#/setup", "#/zzz")] == [("new", None), ("jobs", None), ("job", "a b"), ("not-found", None), ("setup", None), ("not-found", None)]
    assert one(spark, rules.query_string(F.create_map(F.lit("b"), F.lit("x y"), F.lit("a"), F.lit("1"), F.lit("c"), F.lit("")))) == "?a=1&b=x+y" and one(spark, rules.query_string(F.create_map(F.lit("c"), F.lit("")))) == ""
    assert tuple(one(spark, rules.api_error(F.lit(404), F.lit("Not Found"), F.lit('{"error":{"code":"c","message":"m"}}')))) == ("c", "m")
    assert tuple(one(spark, rules.api_error(F.lit(502), F.lit("Bad"), F.lit("<html>")))) == (None, "The server answered 502 Bad")
    assert [one(spark, rules.exit_code(F.lit(k))) for k in ("cancelled", "model", "other")] == [130, 3, 1] and one(spark, rules.http_status(F.lit("full_queue"))) == 429
    empty = F.array().cast("array<struct<kind:string,ok:boolean>>")
    true, false = F.lit(True), F.lit(False)
    assert one(spark, rules.setup_issues(true, true, empty, true, true, true)) == []
    assert one(spark, rules.setup_issues(true, false, F.array(F.struct(F.lit("asr").alias("kind"), false.alias("ok"))), false, false, F.lit(None).cast("boolean"))) == ["runtime is missing or its checksum changed", "asr model is missing or its checksum changed", "ASR model is not installed", "configuration file is missing", "diagnostics have not completed"]
    assert one(spark, rules.setup_issues(false, false, empty, false, false, false)) == ["setup has not been completed"]
    cases = [(None, False, False), (False, False, True), (False, False, False), (True, False, True), (True, True, True)]
    assert [tuple(one(spark, rules.install_summary(F.lit(a).cast("boolean"), F.lit(b), F.lit(c), F.array(F.lit("x")))))[0::2] for a, b, c in cases] == list(zip(rules.HEADLINES, rules.TONES, strict=True))
    with pytest.raises(Exception, match="device is invalid"):
        one(spark, rules.required(rules.choice(F.lit("gpu"), ("cpu",)), F.lit("gpu"), "device"))
    made = F.struct(F.lit("m").alias("model_sha"), F.lit("en").alias("source_language"), F.lit("de").alias("target_language"))
    assert one(spark, rules.translation_matches(made, F.lit("m"), F.lit("en"), F.lit("de"))) and not one(spark, rules.translation_matches(made, F.lit("x"), F.lit("en"), F.lit("de")))
    check = lambda formats, translate=False, source="", target="", stream="", workers="": one(spark, rules.job_options_error(F.array(*[F.lit(f) for f in formats]).cast("array<string>"), F.lit(translate), F.lit(source), F.lit(target), F.lit(stream), F.lit(workers)))
    assert [check([]), check(["srt"]), check(["srt"], True, "en"), check(["srt"], True, "en", "en"), check(["srt"], stream="-1"), check(["srt"], workers="9"), check(["srt"], True, "en", "de", "2", "8")] == ["formats", None, "languages", "same language", "stream", "workers", None]
    assert one(spark, rules.field_errors(F.array(F.struct(F.array(F.lit("a"), F.lit("0")).alias("loc"), F.lit("bad").alias("msg")))))[0].asDict() == {"field": "a.0", "message": "bad"}


def test_stages(spark):
    from cuemill.operators import stages

    schema = "job_id string, source_sha string, stream int, state string, state_detail string, resume boolean, force boolean, ready boolean, wanted boolean, made boolean, matches boolean, there boolean, canonical boolean, audio boolean, direct boolean"
    new = dict(source_sha="s", stream=0, resume=True, force=False, ready=False, wanted=False, made=False, matches=False, there=False, canonical=False, audio=False, direct=False, state=None, state_detail=None)
    cases = {
        "new": {},
        "same source": {},
        "other stream": {"stream": 1},
        "direct": {"direct": True, "source_sha": "d"},
        "ready": {"state": "completed", "ready": True, "canonical": True},
        "artifact lost": {"state": "completed", "canonical": True},
        "translate later": {"state": "completed", "ready": True, "canonical": True, "wanted": True},
        "translated": {"state": "completed", "canonical": True, "wanted": True, "made": True, "matches": True, "there": False},
        "other translation": {"state": "completed", "ready": True, "canonical": True, "wanted": True, "made": True},
        "audio kept": {"state": "failed", "state_detail": "normalized", "audio": True, "source_sha": "k"},
        "audio unfinished": {"state": "failed", "state_detail": "probed", "audio": True, "source_sha": "u"},
        "forced": {"state": "completed", "state_detail": "completed", "ready": True, "canonical": True, "force": True, "source_sha": "f"},
        "in the way": {"state": "completed", "resume": False},
        "no hash": {"source_sha": None, "wanted": True},
    }
    plan = stages.planned(spark.createDataFrame([{"job_id": k} | new | v for k, v in cases.items()], schema))
    got = {r["job_id"]: (r["action"], [s for s in stages.STEPS if r[s]]) for r in plan.collect()}
    fresh = ["probe", "normalize", "transcribe", "render"]
    assert got == {
        "new": ("new", fresh), "same source": ("new", fresh), "other stream": ("new", fresh), "direct": ("new", ["probe", "transcribe", "render"]), "ready": ("skip", []), "artifact lost": ("resume", ["render"]),
        "translate later": ("resume", ["translate", "render"]), "translated": ("resume", ["render"]), "other translation": ("translation conflict", []), "audio kept": ("resume", ["probe", "transcribe", "render"]),
        "audio unfinished": ("resume", fresh), "forced": ("new", fresh), "in the way": ("conflict", []), "no hash": ("new", ["probe", "normalize", "transcribe", "translate", "render"]),
    }
    assert {r["job_id"] for r in plan.where("drop_edits").collect()} == {"forced"}
    hand = spark.createDataFrame([("u", 0), ("s", 1), ("s", 1), ("x", 0)], "source_sha string, stream int")
    assert sorted(rows(stages.normalisations(plan, hand), "job_id", "jobs")) == [("forced", 1), ("new", 2), ("no hash", 1)]
    produced = spark.createDataFrame([("new", True, None, None), ("same source", None, None, "inference failed"), ("direct", False, None, None), ("translate later", None, True, None), ("audio kept", True, None, None), ("no hash", True, False, None)], "job_id string, transcript boolean, translation boolean, error string")
    ends = {r["job_id"]: (r["state"], r["error"], r["skipped"], r["drop_audio"]) for r in stages.completed(plan, produced).collect()}
    assert ends["new"] == ("completed", None, False, True) and ends["audio kept"] == ("completed", None, False, True) and ends["ready"] == ("completed", None, True, False) and ends["artifact lost"] == ("completed", None, False, False)
    assert ends["same source"] == ("failed", "inference failed", False, False) and ends["direct"] == ("failed", stages.NO_TRANSCRIPT, False, False) and ends["no hash"] == ("failed", stages.NO_TRANSLATION, False, False)
    assert ends["in the way"] == ("failed", "conflict", False, False) and ends["translate later"][0] == "completed" and len(ends) == len(cases)
    assert stages.completed(plan, produced, keep_audio=True).where("drop_audio").count() == 0


def test_medians_are_exact_and_not_of_one_task(spark):
    rng = random.Random(5)
    for values in ([], [2.0], [1.0, 2.0], [3.0, None, 1.0, 1.0], [float("nan")] * 50 + [1.0] * 40, [rng.choice([1.5, rng.random()]) for _ in range(3001)]):
        rows = spark.createDataFrame([(v, 1.0) for v in values], "total double, inference double")
        made = jobs.benchmark_summary(rows, 600.0)
        want = rows.agg(F.median("total"), F.median("inference")).first()
        assert [str(x) for x in made.select("total", "inference").first()] == [str(x) for x in want]
        assert "median" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
