"""Documents and places: results nested to any depth, places over all rows, canonical JSON, write-back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cuemill.operators import edits, jobs, validate
from cuemill.operators.ordinals import with_base
from cuemill.sources import ingest, manifests


def plain_container(v):
    while True:
        if isinstance(v.get("result"), dict):
            v = v["result"]
        elif isinstance(v.get("results"), list) and v["results"] and isinstance(v["results"][-1], dict):
            v = v["results"][-1]
        else:
            break
    first = (v.get("alternatives") or [None])[0] if isinstance(v.get("alternatives"), list) else None
    return first if isinstance(first, dict) else v


def nested(rng, depth):
    v = {"words": [{"word": f"w{depth}", "start": 0, "end": 1}], "text": f"t{depth}"}
    if rng.random() < 0.5:
        v = {"alternatives": [v, {"text": "other"}], "text": "above"}
    for _ in range(depth):
        way = rng.randrange(4)
        v = {"result": v, "results": [{"text": "not here"}]} if way == 0 else {"results": [{"text": "first"}, v]} if way == 1 else {"result": [1], "results": [v]} if way == 2 else {"result": v, "text": "result", "alternatives": [{"text": "no"}]}
    return v


def test_results_at_any_depth(spark):
    rng = random.Random(2)
    made = {f"{d}-{k}": nested(rng, d) for d in (0, 1, 2, 3, 4, 5, 6, 9, 17, 33, 50) for k in range(3)}
    payloads = {k: json.dumps(v) for k, v in made.items()}
    payloads["escaped"] = '{"\\u0072esult": {"r\\u0065sults": [{"text": "deep", "words": [{"word": "x", "start": 0, "end": 1}]}]}}'
    raw = spark.createDataFrame([(k, p, None) for k, p in payloads.items()], "job_id string, payload string, duration double")
    got = {r["job_id"]: (r["text"], r["fault"], [w["text"] for w in r["words"]]) for r in ingest.transcripts(raw).collect()}
    assert got.pop("escaped") == ("deep", None, ["x"])
    for k, v in made.items():
        inner = plain_container(v)
        assert got[k] == (inner["text"], None, [inner["words"][0]["word"]]), k


@pytest.mark.parametrize("blocks", [1, 3, 64])
def test_bases_are_sums_of_what_is_before(spark, blocks):
    rng = random.Random(blocks)
    counts = [(k, rng.randrange(5)) for k in rng.sample(range(-1000, 1000), 300)]
    got = {r["k"]: r["base"] for r in with_base(spark.createDataFrame(counts, "k bigint, n bigint"), "k", "n", blocks).collect()}
    assert got == {k: sum(n for j, n in counts if j < k) for k, _ in counts}
    assert with_base(spark.createDataFrame([], "k bigint, n bigint"), "k", "n", blocks).count() == 0


def test_translations_are_placed_without_one_task(spark):
    segments = spark.createDataFrame([(f"j{p}", p, i, f"t{p}.{i}") for p in range(20) for i in range(p % 4)], "job_id string, job_pos bigint, idx bigint, text string")
    n = segments.count()
    results = spark.createDataFrame([(i, f"r{i}") for i in range(n)], "ordinal bigint, text string")
    made = edits.translated(segments, results)
    got = sorted((r["text"], r["translation"]) for r in made.collect())
    assert got == sorted((t, f"r{i}") for i, t in enumerate(f"t{p}.{i}" for p in range(20) for i in range(p % 4)))
    assert "SinglePartition" not in made._jdf.queryExecution().toString()


def tree(rng, depth=0):
    kind = rng.randrange(7 if depth < 5 else 5)
    if kind == 5:
        return [tree(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 6:
        return {rng.choice(["b", "a", "ä", "Z", "", '"', "x y", "é\n", "10", "9", "😀", "￮"]) + str(rng.randrange(3)): tree(rng, depth + 1) for _ in range(rng.randrange(5))}
    return [None, rng.random() < 0.5, rng.randrange(-(10**12), 10**12), rng.choice([0.1, 1e10, -2.5, 1e-7, 123456.789]), rng.choice(["", "a\tb", "ü", '{"}', "\\", "\x01", "☃"])][kind]


def dumped(value):
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def test_canonical_json(spark):
    rng = random.Random(8)
    values = [tree(rng) for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, s string")
    got = df.select("i", manifests.canonical_json(F.col("s")).alias("text"), manifests.canonical_json(F.to_json(F.parse_json("s"))).alias("variant")).collect()
    assert all(r["text"] == dumped(values[r["i"]]) for r in got)
    # A variant keeps 1e10 as a whole number.
    assert all(r["variant"] == dumped(json.loads(r["variant"])) and json.loads(r["variant"]) == values[r["i"]] for r in got)


def test_recovery_writes_back_what_it_changes(spark, tmp_path):
    root, now = tmp_path / "out", "2024-05-06T07:08:09+00:00"

    def manifest(name, **rest):
        (root / name).mkdir(parents=True)
        (root / name / "manifest.json").write_text(json.dumps({"schema_version": 1, "created_at": "2024-01-01", "updated_at": "2024-01-02"} | rest))

    manifest("a", job_id="a", state="processing", source={"path": "/m/a.wav"}, extra={"b": [1, None], "a": "ü"})
    manifest("b/deep", job_id="b", state="completed", source={"path": "/m/b.wav"})
    manifest("c", job_id="c", state="failed", error={"message": "no"})
    manifest("d", job_id="d", state="queued")
    (root / "e").mkdir()
    (root / "e" / "manifest.json").write_text("{")
    (root / "a" / "other.json").write_text('{"state": "processing"}')
    kept = {p: (p.read_bytes(), p.stat().st_mtime_ns) for p in root.rglob("*.json") if p.parent.name != "a" or p.name != "manifest.json"}
    rows, events = manifests.recover(spark, str(root), now)
    assert {p: (p.read_bytes(), p.stat().st_mtime_ns) for p in kept} == kept
    want = {"schema_version": 1, "created_at": "2024-01-01", "updated_at": now, "job_id": "a", "state": "interrupted", "source": {"path": "/m/a.wav"}, "extra": {"b": [1, None], "a": "ü"}}
    assert (root / "a/manifest.json").read_text() == dumped(want)
    got = {r["id"]: (r["state"], r["inputs"], r["error"], r["submitted_at"], r["started_at"], r["finished_at"]) for r in rows.collect()}
    assert got == {"a": ("interrupted", ["/m/a.wav"], None, "2024-01-01", "2024-01-01", now), "b": ("completed", ["/m/b.wav"], None, "2024-01-01", "2024-01-01", "2024-01-02"), "c": ("failed", [], "no", "2024-01-01", "2024-01-01", "2024-01-02")}
    assert sorted(map(tuple, events.collect())) == [("a", 1, "/m/a.wav", "interrupted", "interrupted", jobs.RECOVERED), ("b", 1, "/m/b.wav", "completed", "completed", jobs.RECOVERED), ("c", 1, None, "failed", "failed", jobs.RECOVERED)]
    before = (root / "a/manifest.json").stat().st_mtime_ns
    manifests.recover(spark, str(root), "later")
    assert (root / "a/manifest.json").stat().st_mtime_ns == before and not list(root.glob(".recovery*"))


def test_recovery_goes_on_from_its_staging(spark, tmp_path):
    """A run that stopped between both phases: what it staged is put in place, though nothing is at work any more."""
    (tmp_path / "out/a").mkdir(parents=True)
    (tmp_path / "out/a/manifest.json").write_text('{"schema_version": 1, "job_id": "a", "state": "processing"}')
    staging = str(tmp_path / "staging")
    spark.createDataFrame([(f"file://{tmp_path}/out/a/manifest.json", '{"schema_version": 1, "job_id": "a", "state": "interrupted", "updated_at": "then"}')], "path string, content string").write.parquet(staging)
    rows, _ = manifests.recover(spark, str(tmp_path / "out"), "now", staging)
    assert [(r["state"], r["finished_at"]) for r in rows.collect()] == [("interrupted", "then")] and not (tmp_path / "staging").exists()


def test_registry_documents(spark):
    model = {n: n for n in ingest.MODEL} | {"sha256": None, "url": None, "minimum_free_bytes": 5}
    archive = {n: n for n in ingest.ARCHIVE} | {"features": ["b", "a"], "minimum_free_bytes": 7}
    whole = {"schema_version": 1, "runtime": {n: n for n in ingest.RUNTIME} | {"backends": ["cpu"], "features": [], "archives": [archive]}, "models": [model, model]}
    texts = {"whole": json.dumps(whole), "v2": json.dumps(whole | {"schema_version": 2}), "part": json.dumps(whole | {"models": [{"id": "x"}]}), "no runtime": json.dumps({"schema_version": 1, "models": []}), "list": "[]", "bad": "{"}
    docs = spark.createDataFrame(list(texts.items()), "path string, s string").select("path", F.try_parse_json("s").alias("doc"))
    assert sorted(map(tuple, ingest.unread_registries(docs).collect())) == [("bad", "unreadable"), ("list", "unreadable"), ("no runtime", "incomplete"), ("part", "incomplete"), ("v2", "version")]
    runtimes, models, archives = (df.where("path = 'whole'") for df in ingest.registry(docs))
    assert runtimes.first()["backends"] == ["cpu"] and models.count() == 2 and models.first()["minimum_free_bytes"] == 5
    assert archives.first()["features"] == ["a", "b"]
    assert sorted((r["kind"], r["fault"]) for r in validate.registry_faults(models, archives).collect()) == [("archive", "digest"), ("model", "duplicate"), ("model", "duplicate")]


def test_empty_files_are_discovered(spark, tmp_path):
    for name in ("a.wav", "deep/b.MP3", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "d.wav").write_bytes(b"x")
    names = lambda recursive: [r["path"].rsplit("/", 1)[1] for r in ingest.discovered(spark, [], [str(tmp_path)], recursive).collect()]
    assert names(False) == ["a.wav", "d.wav"] and names(True) == ["a.wav", "d.wav", "b.MP3"]


def test_install_states(spark):
    whole = {"schema_version": 1, "backend": "cpu", "features": ["asr"], "config_path": "/c", "runtime": {"id": "r", "kind": "runtime", "path": "/r", "size": 3}, "models": [{"id": "m", "kind": "asr", "path": "/m"}], "created_at": "a", "updated_at": "b", "installer_version": "1"}
    texts = {"whole": whole, "bare": {k: v for k, v in whole.items() if k not in ("runtime", "models", "features")}, "v2": whole | {"schema_version": 2}, "part": {"schema_version": 1, "backend": "cpu"}, "list": []}
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()] + [("bad", "{")], "path string, s string").select("path", F.try_parse_json("s").alias("doc"))
    assert sorted(map(tuple, ingest.refused_install_states(docs).collect())) == [("bad", "unreadable"), ("list", "unreadable"), ("part", "incomplete"), ("v2", "version")]
    got = {r["path"]: r for r in ingest.install_states(docs).collect()}
    assert set(got) == {"whole", "bare"} and [(a["kind"], a["id"], a["size"]) for a in got["whole"]["artifacts"]] == [("runtime", "r", 3), ("asr", "m", None)] and got["bare"]["artifacts"] == got["bare"]["features"] == []


def test_recogniser_output_is_read_once(spark):
    """Exploding words doesn't read the payload again for a filter, and a word's names aren't looked up one by one."""
    raw = spark.createDataFrame([(1, '{"results": [{"result": {"tokens": [{"token": "a", "begin": "0.5", "finish": 1}, {"text": " b ", "start_sec": 1, "end_sec": 2.50}]}}]}')], "job_id bigint, payload string").withColumn("duration", F.lit(None).cast("double"))
    rows = ingest.transcripts(raw).select("job_id", F.inline(ingest.rows_of("words")))
    assert [(r["idx"], r["text"], r["start"], r["end"]) for r in rows.collect()] == [(0, "a", 0.5, 1.0), (1, "b", 1.0, 2.5)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("words_info.words") == 2


def test_objects_are_told_by_their_kind(spark):
    docs = spark.createDataFrame([(x,) for x in ('{"a": 1}', "{}", '{"_": "x"}', "[{}]", "null", '"{}"', "1", "x", None)], "t string")
    assert [r[0] for r in docs.select(ingest.is_object(F.try_parse_json("t"))).collect()] == [True] * 3 + [False] * 6


def test_results_that_are_the_document_are_read_once(spark):
    """Only what may hold the result inside is searched; what isn't gives the same."""
    flat, inside = '{"text": "x", "words": [{"word": "x", "start": 0, "end": 1}]}', '{"language": "de", "alternatives": [{"transcript": "y", "words": [{"word": "y", "start": 0, "end": 1}]}]}'
    payloads = {"flat": flat, "none": '{"text": "x"}', "inside": inside, "escaped": inside.replace("alter", "\\u0061lter"), "deeper": f'{{"result": {flat}}}', "list": "[1]", "broken": "{", "null": None}
    raw = spark.createDataFrame(list(payloads.items()), "job_id string, payload string").withColumn("duration", F.lit(None).cast("double"))
    assert {r["job_id"] for r in raw.where(ingest._nested(F.col("payload"))).collect()} == {"inside", "escaped", "deeper"}
    got = {r["job_id"]: (r["text"], r["language"], r["fault"]) for r in ingest.transcripts(raw).collect()}
    assert got == {"flat": ("x", None, None), "none": ("x", None, "words"), "inside": ("y", "de", None), "escaped": ("y", "de", None), "deeper": ("x", None, None), "list": (None, None, "object"), "broken": (None, None, "object"), "null": (None, None, "object")}


def test_batch_files_are_matched_by_whole_stems(spark):
    docs = spark.createDataFrame([("/out/a.json.json", "1"), ("b.json", "2"), ("/out/c.txt", "3"), ("/out/.json", "4")], "path string, value string")
    jobs = spark.createDataFrame([(x, x, None) for x in ("a.json", "a", "b", "c", "")], "stem string, job_id string, duration double")
    assert {r["job_id"]: r["payload"] for r in ingest.batch_results(docs, jobs).collect()} == {"a.json": "1", "a": None, "b": "2", "c": None, "": "4"}
