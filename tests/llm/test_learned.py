"""The compression classifier, fill-in-middle and the source divergence audit."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuemill.llm import compression, divergence, infill

TABLE = "doc_id bigint, text string, lang string, source string"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int")


# --- compression classifier


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, compression.scored(docs, labels).join(labels, "doc_id").toPandas()


def test_held_out_documents_are_told_apart(learned):
    held = learned[2][learned[2]["held_out"]]
    good, bad = (held[held["quality"] == q]["score"].to_numpy() for q in (1, 0))
    auc = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    assert len(bad) > 5 and auc > 0.95 and (good >= compression.CUTOFF).mean() > 0.97
    assert ((held["score"] >= 0) & (held["score"] <= 1)).all() and ((held["score"] >= compression.CUTOFF) == (held["predicted"] == 1)).all()


def test_held_out_labels_are_not_learned(spark, learned):
    docs, labels, _ = learned
    turned = labels.withColumn("quality", F.when(compression.fold(F.col("doc_id")) == compression.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression.trained(docs, labels) == compression.trained(docs, turned)


def test_only_the_text_counts(spark, learned):
    docs, labels, scores = learned
    copies = docs.withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    both = compression.scored(docs.unionByName(copies), labels).toPandas().set_index("doc_id")["score"]
    assert all(both[i] == both[i + 1_000_000] for i in both.index if i < 1_000_000)


def test_sizes_are_those_of_whole_texts():
    made = compression.Compressors(b"the quick brown fox " * 300, b"### $$$ %%% &&& " * 300)
    text = "the quick brown fox é😀 " * 2000
    pieces = list(compression.pieces_of(text))
    assert b"".join(pieces).decode() == text and all(p.decode() and len(p) <= compression.PIECE for p in pieces)
    want = sum(len(made.bad.compress(p)) - len(made.good.compress(p)) for p in pieces) / (len(text.encode()) + compression.LEAST)
    assert made.measure(text) == want > 0 > made.measure("### $$$ %%% &&& " * 50) and made.measure(None) == made.measure("") == 0


def test_calibration_is_the_likeliest_curve():
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000)
    good = rng.random(4000) < 1 / (1 + np.exp(-(2.5 * x + 0.5)))
    a, b = compression.calibrated(x, good)
    assert abs(a - 2.5) < 0.25 and abs(b - 0.5) < 0.15
    apart = compression.calibrated(np.array([-1.0, -2.0, 1.0, 2.0]), np.array([False, False, True, True]))
    assert np.isfinite(apart).all() and apart[0] > 0


def test_odd_documents_are_scored(spark, odd, none):
    rows = compression.scored(odd, labels_of(spark, [(4, 1), (5, 1), (6, 0), (7, 0), (None, 1), (2, None), (6, 1)])).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert compression.scored(none, labels_of(spark, [(1, 1)])).count() == 0
    nothing = compression.scored(odd, labels_of(spark, [])).collect()
    assert {r["score"] for r in nothing} == {0.5} and len(nothing) == len(rows)


def test_samples_are_bounded(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id", F.repeat(F.lit(" again"), 50)).alias("text"))
    hot = docs.unionByName(docs.where("doc_id = 1").crossJoin(spark.range(200)).drop("id"))
    chosen = compression._learners(hot, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")), 5)
    assert chosen.select("doc_id").distinct().count() == 10


# --- fill-in-middle


def plain_turn(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i * 8 : i * 8 + 8], 16) for i in range(4)]
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", len(units), None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return ("spm", len(units), len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", len(units), len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_texts_are_turned_as_written_down(spark, odd):
    extra = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(["<P>", "a<S>b", "x<M", "<<P", "P>a<", "a", " ", "a1\n\nB", "<", "é<S"] * 20, 100)], TABLE)
    docs = odd.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    made = infill.transformed(docs)
    got = sorted(map(repr, ((r["doc_id"], r["form"], r["n"], r["prefix_chars"], r["middle_chars"], r["output"], r["output_sha256"], r["restored_sha256"]) for r in made.collect())))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in docs.collect():
        form, n, p, m, out = plain_turn(r["doc_id"], r["text"])
        want.append(repr((r["doc_id"], form, n, p, m, out, sha(out), sha(r["text"] or ""))))
    assert got == sorted(want)
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_outputs_are_restored(spark, docs, none):
    made = infill.transformed(docs)
    back = made.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("back")).join(docs, "doc_id")
    assert back.count() == docs.count() and back.where("back IS DISTINCT FROM coalesce(text, '')").count() == 0
    assert infill.transformed(none).count() == 0


# --- source divergence


def plain_audit(rows, least=3, top=200):
    count, having, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        groups[lang].add(source)
        terms = [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        count[lang, source].update(terms)
        having[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in having[lang].items() if n >= least)
        all_of = Counter()
        for s in sources:
            all_of.update(count[lang, s])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}  # noqa: E731,B023
        p, q = {s: share(count[lang, s]) for s in sources}, share(all_of)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def audit(df, **sizes):
    return sorted(tuple(r) for r in divergence.audited(df, **sizes).select("lang", "source", "part", "item", "value", "rank").collect())


def texts(spark, seed, sources=7):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "É", "é", "ÀB", "naïve", "x1y", "Zebra", "a_b", "😀", "ſ", "K", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))]
    rows = [(rng.choice(["en", "de"]).item(), f"s{min(rng.geometric(0.4), sources)}", " ".join(rng.choice(words, rng.integers(0, 60), p=None).tolist())) for _ in range(150)]
    return spark.createDataFrame([*rows, (None, None, None), ("fr", "a", "one two"), ("fr", "b", ""), ("fr", None, "one"), ("en", "void", None), ("en", "s1", "x" * 300_000), *[("en", "s1", "The same text")] * 5], "lang string, source string, text string")


@pytest.mark.parametrize("sizes", [{}, {"terms": 10, "sources": 3}, {"terms": 40, "sources": 1, "top": 4}, {"top": 3, "terms": 1}])
def test_audit_equals_the_plain_one(spark, sizes):
    df = texts(spark, 5).withColumns({c: F.lit(1) for c in ("term", "n", "block", "p")})
    got = audit(df, **sizes)
    assert got == plain_audit([(r["lang"], r["source"], r["text"]) for r in df.collect()], top=sizes.get("top", 200))
    assert ("fr", "a", "pair", "", 0, 1) in got


def test_audit_of_odd_rows(spark, odd, none):
    assert audit(odd) == plain_audit([(r["lang"], r["source"], r["text"]) for r in odd.collect()])
    assert audit(none) == []


def test_terms_are_counted_in_pieces(monkeypatch):
    text = "Ab é bx! " * 500 + "z" * 5000 + " end"
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert divergence.term_counts(text) == whole and whole["é".encode()] == 500


def test_shares_of_large_counts_are_exact(spark):
    rows = [(0, 1, 1), (10**12, 10**12, 7), (10**15 - 1, 10**17, 10**6), (9 * 10**17, 9 * 10**17 + 1, 3)]
    df = spark.createDataFrame(rows, "n bigint, total bigint, v bigint")
    assert [r["p"] for r in df.select(divergence.share("n", "total", "v").alias("p")).collect()] == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in rows]


def test_tables_are_flushed(spark, monkeypatch):
    df = texts(spark, 9)
    want = sorted(tuple(r) for r in divergence.counts_of(df).na.fill("~", ["term"]).collect())
    monkeypatch.setattr(divergence, "FLUSH", 20)
    batches = list(divergence._counted(iter(df.fillna("").select("lang", "source", "text").toArrow().to_batches(10))))
    total = defaultdict(lambda: [0, 0])
    for b in batches:
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"] or "~"][0] += r["n"]
            total[r["lang"], r["source"], r["term"] or "~"][1] += r["docs"]
    assert len(batches) > 10 and sorted((*k, *v) for k, v in total.items()) == want


def test_terms_leave_a_task_once_a_chunk():
    """Many different terms don't make a table be handed on early: each is one row of its group, with and without other terms."""
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(250_000)]
    texts = [" ".join(words[i : i + 10_000]) + " Every, EVERY" for i in range(0, len(words), 10_000)] * 2
    table = pa.table({"lang": ["en", *["en"] * 50, "de"], "source": ["void", *["a"] * 50, ""], "text": [None, *texts, "--"]})
    rows = [r for b in divergence._counted(iter(table.to_batches(7))) for r in b.to_pylist()]
    assert len(rows) == len(words) + 4 and {r["term"] for r in rows if r["source"] == "a"} == {None, "every", *words}
    assert {(r["n"], r["docs"]) for r in rows if r["term"] not in (None, "every")} == {(2, 2)}
    assert [(r["n"], r["docs"]) for r in rows if r["term"] == "every"] == [(100, 50)]
    assert sorted((r["lang"], r["source"], r["n"]) for r in rows if r["term"] is None) == [("de", "", 0), ("en", "a", 0), ("en", "void", 0)]
