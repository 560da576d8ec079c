"""Jaccard join, decontamination, language identification, licences and language model against brute force."""

import collections
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuemill.llm import decontaminate, jaccard, language, language_model, license_scan

WORD = r"[^\x20\x09-\x0D]+"


def plain_join(rows):
    """(id, links) and the component of each row."""
    sets = []
    for r in rows:
        w = re.findall(WORD, r["text"] or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    by_shingle = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            by_shingle[g].append(k)
    links, part = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for k, s in enumerate(sets):
        for o, n in collections.Counter(o for g in s for o in by_shingle[g] if o > k).items():
            if 10 * n >= 8 * (len(s) + len(sets[o]) - n):
                links[k] += 1
                links[o] += 1
                part[root(k)] = root(o)
    return links, [root(k) for k in range(len(rows))]


def near_copies(spark, seed=1, groups=30, size=6):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(50)}"
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                rows.append((len(rows), "  ".join(copy)))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def check_join(table):
    rows = table.collect()
    links, part = plain_join(rows)
    least = {}
    for r, p in zip(rows, part, strict=True):
        if r["doc_id"] is not None:
            least[p] = min(least.get(p, r["doc_id"]), r["doc_id"])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(((r["doc_id"], least.get(p), n) for r, p, n in zip(rows, part, links, strict=True)), key=key)
    assert sorted((tuple(r) for r in jaccard.joined(table).collect()), key=key) == want


def test_join_equals_brute_force(spark, docs):
    check_join(docs)
    check_join(near_copies(spark))


def test_large_groups_are_cut(spark, monkeypatch):
    """Blocks and incidence matrices, where a group has many different near copies."""
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    check_join(near_copies(spark, 2, 3, 60))


def test_chains_are_one_class(spark):
    """Each text is like the next, but not like the one after: labels must travel."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[6 * k : 6 * k + 120])) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_join(table)
    assert {r["class_id"] for r in jaccard.joined(table).collect()} == {61}


def test_join_of_odd_rows(odd, none):
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.joined(odd).collect()), key=str)
    assert got == sorted([(None, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (None, None, 0), (4, 4, 1), (4, 4, 1), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0)], key=str)
    assert jaccard.joined(none).count() == 0 and jaccard.one_of_each(none).count() == 0
    one = jaccard.one_of_each(odd)
    assert one.columns == odd.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in one.collect()) == sorted({(r["doc_id"] or -1, r["text"] or "") for r in odd.collect()})


def test_one_of_each_class(spark):
    table = near_copies(spark, 3)
    rows = table.collect()
    _, part = plain_join(rows)
    least = {p: min(r["doc_id"] for r, q in zip(rows, part, strict=True) if q == p) for p in set(part)}
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(table).collect()) == sorted(least.values())


def edit_distance(a, b):
    """Least distance of a to a stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(lo, 30))) for lo in (1, 0))
        distance, start, end = decontaminate.closest(a, b)
        assert distance == edit_distance(a, b)
        assert edit_distance(a, b[start:end]) == distance and abs(end - start - len(a)) <= distance


def test_leaks(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    texts = [(r["doc_id"], decontaminate.normal(r["text"])) for r in docs.collect()]
    wanted = [(r["item_id"], decontaminate.normal(r["text"])) for r in items.collect()]
    exact = {(d, i) for d, t in texts for i, x in wanted if x in t}
    assert exact and exact <= found
    for d, i in found - exact:
        assert edit_distance(dict(wanted)[i], dict(texts)[d]) <= decontaminate.LIMIT * len(dict(wanted)[i])
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()} == {d for d, _ in texts} - {d for d, _ in found}


def planted(text, rate, rng, low=0.0, high=1.0):
    """text with edits between two parts of its length."""
    letters, a, b = list(text), int(low * len(text)), int(high * len(text))
    for _ in range(round(rate * len(text))):
        i, kind = rng.randrange(a, min(b, len(letters)) + 1), rng.randrange(3)
        letters[i : i + (kind > 0)] = [] if kind == 2 else [rng.choice(text)]
    return "".join(letters)


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.2])
def test_edited_leaks_are_found(docs, rate):
    """Edits all over an item, or all at its head, middle or tail: nine in ten of those within LIMIT, at LIMIT itself."""
    items = [(r["item_id"], r["text"]) for r in docs.sparkSession.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    index, rng = decontaminate.Index(items), random.Random(6)
    words = " ".join(decontaminate.normal(r["text"]) for r in docs.limit(60).collect()).split()
    for low, high in ((0.0, 1.0), (0.0, 0.4), (0.3, 0.7), (0.6, 1.0)):
        texts = []
        for _, text in items:
            a = rng.randrange(len(words) - 100)
            texts.append(" ".join([*words[a : a + 50], planted(text, rate, rng, low, high), *words[a + 50 : a + 100]]))
        found = {(t, i) for t, n, *_ in index.matches([texts[:70], texts[70:]]) for i in index.ids[n]}
        near = [decontaminate.closest(decontaminate.normal(x), decontaminate.normal(t))[0] <= decontaminate.LIMIT * len(decontaminate.normal(x)) for (_, x), t in zip(items, texts, strict=True)]
        wanted = {(k, i) for k, ((i, _), n) in enumerate(zip(items, near, strict=True)) if n}
        assert len(wanted) > 100 and len(wanted & found) >= 0.9 * len(wanted)


def test_short_and_alike_items(docs):
    """Items of a word or two, and many items that share most of their text."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6))
    stem = [word() for _ in range(30)]
    items = [(k, " ".join([*stem, *(word() for _ in range(25))])) for k in range(40)] + [(100, "paris"), (101, "xylophone music"), (102, "7")]
    index = decontaminate.Index(items)
    around = [word() for _ in range(20)]
    texts = [" ".join([*around, text, *around]) for _, text in items]
    found = {(t, i): d for t, n, d, *_ in index.matches([texts]) for i in index.ids[n]}
    assert all(found.get((k, i)) == 0 for k, (i, _) in enumerate(items))
    assert not {(t, i) for t, i in found if i < 100 and t < 40 and items[t][0] != i}


def test_items_with_one_opening(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    opening = [word() for _ in range(12)]
    short, long = (opening + [word() for _ in range(n - 12)] for n in (20, 40))
    assert len(" ".join(opening)) >= 64
    index = decontaminate.Index([(1, " ".join(short)), (2, " ".join(long))])
    around = [word() for _ in range(30)]
    found = index.matches([[" ".join(t) for t in (around + long + around, around + short + around, around + short + around + long)]])
    assert [(t, index.ids[i], d) for t, i, d, *_ in found if d == 0] == [(0, [2], 0), (1, [1], 0), (2, [1], 0), (2, [2], 0)]
    assert [(first, last) for *_, d, first, last in found if d == 0] == [(30, 70), (30, 50), (30, 50), (80, 120)]


def test_leaks_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four"), (2, "one  two three\nfour"), (3, None), (None, "words of a row without"), (4, " "), (5, "naïve")], "item_id bigint, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(odd, items).collect()), key=str)
    assert got == sorted([(4, 1, 0), (4, 1, 0), (4, 2, 0), (4, 2, 0), (None, None, 0), (7, 5, 0)], key=str)
    span = decontaminate.leaks(odd, items).where("item_id = 5").first()
    assert odd.where("doc_id = 7").first()["text"][span["start"] : span["end"]] == "naïve"
    left = decontaminate.clean(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 4
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(odd, items.limit(0)).count() == 0 and decontaminate.clean(odd, items.limit(0)).count() == odd.count()


def test_blocks_of_items(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert sum(len(b) for b in decontaminate.blocks(items, 500)) == items.count() and len(list(decontaminate.blocks(items, 500))) > 5


def test_gradients():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, mask, labels = rng.integers(0, 256, (7, 5)).astype(np.uint8), (rng.random((7, 5)) < 0.8).astype(float), rng.integers(0, 3, 5)

    def loss():
        p = net.chances(net.states(codes, "f").astype(float), net.states(codes, "b").astype(float))
        return -(np.log(p[:, np.arange(5), labels]) * mask).sum() / mask.sum()

    for name, g in net.gradients(codes, mask, labels).items():
        for i in np.argsort(-np.abs(g).ravel())[:3]:
            flat = net.p[name].ravel()
            kept = flat[i]
            flat[i] = kept + 1e-3
            up = loss()
            flat[i] = kept - 1e-3
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-3 - g.ravel()[i]) < 1e-3


def test_languages_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predicted(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_every_language_is_learned(spark):
    rng, rows = random.Random(2), []
    for k in range(70):
        rows += [(len(rows) + i, " ".join("".join(rng.choice(chr(0x4E00 + 4 * k) + chr(0x4E01 + 4 * k)) for _ in range(4)) for _ in range(20)), f"l{k:02}") for i in range(12 if k < 69 else 6)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert len(learned) == 70 and {k for k, _ in language.sample(table)} == learned
    assert language.Network(sorted(learned)).size > language.STATES


def test_languages_of_odd_rows(spark, odd, none):
    got = language.predicted(odd).collect()
    assert len(got) == odd.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (1, 2, 3))
    assert language.predicted(none).count() == 0
    unknown = spark.createDataFrame([(1, "abc", None), (None, "abc", "en")], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in language.predicted(unknown).collect()} == {"und"}


@pytest.fixture(scope="module")
def licences(docs):
    return license_scan.Classifier(license_scan.negatives(docs))


def test_licences_held_out(licences, docs):
    rng, hint = random.Random(8), license_scan.hints()
    plain = [w for r in docs.collect() for w in license_scan.words_in(r["text"])]
    right = total = 0
    for family, templates in license_scan.TEMPLATES.items():
        for t in templates:
            for k in range(4):
                line = " ".join(rng.choices(plain, k=k) + [t] + rng.choices(plain, k=k))
                found = license_scan._notices(licences, f"first line\n{line}\nlast", hint)
                total += 1
                right += [(f[0], f[3]) for f in found] == [(1, family)]
    assert right >= 0.95 * total
    for text in ("The license of the car is public", "we reserve rights to gnu animals", " ".join(plain[:500])):
        assert not [f for f in license_scan._notices(licences, text, hint) if f[3]]


def test_licences_in_long_lines(licences, docs):
    rng, hint = random.Random(9), license_scan.hints()
    plain = [w for r in docs.collect() for w in license_scan.words_in(r["text"])]
    right = total = 0
    for family, templates in license_scan.TEMPLATES.items():
        for t in templates:
            for n in (20, 100, 1000):
                words = rng.choices(plain, k=n)
                found = license_scan._notices(licences, " ".join([*words[: n // 2], t, *words[n // 2 :]]), hint)
                total += 1
                right += [(f[0], f[3]) for f in found] == [(0, family)]
    assert right >= 0.95 * total
    two = " ".join([*plain[:100], "Released under the MIT License.", *plain[100:120], "Licensed under CC BY-SA 4.0.", *plain[120:300]])
    assert {f[3] for f in license_scan._notices(licences, two, hint)} == {"MIT", "CC-BY-SA"}
    assert not license_scan._notices(licences, " ".join([*plain[:100], "the rights of the car", *plain[100:300]]), hint)


def test_licences_over_several_lines(licences, docs):
    rng, hint = random.Random(10), license_scan.hints()
    plain = [w for r in docs.collect() for w in license_scan.words_in(r["text"])]
    right = total = 0
    for family, templates in license_scan.TEMPLATES.items():
        for t in templates:
            words = t.split()
            for width in (2, 3, 5):
                if len(words) < 2 * width:
                    continue
                lines = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
                text = "\n".join([*(" ".join(rng.choices(plain, k=9)) for _ in range(5)), *lines, *(" ".join(rng.choices(plain, k=9)) for _ in range(5))])
                found = [f for f in license_scan._notices(licences, text, hint) if f[3]]
                total += 1
                right += {f[3] for f in found} == {family} and all(f[1] <= text.index(lines[-1]) + len(lines[-1]) and f[2] >= text.index(lines[0]) for f in found)
    assert total > 40 and right >= 0.95 * total
    # A blank line ends a paragraph, and a line that holds a notice by itself has no second row.
    assert not [f for f in license_scan._notices(licences, "released under the\n\nMIT\n\nlicense", hint) if f[3]]
    assert [(f[0], f[3]) for f in license_scan._notices(licences, "we say\nReleased under the MIT License.\nMIT license", hint) if f[3]] == [(1, "MIT")]
    wrapped = "one two\nReleased under\nthe MIT\nLicense.\nthree"
    assert [(*f[:4],) for f in license_scan._notices(licences, wrapped, hint)] == [(1, 8, 39, "MIT")]


def test_every_excerpt_is_asked_about():
    hint = license_scan.hints()
    for templates in license_scan.TEMPLATES.values():
        for t in templates:
            words = license_scan.words_in(t)
            assert all(hint.search(" ".join(words[i : i + 8])) for i in range(max(1, len(words) - 7)))


def test_licences_in_documents(docs, odd, none):
    found = license_scan.scanned(docs).where("family is not null").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT", "All rights reserved.": "all-rights-reserved", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL"}
    want = {(d, k, lines[x]) for d, t in texts.items() for k, x in enumerate(t.split("\n")) if x in lines}
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in found} == want
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] in lines for r in found)
    assert license_scan.scanned(odd).count() == 0 and license_scan.scanned(none).count() == 0


def plain_scores(rows, corpus=None, order=3, least=1):
    words = [re.findall(WORD, r["text"] or "") for r in rows]
    known = words if corpus is None else [re.findall(WORD, r["text"] or "") for r in corpus]
    counts = [collections.Counter(tuple(x[i : i + k]) for x in known for i in range(len(x) - k + 1)) for k in range(order + 1)]
    total = max(counts[1].total(), 1)
    unit = lambda x: int(np.rint(1e6 * np.log(x)))

    def score(gram):
        if len(gram) == 1:
            return unit(max(counts[1][gram], 1)) - unit(total)
        if counts[len(gram)][gram] >= least:
            return unit(counts[len(gram)][gram]) - unit(counts[len(gram) - 1][gram[:-1]])
        return round(1e6 * math.log(0.4)) + score(gram[1:])

    out = [(r["doc_id"], len(x), sum(score(tuple(x[max(i - order + 1, 0) : i + 1])) for i in range(len(x))) / 1e6 if x else None) for r, x in zip(rows, words, strict=True)]
    return sorted(out, key=str)


def scores(table, *args, **levels):
    return sorted(((r["doc_id"], r["n_tokens"], r["log_score"]) for r in language_model.scored(table, *args, **levels).collect()), key=str)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_brute_force(docs, odd, none, order):
    for table in (docs, odd):
        assert scores(table, order=order) == plain_scores(table.collect(), order=order)
    assert not scores(none, order=order) and not scores(none, docs)


@pytest.mark.parametrize("order", [2, 3])
def test_rare_n_grams_back_off(docs, odd, none, order):
    """Where n-grams must be seen twice, and where others count than are scored, words back off."""
    some, rest = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    assert scores(some, order=order, least=2) == plain_scores(some.collect(), order=order, least=2)
    assert scores(some, rest, order=order, least=1) == plain_scores(some.collect(), rest.collect(), order)
    assert scores(odd, docs, order=order, least=3) == plain_scores(odd.collect(), docs.collect(), order, 3)
    assert scores(some, none, order=order) == plain_scores(some.collect(), [], order)


def test_hot_n_grams_are_spread(spark):
    rng = random.Random(5)
    texts = ["x " * 2000 + f"y{i}" for i in range(10)] + ["to be or not to be " * 30 + f"z{rng.randrange(9)}" for i in range(40)] + [" ".join(f"w{rng.randrange(3000)}" for _ in range(500)) for _ in range(40)] + ["", None, "x", "x x", "x x x"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert scores(table, share=1000) == plain_scores(table.collect())
    assert scores(table, share=1000, least=2) == plain_scores(table.collect(), least=2)
    words = language_model.word_counts(table)
    hot = language_model.hot_counts(table, None, 3, words, 500)
    counted = {(r["word"] is None, r["n"]) for r in hot.collect()}
    assert {(True, 19993), (False, 19981)} <= counted
    rows = language_model.resolved(language_model.n_grams(table, 3, asked="sums"), hot, 45)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 5 * sum(sizes) / 45


def test_n_grams_are_moved_in_parts(spark, docs, none):
    """Each pass moves its part of the histories and leaves no shuffle files, so the disk never holds all n-grams."""
    whole = language_model.n_grams(docs, 3, asked="sums")
    parts = [language_model.n_grams(docs, 3, asked="sums", part=i, parts=4) for i in range(4)]
    rows = lambda *tables: collections.Counter(tuple(r) for t in tables for r in t.collect())
    assert rows(*parts) == rows(whole) and max(p.count() for p in parts) < 0.4 * whole.count()
    assert not set.intersection(*({r["history"] for r in p.where("history is not null").select("history").distinct().collect()} for p in parts[:2]))
    folders = [f.getPath() for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f.name for folder in folders for f in Path(folder).rglob("shuffle_*")}
    before = files()
    table = language_model.scored(docs)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and scores(docs) == sorted(map(tuple, table.select("doc_id", "n_tokens", "log_score").collect()), key=str)
    assert scores(docs, passes=1) == scores(docs, passes=5) == plain_scores(docs.collect())


def test_terms_do_not_grow_with_partitions(spark, docs, odd):
    """More tasks don't make more rows of the same n-grams, and words that always follow their history make none."""
    for table in (docs, odd):
        hot = language_model.hot_counts(table, None, 3, language_model.word_counts(table), 500)
        made = lambda n: language_model.resolved(language_model.n_grams(table, 3, asked="sums"), hot, n, lambda t: language_model._terms(t, 1), language_model._TERMS)  # noqa: B023, E731
        few, many = (collections.Counter(map(tuple, made(n).collect())) for n in (2, 60))
        assert few == many
        words = [re.findall(WORD, r["text"] or "") for r in table.collect()]
        grams = [tuple(x[i : i + 3]) for x in words for i in range(len(x) - 2)]
        counts, before = collections.Counter(grams), collections.Counter(tuple(x[i : i + 2]) for x in words for i in range(len(x) - 1))
        assert few.total() == len(words) + sum(len(x) > 1 for x in words) + sum(counts[g] < before[g[:2]] for g in grams)


def test_hot_candidates_are_summed_in_their_task(spark):
    """A pair that stands everywhere leaves a task once, not once for each time."""
    one = lambda history, word: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (history, word, [1] * len(word))], names=["history", "word", "times"])
    many = [one([1, 1, 2], [None, 5, 5]) for _ in range(100_000)]
    made = pa.Table.from_batches(language_model._together(iter(many)))
    assert sorted(map(str, made.to_pylist())) == sorted(str({"history": h, "word": w, "times": 100_000}) for h, w in ((1, None), (1, 5), (2, 5)))
    assert not list(language_model._together(iter([])))


SEPARATED = {
    "a comma after every word": lambda t, rng: t.replace(" ", ", "),
    "underscores": lambda t, rng: t.replace(" ", "_"),
    "other punctuation": lambda t, rng: "".join(rng.choice([" ", "\n", " - ", "; "]) if c == " " else c for c in t),
    **{f"every {k}th letter": lambda t, rng, k=k: decontaminate.spread(t.encode(), k, rng).decode(errors="ignore") for k in (8, 9, 10, 12, 14)},
}


@pytest.mark.parametrize("kind", sorted(SEPARATED))
def test_spread_and_separated_edits_are_found(spark, docs, kind):
    """Edits that leave no long run of letters as it was, inside the limit: at least nine of ten are found."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    index, rng = decontaminate.Index(items), random.Random(9)
    around = [r["text"] for r in docs.where("length(text) > 500").limit(2 * len(items)).collect()]
    texts = [f"{around[i % len(around)]} {SEPARATED[kind](decontaminate.normal(t), rng)} {around[-i % len(around)]}" for i, (_, t) in enumerate(items)]
    near = [i for i, (_, t) in enumerate(items) if decontaminate.closest(decontaminate.normal(t), decontaminate.normal(texts[i]))[0] <= decontaminate.LIMIT * len(decontaminate.normal(t))]
    found = {(t, index.texts[i]) for t, i, *_ in index.matches([texts])}
    assert len(near) == len(items) and sum((i, decontaminate.normal(items[i][1])) in found for i in near) >= 0.9 * len(near)


PROBES = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3": "AGPL",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "ISC",
    "It comes under the terms of the Apache 2.0 license": "Apache-2.0",
    "GNU GPL version 2 or, at your option, any later version": "GPL",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD",
    "available under CC BY-SA 3.0": "CC-BY-SA",
    "available under CC BY 3.0": "CC-BY",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "BSD",
    "MIT licensed": "MIT",
    "Licensed under the GNU Lesser General Public License, version 3.": "LGPL",
    "Licensed under the Foobar Public License, version 2.0.": None,
    "This work is licensed under the Open Data Commons Attribution License.": None,
}


def test_licence_look_alikes(licences):
    hint = license_scan.hints()
    assert {p: {f[3] for f in license_scan._notices(licences, p, hint)} for p in PROBES} == {p: {f} for p, f in PROBES.items()}
    assert not license_scan._notices(licences, "The license of the car is public", hint)


def test_families_left_out_are_unknown(monkeypatch, docs):
    """Notices of a family that neither the model nor the templates know aren't taken for one that they know."""
    negatives, whole, wrong, total = license_scan.negatives(docs, 800), license_scan.TEMPLATES, 0, 0
    assert len(whole) >= 25
    for part in range(3):
        monkeypatch.setattr(license_scan, "TEMPLATES", {f: ts for k, (f, ts) in enumerate(whole.items()) if k % 3 != part})
        model, hint = license_scan.Classifier(negatives), license_scan.hints()
        for f, ts in whole.items():
            for t in ts if f not in license_scan.TEMPLATES else ():
                total += 1
                wrong += any(n[3] for n in license_scan._notices(model, t, hint))
    assert total > 100 and wrong <= 0.1 * total


def test_template_candidates_lose_nothing(licences, docs):
    """Looking up templates by their words gives what every template at every place gives."""
    rng = random.Random(12)
    plain = [w for r in docs.limit(50).collect() for w in license_scan.words_in(r["text"])]
    for f, ts in license_scan.TEMPLATES.items():
        for t in ts:
            words = [*rng.choices(plain, k=15), *license_scan.words_in(t), *rng.choices(plain, k=15)]
            every = {(g, s) for g, u in licences.all for s in license_scan._aligned(u, words)}
            near = {(g, s) for g, u in licences.near(words) for s in license_scan._aligned(u, words)}
            confirmed = lambda found: {(g, s) for g, s in found if licences.cover(g, words[s[0] : s[1]])[0] >= license_scan.COVER}  # noqa: E731,B023
            assert confirmed(near) == confirmed(every) and f in {g for g, _ in near}


def test_windows_and_keys_are_fitted_to_all_items(monkeypatch):
    rng, seen = random.Random(3), set()
    texts = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)).encode() for _ in range(450)]
    monkeypatch.setattr(decontaminate, "PLACEMENTS", tuple(lambda text, rng, f=f: (seen.add(text), f(text, rng))[1] for f in decontaminate.PLACEMENTS))
    decontaminate.Family(list(range(len(texts))), texts)
    assert seen == set(texts)
