"""Source divergence audit: how far each source's words are from those of the other sources of its language, and which words
set it apart.

Terms are runs of ASCII letters and of code points beyond ASCII; only A to Z are lower-cased. A language keeps the terms that
LEAST of its documents have. A group is a language and a source; its shares are smoothed over all kept terms of the language,
in billionths, whole numbers throughout: p = 1 + floor(SCALE * (count + 1) / (N + V)). What a term adds to the distance from
q to p is floor((p - q)^2 / q).

How it is spread. A task counts the terms of FLUSH bytes of documents at a time, by one sort of numbers that stand for group,
term and document, so a word that every document has leaves a task as one row a group and FLUSH bytes. Kept counts are dealt out by (language, block of terms, block of
sources, block of sources): such a tile is a dense int64 matrix of groups by terms, in which all pairs of its groups are
compared by broadcasting, SLICE numbers at a time. Tiles have bounded size, whatever the numbers of documents, terms, sources
and languages: TERMS terms (by hash, so some more or fewer) and twice SOURCES sources. They return partial sums of pairs and
a heap of the foremost terms for each group; sums are added up, heaps merged in two rounds. A term that no group of a tile
has isn't in it: those are counted, and their part, the same for each, is added at the end.

A row of documents is a document, also a repeated one. Null text, lang and source are ''. A group without terms has N = 0; a
language without kept terms has pairs of value 0 and no terms. An empty table gives no rows; of one source there are no
pairs. Texts of over FLUSH bytes are counted in pieces of PIECE bytes that end between terms; a term is whole, however long. Only lang,
source and text are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import small_batches, staged

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
TERMS, SOURCES, SLICE = 4096, 128, 1 << 20
#: Bytes of texts whose terms are counted at once, and what a row takes besides; bytes of a longer text that are.
FLUSH, ROW, PIECE = 16 << 20, 64, 1 << 20
#: Rows that a task hands on at once.
BATCH = 1 << 16
#: Blocks whose heaps are merged in the first round.
ROUND = 64

#: In UTF-8, code points beyond ASCII are bytes beyond ASCII, and bytes.lower() touches A to Z only.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_IN_TERM = np.array([bool(_TERM.match(bytes([c]))) for c in _LOWER])
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_TILE = "lang string, source string, part string, item string, block int, value bigint, seen bigint, lone bigint"


def term_counts(text: str | bytes | None) -> Counter:
    """Terms, in UTF-8, and how often the text has them."""
    data, counts, at = (text if isinstance(text, bytes) else (text or "").encode()).lower(), Counter(), 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        counts.update(_TERM.findall(data, at, end))
        at = end
    return counts


def _rows(groups: list[tuple[str, str]], group: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """_COUNTS: a row for each count of a group's term, and one without a term for each group, which tells that it occurs."""
    which = pa.array(np.concatenate([np.arange(len(groups)), group]))
    names = [pa.array(x, pa.string()).take(which) for x in zip(*groups, strict=True)]
    numbers = [pa.array(np.concatenate([np.zeros(len(groups), np.int64), x])) for x in (n, docs)]
    made = pa.RecordBatch.from_arrays([*names, pa.concat_arrays([pa.nulls(len(groups), pa.string()), terms.cast(pa.string())]), *numbers], names=["lang", "source", "term", "n", "docs"])
    for i in range(0, made.num_rows, BATCH):
        yield made.slice(i, BATCH)


def _counted_texts(rows: list[tuple[str, str, bytes]]) -> Iterator[pa.RecordBatch]:
    """_COUNTS of some rows (lang, source, text) by one sort of their terms' numbers."""
    places: dict[tuple[str, str], int] = {}
    group = np.array([places.setdefault(row[:2], len(places)) for row in rows], np.int64)
    # The last byte of each text is a gap.
    letters = np.frombuffer(b"\n".join([*(row[2] for row in rows), b""]), np.uint8)
    inside = _IN_TERM[letters]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
    found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[letters[inside]])]).dictionary_encode()
    held = np.diff(np.searchsorted(starts, np.cumsum([len(row[2]) + 1 for row in rows])), prepend=0)
    doc, kinds = np.repeat(np.arange(len(rows)), held), max(1, len(found.dictionary))
    # The rows of a chunk are too few for these numbers to pass 64 bits.
    keys = (group[doc] * kinds + found.indices.to_numpy()) * len(rows) + doc
    keys.sort()
    pairs = keys // len(rows)
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    docs = np.add.reduceat(np.diff(keys, prepend=-1) != 0, first, dtype=np.int64) if len(first) else first
    at = pairs[first]
    yield from _rows(list(places), at // kinds, found.dictionary.take(pa.array(at % kinds)), np.diff(np.append(first, len(keys))), docs)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            text = (text or "").encode()
            if len(text) > FLUSH:
                counts = term_counts(text)
                n = np.fromiter(counts.values(), np.int64, len(counts))
                yield from _rows([(lang, source)], np.zeros(len(n), np.int64), pa.array(list(counts), pa.binary()), n, np.ones(len(n), np.int64))
                continue
            # A row takes some room, however short its text.
            if held and size + len(text) + ROW > FLUSH:
                yield from _counted_texts(held)
                held, size = [], 0
            held.append((lang, source, text))
            size += len(text) + ROW
    if held:
        yield from _counted_texts(held)


def counts_of(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often each group has a term, and in how many documents; a row with a null term for
    each group."""
    whole = small_batches(docs).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "text")
    return whole.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> F.Column:
    """p of a count, as whole numbers of any size."""
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(19, 0)) div CAST({total} + {terms} AS DECIMAL(19, 0))")


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _heap(terms: np.ndarray, values: np.ndarray, top: int) -> list[tuple[int, str]]:
    """The foremost terms: greatest value first, then by UTF-8 (which orders as code points do)."""
    if len(values) > top:
        enough = values >= np.partition(values, len(values) - top)[len(values) - top]
        terms, values = terms[enough], values[enough]
    return heapq.nsmallest(top, ((-v, t) for v, t in zip(values.tolist(), terms.tolist(), strict=True)))


def _merged(top: int):
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(top, zip((-rows["value"]).tolist(), rows["item"].tolist(), strict=True))
        return pd.DataFrame({"lang": key[0], "source": key[1], "block": key[2], "item": [t for _, t in best], "value": [-v for v, _ in best]})

    return merge


def _tile(top: int):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, block, left, right = key
        groups = rows[rows["term"].isna()].sort_values("place")
        cells = rows[rows["term"].notna()]
        columns, terms = pd.factorize(cells["term"])
        names, base, side = groups["source"].tolist(), groups["p"].to_numpy(np.int64), groups["side"].to_numpy()
        at = pd.Series(np.arange(len(names)), index=groups["place"].to_numpy())[cells["place"].to_numpy()].to_numpy()
        p = np.repeat(base[:, None], len(terms), axis=1)
        p[at, columns] = cells["p"].to_numpy(np.int64)
        a, b = np.flatnonzero(side == left), np.flatnonzero(side == right)
        sums = np.zeros((len(a), len(b)), np.int64)
        width = max(1, SLICE // max(1, len(a) * len(b)))
        for i in range(0, len(terms), width):
            part = p[:, i : i + width]
            sums += _divergence(part[a][:, None, :], part[b][None, :, :]).sum(axis=2)
        # In a tile of one block of sources, both its sides are the same groups.
        x, y = np.nonzero(a[:, None] != b[None, :])
        lone = _divergence(base[a][:, None], base[b][None, :])
        out = [("pair", names[g], names[h], v, len(terms), w) for g, h, v, w in zip(a[x], b[y], sums[x, y].tolist(), lone[x, y].tolist(), strict=True)]
        if left == right:
            own, q, texts = cells["p"].to_numpy(np.int64), cells["q"].to_numpy(np.int64), cells["term"].to_numpy(object)
            for g, name in enumerate(names):
                mine = (at == g) & (own > q)
                out += [("term", name, t, -v, 0, 0) for v, t in _heap(texts[mine], _divergence(own[mine], q[mine]), top)]
        made = pd.DataFrame(out, columns=["part", "source", "item", "value", "seen", "lone"])
        return made.assign(lang=lang, block=block)[["lang", "source", "part", "item", "block", "value", "seen", "lone"]]

    return compare


def audited(docs: DataFrame, least: int = LEAST, top: int = TOP, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank. docs: lang, source, text.

    Part pair: the distances of each group from every other source of its language. Part term: the terms that a group has
    more of than its language, up to rank top. terms and sources: the sizes of a tile.
    """
    counts = staged(counts_of(docs), "terms")
    groups, found = counts.where("term IS NULL").select("lang", "source"), counts.where("term IS NOT NULL")
    of_term = Window.partitionBy("lang", "term")
    kept = found.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("whole")).where(F.col("docs") >= least)
    kept = staged(kept.select("lang", "source", "term", "n", "whole"), "kept_terms")
    # N of each group; V and N of each language; places of groups in their language, which make blocks.
    totals = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").select("lang", "source", F.coalesce("own", F.lit(0)).alias("own"))
    sizes = kept.groupBy("lang", "term").agg(F.first("whole").alias("whole")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("all"))
    places = totals.join(sizes, "lang", "left").select("lang", "source", "own", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all", F.lit(0)).alias("all"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"), F.count("*").over(Window.partitionBy("lang")).alias("groups"))
    side = F.floor(F.col("place") / sources).cast("int")
    last = F.floor((F.col("groups") - 1) / sources).cast("int")
    places = staged(places.select("lang", "source", "own", "v", "all", "place", side.alias("side"), last.alias("last"), F.ceil(F.col("v") / terms).cast("int").alias("blocks")), "groups", gather=True)
    # A group meets each block of sources in a tile, as its left and as its right side.
    sides = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.col("last")), lambda s: F.array(F.struct(F.col("side").alias("left"), s.alias("right")), F.struct(s.alias("left"), F.col("side").alias("right")))))))
    shown = places.where("v > 0")
    bare = shown.select("lang", "source", "place", "side", "last", F.lit(None).cast("string").alias("term"), share("0", "own", "v").alias("p"), F.lit(0).cast("bigint").alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = kept.join(shown, ["lang", "source"]).select("lang", "source", "place", "side", "last", "term", share("n", "own", "v").alias("p"), share("whole", "all", "v").alias("q"), F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    dealt = cells.unionByName(bare).select("*", sides.alias("s")).select("lang", "source", "place", "side", "term", "p", "q", "block", "s.left", "s.right")
    tiles = staged(dealt.groupBy("lang", "block", "left", "right").applyInPandas(_tile(top), _TILE), "tiles")

    # Terms in none of a tile's groups add the same each; a language without kept terms has no tile.
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.first("lone").alias("lone"))
    pairs = pairs.join(sizes.select("lang", "v"), "lang").select("lang", "source", "item", (F.col("value") + (F.col("v") - F.col("seen")) * F.col("lone")).alias("value"))
    void = places.where("v = 0").select("lang", "source")
    empty = void.join(void.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    heaps = tiles.where("part = 'term'").select("lang", "source", (F.col("block") % ROUND).alias("block"), "item", "value")
    for block in (F.col("block"), F.lit(0)):
        heaps = heaps.withColumn("block", block).groupBy("lang", "source", "block").applyInPandas(_merged(top), "lang string, source string, block int, item string, value bigint")
    return ranked(pairs.unionByName(empty), "pair").unionByName(ranked(heaps, "term"))
