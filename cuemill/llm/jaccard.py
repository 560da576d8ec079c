"""N-gram Jaccard self-join: a MinHash LSH forest, then exact verification, then classes.

Words are runs without white space, shingles are SHINGLE words in a row (all words of a shorter text). Texts with equal sets
of shingles are one node with a count of copies; only nodes are compared. Each node has TREES lists of DEPTH MinHash labels:
its paths in the prefix tries of the forest. Nodes that share a prefix of the present depth in a tree are candidates. Prefixes
are shortened until a pair at the threshold itself is found with a chance of TARGET, and then on until the recall estimated
from what is found reaches it too: a pair of similarity s that is found stands for 1 / (1 - (1 - s^depth)^TREES). A pair belongs to the first tree
in which it shares the prefix, so it is looked at once. Its shingle sets are then compared exactly (as 64-bit hashes).

No pairs are written anywhere. A trie node with many members is cut into blocks, and every two blocks meet in one bounded
group; a group gives each member's number of links and a spanning forest of its links. Links of a document are all other
documents with a similarity of at least THRESHOLD, its exact copies included. Classes are the connected components of links.

Texts without words (null, empty, white space) link to nothing and are classes by themselves. Null and repeated ids are
kept; a class is named after its least doc_id. An empty table gives no rows. Very long texts are read whole, as sets of
hashes. joined() reads doc_id and text only; one_of_each() keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import small_batches, staged, text_key, unused, words_of

SHINGLE, THRESHOLD, TARGET = 5, 0.8, 0.995
TREES, DEPTH = 16, 8
DEPTHS = (8, 7, 6, 5, 4, 3)
#: Members of a block. Groups hold two blocks at most.
BLOCK = 400
#: Pairs whose labels agree less than this are not compared: over four standard deviations below the threshold.
LEAST_AGREEMENT = 0.65
BINS = 64
#: Rows of 16-byte keys that may be broadcast (32 MB); more are joined by shuffle.
BROADCAST_ROWS = 2_000_000

_rng = np.random.default_rng(20)
_FLIP = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_TURN = _rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def hashed_words(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def shingle_sets(hashes: pa.ListArray) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    values, ends = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64), hashes.offsets.to_numpy()
    mixed = np.zeros(max(len(values) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        mixed = (mixed ^ values[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(mixed[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(np.frombuffer(hashlib.blake2b(values[a:b].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def paths(sets: list[np.ndarray]) -> np.ndarray:
    """TREES * DEPTH labels of 16 bits for each non-empty set: the least of its hashes under as many permutations."""
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    start = 0
    while start < len(sets):  # chunks that stay in a core's cache
        stop, size = start, 0
        while stop < len(sets) and (stop == start or size + len(sets[stop]) <= 30_000):
            size += len(sets[stop])
            stop += 1
        flat = (np.concatenate(sets[start:stop]) >> np.uint64(32)).astype(np.uint32)
        first = np.cumsum([0, *(len(s) for s in sets[start : stop - 1])])
        turned = np.empty_like(flat)
        for j in range(TREES * DEPTH):
            np.bitwise_xor(flat, _FLIP[j], out=turned)
            np.multiply(turned, _TURN[j], out=turned)
            out[start:stop, j] = np.minimum.reduceat(turned, first)
        start = stop
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key, text_hash, node (null without words), size, path: a row for each row of docs."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                sets = shingle_sets(pa.concat_arrays([part.column(3)]))
                full = np.flatnonzero([len(s) > 0 for s in sets])
                path = iter(paths([sets[k] for k in full]))
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                labels = [next(path).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(labels, pa.binary())], names=["doc_id", "key", "text_hash", "node", "size", "path"])

    text = F.coalesce("text", F.lit(""))
    rows = small_batches(docs).select("doc_id", text_key(F.col("doc_id"), F.col("text")).alias("key"), F.unhex(F.md5(text)).alias("text_hash"), hashed_words(F.col("text")).alias("words"))
    return staged(rows.mapInArrow(sketch, "doc_id bigint, key string, text_hash binary, node binary, size bigint, path binary"), "sketches", gather=True)


def _groups(batches: Iterator[pa.RecordBatch], width: int = 4) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows with equal first columns, one group at a time, from rows that are sorted by those."""
    now, rows = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(width)), strict=True))
        rest = {batch.schema.names[k]: batch.column(k).to_pylist() for k in range(width, batch.num_columns)}
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])] if keys else []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            if keys[a] != now:
                if rows:
                    yield now, rows
                now, rows = keys[a], {k: v[a:b] for k, v in rest.items()}
            else:
                for k, v in rest.items():
                    rows[k] += v[a:b]
    if rows:
        yield now, rows


def _pairs(group: tuple, blocks: list[int], labels: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i < j of this group's own pairs, and how far their labels agree.

    Own are pairs whose first common prefix is in this tree, of different blocks where two blocks meet.
    """
    tree, _, one, two = group
    side, n = np.array(blocks), len(blocks)
    found = []
    step = max(1, 4_000_000 // (n * TREES * DEPTH))
    for a in range(0, n, step):
        same = labels[a : a + step, None, :] == labels[None, :, :]
        common = same.reshape(*same.shape[:2], TREES, DEPTH)[..., :depth].all(axis=3)
        own = common[..., tree] & ~common[..., :tree].any(axis=2) & (np.arange(n)[None, :] > np.arange(a, min(a + step, n))[:, None])
        if one != two:
            own &= side[a : a + step, None] != side[None, :]
        i, j = np.nonzero(own)
        agreement = same[i, j].mean(axis=1)
        close = agreement >= LEAST_AGREEMENT
        found.append((i[close] + a, j[close], agreement[close]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _labels(paths_: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(paths_), "<u2").reshape(len(paths_), TREES * DEPTH)


def candidate_groups(nodes: DataFrame, depth: int) -> DataFrame:
    """tree, prefix, one, two (the blocks that meet), node, block, path, text_hash, copies: members of trie nodes."""
    at = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    prefix = F.xxhash64("tree", F.substring(F.col("path"), F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * depth)))
    bare = nodes.select("node", "path", at.alias("tree")).select("node", "tree", prefix.alias("prefix"))
    shared = bare.groupBy("tree", "prefix").agg(F.count("*").alias("members")).where("members > 1")
    shared = staged(shared, "trie")
    # Few trie nodes are shared, so of most nodes nothing is left after this join; large ones are split by Spark.
    inside = bare.join(shared, ["tree", "prefix"])
    cut = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), cut).cast("int")
    met = inside.select("node", "tree", "prefix", block.alias("block"), F.explode(F.sequence(F.lit(0), cut - 1)).alias("other"))
    return met.select("tree", "prefix", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "block")


def _sorted_groups(rows: DataFrame) -> DataFrame:
    keys = ["tree", "prefix", "one", "two"]
    first = [*keys, *[c for c in rows.columns if c not in keys]]
    return rows.select(first).repartition(*keys).sortWithinPartitions(*keys)


def close_members(nodes: DataFrame, depth: int) -> DataFrame:
    """Of the candidate groups only members with an own pair that may be similar; found: such pairs by agreement, once a group."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group, rows in _groups(batches):
            if len(rows["node"]) > 1:
                i, j, agreement = _pairs(group, rows["block"], _labels(rows["path"]), depth)
                if len(i):
                    counts = np.bincount(np.minimum(agreement * BINS, BINS - 1).astype(int), minlength=BINS).tolist()
                    for k in np.unique(np.concatenate([i, j])).tolist():
                        out.append((*group, rows["node"][k], rows["block"][k], rows["path"][k], rows["text_hash"][k], rows["copies"][k], counts))
                        counts = None
            if len(out) >= 5000:
                yield _batch(out, members)
                out = []
        yield _batch(out, members)

    members = pa.schema([("tree", pa.int32()), ("prefix", pa.int64()), ("one", pa.int32()), ("two", pa.int32()), ("node", pa.binary()), ("block", pa.int32()), ("path", pa.binary()), ("text_hash", pa.binary()), ("copies", pa.int64()), ("found", pa.list_(pa.int64()))])
    rows = candidate_groups(nodes, depth).join(nodes.select("node", "path", "text_hash", "copies"), "node")
    return staged(_sorted_groups(rows).mapInArrow(look, "tree int, prefix bigint, one int, two int, node binary, block int, path binary, text_hash binary, copies bigint, found array<bigint>"), "members")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def recall(members: DataFrame, depth: int) -> float:
    """Estimated share of similar pairs that this depth has found, from their agreements."""
    rows = members.where("found is not null").select(F.posexplode("found").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS rows at most
    seen = [((r["bin"] + 0.5) / BINS, r["n"]) for r in rows if (r["bin"] + 0.5) / BINS >= THRESHOLD]
    stand_for = sum(n / chance(s, depth) for s, n in seen)
    return sum(n for _, n in seen) / stand_for if stand_for else 1.0


def chance(similarity: float, depth: int) -> float:
    """That a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, links, root: verified links of each node by group, and the group's spanning forest as edges to roots."""
    for depth in (d for d in DEPTHS if chance(THRESHOLD, d) >= TARGET):
        members = close_members(nodes, depth)
        if recall(members, depth) >= TARGET:
            break
    wanted = staged(members.select("text_hash").distinct(), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.unhex(F.md5(text)).alias("text_hash"), "text").join(wanted, "text_hash", "left_semi")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(pa.concat_arrays([part.column(1)]))], pa.binary())], names=["text_hash", "shingles"])

    sets = rows.select("text_hash", hashed_words(F.col("text")).alias("words")).mapInArrow(shingled, "text_hash binary, shingles binary").dropDuplicates(["text_hash"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group, rows in _groups(batches):
            i, j, _ = _pairs(group, rows["block"], _labels(rows["path"]), depth)
            if len(i):
                real = similar([np.frombuffer(s, np.uint64) for s in rows["shingles"]], i, j)
                i, j = i[real], j[real]
            if len(i):
                copies = np.array(rows["copies"])
                n = np.bincount(i, copies[j], len(copies)) + np.bincount(j, copies[i], len(copies))
                root = roots(len(copies), i, j)
                out += [(rows["node"][k], int(n[k]), rows["node"][root[k]]) for k in np.flatnonzero(n).tolist()]
            if len(out) >= 5000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    schema = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
    return staged(_sorted_groups(members.drop("found").join(sets, "text_hash").drop("text_hash")).mapInArrow(verify, "node binary, links bigint, root binary"), "links")


def similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs have a Jaccard similarity of THRESHOLD at least, exactly."""
    size = np.array([len(s) for s in sets])
    if len(i) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    else:  # products of incidence matrices, of few shingles at a time
        owner = np.repeat(np.arange(len(sets)), size)
        _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = times[shingle] > 1
        owner, shingle = owner[several], shingle[several]
        order = np.argsort(shingle, kind="stable")
        owner, shingle = owner[order], np.cumsum(np.diff(shingle[order], prepend=-1) > 0) - 1
        both = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, 4096):
            x, y = np.searchsorted(shingle, [a, a + 4096])
            inside = np.zeros((len(sets), 4096), np.float32)
            inside[owner[x:y], shingle[x:y] - a] = 1
            both += inside @ inside.T
        common = both[i, j].astype(int)
    return 10 * common >= round(10 * THRESHOLD) * (size[i] + size[j] - common)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label: the least label of each node's component. edges: node, root; nodes: node, label.

    Labels pass over edges and then jump to their label's label, until none changes. Each round's table is written.
    """
    edges = edges.where("node != root").select("node", "root").distinct()
    both = staged(edges.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges.select(F.col("root").alias("a"), F.col("node").alias("b"))), "edges")
    labels = staged(nodes.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi"), "labels")
    while True:
        offered = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("offer"))
        passed = labels.join(offered, labels["node"] == offered["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("offer", "label")).alias("label"))
        passed = staged(passed, "labels")
        far = passed.select(F.col("node").alias("via"), F.col("label").alias("further"))
        jumped = staged(passed.join(far, passed["label"]["node"] == far["via"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = jumped.where("old != label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches of docs, and node, label, links for each node."""
    made = sketches(docs)
    nodes = staged(made.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("text_hash").alias("text_hash"), F.min("path").alias("path")), "nodes")
    found = links(docs, nodes)
    own = nodes.select("node", "copies", F.struct("least", "node").alias("label"))
    part = components(found, own.select("node", "label"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = own.join(part.withColumnRenamed("label", "part"), "node", "left").join(counted, "node", "left")
    return made, staged(joined.select("node", F.coalesce("part", "label").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "classes")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links: a row for each row of docs (doc_id, text)."""
    made, classes = _classes(docs)
    rows = made.select("doc_id", "node").join(classes, "node", "left")
    return rows.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("label.least")).alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are left if one document of each class stays: that of the least id.

    Texts without words all stay. Dropped keys are joined away rather than kept ones joined in, since they are fewer.
    """
    made, classes = _classes(docs)
    rows = staged(made.where("node is not null").select("doc_id", "key", "node").join(classes.select("node", "label"), "node").groupBy("key", "label").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "keys")
    stays = rows.groupBy("label").agg(F.min_by("key", F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "key")).alias("key"))
    dropped = staged(rows.join(stays, ["label", "key"], "left_anti").select("key"), "dropped")
    again = staged(rows.join(stays, ["label", "key"], "left_semi").where("rows > 1").select("key"), "again")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    mark = unused(docs, "__key_of_row")
    left = docs.withColumn(mark, text_key(docs["doc_id"], docs["text"])).join(small(dropped.withColumnRenamed("key", mark)), mark, "left_anti")
    repeated = small(again.withColumnRenamed("key", mark))
    once = left.join(repeated, mark, "left_anti").unionByName(left.join(repeated, mark, "left_semi").dropDuplicates([mark])) if again.limit(1).count() else left
    return once.select(docs.columns)
