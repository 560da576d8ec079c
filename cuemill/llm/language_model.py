"""Stupid-backoff scores of documents under the n-gram counts of a corpus, computed relationally.

Every word of a text makes an n-gram of up to ORDER words with those before it: a history and the word. A word scores
c(history, word) / c(history) if the n-gram occurs LEAST times or more, else BACKOFF times its score after a history that is
one word shorter; a word without history scores c(word) / N, and one that the corpus lacks counts as once. A document's score
is the sum of logarithms of counts, each in rounded millionths, so that sums don't depend on their order.

For each order the exploded n-grams (document, history, word) are dealt by the hash of their history together with those of
the corpus. Counting by history and word, and by history, gives each partition its part of the n-gram table and of the table
of the next lower order, and joins them to the n-grams, which were moved once. Sums go to the documents; n-grams that are too
rare go on to the next lower order. Where the scored documents are the corpus and LEAST is 1, every n-gram is counted, so
c(first words) / N is what remains of a document's first words, and no lower order is needed but for texts of one word.

An order's n-grams are moved in PASSES, one after another, each for its share of the histories by their hash. What a pass moved
is summed up and dropped before the next one starts, so the disk holds about that share of the n-grams at a time.

Histories and n-grams that are more than 1 / (HOT * partitions) of all n-grams are hot; there are at most HOT * partitions of
either. They consist of hot words, so few n-grams have to be counted to find them. Their counts are broadcast: n-grams of a
hot history are dealt by their word too, and hot n-grams by their document. So no partition gets much more than its share.

Words and n-grams are told apart by 64-bit hashes, documents by id and a hash of their text. Null texts and texts without
words have no words and a null score. Repeated rows count and score each; ids may be null. Very long texts need no more than
their words' hashes at once. An empty table gives no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cuemill.llm.common import shuffles_dropped, small_batches, staged

ORDER, LEAST, BACKOFF, UNIT = 3, 1, 0.4, 1e6
#: Hot n-grams a partition, and n-grams that a partition has on average.
HOT, SHARE = 4, 2_000_000
#: Passes over the texts, each of which moves the n-grams of its share of the histories.
PASSES = 3
#: Bytes of texts whose words are hashed at once.
GROUP = 2 << 20
#: Rows that are held in a task to be put together, and rows that a task hands on at once.
HELD, BATCH = 1 << 18, 1 << 16
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LETTERS = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_KEY = ["doc_id", "mark"]
ONE_WORD = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+$"
#: value is a word, or the number of words of a text; kind is a sum of these.
_ROWS = "doc_id bigint, mark int, history bigint, value bigint, kind int"
COUNTED, ASKED, WORD, TEXT = 1, 2, 4, 8


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in their order."""
    x = (a ^ (a >> np.uint64(31))) * _MIX + b
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, and how many each text has. A word's is made from the sum of its letters' codes
    times the powers of an odd number, which is a difference of two running sums."""
    letters = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[letters], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, length = edges[::2], edges[1::2] - edges[::2]
    upto = np.cumsum(length)
    place = np.arange(int(length.sum())) - np.repeat(upto - length, length)
    powers = np.cumprod(np.append(np.ones(1, np.uint64), np.full(int(length.max(initial=0)), _MIX)), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[letters[np.repeat(starts, length) + place]] * powers[place], dtype=np.uint64)])
    hashes = mixed(sums[upto] - sums[upto - length], length.astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)


def _grams(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The hashes of the size words that end before each of at; those of one word are its own."""
    out = words[at - size]
    for k in range(size - 1, 0, -1):
        out = mixed(out, words[at - k])
    return out


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """history, word, times: the times of an n-gram that stands in many batches are summed before they leave the task."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= HELD:
            held = _added(held)
            size = sum(b.num_rows for b in held)
            if size >= HELD // 2:
                yield from held
                held, size = [], 0
    yield from _added(held) if held else ()


def _added(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    sums = pa.Table.from_batches(batches).group_by(["history", "word"], use_threads=False).aggregate([("times", "sum")])
    return sums.select(["history", "word", "times_sum"]).rename_columns(["history", "word", "times"]).to_batches()


def _hashed(docs: DataFrame, rows, schema: str, after=iter) -> DataFrame:
    """What rows(words, sizes, doc_ids, marks) makes of some documents at a time, a record batch each, and after() of those."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t.encode() for t in batch.column(2).to_pylist()]
            start, size = 0, 0
            for k, t in enumerate(texts, 1):
                size += len(t)
                if size >= GROUP or k == len(texts):
                    yield rows(*word_hashes(texts[start:k]), batch.column(0).slice(start, k - start), batch.column(1).slice(start, k - start))
                    start, size = k, 0

    return small_batches(docs).select("doc_id", F.hash("text").alias("mark"), "text").mapInArrow(lambda batches: after(explode(batches)), schema)


def n_grams(docs: DataFrame, order: int, counted: bool = True, asked: str = "all", lower: bool = False, part: int = 0, parts: int = 1) -> DataFrame:
    """_ROWS (kinds in brackets): the n-grams of an order (history and word), which count, or are asked for ("all", the "first" one of each text,
    none: ""), or both. Counted ones have a row without word for the history at the end of a text, so that a history counts
    as often as it occurs; "sums" asks for all and for the count of the first history. A row for each text has its number of
    words, where all are asked for. lower: with the hash of the history without its first word. part: of this many parts of the
    histories only one; rows of whole texts are in the first."""
    schema = _ROWS + ", lower bigint" * lower

    def rows(words: np.ndarray, sizes: np.ndarray, doc_ids: pa.Array, marks: pa.Array) -> pa.RecordBatch:
        ends = np.cumsum(sizes)
        owner, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(words)) - np.repeat(ends - sizes, sizes)
        at = np.flatnonzero(place >= order - 1) if counted or asked != "first" else np.flatnonzero(place == order - 1)
        wants = np.full(len(at), bool(asked)) if asked != "first" else place[at] == order - 1
        long = np.flatnonzero(sizes >= order - 1) if order > 1 else np.empty(0, np.intp)
        last, first = (long if counted else long[:0]), (long if asked == "sums" else long[:0])
        texts = np.arange(len(sizes)) if asked in ("all", "sums") else np.empty(0, np.intp)
        owners = np.concatenate([owner[at], last, first, texts])
        spots = np.concatenate([at, ends[last], ends[first] - sizes[first] + order - 1]) if order > 1 else at
        history = _grams(words, spots, order - 1) if order > 1 else np.zeros(len(spots), np.uint64)
        none = np.ones(len(owners), bool)
        word_there, history_there = none.copy(), none.copy()
        word_there[len(at) :], history_there[len(spots) :] = False, False
        pad = lambda x: np.concatenate([x.view(np.int64), np.zeros(len(owners) - len(x), np.int64)])
        kind = np.zeros(len(owners), np.int32)
        kind[: len(at) + len(last)] = COUNTED * counted
        kind[: len(at)] += WORD + ASKED * wants
        kind[len(at) + len(last) : len(spots)] = ASKED
        kind[len(spots) :] = TEXT
        value = pad(words[at])
        value[len(spots) :] = sizes[texts]
        who = pa.array(owners)
        columns = [doc_ids.take(who), marks.take(who), pa.array(pad(history), mask=~history_there), pa.array(value, mask=history_there & ~word_there), pa.array(kind)]
        if lower:
            columns.append(pa.array(pad(_grams(words, at, order - 2)) if order > 2 else value, mask=~word_there | (order < 3)))
        batch = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])
        if parts == 1:
            return batch
        mine = np.full(len(owners), part == 0)
        mine[: len(history)] = (history >> np.uint64(33)) % np.uint64(parts) == part
        return batch.filter(pa.array(mine))

    return _hashed(docs, rows, schema)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: how often each word occurs in all documents."""

    def rows(words: np.ndarray, *_) -> pa.RecordBatch:
        words, n = np.unique(words, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    with shuffles_dropped(docs.sparkSession):
        return staged(_hashed(docs, rows, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words", gather=True)


def hot_counts(corpus: DataFrame, docs: DataFrame | None, order: int, words: DataFrame, least: float) -> DataFrame:
    """history, word (null: any), n: the histories and n-grams of an order (over 1) that occur more than least times in the
    corpus and docs, with their counts in the corpus. words: the words of both.

    Each of their words is as frequent, of which there are few, so n-grams with others are left out where they are read.
    """
    few = words.where(F.col("n") > least).select("word").collect()  # n / least rows at most
    shipped = corpus.sparkSession.sparkContext.broadcast(np.sort(np.array([r["word"] for r in few], np.int64).view(np.uint64)))

    def rows(words: np.ndarray, sizes: np.ndarray, *_) -> pa.RecordBatch:
        hot, place = shipped.value, np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        known = hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words if len(hot) else np.zeros(len(words), bool)

        def ends(size: int) -> np.ndarray:
            """Where size hot words of a text end."""
            whole = place >= size - 1
            for k in range(size):
                whole[k:] &= known[: len(known) - k]
            return np.flatnonzero(whole)

        short, long = ends(order - 1), ends(order)
        history = np.concatenate([_grams(words, short + 1, order - 1), _grams(words, long, order - 1)])
        word = np.concatenate([words[short], words[long]])
        return pa.RecordBatch.from_arrays([pa.array(history.view(np.int64)), pa.array(word.view(np.int64), mask=np.arange(len(word)) < len(short)), pa.array(np.ones(len(word), np.int64))], names=["history", "word", "times"])

    schema = "history bigint, word bigint, times bigint"
    found = _hashed(corpus, rows, schema, _together).withColumn("n", F.col("times"))
    if docs is not None:
        found = found.unionByName(_hashed(docs, rows, schema, _together).withColumn("n", F.lit(0).cast("bigint")))
    counts = found.groupBy("history", "word").agg(F.sum("n").alias("n"), F.sum("times").alias("rows"))
    with shuffles_dropped(corpus.sparkSession):
        return staged(counts.where(F.col("rows") > least).drop("rows"), "hot", gather=True)


def log_of(count: Column) -> Column:
    return F.round(UNIT * F.log(count)).cast("bigint")


def resolved(rows: DataFrame, hot: DataFrame, partitions: int, after=None, schema: str | None = None) -> DataFrame:
    """rows of n_grams() with n, how often the n-gram occurs among the counted rows, and total, how often its history does; or what
    after() makes of them (an Arrow table a partition), by its schema."""
    totals = F.broadcast(hot.where("word is null").select("history", F.col("n").alias("hot_total")))
    times = F.broadcast(hot.where("word is not null").select("history", F.col("word").alias("value"), F.col("n").alias("hot_n")))
    known = rows.join(totals, "history", "left").join(times, ["history", "value"], "left")
    counted = F.col("hot_n").isNotNull() | F.col("history").isNull() | (F.col("hot_total").isNotNull() & F.col("value").isNull())
    slot = F.when(counted, F.xxhash64(*_KEY)).when(F.col("hot_total").isNotNull(), F.col("value")).otherwise(0)
    dealt = known.repartition(partitions, "history", slot).select(*rows.columns)
    # Tasks look the counts of what is hot up themselves, so they needn't be moved with each row.
    found = hot.collect()  # HOT * partitions of either at most
    hashes = lambda name: np.array([r[name] or 0 for r in found], np.int64).view(np.uint64)
    whole = np.array([r["word"] is None for r in found], bool)
    keys, often = np.where(whole, hashes("history"), mixed(hashes("history"), hashes("word"))), np.array([r["n"] for r in found], np.int64)
    by_key = np.argsort(keys)
    tables = [(keys[order], often[order]) for order in (by_key[~whole[by_key]], by_key[whole[by_key]])]
    shipped = rows.sparkSession.sparkContext.broadcast(tables)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (parts := list(batches)):
            return
        table = pa.Table.from_batches(parts)
        history, value = (table[name].fill_null(0).to_numpy().view(np.uint64) for name in ("history", "value"))
        kind = table["kind"].to_numpy()

        def times(keys: np.ndarray, counts: np.ndarray, known: np.ndarray, often: np.ndarray) -> pa.Array:
            each, which = np.unique(keys, return_inverse=True)
            n = np.bincount(which, counts).astype(np.int64)
            at = np.searchsorted(each, known)
            there = at < len(each)
            there[there] = each[at[there]] == known[there]
            n[at[there]] = often[there]
            return pa.array(n[which])

        counted = (kind & COUNTED) > 0
        n = times(mixed(history, value), counted & ((kind & WORD) > 0), *shipped.value[0])
        table = table.append_column("n", n).append_column("total", times(history, counted, *shipped.value[1]))
        yield from (after(table) if after else table).to_batches(BATCH)

    return dealt.mapInArrow(count, schema or StructType([*rows.schema, StructField("n", LongType()), StructField("total", LongType())]))


_TERMS = "doc_id bigint, mark int, term bigint, tokens bigint"


def _terms(table: pa.Table, alone: int) -> pa.Table:
    """_TERMS: what the rows of resolved() add to their documents' scores, and a row of 0 with its number of words for each text.
    The first words, as many as a history has, score their count / N (whose logarithm is alone) in all: each one's count is the
    next one's history. A word that always follows its history adds nothing and needs no row.

    The rows are a share of the n-grams. Sums of a task's n-grams would be about as many where tasks are many, as each then has
    few n-grams of a document, but where they are few they would be a row for each document and task."""
    kind, n, total = (table[name].to_numpy() for name in ("kind", "n", "total"))
    text, word = (kind & TEXT) > 0, (kind & WORD) > 0
    there = text | (((kind & ASKED) > 0) & ~(word & (n == total)))
    text, word, kept = text[there], word[there], table.select([*_KEY, "value"]).filter(pa.array(there))
    logs = lambda counts: np.floor(UNIT * np.log(np.maximum(counts[there], 1)) + 0.5).astype(np.int64)
    term = np.where(text, 0, logs(total) - alone)
    term[word] = (logs(n) - logs(total))[word]
    tokens = pa.array(kept["value"].fill_null(0).to_numpy(), mask=~text)
    return kept.select(_KEY).append_column("term", pa.array(term)).append_column("tokens", tokens).combine_chunks()


def scored(docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, least: int = LEAST, share: int = SHARE, passes: int = PASSES) -> DataFrame:
    """doc_id, n_tokens, log_score (natural, rounded to millionths), mean_log_score: a row for each row of docs (doc_id, text),
    under the counts of corpus (text), which is docs itself if none is given."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    certain = corpus is None and least <= 1
    source = docs if corpus is None else corpus.select(F.lit(None).cast("bigint").alias("doc_id"), "text")
    words = word_counts(source)
    every = words if corpus is None else words.unionByName(word_counts(docs)).groupBy("word").agg(F.sum("n").alias("n"))
    with shuffles_dropped(docs.sparkSession):
        total, size = (table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] for table in (words, every))
    least_partitions, places = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / share)
    partitions = max(least_partitions, math.ceil(places / passes))
    hot = lambda k: hot_counts(source, None if corpus is None else docs, k, every, size / (HOT * max(least_partitions, places)))
    sums = []
    has = lambda kinds: F.col("kind").bitwiseAND(kinds) > 0

    def summed(terms: DataFrame) -> DataFrame:
        # Rows of one id and text are one document that stands there as often as it has a number of words.
        return terms.groupBy(*_KEY).agg(F.sum("term").alias("term"), F.max("tokens").alias("tokens"), F.count("tokens").alias("copies"))

    def add(rows: DataFrame, term: Column) -> None:
        sums.append(summed(rows.select(*_KEY, term.alias("term"), F.when(has(TEXT), F.col("value")).alias("tokens"))))

    alone = round(UNIT * math.log(max(total, 1)))
    if certain:
        often = hot(order)
        for part in range(passes):
            rows = n_grams(docs, order, asked="sums", part=part, parts=passes)
            found = summed(resolved(rows, often, partitions, lambda table: _terms(table, alone), _TERMS))
            with shuffles_dropped(docs.sparkSession):
                sums.append(staged(found, "sums", gather=True))
        left = n_grams(docs.where(F.col("text").rlike(ONE_WORD)), 1, counted=False, asked="first") if order > 2 else None
    else:
        left = None
        for k in range(order, 1, -1):
            often, whole = hot(k), []
            for part in range(passes):
                asked = n_grams(docs, k, counted=False, asked="all" if k == order else "first", lower=True, part=part, parts=passes)
                rows = n_grams(source, k, asked="", lower=True, part=part, parts=passes).unionByName(asked)
                if left is not None:
                    rows = rows.unionByName(left.where(F.shiftrightunsigned("history", 33) % passes == part))
                with shuffles_dropped(docs.sparkSession):
                    whole.append(staged(resolved(rows, often, partitions).where(has(ASKED | TEXT)), "scored"))
            rows = reduce(DataFrame.unionByName, whole)
            seen = F.col("n") >= least
            add(rows, F.when(has(WORD), F.when(seen, log_of(F.col("n")) - log_of(F.col("total"))).otherwise(round(UNIT * math.log(BACKOFF)))))
            rare = rows.where(has(WORD) & ~seen)
            left = rare.select(*_KEY, F.col("lower").alias("history"), "value", F.lit(ASKED | WORD).alias("kind"), F.lit(None).cast("bigint").alias("lower"))
        left = left.unionByName(n_grams(docs, 1, counted=False, asked="first", lower=True))
    if left is not None:
        add(left.join(words.withColumnRenamed("word", "value"), "value", "left"), log_of(F.coalesce("n", F.lit(1))) - F.lit(alone))
    found = reduce(DataFrame.unionByName, sums).groupBy(*_KEY).agg(F.sum("term").alias("score"), F.max("tokens").alias("n_tokens"), F.sum("copies").alias("copies"))
    value = F.when(F.col("n_tokens") > 0, F.col("score") / F.col("copies") / UNIT)
    return found.select("doc_id", F.col("n_tokens"), value.alias("log_score"), (value / F.col("n_tokens")).alias("mean_log_score"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("__copy")).drop("__copy")
