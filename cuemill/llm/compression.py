"""Quality by compression: texts are compressed with a zstandard dictionary of good texts and with one of bad ones, and the
difference of the sizes, over the text's own size, is calibrated to the chance that a text is good.

Whole texts are read, in pieces of PIECE bytes of UTF-8 (cut at code points), each compressed alone: a dictionary tells most
at the start of what is compressed, and a long text would otherwise soon be compressed with itself. A text's measure is the
difference summed over its pieces by its bytes, so what says the same again and again, which takes next to nothing with
either dictionary, comes near 0 and not near good texts. Memory doesn't grow with a text.

Learning sees a bounded sample of labelled documents: LABELLED by hash of the id of each label at most. Of half of them,
drawn by hash, up to SAMPLED distinct pieces of each label from anywhere in the texts make the dictionaries; the other half's
measures fit the calibration (a logistic curve with both classes' targets smoothed), so it never sees what a dictionary was
made of. Documents whose crc32 of the id, modulo FOLDS, is HELD_OUT are never learned from, nor are those without id or
quality. Of several labels of a document the best counts. lang, source and doc_id are no inputs of a score.

Without text of both labels for dictionaries there is no measure: it is 0 for all. Calibration without one of the labels
gives the smoothed share of good documents among the labelled ones (a half if there are none) to all. A null or empty text has
measure 0, as has one that both dictionaries fit alike. Repeated rows are each scored alike; an empty table gives no rows.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import small_batches, staged

FOLDS, HELD_OUT, CUTOFF = 5, 0, 0.3
LABELLED, SAMPLED = 4000, 4000
PIECE, DICTIONARY, LEVEL = 512, 64 << 10, 3
#: Training needs several times as much text as the dictionary holds: with less of either label, both dictionaries are smaller.
ENOUGH = 8
#: Added to the bytes of a text, so that a few letters alone don't decide.
LEAST = 8


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def pieces_of(text: str | None) -> Iterator[bytes]:
    data, at = (text or "").encode(), 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def dictionary(pieces: list[bytes], size: int, level: int = LEVEL) -> bytes:
    """A trained dictionary, or the last of the text itself where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


class Compressors:
    """Sizes of texts under a good and a bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        self.ready = bool(good and bad)
        if self.ready:
            self.good, self.bad = (self._made(d, level) for d in (good, bad))

    @staticmethod
    def _made(content: bytes, level: int) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level)
        return zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)

    def measure(self, text: str | None) -> float:
        """Above 0 if the good dictionary fits better."""
        if not self.ready or not text:
            return 0.0
        size = good = bad = 0
        for piece in pieces_of(text):
            size += len(piece)
            good += len(self.good.compress(piece))
            bad += len(self.bad.compress(piece))
        return (bad - good) / (size + LEAST)


def calibrated(measures: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * measure + b))): Newton's steps on the cross-entropy with smoothed targets."""
    n, k = len(good), int(good.sum())
    if k in (0, n):
        return 0.0, math.log((k + 1) / (n - k + 1))
    target = np.where(good, (k + 1) / (k + 2), 1 / (n - k + 2))
    x, w = np.stack([measures, np.ones(n)]), np.array([0.0, math.log(k / (n - k))])
    loss = lambda w: float(np.sum(np.logaddexp(0, w @ x) - target * (w @ x)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(w @ x)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        scale = 1.0
        while scale > 1e-6 and loss(w - scale * step) > loss(w):
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])



def _learners(docs: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """doc_id, text, good, half: the bounded sample, with every row that has one of its ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    draw = F.xxhash64("doc_id", F.lit(1))
    ids = None
    for good in (True, False):
        some = known.where(F.col("good") == good).orderBy(draw, "doc_id").limit(labelled)
        ids = some if ids is None else ids.unionByName(some)
    chosen = staged(ids.select("doc_id", "good", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)).alias("half")), "labelled", gather=True)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # two labels' worth of ids at most


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for good, text in zip(*batch.columns, strict=True):
            found = []
            for piece in pieces_of(text.as_py()):
                found.append(piece.decode())
                if len(found) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array([good.as_py()] * 1000, pa.bool_()), pa.array(found, pa.string())], names=["good", "piece"])
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([good.as_py()] * len(found), pa.bool_()), pa.array(found, pa.string())], names=["good", "piece"])


def trained(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, sampled: int = SAMPLED) -> tuple[bytes, bytes, float, float]:
    """The good and the bad dictionary, and the calibration. docs: doc_id, text; labels: doc_id, quality."""
    learners = staged(_learners(small_batches(docs), labels, labelled), "learners", gather=True)
    pieces = learners.where("half = 0").select("good", "text").mapInArrow(_pieces, "good boolean, piece string")
    # Copies of a piece have one key and count once.
    keyed = pieces.select("good", "piece", F.xxhash64("piece").alias("key"))
    drawn = [[r["piece"].encode() for r in keyed.where(F.col("good") == good).groupBy("key").agg(F.min("piece").alias("piece")).orderBy("key").limit(sampled).collect()] for good in (True, False)]
    size = min(DICTIONARY, min(sum(map(len, d)) for d in drawn) // ENOUGH)
    made = [dictionary(d, size) if size else b"" for d in drawn]
    compare = _measured(*made)
    seen = learners.where("half = 1").select("doc_id", "good", compare("text").alias("measure")).groupBy("doc_id", "good").agg(F.min("measure").alias("measure")).orderBy("doc_id").collect()
    a, b = calibrated(np.array([r["measure"] for r in seen]), np.array([r["good"] for r in seen], bool))
    return made[0], made[1], a, b


_held: dict[tuple[bytes, bytes], Compressors] = {}


def _measured(good: bytes, bad: bytes):
    """A pandas function of texts that gives their measures."""

    @F.pandas_udf("double")
    def measured(texts: pd.Series) -> pd.Series:
        if (good, bad) not in _held:  # one a worker
            _held.clear()
            _held[good, bad] = Compressors(good, bad)
        return texts.map(_held[good, bad].measure).astype("float64")

    return measured


def scored(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, sampled: int = SAMPLED) -> DataFrame:
    """doc_id, held_out, measure, score, predicted (1 from CUTOFF on): a row for each row of docs (doc_id, text)."""
    good, bad, a, b = trained(docs, labels, labelled, sampled)
    rows = small_batches(docs).select("doc_id", _measured(good, bad)("text").alias("measure"))
    score = 1 / (1 + F.exp(-(a * F.col("measure") + b)))
    rows = rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "measure", score.alias("score"))
    return rows.select("*", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
