"""Language identification: a bidirectional gated recurrent network over bytes.

Each byte of a text gets a state from what is before it and one from what is after it, within stretches of STRETCH bytes;
both together give every position a distribution over the learned languages, and a document's is the mean over all its
positions. The network is trained here, in numpy, by backpropagation through time on a bounded sample: SPANS stretches from
all over each of at most about PER_LANGUAGE documents per language, and of fewer where there are more than LANGUAGES
languages, but of one at least. Every language is learned; the states grow with the logarithm of their number.
Inference reads whole texts, many stretches at a time, so its memory doesn't depend on a text's length.

Documents whose crc32 of the id, modulo FOLDS, is HELD_OUT are never learned from; nor are those without id or language.
Texts that are null or have no letter get UNKNOWN with score 0, as all texts do if there is nothing to learn from.
Repeated rows are each predicted. Ties go to the language that sorts first. An empty table gives no rows. Only doc_id, text and
lang are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import small_batches

FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
STRETCH, STATES = 64, 8
LANGUAGES, PER_LANGUAGE, SPANS = 64, 1200, 3
EPOCHS, BATCH, RATE = 6, 256, 0.02
TILE = 2048


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, stretch of text): what is learned from. Bounded by LANGUAGES * PER_LANGUAGE * SPANS stretches or so, and a document a language."""
    known = docs.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    steps = 1 << 20
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(steps))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()
    if not counts:
        return []
    each = max(1, min(PER_LANGUAGE, LANGUAGES * PER_LANGUAGE // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], max(min(steps, steps * each // r["n"] + 1), r["least"] + 1)) for r in counts], "lang string, share bigint")
    chosen = known.join(F.broadcast(shares), "lang").where(draw < F.col("share"))
    # Places come from a hash, anywhere in the text.
    spots = F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1).cast("int") + 1 for k in range(2, 2 + SPANS)])
    rows = chosen.select("doc_id", "lang", F.explode(F.transform(spots, lambda s: F.substring(F.col("text"), s, F.lit(STRETCH)))).alias("part"))
    # Repeated rows count once; the limit holds even where a hash picks more than it should.
    return [(r["lang"], r["part"]) for r in rows.distinct().orderBy("doc_id", "lang", "part").limit(2 * SPANS * (LANGUAGES * PER_LANGUAGE + len(counts))).collect()]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Parameters: for both directions a table of inputs by byte and the recurrent weights, and the output layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(languages)
        self.languages, self.size = languages, STATES * max(1, math.ceil(math.log2(max(n, 1)) / 2))
        h = self.size
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", draw(256, 3 * h, scale=0.3)), ("u", draw(h, 3 * h, scale=h**-0.5)))} | {"vf": draw(h, n, scale=h**-0.5), "vb": draw(h, n, scale=h**-0.5), "c": np.zeros(n, np.float32)}

    def states(self, codes: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """The state at each of codes (steps x rows), read forwards or backwards; keep: gets what training needs."""
        x, u, h = self.p["x" + d], self.p["u" + d], self.size
        out = np.empty((*codes.shape, h), np.float32)
        state = np.zeros((codes.shape[1], h), np.float32)
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            a, b = x[codes[t]], state @ u
            gates = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, r, new, b[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def chances(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        logits = forward @ self.p["vf"] + backward @ self.p["vb"] + self.p["c"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, codes: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all positions, by backpropagation through time."""
        kept = {"f": [], "b": []}
        seen = {d: self.states(codes, d, kept[d]) for d in "fb"}
        error = self.chances(seen["f"], seen["b"])
        error[:, np.arange(len(labels)), labels] -= 1
        error *= mask[:, :, None] / max(mask.sum(), 1)
        g = {"c": error.sum(axis=(0, 1))}
        h = self.size
        for d in "fb":
            u, v = self.p["u" + d], self.p["v" + d]
            g["v" + d] = np.tensordot(seen[d], error, axes=((0, 1), (0, 1)))
            gx, gu = np.zeros_like(self.p["x" + d]), np.zeros_like(u)
            back, came = error @ v.T, np.zeros((codes.shape[1], h), np.float32)
            for t, before, z, r, new, b in reversed(kept[d]):
                came = came + back[t]
                dn = came * (1 - z) * (1 - new * new)
                inner = np.concatenate([came * (before - new) * z * (1 - z), dn * b * r * (1 - r), dn * r], axis=1)
                gu += before.T @ inner
                outer = inner.copy()
                outer[:, 2 * h :] = dn
                np.add.at(gx, codes[t], outer)
                came = came * z + inner @ u.T
            g["x" + d], g["u" + d] = gx, gu
        return g

    def train(self, parts: list[tuple[str, str]], seed: int = 3) -> Network:
        """Adam over shuffled batches, languages weighing the same."""
        rng = np.random.default_rng(seed)
        number = {k: i for i, k in enumerate(self.languages)}
        labels = np.array([number[k] for k, _ in parts])
        raw = [t.encode()[:STRETCH] for _, t in parts]
        codes = np.frombuffer(b"".join(t.ljust(STRETCH, b"\0") for t in raw), np.uint8).reshape(-1, STRETCH).T
        mask = (np.arange(STRETCH)[:, None] < np.array([len(t) for t in raw])[None, :]).astype(np.float32)
        weight = len(labels) / np.bincount(labels, minlength=len(number))[labels] / len(number)
        draw = weight / weight.sum()
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = max(60, 4 * len(number), EPOCHS * len(parts) // BATCH)
        for step in range(1, steps + 1):
            some = rng.choice(len(parts), size=min(BATCH, len(parts)), p=draw)
            rate = RATE * (1 - step / (steps + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, g in self.gradients(codes[:, some], mask[:, some], labels[some]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = (self.p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """The mean distribution over all positions of each text."""
        n = len(self.languages)
        out = np.zeros((len(texts), n))
        lengths = np.array([len(t) for t in texts])
        counts = -(-lengths // STRETCH)
        owner = np.repeat(np.arange(len(texts)), counts)
        flat = np.frombuffer(b"".join(t.ljust(c * STRETCH, b"\0") for t, c in zip(texts, counts.tolist(), strict=True)), np.uint8).reshape(-1, STRETCH)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        left = np.minimum(lengths[owner] - place * STRETCH, STRETCH)
        for a in range(0, len(flat), TILE):
            codes = np.ascontiguousarray(flat[a : a + TILE].T)
            chances = self.chances(self.states(codes, "f"), self.states(codes, "b"))
            inside = np.arange(STRETCH)[:, None] < left[None, a : a + TILE]
            np.add.at(out, owner[a : a + TILE], np.einsum("tnc,tn->nc", chances, inside.astype(np.float32)))
        return out / np.maximum(lengths, 1)[:, None]


def trained(docs: DataFrame) -> Network | None:
    parts = sample(docs)
    return Network(sorted({k for k, _ in parts})).train(parts) if parts else None


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each row of docs (doc_id, text, lang)."""
    shipped = docs.sparkSession.sparkContext.broadcast(trained(docs))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shipped.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                lettered = np.array(part.column(3).to_pylist(), bool)
                names, scores = np.array([UNKNOWN] * len(lettered), object), np.zeros(len(lettered))
                at = np.flatnonzero(lettered)
                if network and len(at):
                    chances = network.documents([part.column(2)[k].as_buffer().to_pybytes() for k in at.tolist()])
                    best = chances.argmax(axis=1)
                    names[at], scores[at] = [network.languages[k] for k in best], np.clip(chances[np.arange(len(at)), best], 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names.tolist(), pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = small_batches(docs).select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(label, "doc_id bigint, held_out boolean, lang_pred string, score double")
