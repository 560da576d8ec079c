"""Benchmark passages in documents: CGK embedding, repeated bit sampling, exact edit verification.

Texts are compared as lower-case words (runs of letters and digits) joined by single spaces, in UTF-8: punctuation, symbols,
underscores and the kind of white space never count as edits. The random walk of Chakraborty, Goldenberg and
Koucky (a letter is written, and the walk moves on or stays by a random bit for step and letter) turns edit distance into
Hamming distance. Windows are as long as the items: a walk takes two steps a letter, forwards from where a word starts and
backwards from where one ends, over the whole length of the longest item that the window may hold. Keys are SAMPLED steps of
a walk out of STRETCH in a row, and such stretches lie all over the item, so an item is met wherever its edits are. There are
KEYS keys a walk, and walks are drawn anew until TARGET of the items share a key with themselves edited, for each of PLACEMENTS. Items
that share a key with a window are candidates; Myers' bit-parallel search then gives the exact least edit distance between
the item and any stretch around the window, which counts up to LIMIT of the item's length.

Windows stand where several runs of letters (seeds) that also stand in items of that length agree on where an item would
start or end. How long seeds are and how many must agree is fitted to each class of lengths, such that at most UNSEEN of its
items go without a window, for the worst of PLACEMENTS. Short seeds stand in many places, so more of them must agree. A seed knows one place only, however many items have it: seeds
say where to look, and for how long an item; which one it is, is for the keys to say. Items so short that no seeds are sure to
be left are looked for at every word.

The items are a stated query set: they are indexed in blocks of at most BLOCK_CHARS, each of which is shipped to all tasks.
Null texts and texts without words (of symbols alone) never match. Items of equal text are all reported; items without words are skipped.
Repeated document rows are each reported. An empty table of either kind gives no rows. Very long texts are searched whole,
a group of texts at a time; columns other than doc_id, item_id and text are passed on by clean() whatever their names.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuemill.llm.common import small_batches

LIMIT, TARGET, UNSEEN = 0.2, 0.96, 0.04
SAMPLED, STRETCH, KEYS, MOST_WALKS = 12, 40, 32, 400
#: Edited items that a class is fitted to, at least: all of its items, again and again while they are fewer.
CALIBRATED = 400
#: Of the steps of a walk, texts that have nothing in common share about a tenth.
ALIKE = 0.25
#: Lengths of seeds that are tried, in bytes.
SEEDS = (14, 12, 10, 8, 7, 6, 5, 4, 3)
BLOCK_CHARS = 1_000_000
#: Windows that walk at once, bytes of the texts that are searched at once, and of those that are looked up at once.
WINDOWS, GROUP, SLICE = 4096, 4 << 20, 1 << 15
_RESULT = "doc_id bigint, item_id bigint, start bigint, end bigint, distance bigint, similarity double"
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: A letter or digit is what isn't a space, punctuation or a symbol.
WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join([w.lower() for w in WORD.findall(text or "")])


def edited(text: bytes, rate: float, rng: random.Random) -> bytes:
    letters = bytearray(text)
    for _ in range(int(rate * len(text))):
        i, kind = rng.randrange(len(letters) + 1), rng.randrange(3)
        letters[i : i + (kind > 0)] = b"" if kind == 2 else bytes([rng.choice(text)])
    return bytes(letters)


def spread(text: bytes, step: int, rng: random.Random) -> bytes:
    """text with every step-th letter replaced by another."""
    letters = bytearray(text)
    for i in range(step - 1, len(letters), step):
        letters[i] = rng.choice([c for c in {*text, *b"xyz"} if c != letters[i]])
    return bytes(letters)


#: Edits that windows and keys are fitted to, each by itself: LIMIT of the letters anywhere, and every eighth. Nearer ones take
#: seeds of five letters and fewer, which stand nearly everywhere in a text.
PLACEMENTS = (lambda text, rng: edited(text, LIMIT, rng), lambda text, rng: spread(text, 8, rng))


def runs(letters: np.ndarray, size: int) -> np.ndarray:
    """A code for each run of size letters; letters have 16 more at their end."""
    eight = np.ndarray((max(len(letters) - 16, 0),), "<u8", letters, 0, (1,))
    if size < 8:
        return (eight & np.uint64((1 << 8 * size) - 1)) * _MIX
    rest = np.ndarray((max(len(letters) - 16, 0),), "<u8", letters, size - 8, (1,))
    return eight * _MIX ^ rest * _MIX2


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one, spaces between them and 17 after the last, and where each starts."""
    return np.frombuffer(b" " + b" ".join(texts) + b" " * 17, np.uint8), 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])


class Codes:
    """A set of 64-bit codes: most others are told apart by one look into a table of their first bits."""

    def __init__(self, codes: np.ndarray):
        self.sorted = codes
        self.shift = np.uint64(64 - max(16, int(16 * len(codes)).bit_length()))
        self.table = np.zeros(1 << int(64 - self.shift), bool)
        self.table[(codes >> self.shift).astype(np.intp)] = True

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where codes of the set stand, ascending, and which they are."""
        at = np.flatnonzero(self.table.take((codes >> self.shift).view(np.int64)))
        which = np.minimum(np.searchsorted(self.sorted, codes[at]), max(len(self.sorted) - 1, 0))
        same = self.sorted[which] == codes[at] if len(self.sorted) else np.zeros(len(at), bool)
        return at[same], which[same]


def walked(letters: np.ndarray, starts: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """What the walks of this seed write from each start (steps x starts). Odd seeds walk backwards."""
    moves = np.random.default_rng(seed).integers(0, 2, (steps, 256), dtype=np.intp) * (-1 if seed % 2 else 1)
    at, out = starts.copy(), np.empty((steps, len(starts)), np.uint8)
    for move, row in zip(moves, out, strict=True):
        letters.take(at, mode="clip", out=row)
        at += move.take(row)
    return out


class Family:
    """Items of about one length: how their windows are found, and the keys of their walks."""

    def __init__(self, numbers: list[int], texts: list[bytes]):
        self.numbers, rng = np.array(numbers), random.Random(len(numbers))
        self.least_size, self.size = min(map(len, texts)), max(map(len, texts))
        self.sizes, self.steps = np.array([len(t) for t in texts]), 2 * self.size
        #: How far apart seeds may see the start of an item: three deviations of what letters joined and cut move.
        self.slack = 6 + round(3 * (LIMIT * 2 / 3 * self.size) ** 0.5)
        each = CALIBRATED // len(PLACEMENTS)
        own = [t for t in texts * -(-each // len(texts)) for _ in PLACEMENTS]
        other = [PLACEMENTS[i % len(PLACEMENTS)](t, rng) for i, t in enumerate(own)]
        self._sow(texts, other)
        self._draw(texts, own, other)

    def _sow(self, texts: list[bytes], other: list[bytes]) -> None:
        """Chooses how long seeds are (0: no seeds), and how many must agree."""
        letters, at = padded(texts)
        changed, to = padded(other)
        sizes = np.array([len(t) for t in texts])
        self.seed_size = self.agreeing = 0
        for size in SEEDS:
            place = np.concatenate([np.arange(a, max(a + n - size + 1, a)) for a, n in zip(at[:-1], sizes, strict=True)])
            codes, first = np.unique(runs(letters, size)[place], return_index=True)
            owner = np.searchsorted(at, place[first], "right") - 1
            seeds, offset, length = Codes(codes), place[first] - at[owner], sizes[owner]
            where, which = seeds.found(runs(changed, size))
            text = np.searchsorted(to, where, "right") - 1
            start = where - offset[which] - to[np.maximum(text, 0)]
            near = (np.abs(start) <= self.slack) & (text >= 0)
            seen = np.bincount(text[near], minlength=len(other))[: len(other)].reshape(-1, len(PLACEMENTS))
            least = int(np.quantile(seen, UNSEEN, axis=0, method="lower").min())
            if least > 1:
                self.seed_size, self.agreeing, self.seeds, self.offset, self.length = size, least, seeds, offset, length
                return

    def _draw(self, texts: list[bytes], own: list[bytes], other: list[bytes]) -> None:
        # What follows an edited text differs from what follows its own.
        (a, a_at), (b, b_at), (c, c_at) = padded(own), padded(other[::-1]), padded(texts)
        starts = {"f": (a_at[:-1], b_at[:-1][::-1], c_at[:-1]), "b": (a_at[1:] - 2, b_at[1:][::-1] - 2, c_at[1:] - 2)}
        span = min(STRETCH, 2 * self.least_size)
        draw = np.random.default_rng(self.size)
        met = np.zeros(len(own), bool)
        self.walks: list[tuple[int, np.ndarray]] = []
        self.written: list[np.ndarray] = []
        codes, items = [], []
        share = lambda: met.reshape(-1, len(PLACEMENTS)).mean(axis=0).min()
        while share() < TARGET:
            if len(self.walks) == MOST_WALKS:
                raise ValueError(f"{MOST_WALKS} walks find {share():.2f} of items of {self.size} bytes, which is less than {TARGET}")
            seed = len(self.walks)
            # Stretches stand all over the shortest item; walks keep together best near their start, so more stand there.
            first = (draw.random(KEYS) ** 2 * max(2 * self.least_size - span, 0)).astype(int)
            places = np.array([f + np.sort(draw.choice(span, min(SAMPLED, span), replace=False)) for f in first])
            self.walks.append((seed, places))
            w, x, y = (walked(t, at, seed, self.steps) for t, at in zip((a, b, c), starts["b" if seed % 2 else "f"], strict=True))
            own_steps = np.arange(self.steps)[:, None] < 2 * np.array([len(t) for t in own])
            alike = ((w == x) & own_steps).sum(axis=0) >= ALIKE * own_steps.sum(axis=0)
            met |= (self.keys(w, seed) == self.keys(x, seed)).any(axis=0) & alike
            keys = self.keys(y, seed)
            self.written.append(np.ascontiguousarray(y.T))
            codes.append(keys.ravel())
            items.append(np.tile(np.arange(len(texts)), len(keys)))
        codes, items = np.concatenate(codes), np.concatenate(items)
        order = np.argsort(codes, kind="stable")
        self.codes, self.items = codes[order], items[order]
        self.known = Codes(self.codes)

    def keys(self, written: np.ndarray, walk: int) -> np.ndarray:
        """The keys (keys x windows) of one walk."""
        out = np.empty((KEYS, written.shape[1]), np.uint64)
        for k, places in enumerate(self.walks[walk][1]):
            packed = np.zeros((written.shape[1], 16), np.uint8)
            packed[:, : len(places)] = written[places].T
            two = packed.view("<u8")
            out[k] = (two[:, 0] + np.uint64(1 + walk * KEYS + k)) * _MIX
            out[k] ^= two[:, 1] * _MIX2
        out ^= out >> np.uint64(29)
        out *= _MIX2
        return out

    def candidates(self, written: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items, by their places here, that share a key and are alike."""
        at, first = self.known.found(self.keys(written, walk).ravel())
        times = np.searchsorted(self.codes, self.codes[first], "right") - first
        window = np.repeat(at % written.shape[1], times)
        item = self.items[np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        both = np.unique(window * len(self.sizes) + item)
        window, item = both // len(self.sizes), both % len(self.sizes)
        alike, rows = np.zeros(len(both), bool), np.ascontiguousarray(written.T) if len(both) else written
        for a in range(0, len(both), WINDOWS):
            i = item[a : a + WINDOWS]
            same = (rows[window[a : a + WINDOWS]] == self.written[walk][i]) & (np.arange(self.steps) < 2 * self.sizes[i][:, None])
            alike[a : a + WINDOWS] = same.sum(axis=1) >= ALIKE * 2 * self.sizes[i]
        return window[alike], item[alike]


def _search(pattern: str, text: str, anywhere: bool) -> tuple[int, int]:
    """Least edit distance between pattern and a stretch of text, and where the first such stretch ends.

    Stretches start anywhere, or else at the start of text. Columns of differences are kept as bits of two integers.
    """
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    up, down, score, best = full, 0, n, (n, 0)
    for j, c in enumerate(text, 1):
        same = where.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        down_or_same = same | down
        plus, minus = down | (full & ~(across | up)), up & across
        score += bool(plus & top) - bool(minus & top)
        plus = (plus << 1) | (not anywhere)
        minus <<= 1
        up, down = (minus | ~(down_or_same | plus)) & full, plus & down_or_same & full
        if score < best[0]:
            best = (score, j)
    return best


def closest(pattern: str, text: str) -> tuple[int, int, int]:
    """Least distance of pattern to a stretch of text, and that stretch."""
    if (at := text.find(pattern)) >= 0:
        return 0, at, at + len(pattern)
    distance, end = _search(pattern, text, True)
    _, back = _search(pattern[::-1], text[:end][::-1], False)
    return distance, end - back, end


class Index:
    """Items of one block."""

    def __init__(self, items: list[tuple[int | None, str]]):
        by_text: dict[str, list] = defaultdict(list)
        for item_id, text in items:
            if t := normal(text):
                by_text[t].append(item_id)
        self.texts, self.ids = list(by_text), list(by_text.values())
        self.raw = [t.encode() for t in self.texts]
        classes = defaultdict(list)
        for i, t in enumerate(self.raw):
            classes[int(2 * np.log2(len(t)))].append(i)
        self.families = [Family(numbers, [self.raw[i] for i in numbers]) for _, numbers in sorted(classes.items())]
        sizes = {f.seed_size for f in self.families} - {0}
        self.seeds = {size: Codes(np.unique(np.concatenate([f.seeds.sorted for f in self.families if f.seed_size == size]))) for size in sizes}

    def _windows(self, letters: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each family the places where its windows start, and those where they end."""
        space = letters == 32
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:])
        hits = {}
        for size, seeds in self.seeds.items():
            parts = []
            for a in range(0, len(letters) - 16, SLICE):  # slices that stay in a core's cache
                codes = runs(letters[a : a + SLICE + 16], size)
                at, _ = seeds.found(codes)
                parts.append((at + a, codes[at]))
            hits[size] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        out: tuple[list, list] = [], []
        for f in self.families:
            if not f.seed_size:
                out[0].append(starts)
                out[1].append(ends)
                continue
            at, codes = hits[f.seed_size]
            own, which = f.seeds.found(codes)
            start = at[own] - f.offset[which]
            for places, seen, windows in ((starts, start, out[0]), (ends, start + f.length[which] - 1, out[1])):
                seen = np.sort(seen)
                first, last = seen[: max(len(seen) - f.agreeing + 1, 0)], seen[f.agreeing - 1 :]
                agree = last - first <= f.slack
                windows.append(_among(places, last[agree] - f.slack, first[agree] + f.slack))
        return out

    def matches(self, groups: Iterable[list[str]]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, word after the last): the closest stretch for each text and item.

        Texts come in groups, of which one is in memory at a time; a text belongs to one group.
        """
        found, before = [], 0
        for texts in groups:
            raw = [normal(t).encode() for t in texts]
            letters, at = padded(raw)
            found += [(before + t, i, *x) for (t, i), x in sorted(self._searched(letters, at, raw).items())]
            before += len(texts)
        return found

    def _searched(self, letters: np.ndarray, at: np.ndarray, raw: list[bytes]) -> dict[tuple[int, int], tuple[int, int, int]]:
        spots: dict[tuple[int, int], set[int]] = defaultdict(set)
        for back, windows in enumerate(self._windows(letters)):
            places = np.unique(np.concatenate(windows)) if windows else np.empty(0, np.intp)
            if not len(places):
                continue
            holds = [np.isin(places, w, assume_unique=False) for w in windows]
            longest = np.max([np.where(h, f.steps, 0) for h, f in zip(holds, self.families, strict=True)], axis=0)
            order = np.argsort(longest, kind="stable")  # windows of like length walk together
            for a in range(0, len(order), WINDOWS):
                some = order[a : a + WINDOWS]
                here, inside = places[some], [(f, np.flatnonzero(h[some])) for f, h in zip(self.families, holds, strict=True)]
                inside = [(f, w) for f, w in inside if len(w)]
                for walk in range(back, max(len(f.walks) for f, _ in inside), 2):
                    written = walked(letters, here, walk, max(f.steps for f, _ in inside if walk < len(f.walks)))
                    for f, w in inside:
                        if walk < len(f.walks):
                            window, item = f.candidates(written[: f.steps, w], walk)
                            start = here[w[window]]
                            text = np.searchsorted(at, start, "right") - 1
                            if back:
                                start = start - f.sizes[item] + 1
                            for key in zip(text.tolist(), f.numbers[item].tolist(), start.tolist(), strict=True):
                                spots[key[:2]].add(key[2])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (text, item), starts in spots.items():
            size, own, searched = len(self.raw[item]), raw[text], None
            slack = max(3, size // 4)
            for start in sorted(starts):
                if searched is not None and start - searched <= size // 8 or best.get((text, item), (1,))[0] == 0:
                    continue  # what was searched for the window before reaches as far as its slack
                searched = start
                start -= int(at[text])
                a, b = own.rfind(b" ", 0, max(start - slack, 0)) + 1, own.find(b" ", min(start + size + slack, len(own)))
                region = own[a : b if b >= 0 else len(own)].decode()
                distance, begin, end = closest(self.texts[item], region)
                words = own.count(b" ", 0, a)
                if distance <= LIMIT * len(self.texts[item]) and (distance, words) < best.get((text, item), (distance + 1, 0)):
                    best[text, item] = distance, words + region.count(" ", 0, begin + 1), words + region.count(" ", 0, end) + 1
        return best


def _among(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The places in any of the ranges low to high, which both ascend."""
    if not len(low):
        return places[:0]
    cover = np.zeros(len(places) + 1, np.int32)
    a, b = np.searchsorted(places, low, "left"), np.searchsorted(places, high, "right")
    np.add.at(cover, a, 1)
    np.add.at(cover, np.maximum(a, b), -1)
    return places[np.cumsum(cover[:-1]) > 0]


def blocks(items: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size, of which the driver holds one at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        if row["text"]:
            block.append((row["item_id"], row["text"]))
            size += len(row["text"])
            if size >= chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def in_groups(texts: pa.Array, size: int = GROUP) -> Iterator[list[str]]:
    """Texts in a row that have about size letters together."""
    group, letters = [], 0
    for text in texts:
        group.append(text.as_py() or "")
        letters += len(group[-1])
        if letters >= size:
            yield group
            group, letters = [], 0
    if group:
        yield group


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, distance, similarity: a row for each document and item that it holds."""
    out = None
    for block in blocks(items):
        shipped = docs.sparkSession.sparkContext.broadcast(Index(block))

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                rows = []
                for t, item, distance, first, last in index.matches(in_groups(batch.column(1))):
                    words = [m.span() for m in WORD.finditer(batch.column(1)[t].as_py())]
                    start, end = words[first][0], words[min(last, len(words)) - 1][1]
                    rows += [(batch.column(0)[t].as_py(), i, start, end, distance, 1 - distance / len(index.texts[item])) for i in index.ids[item]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, [pa.int64()] * 5 + [pa.float64()], strict=True)], names=["doc_id", "item_id", "start", "end", "distance", "similarity"])

        found = small_batches(docs).select("doc_id", "text").mapInArrow(search, _RESULT)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], _RESULT)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    for block in blocks(items):
        shipped = docs.sparkSession.sparkContext.broadcast(Index(block))
        column = docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch], shipped=shipped, column=column) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                for t, *_ in index.matches(in_groups(batch.column(column))):
                    stays[t] = False
                yield batch.filter(pa.array(stays))

        docs = small_batches(docs).mapInArrow(keep, docs.schema)
    return docs
