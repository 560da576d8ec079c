"""Token ids as flat binary files with 64-bit document offsets, written by partition and memory-mapped to read.

Documents are dealt by range of doc_id, of how their text begins and of their place, so that rows of one id are spread too, and
sorted; each task writes one set of files: NAME.ids (unsigned integers, 16 bits
where the vocabulary allows, else 32), NAME.offsets (unsigned 64 bits: where each document starts in the file, and the end
of the last) and NAME.docs (64-bit doc_ids; null as the smallest). The manifest has a row a task, and prefix sums over it
give each file's base, so a token's place in the whole is base + offset. Names are new for each attempt of a task: files of
lost attempts are never in the manifest.

Null texts count as empty and give the end id only. Null ids come first; rows with equal ids are in the order of how
their texts begin. An empty table gives no files and no rows. Very long texts are cut into stretches that the library sees one by one.
Other columns aren't read, whatever their names. Files go to the shared folder of the cluster through its file system;
where that is not mounted, a reader copies one file at a time to its own disk to map it.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import tempfile
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import small_batches, stage_dir, staged

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Stretches that are remembered, how long such a stretch may be, and new ones that are encoded together.
MEMO, LONGEST, MISSES = 650_000, 64, 1024
#: Files that a reader's task takes.
FILES_A_TASK = 2
MARKS = (".", ",")
NO_ID = np.iinfo(np.int64).min


def lowered(text: str) -> str:
    """Lower case, which the tokenizer's normaliser makes anyway, where that is sure to be the same: Latin-1 text without
    anything like the spelling of a special token. Fewer stretches differ then."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


#: Fixed value: the pattern of the words that may be cut out of their stretch: runs of letters, single digits, runs of other marks.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_spaces(vocabulary: str) -> bool:
    """Does this tokenizer lower-case texts and take WORDS out of them, with nothing put before or after? Only then are stretches
    between spaces encoded by themselves, each once; whole texts are otherwise."""
    made = json.loads(vocabulary)
    normal, cut = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
    steps, parts = [n["type"] for n in normal.get("normalizers", [])], cut.get("pretokenizers", [])
    split = parts[0] if parts else {}
    plain = split.get("type") == "Split" and split.get("pattern") == {"Regex": WORDS} and split.get("behavior") == "Removed" and split.get("invert") is True
    return steps == ["NFC", "Replace", "Lowercase"] and plain and [(q["type"], q.get("add_prefix_space"), q.get("use_regex")) for q in parts[1:]] == [("ByteLevel", False, False)] and not made.get("post_processor")


class Encoder(dict):
    """The tokenizers library, asked once for each stretch between spaces: its pre-tokens never hold white space.

    A dict of stretches to packed ids. A new stretch is None until its group of texts is through; then all new ones are
    encoded together and the gaps filled.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.cuts = cuts_at_spaces(vocabulary)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = f"<u{array(self.code).itemsize}"
        self.new: list[str] = []
        self.marked: list[str] = []
        self.long: list[str] = []
        self.marks = dict(zip(MARKS, self.encoded(list(MARKS)), strict=True))

    def __missing__(self, stretch: str) -> bytes | None:
        # A mark after a letter is a pre-token by itself, so the library is asked for what is before it only.
        if stretch[-1:] in MARKS and "a" <= stretch[-2:-1] <= "z":
            if (stem := self[stretch[:-1]]) is not None:
                self[stretch] = packed = stem + self.marks[stretch[-1]]
                return packed
            self.marked.append(stretch)
        else:
            self.new.append(stretch)
        self[stretch] = None
        if len(stretch) > LONGEST:
            self.long.append(stretch)

    def encoded(self, stretches: list[str]) -> Iterator[bytes]:
        """Packed ids of stretches, from one call for all of them: offsets tell whose each id is."""
        made = self.tokenizer.encode(" ".join(stretches), add_special_tokens=False)
        ids = array(self.code, made.ids)
        starts = np.array([a for a, _ in made.offsets], dtype="int64")
        cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in stretches])).tolist()
        return (ids[a:b].tobytes() for a, b in pairwise([0, *cuts]))

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with the end id, as the library gives them for the whole text."""
        end = array(self.code, [END_ID]).tobytes()
        if not self.cuts:
            return [array(self.code, made.ids).tobytes() + end for made in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self) >= MEMO:
            self.clear()
        cut = [lowered(t).replace("\n", " ").split(" ") for t in texts]
        parts = [list(map(self.__getitem__, words)) for words in cut]
        for i in range(0, len(self.new), MISSES):
            some = self.new[i : i + MISSES]
            self.update(zip(some, self.encoded(some), strict=True))
        for stretch in self.marked:
            self[stretch] = self[stretch[:-1]] + self.marks[stretch[-1]]
        if self.new:
            self.new, self.marked = [], []
            for words, part in zip(cut, parts, strict=True):
                at = -1
                for _ in range(part.count(None)):
                    at = part.index(None, at + 1)
                    part[at] = self[words[at]]
        for stretch in self.long:  # few, and too long to be remembered
            del self[stretch]
        self.long = []
        return [b"".join(part) + end for part in parts]


_encoders: dict[bytes, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    key = hashlib.sha256(vocabulary.encode()).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@contextlib.contextmanager
def mapped(path: str, kind: str) -> Iterator[np.ndarray]:
    """A file as an array in mapped memory."""
    store, name = _store(path)
    if isinstance(store, fs.LocalFileSystem):
        yield np.memmap(name, dtype=kind, mode="r") if os.path.getsize(name) else np.empty(0, kind)
        return
    with tempfile.TemporaryDirectory() as own:
        fs.copy_files(name, f"{own}/part", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        yield np.memmap(f"{own}/part", dtype=kind, mode="r") if os.path.getsize(f"{own}/part") else np.empty(0, kind)


def written(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the files; returns the manifest: part, name, kind, n_docs, n_tokens, base."""
    spark = docs.sparkSession
    folder = folder or f"{stage_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shipped = spark.sparkContext.broadcast(Path(path or public_tokenizers.path(VOCABULARY)).read_text())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(shipped.value)
        name, n, at = f"{folder}/{uuid.uuid4().hex}", 0, 0
        store, _ = _store(folder)
        with contextlib.ExitStack() as stack:
            store.create_dir(_store(folder)[1])
            ids, offsets, keys = (stack.enter_context(store.open_output_stream(_store(f"{name}.{x}")[1])) for x in ("ids", "offsets", "docs"))
            for batch in batches:
                for i in range(0, batch.num_rows, 500):  # ids of few documents at a time are in memory
                    part = batch.slice(i, 500)
                    packed = code.packed([t or "" for t in part.column(1).to_pylist()])
                    ends = at + np.cumsum([0, *(len(p) for p in packed)], dtype="<u8") // np.dtype(code.kind).itemsize
                    offsets.write(ends[:-1].tobytes())
                    keys.write(part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    for p in packed:
                        ids.write(p)
                    n, at = n + len(packed), int(ends[-1])
            offsets.write(np.array([at], dtype="<u8").tobytes())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([code.kind]), pa.array([n], pa.int64()), pa.array([at], pa.int64())], names=["part", "name", "kind", "n_docs", "n_tokens"])

    # A row's place in its file of documents parts rows of one id and one text, whose order doesn't matter.
    rows = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.substring("text", 1, 16).alias("opening"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange("doc_id", "opening", "place").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    manifest = staged(ordered.mapInArrow(write, "part int, name string, kind string, n_docs bigint, n_tokens bigint"), "manifest", gather=True)
    # One row a task that wrote, so the one partition of the window stays small.
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that a manifest names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                with mapped(f"{file['name']}.ids", file["kind"]) as ids, mapped(f"{file['name']}.offsets", "<u8") as offsets, mapped(f"{file['name']}.docs", "<i8") as keys:
                    for i in range(0, len(keys), 10_000):
                        some, at = np.array(keys[i : i + 10_000]), np.array(offsets[i : i + 10_001]).astype("int64")
                        crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(some, mask=some == NO_ID), pa.array(at[:-1] + file["base"]), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("name", "kind", "base")
    tasks = max(1, manifest.count() // FILES_A_TASK)  # as many rows as tasks that wrote
    return files.repartition(tasks, "name").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_back(written(docs, path=path))
