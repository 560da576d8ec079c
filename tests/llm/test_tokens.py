"""Byte-level BPE and token files against the libraries that they must equal."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuemill.llm import bpe, token_files

ODD = ["a", "B", "e", " ", "  ", "\n", " \n", "\x1c", "\x85", "\xa0", "é", "É", "ß", "😀", "日本", "1", "²", "Ⅷ", "'s", "'LL", "\t", " ", "　", "​", "The", "ing", ".", ",", "#", "́", "İ", "ſ", "٣", "Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "À", "µ", "\r\n"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["".join(chr(rng.randint(1, 255)) for _ in range(30)) for _ in range(n // 4)]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))


def test_merges_equal_the_library(library):
    code = bpe.coder(bpe.vocabulary_of(), public_tokenizers.PATTERN)
    rng = random.Random(2)
    for text in [*odd_texts(8000), "a" * 20_000, "ab" * 5000, " " * 3000, "\n" * 999 + " x", "".join(rng.choice("abcdefgh") for _ in range(20_000))]:
        packed = code.packed(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text), text[:80]
        assert code.decoded(packed).decode() == text


def merged(piece, ranks):
    """One merge at a time: the earliest token that two neighbours make, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 999), i) for i in range(len(parts) - 1))
        if rank == 999:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("seed", range(8))
def test_small_vocabulary_equals_merging(seed):
    rng = random.Random(seed)
    draw = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 14)))
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
    while len(ranks) < 50:  # each new token joins two that merging leaves side by side
        ids = merged(draw(), ranks)
        names = list(ranks)
        if len(ids) > 1:
            k = rng.randrange(len(ids) - 1)
            ranks.setdefault(names[ids[k]] + names[ids[k + 1]], len(ranks))
    code = bpe.Merges(ranks)
    for _ in range(1500):
        piece = draw()
        assert code.ids(piece) == ([ranks[piece]] if piece in ranks else merged(piece, ranks)), piece


def test_full_memo_is_emptied(library):
    code = bpe.Coder(bpe.vocabulary_of(), public_tokenizers.PATTERN, 50)
    for text in odd_texts(500, 9):
        assert np.frombuffer(code.packed(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_query(odd, docs, none, library):
    for table in (odd, docs):
        want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(ids := library.encode_ordinary(r["text"] or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in table.collect())
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(table).collect()) == want
    assert bpe.round_trip(none).count() == 0 and bpe.encoded(none).count() == 0
    back = bpe.encoded(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == texts[r["doc_id"]] and r["ids"] == library.encode_ordinary(r["text"]) for r in back)


def test_stretches_equal_the_library(words):
    code = token_files.encoder(open(public_tokenizers.path(token_files.VOCABULARY)).read())
    texts = odd_texts(8000, 3)
    for text, packed, want in zip(texts, code.packed(texts), words.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(packed, code.kind).tolist() == [*want.ids, 1], text


def test_other_tokenizers_see_whole_texts(words):
    """Stretches are only cut out where the file's own rules allow it."""
    import json

    made = json.loads(open(public_tokenizers.path(token_files.VOCABULARY)).read())
    assert token_files.cuts_at_spaces(json.dumps(made))
    made["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    other = token_files.Encoder(json.dumps(made))
    texts = odd_texts(200, 5)
    assert not other.cuts
    for packed, want in zip(other.packed(texts), other.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(packed, other.kind).tolist() == [*want.ids, 1]


def test_long_stretches_are_forgotten():
    code = token_files.Encoder(open(public_tokenizers.path(token_files.VOCABULARY)).read())
    code.packed(["x" * 1000 + " short " + "y" * 500 + ". " + "\u4e00" * 300])
    assert max(map(len, code)) <= token_files.LONGEST


def test_rows_of_one_id_are_spread(spark, words):
    table = spark.range(4000).select((F.col("id") * 0 + 7).alias("doc_id"), F.lit("the same text in every row").alias("text")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.written(table)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n_docs"] for r in manifest.collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = sorted(tuple(r) for r in token_files.read_back(manifest).collect())
    assert got == plain_files(table.collect(), words)


def plain_files(rows, words):
    start, out = 0, []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")):
        ids = [*words.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_file_query(odd, docs, none, words):
    order = lambda rows: sorted(rows, key=lambda r: r[1])
    for table in (odd, docs):
        got = [tuple(r) for r in token_files.round_trip(table.repartition(7)).collect()]
        assert order(got) == plain_files(table.collect(), words)
    assert token_files.round_trip(none).count() == 0


def test_files_on_disk(docs, words, tmp_path):
    manifest = token_files.written(docs, str(tmp_path)).collect()
    assert sum(r["n_docs"] for r in manifest) == docs.count()
    first = min(manifest, key=lambda r: r["part"])
    assert first["base"] == 0 and np.fromfile(f"{first['name']}.offsets", "<u8")[-1] == first["n_tokens"]
    with token_files.mapped(f"{first['name']}.ids", first["kind"]) as ids:
        assert isinstance(ids, np.memmap) and len(ids) == first["n_tokens"] and ids[-1] == 1


def test_staged_tables_go(spark, docs):
    from pathlib import Path

    from cuemill.llm.common import drop_staged, stage_dir, staged

    assert staged(docs, "x").count() == docs.count()
    folder = Path(stage_dir(spark).removeprefix("file:"))
    assert list(folder.glob("x-*"))
    drop_staged(spark)
    assert not folder.exists()
