"""The pipeline on real documents against plain stages, and on odd ones."""

import base64
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cuemill.llm import queries
from cuemill.llm.common import staged
from tests.llm.conftest import SF
from tests.llm.test_pairs import plain_join
from tests.llm.test_scans import plain_quality, plain_secrets


def masked(text):
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in plain_secrets(text)[1].split(",") if s)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def plain_pipeline(rows, items):
    rows = [r for r in rows if (m := plain_quality(r["text"]))[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    _, part = plain_join(rows)
    least = {}
    for r, p in zip(rows, part, strict=True):
        least[p] = min(least.get(p, r["doc_id"]), r["doc_id"])
    rows = [r for r in rows if r["doc_id"] in set(least.values())]
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(i["text"]) for i in items]
    return {r["doc_id"]: masked(r["text"]) for r in rows if not any(i in flat(r["text"]) for i in items)}


def test_pipeline_equals_plain_stages(spark, docs):
    want = plain_pipeline(docs.collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["ids"] == library.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"]) for r in got)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, odd, empty):
    """Each stage returns the columns of its input, all but the last; none fails. The rows are long enough to stay."""
    long = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("t"), F.coalesce("doc_id", F.lit(0)), F.lit("n"), i)), " "))
    table = odd.withColumn("text", F.when(F.col("doc_id") != 1, long).otherwise(F.col("text")))
    table = staged(table.limit(0) if empty else table, "odd")
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, table, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == table.columns
            table = out
    assert (out.count() == 0) == empty


def test_stages_are_the_dealt_ones():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "decontamination", "secret_masks", "token_ids"]
    names = [int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()]
    assert names == list(range(1, 14))


def test_helper_columns_clash_with_nothing(spark, docs):
    """Columns of a user's that are called like the ones that stages add keep their values."""
    from cuemill.llm import jaccard, quality, secrets

    names = ["__key_of_row", "__QUALITY_of_row", "__secret_key", "__secret_spans"]
    own = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in names})
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for left in (jaccard.one_of_each(own), quality.kept(own, labels), secrets.redacted(own)):
        assert left.columns == own.columns
        assert left.count() > 50 and left.where(" OR ".join(f"`{c}` IS DISTINCT FROM concat('{c}-', doc_id)" for c in names)).count() == 0
