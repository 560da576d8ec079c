"""Secret scans in DataFrame functions only: strong patterns, and weak parts linked by interval joins.

Base findings stand by themselves. Weak parts are a long mixed token (weak_secret), a named account (weak_id) and a host or
URL (endpoint). A weak part counts only where complementary parts lie in its scope, which is the same text within SCOPE
code points: a weak secret next to an identifier (AKIA key or weak_id), a weak identifier next to a secret (assign, hex or
a weak secret that is itself linked to an endpoint or an AKIA key), and an endpoint next to both. Parts are exploded to
rows, cut into scope bins and joined by bin and distance with semi joins: no pairs are made, however many parts meet.

Null texts count as empty. Repeated rows and null ids are kept: the key of a text is its id and hash. Weak parts that
overlap a base finding are dropped. Matching is linear in the text: no pattern rescans a run that it has already refused, so
very long texts are read whole, in their row. An empty table gives no rows. scanned() reads doc_id and text only; redacted()
keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import matches_of, ranked, staged, text_key, unused, written

#: Base kinds, in the order in which spans of one start are written.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Weak kinds.
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}"
WEAK_ID = r"""\b(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9._@+-]{3,}+"""
ENDPOINT = r"""(?:\b[a-z][a-z0-9+]{1,15}://[^\x20\x09-\x0D"'<>]++)|(?:\b(?i:host|endpoint|server)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9.:-]{3,}+)"""
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
SCOPE = 200
#: Texts with linked weak parts that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def base(text: Column) -> dict[str, Column]:
    """Arrays of (start, end, text) by base kind; failing matches are dropped, not retried."""
    full = F.coalesce(text, F.lit(""))
    return {
        "assign": F.filter(matches_of(full, ASSIGN), lambda m: F.length(F.regexp_extract(m["text"], ASSIGN_VALUE, 1)) >= 8),
        "access": F.filter(matches_of(full, ACCESS), lambda m: F.length(m["text"]) >= 16),
        "hex": matches_of(full, HEX),
    }


def weak(text: Column) -> dict[str, Column]:
    full = F.coalesce(text, F.lit(""))
    mixed = lambda t: t.rlike("[0-9]") & t.rlike("[a-z]") & t.rlike("[A-Z]")
    return {"weak_secret": F.filter(matches_of(full, WEAK_SECRET), lambda m: mixed(m["text"])), "weak_id": matches_of(full, WEAK_ID), "endpoint": matches_of(full, ENDPOINT)}


def _near(parts: DataFrame, others: DataFrame) -> DataFrame:
    """The parts with one of the others in their scope. A part's neighbours start in its own bin or the two beside it."""
    near = others.select(F.col("key").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.array(*[F.floor(F.col("start") / SCOPE) + d for d in (-1, 0, 1)])).alias("bin2"))
    # Whole parts may be longer than a scope; distance is taken between starts, so that bins bound it.
    return parts.join(near, (F.floor(F.col("start") / SCOPE) == F.col("bin2")) & (F.col("key") == F.col("k2")) & (F.abs(F.col("start") - F.col("s2")) <= SCOPE) & ((F.col("start") >= F.col("e2")) | (F.col("end") <= F.col("s2"))), "left_semi")


def linked(parts: DataFrame) -> DataFrame:
    """parts: key, kind, start, end of all kinds; returns the weak ones whose complements co-occur."""
    of = lambda *kinds: parts.where(F.col("kind").isin(*kinds))
    secrets = _near(of("weak_secret"), of("access", "weak_id"))
    any_secret = of("assign", "hex").unionByName(secrets)
    ids = _near(of("weak_id"), any_secret)
    ends = _near(_near(of("endpoint"), any_secret), of("access").unionByName(ids))
    return secrets.unionByName(ids).unionByName(ends)


_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _bare(found: DataFrame) -> DataFrame:
    """key and the spans of each kind, of rows (key, arrays of matches by kind)."""
    return found.select(*[c for c in found.columns if c not in KINDS], *[ranked(F.col(k), k, i).alias(k) for i, k in enumerate(KINDS)])


def _linked_spans(bare: DataFrame) -> DataFrame:
    """key, extra: the weak spans of each text whose complements co-occur. bare: key and spans by kind."""
    has = lambda *kinds: sum((F.size(k) for k in kinds), F.lit(0)) > 0
    together = bare.where(has("weak_secret", "weak_id", "endpoint") & has("assign", "access", "hex", "weak_secret") & has("access", "weak_id"))
    # Weak parts never overlap a base finding; that is settled in the row, where the base findings are.
    strong = F.concat("assign", "access", "hex")
    clear = lambda k: F.filter(k, lambda s: ~F.exists(strong, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    parts = staged(together.select("key", F.explode(F.concat(strong, clear("weak_secret"), clear("weak_id"), clear("endpoint"))).alias("s")).select("key", "s.kind", "s.start", "s.end").distinct(), "secret-parts")
    rank = (F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1).cast("int")
    return linked(parts).groupBy("key").agg(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end")).alias("extra"))


def _found(docs: DataFrame, *keep: str) -> DataFrame:
    strong, loose = base(F.col("text")), weak(F.col("text"))
    return docs.select(*keep, text_key(F.col("doc_id"), F.col("text")).alias("key"), *[c.alias(k) for k, c in (strong | loose).items()])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row for each row of docs (doc_id, text)."""
    bare = _bare(staged(_found(docs, "doc_id"), "secrets", gather=True))
    strong = F.concat("assign", "access", "hex")
    joined = bare.join(_linked_spans(bare), "key", "left")
    return joined.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(written(strong), 256).alias("base_sha256"), written(F.concat(strong, F.coalesce("extra", F.array().cast(_SPANS)))).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with all their columns, and every span in text replaced by mask; n_chars, if there, counts the new text.

    Overlapping spans become one mask. The few texts with linked weak parts are found first; base findings are found again
    in the row, so that texts aren't shuffled.
    """
    spotted = staged(_found(docs.select("doc_id", "text")).where(sum((F.size(k) for k in KINDS), F.lit(0)) > 0), "secrets", gather=True)
    extra = staged(_linked_spans(_bare(spotted)), "secret-links")
    if extra.count() <= BROADCAST_ROWS:
        extra = F.broadcast(extra)
    key, spans = unused(docs, "__secret_key"), unused(docs, "__secret_spans")
    strong = F.concat(*[ranked(c, k, KINDS.index(k)) for k, c in base(F.col("text")).items()])
    marked = docs.withColumn(key, text_key(docs["doc_id"], docs["text"])).join(extra.select(F.col("key").alias(key), F.col("extra").alias(spans)), key, "left")
    marked = marked.withColumn(spans, F.array_sort(F.concat(strong, F.coalesce(spans, F.array().cast(_SPANS)))))
    text = F.col("text")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def cover(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        more = F.when(s["start"] >= a["at"], F.array(gap, F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(s["end"], a["at"]).alias("at"), F.concat(a["parts"], more).alias("parts"))

    new = F.aggregate(spans, begin, cover, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    out = marked.withColumn("text", F.when(F.size(spans) > 0, new).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
