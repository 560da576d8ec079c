"""Places in one order over all rows, without gathering the rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 64
#: Share of the rows on either side of the middle, in which a median is looked for.
NEAR = 0.01


def medians(rows: DataFrame, *names: str) -> DataFrame:
    """One row: the exact medians of number columns, null of none, as F.median() gives them.

    Approximate quantiles say between which values the middle lies, and exact counts whether it does (many NaN, which are the
    greatest, may move it; then all values are taken). Only the values between them, NEAR of the rows on either side and what
    the quantiles may err, are counted and put in order.
    """
    rows = rows.select(*[F.col(n).cast("double").alias(n) for n in names])
    between = [x if len(x) == 2 else None for x in rows.approxQuantile(list(names), [0.5 - NEAR, 0.5 + NEAR], NEAR / 2)]
    asked = [c for n, x in zip(names, between, strict=True) for c in (F.count(n), F.count_if(F.col(n) < x[0]) if x else F.lit(0), F.count_if(F.col(n).between(*x)) if x else F.lit(0))]
    counted, out = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(asked)]).first(), None
    for i, (name, x) in enumerate(zip(names, between, strict=True)):
        total, below, inside = counted[3 * i : 3 * i + 3]
        low, high = (total - 1) // 2, total // 2
        near = x is not None and below <= low and high < below + inside
        values = rows.where(F.col(name).between(*x) if near else F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
        last = F.sum("n").over(Window.orderBy(name)) + (below if near else 0)
        middle = values.withColumn("last", last).where((F.col("last") - F.col("n") <= high) & (F.col("last") > low))
        a, b = F.min(name), F.max(name)
        one = middle.agg(F.when(a == b, a).otherwise(0.5 * a + 0.5 * b).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def with_base(counts: DataFrame, key: str, n: str, blocks: int = BLOCKS) -> DataFrame:
    """counts with base: the sum of n over all rows with a lower key. key: a number, unique and not null.

    Sums are taken in two levels: inside blocks of keys, and over the blocks' totals, which are as many as blocks. Blocks are
    cut at quantiles of the keys, so a row's block depends on its key alone and not on the task that happens to hold it. Three
    passes over counts, of which the first two (for quantiles and totals) run at once.
    """
    wanted = [i / blocks for i in range(1, blocks)]
    cuts = sorted(set(counts.approxQuantile(key, wanted, 0.25 / blocks))) if wanted else []
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col(key)))
    placed = counts.withColumn("base", block)
    totals = {r["base"]: r["n"] or 0 for r in placed.groupBy("base").agg(F.sum(n).alias("n")).collect()}
    offsets = [0, *accumulate(totals.get(b, 0) for b in range(len(cuts)))]
    inside = F.sum(n).over(Window.partitionBy("base").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    start = F.array(*[F.lit(x) for x in offsets]).cast("array<bigint>")
    return placed.withColumn("base", F.get(start, F.col("base")) + F.coalesce(inside, F.lit(0)))
