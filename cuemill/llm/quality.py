"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects documents whose measure is above a cutoff. For every stratum and rule, labelled documents decide which
cutoffs are safe: a cutoff is safe if an exact binomial test refutes, at level delta / (strata x rules), that it would
reject more than alpha / rules of the good documents of that stratum. Cutoffs are tested from the loosest down and testing
stops at the first that fails (fixed sequence), so with probability 1 - delta no stratum loses more than alpha of its good
documents. Of the safe cutoffs the one that removes most bad documents is used, a good one counting as COST bad ones;
where none removes any, the rule is off.

Null texts have no words and fail the base rule. Documents of one language are a stratum, those without (null or empty) one
too; languages without labels have no rule on. The strata are counted from the labelled documents that pass the base rule,
so every language has the guarantee. A cutoff needs some hundreds of good labelled documents to be safe (348 with one stratum,
more with each further one), so the table of cutoffs has at most len(RULES) rows for every 348 of them. A document with several labels is good if
any label says so, and counts once; of several rows with its id the least by stratum and measures does. Repeated rows are
returned as often as they occur. Without labels no rule is on, and an empty table gives no rows. Very long texts are measured
whole, in the row. Other columns keep their values, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import let, staged, unused, words_of

WINDOW = 8
ALPHA, DELTA, COST = 0.05, 0.05, 10.0
#: Measures, and the cutoffs that are tested, loosest first.
RULES = {
    "symbol_rate": [x / 100 for x in (200, 150, 100, 75, 50, 40, 30, 25, 20, 15, 10, 8, 6, 5, 4, 3, 2)],
    "dup_line_rate": [x / 100 for x in (90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20, 15, 10, 5)],
    "repeat_rate": [x / 100 for x in (28, 26, 24, 22, 20, 18, 16, 14, 12, 10, 8, 6, 4, 2)],
    "word_length": [float(x) for x in (60, 50, 40, 30, 25, 20, 18, 16, 15, 14, 13, 12, 11, 10, 9, 8, 7)],
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def _repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, the first occurrence included."""
    # A window's hash doubles up from those of its halves; windows that run over the end are cut off.
    joined = lambda step: lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashed = let(hashed, joined(step))

    def covered(h: Column) -> Column:
        # Equal hashes stand side by side after the sort; each start covers up to the next start, WINDOW words at most.
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())
        return let(F.array_sort(let(pairs, again)), lambda d: F.aggregate(F.transform(d, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(d, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(F.slice(hashed, F.lit(1), F.size(words) - (WINDOW - 1)), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def measures(text: Column) -> Column:
    """A struct of MEASURES, all bigint."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(F.regexp_replace(full, r"[^#*$%&|<>]++", ""))
    made = let(words_of(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), _repeated_words(w).cast("bigint").alias("n_repeat_words")))
    return let(F.struct(made.alias("w"), let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l")), lambda m: F.struct(m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"), symbols.cast("bigint").alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"), m["l"]["n_lines"].alias("n_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words")))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def _values(m: Column) -> dict[str, Column]:
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {"symbol_rate": rate(m["n_symbols"], m["n_words"]), "dup_line_rate": rate(m["n_dup_lines"], m["n_lines"]), "repeat_rate": rate(m["n_repeat_words"], m["n_words"]), "word_length": rate(m["word_chars"], m["n_words"])}


def stratum(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def _log_gamma(x: Column) -> Column:
    """Stirling's series, nine steps further on."""
    far = x + 9
    series = (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + 1 / (12 * far) - 1 / (360 * far * far * far) + 1 / (1260 * F.pow(far, 5))
    for k in range(9):
        series = series - F.log(x + k)
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p) where k lies below the mean, else 1: a sum from k down, while terms matter."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.sequence(F.lit(0), F.least(k, 12 * F.sqrt(n) + 100).cast("int"))
    summed = F.aggregate(steps, F.struct(top.alias("term"), F.lit(0.0).alias("sum")), lambda a, j: F.struct((a["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term"), (a["sum"] + a["term"]).alias("sum")))["sum"]
    return F.when(k < n * p, F.least(summed, F.lit(1.0))).otherwise(1.0)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """stratum, rule, cutoff: the rules that are on. measured: doc_id, lang, m (of measures()); labels: doc_id, quality."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    values = _values(F.col("m"))
    rows = measured.where(~base_failed(F.col("m"))).select("doc_id", F.struct(stratum(F.col("lang")).alias("stratum"), *[v.alias(k) for k, v in values.items()]).alias("x")).join(known, "doc_id")
    # A labelled document is one trial of the bounds, however often its row is repeated.
    rows = rows.groupBy("doc_id", "good").agg(F.min("x").alias("x")).select("good", "x.*")
    # How many cutoffs of its rule a document exceeds: the last ones of the list, since they fall.
    over = lambda rule: F.size(F.filter(F.array(*[F.lit(c) for c in RULES[rule]]), lambda c: F.col(rule) > c))
    counted = rows.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), over(r).alias("over")) for r in RULES])).alias("x")).groupBy("stratum", "x.rule", "x.over").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counted = staged(counted, "labelled", gather=True)  # a row for each stratum, rule and place in the list
    strata = counted.select("stratum").distinct().count()
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.lit(len(cs) - i).alias("least")) for r, cs in RULES.items() for i, c in enumerate(cs)]))
    by_rule = counted.groupBy("stratum", "rule").agg(F.collect_list(F.struct("over", "good", "bad")).alias("hist"), F.sum("good").alias("n"))  # as many entries as cutoffs, at most
    tested = by_rule.select("stratum", F.col("rule").alias("of"), "hist", "n", grid.alias("g")).where(F.col("of") == F.col("g.rule"))
    added = lambda name: F.aggregate("hist", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["over"] >= F.col("g.least"), x[name]).otherwise(0))
    tested = tested.select("stratum", "g.rule", "g.i", "g.cutoff", "n", added("good").alias("k"), added("bad").alias("caught"))
    level = delta / (max(strata, 1) * len(RULES))
    tested = tested.select("*", (binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= level).alias("safe"))
    order = F.array_sort(F.collect_list(F.struct("i", "cutoff", "k", "caught", "safe")))
    # Safe up to the first failure; the largest gain, and of equals the loosest.
    chosen = tested.groupBy("stratum", "rule").agg(order.alias("all")).select("stratum", "rule", let(F.filter("all", lambda x: ~F.exists("all", lambda y: (y["i"] <= x["i"]) & ~y["safe"])), lambda ok: F.array_max(F.transform(ok, lambda x: F.struct((x["caught"] - cost * x["k"]).alias("gain"), x["cutoff"].alias("cutoff"))))).alias("best"))
    return chosen.where("best.gain > 0").select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def verdict(m: Column, lang: Column, chosen: list) -> Column:
    """True for documents that stay. chosen: the rows of cutoffs(), which are as few as is said above."""
    values, rejected = _values(m), F.lit(False)
    for rule, value in values.items():
        limits = [F.lit(x) for row in chosen if row["rule"] == rule for x in (row["stratum"], row["cutoff"])]
        if limits:
            rejected = rejected | F.coalesce(value > F.create_map(*limits)[stratum(lang)], F.lit(False))
    return ~base_failed(m) & ~rejected


def judged(docs: DataFrame, labels: DataFrame, **levels: float) -> DataFrame:
    """doc_id, the measures, base_failed and kept: a row for each row of docs (doc_id, text, lang)."""
    measured = staged(docs.select("doc_id", "lang", measures(F.col("text")).alias("m")), "quality", gather=True)
    chosen = cutoffs(measured, labels, **levels).collect()
    return measured.select("doc_id", *[F.col("m")[c].alias(c) for c in MEASURES], base_failed(F.col("m")).alias("base_failed"), verdict(F.col("m"), F.col("lang"), chosen).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame, **levels: float) -> DataFrame:
    """The rows of docs that stay, with all their columns. The measures are computed again rather than texts shuffled."""
    measured = staged(docs.select("doc_id", "lang", measures(F.col("text")).alias("m")), "quality", gather=True)
    chosen = cutoffs(measured, labels, **levels).collect()
    mark = unused(docs, "__quality_of_row")
    return docs.withColumn(mark, measures(docs["text"])).where(verdict(F.col(mark), F.col("lang"), chosen)).drop(mark)
