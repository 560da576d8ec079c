"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the matches of the base patterns, also those that fail a base check, and of a few looser patterns. Labelers
vote on each candidate for (1), against (-1) or not at all (0): the strict form of its kind, a range or checksum rule, cue
words before it, a gazetteer, and what touches it. Each of them can vote both ways on every kind, and they look at different
things: the candidate's form, its value, the words around it, lists of known values, and the letters beside it.

Votes are counted by pattern of votes and features, of which there are boundedly many, however large the corpus is.
Expectation-maximisation over those counts gives the reliability of every labeler for each kind, and each pattern's
probability; weak priors keep chances apart where votes are few. The final span classifier is a naive Bayes model over
features of the span and of what surrounds it, fitted to those probabilities. It alone decides: base spans always stay, and
other candidates are reported where it gives ACCEPT or more, unless they overlap a base span.

Null texts count as empty, and repeated rows count and are reported each. Without candidates the model is empty and nothing is
added, as for an empty table. Ties at the threshold are accepted. Very long texts are matched whole; candidates of a text are
an array in its row. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import let, matches_of, staged, written

#: Base kinds, in the order in which spans of one start are written.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser kinds: telephone numbers without a country, spelt-out addresses, numbers of persons, bank accounts.
LOCAL_PHONE = r"(?<![0-9+(.)-])(?<![0-9+)] )\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z0-9-]{1,63}){1,4}"
PERSON_NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "local_phone": LOCAL_PHONE, "spelt_email": SPELT_EMAIL, "person_number": PERSON_NUMBER, "account": ACCOUNT}
KINDS = tuple(PATTERNS)
BASE = KINDS[:4]
#: Gazetteers. Endings of hosts, endings of file names, countries' calling codes, area codes and country codes of
#: bank accounts, and first digits of card numbers by issuer.
ENDINGS = "com org net edu gov mil int io dev app info biz eu at au be br ca ch cl cn cz de dk es fi fr gr hk hu ie il in it jp kr mx nl no nz pl pt ro ru se sg sk tr tw uk us za".split()
FILE_ENDINGS = "png jpg jpeg gif svg webp css js ts py sh md txt json xml yaml yml html htm pdf zip gz tar exe dll so local lan invalid test".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 212 213 216 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972".split()
UNUSED_AREAS = "000 037 096 123 911 999".split()
ACCOUNT_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK SM TR".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|5))"
#: Words that announce a kind and words that announce something else, in the CUE_REACH code points before it.
CUES = {"email": r"e-?mail|contact|write|reach|courriel|correo|adresse|@", "ip": r"\bip\b|\bip-|address|server|client|login|adresse", "card": "card|visa|payment|credit|debit|carte|karte|tarjeta", "phone": r"phone|\bcall|\btel|\bfax|mobile|appel|anruf|whatsapp|ring", "person_number": r"\bssn\b|social|security|insurance|passport", "account": r"iban|account|konto|compte|cuenta|bank"}
OTHERS = r"version|\bv\b|release|build|isbn|issn|\bdoi\b|invoice|order|ticket|serial|\bpart\b|article|model|chapter|section|figure|table|\bpage|score|page|ratio|example only"
OF = {"local_phone": "phone", "spelt_email": "email"}
CUE_REACH, LONGEST = 28, 320
LABELERS = ("form", "value", "cue", "gazetteer", "edges")
FEATURES = ("length", "digits", "marks", "around", "beside", "known")
ROUNDS, ACCEPT, STRENGTH, SMOOTHED = 20, 0.9, 6.0, 2.0
_ROW = "array<struct<start:bigint,end:bigint,kind:string,rank:int,ok:boolean," + ",".join(f"{v}:int" for v in LABELERS) + "," + ",".join(f"f_{f}:int" for f in FEATURES) + ">>"


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less nine above nine; the sum ends in zero."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(F.coalesce(d.try_cast("int"), F.lit(0)) * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _checked(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # Leading zeros don't count; a part of more than three digits without them is too large.
        return F.forall(F.split(text, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda d: (F.length(d) <= 3) & (F.coalesce(d.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return let(_digits(text), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    return F.length(_digits(text)).between(10, 15)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for yes, -1 for no, which is the opposite if it isn't given; else 0."""
    return F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0)


def _form(kind: str, t: Column) -> Column:
    """Is it written as its kind is usually written?"""
    usual = {"email": r"^[A-Za-z][A-Za-z0-9]*(?:[._+-][A-Za-z0-9]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$", "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$", "card": r"^(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5})$", "phone": r"^\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}$", "local_phone": r"^(?:\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}([-. ])[0-9]{3}\1[0-9]{4})$", "spelt_email": r"(?i)^[a-z][a-z0-9._+-]*( ?)[\[(]at[\])]\1", "person_number": r"^[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}$", "account": r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"}
    # None is longer than an address may be, so long runs aren't matched again.
    return F.when(F.length(t) <= LONGEST, _vote(t.rlike(usual[kind]))).otherwise(-1)


def _value(kind: str, t: Column, ok: Column) -> Column:
    """Is it a value that its kind can have?"""
    if kind == "local_phone":
        return let(_digits(t), lambda d: _vote(d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")))
    if kind == "spelt_email":
        return _vote(~t.rlike(r"\.\.|--|^[.-]"))
    if kind == "person_number":
        return _vote(~t.rlike("^(?:000|666|9)|-00-|-0000$"))
    if kind == "account":  # letters count from ten; the remainder by 97 is 1, taken digit by digit
        moved = let(F.regexp_replace(t, " ", ""), lambda c: F.concat(F.substring(c, F.lit(5), F.length(c)), F.left(c, F.lit(4))))
        number = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))))
        return _vote(F.aggregate(number, F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97) == 1)
    return _vote(ok)


def _gazetteer(kind: str, t: Column) -> Column:
    """Is it, or a part of it, on a list of known values, or on one of others?"""
    if "email" in kind:
        return let(F.lower(F.regexp_extract(F.right(t, F.lit(24)), r"([A-Za-z0-9-]++)$", 1)), lambda e: _vote(e.isin(*ENDINGS), e.isin(*FILE_ENDINGS) | e.rlike("[0-9]")))
    if kind == "ip":
        return _vote(t.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.") & ~t.rlike(r"^127\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"), t.rlike(r"^(?:0|127|2[3-9][0-9]|22[4-9]|[3-9][0-9]{2})\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"))
    if kind == "card":
        return _vote(_digits(t).rlike(ISSUERS))
    if kind == "phone":
        return let(_digits(t), lambda d: _vote(F.left(d, F.lit(1)).isin(*CALLING) | F.left(d, F.lit(2)).isin(*CALLING) | F.left(d, F.lit(3)).isin(*CALLING)))
    if kind == "account":
        return _vote(F.left(t, F.lit(2)).isin(*ACCOUNT_COUNTRIES))
    area = F.left(_digits(t), F.lit(3))
    return _vote(~area.isin(*UNUSED_AREAS), area.isin(*UNUSED_AREAS)) if kind == "local_phone" else _vote(~t.isin("123-45-6789", "078-05-1120", "111-11-1111") & ~area.isin("000", "666", "999"))


def _candidates(kind: str, pattern: str, text: Column) -> Column:
    """Structs of _ROW: the votes of LABELERS and the features of the final classifier."""
    strict, cues = kind in BASE, CUES[OF.get(kind, kind)]

    def row(m: Column) -> Column:
        t = m["text"]
        before = F.lower(F.substring(text, F.greatest(m["start"] - CUE_REACH, F.lit(0)).cast("int") + 1, F.least(m["start"], F.lit(CUE_REACH)).cast("int")))
        around = F.struct(before.alias("before"), F.concat(F.right(before, F.lit(1)), F.substring(text, (m["end"] + 1).cast("int"), F.lit(1))).alias("touched"), (_checked(kind, t) if strict else F.lit(True)).alias("ok"))
        beside = lambda a: F.when(a["touched"].rlike(r"[\p{L}\p{N}_]"), 2).when(a["touched"].rlike("[=/#&%]"), 1).otherwise(0)
        judged = lambda a: F.struct(a["ok"].alias("ok"), _form(kind, t).alias("form"), _value(kind, t, a["ok"]).alias("value"), _vote(a["before"].rlike(cues), a["before"].rlike(OTHERS)).alias("cue"), _gazetteer(kind, t).alias("gazetteer"), beside(a).alias("beside"))
        size = lambda x, step, most: F.least(F.length(x) / step, F.lit(most)).cast("int")
        looks = (size(t, 4, 9), size(_digits(t), 3, 7), size(F.regexp_replace(t, "[A-Za-z0-9]", ""), 1, 6))

        def whole(j: Column) -> Column:
            votes = (j["form"], j["value"], j["cue"], j["gazetteer"], _vote(j["beside"] == 0))
            features = (*looks, j["cue"], j["beside"], j["value"] * 3 + j["gazetteer"])
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), j["ok"].alias("ok"), *[v.alias(k) for k, v in zip(LABELERS, votes, strict=True)], *[f.alias(f"f_{k}") for k, f in zip(FEATURES, features, strict=True)])

        return let(let(around, judged), whole)

    found = matches_of(text, pattern)
    if kind == "card":  # most runs of digits are far too short to be one
        found = F.filter(found, lambda m: F.length(m["text"]) >= 14)
    return F.transform(found, row).cast(_ROW)


def candidates(text: Column) -> Column:
    full = F.coalesce(text, F.lit(""))
    return F.concat(*[_candidates(k, p, full) for k, p in PATTERNS.items()])


def vote_counts(found: DataFrame) -> DataFrame:
    """kind, the votes, the features, n: bounded by the number of patterns. Partial sums are made before the shuffle."""
    columns = ["kind", *LABELERS, *[f"f_{f}" for f in FEATURES]]
    return found.select(F.explode("found").alias("c")).select(*[f"c.{c}" for c in columns]).groupBy(*columns).agg(F.count("*").alias("n"))


def _labeled(value) -> list[tuple[str, object]]:
    return [(f"{v}_{s}", value(v, s)) for v in LABELERS for s in ("pos", "neg")]


def reliabilities(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind and the model of each: prior, and by labeler the chance of a vote for, among votes cast, on personal data (_pos) and
    on other candidates (_neg), by expectation-maximisation over the counts of vote patterns, a list of which a kind has.

    The chances start at 0.8 and 0.2, and STRENGTH votes hold them there; those are the only labels that anybody gives.
    """
    start = F.struct(F.lit(0.5).alias("prior"), *[F.lit(0.8 if k.endswith("pos") else 0.2).alias(k) for k, _ in _labeled(lambda v, s: None)])
    rows = counts.groupBy("kind", *LABELERS).agg(F.sum("n").cast("double").alias("n")).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(*LABELERS, "n"))).alias("rows"))

    def refit(model: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("p"), *[F.lit(0.0).alias(f"{v}_{s}") for v in LABELERS for s in ("cast", "cast_p", "yes", "yes_p")])

        def add(a: Column, x: Column) -> Column:
            def summed(p: Column) -> Column:
                weight = {"cast": x["n"], "cast_p": x["n"] * p, "yes": x["n"], "yes_p": x["n"] * p}
                voted = lambda v, s: (x[v] != 0) if s.startswith("cast") else (x[v] == 1)
                return F.struct((a["n"] + x["n"]).alias("n"), (a["p"] + x["n"] * p).alias("p"), *[(a[f"{v}_{s}"] + F.when(voted(v, s), w).otherwise(0.0)).alias(f"{v}_{s}") for v in LABELERS for s, w in weight.items()])

            return let(posterior(x, model), summed)

        def chances(s: Column) -> Column:
            pos = lambda v: (s[f"{v}_yes_p"] + 0.8 * STRENGTH) / (s[f"{v}_cast_p"] + STRENGTH)
            neg = lambda v: (s[f"{v}_yes"] - s[f"{v}_yes_p"] + 0.2 * STRENGTH) / (s[f"{v}_cast"] - s[f"{v}_cast_p"] + STRENGTH)
            return F.struct(((s["p"] + STRENGTH / 2) / (s["n"] + STRENGTH)).alias("prior"), *[c.alias(k) for k, c in _labeled(lambda v, side: pos(v) if side == "pos" else neg(v))])

        return let(F.aggregate("rows", zero, add), chances)

    return rows.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda model, _: refit(model)).alias("model"))


def posterior(x: Column, model: Column) -> Column:
    """The chance that a candidate with these votes is personal data."""
    odds = F.log(model["prior"] / (1 - model["prior"]))
    for v in LABELERS:
        odds = odds + F.when(x[v] == 1, F.log(model[f"{v}_pos"] / model[f"{v}_neg"])).when(x[v] == -1, F.log((1 - model[f"{v}_pos"]) / (1 - model[f"{v}_neg"]))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _features(of) -> list[tuple[str, Column]]:
    """The names and values of what the classifier looks at; of() gives a column of a candidate. What a span looks like is
    told apart by kind, what surrounds it and how it was judged isn't."""
    own = ("length", "digits", "marks")
    return [("kind", of("kind")), *[(f, F.concat_ws(":", of("kind"), of(f"f_{f}").cast("string")) if f in own else of(f"f_{f}").cast("string")) for f in FEATURES]]


def classifier(counts: DataFrame, models: DataFrame) -> DataFrame:
    """feature, value, weight: the prior's log odds and each value's log ratio, of soft counts. A few hundred rows.

    SMOOTHED candidates that are as often personal data as all are come to each value, so rare values weigh little.
    """
    rows = counts.join(F.broadcast(models), "kind").select("n", posterior(F.struct(*LABELERS), F.col("model")).alias("p"), *[v.alias(f) for f, v in _features(F.col)])  # as many models as kinds
    each = F.explode(F.array(F.struct(F.lit("prior").alias("feature"), F.lit("").alias("value")), *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in ("kind", *FEATURES)]))
    soft = rows.select("n", "p", each.alias("f")).groupBy("f.feature", "f.value").agg(F.sum(F.col("n") * F.col("p")).alias("pos"), F.sum(F.col("n") * (1 - F.col("p"))).alias("neg"))
    base = soft.where("feature = 'prior'").select(((F.col("pos") + 1) / (F.col("pos") + F.col("neg") + 2)).alias("base"))  # one row
    share, ratio = F.col("base"), F.log((F.col("pos") + SMOOTHED * F.col("base")) / (F.col("neg") + SMOOTHED * (1 - F.col("base"))))
    prior = F.log(share / (1 - share))
    return soft.join(F.broadcast(base), F.lit(True)).select("feature", "value", F.when(F.col("feature") == "prior", prior).otherwise(ratio - prior).alias("weight"))


def _accepted(weights: dict[tuple[str, str], float], c: Column) -> Column:
    odds = F.lit(weights.get(("prior", ""), 0.0))
    for feature, value in _features(lambda name: c[name]):
        table = [(v, w) for (f, v), w in sorted(weights.items()) if f == feature]
        if table:
            odds = odds + F.coalesce(F.create_map(*[F.lit(x) for pair in table for x in pair])[value], F.lit(0.0))
    return odds >= math.log(ACCEPT / (1 - ACCEPT))


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row for each row of docs (doc_id, text)."""
    found = staged(docs.select("doc_id", candidates(F.col("text")).alias("found")), "pii", gather=True)
    counts = staged(vote_counts(found), "pii-votes")
    weights = {(r["feature"], r["value"]): r["weight"] for r in classifier(counts, staged(reliabilities(counts), "pii-models")).collect()}
    base = F.filter("found", lambda c: c["kind"].isin(*BASE) & c["ok"])
    clear = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    extra = F.filter("found", lambda c: ~(c["kind"].isin(*BASE) & c["ok"]) & _accepted(weights, c) & clear(c))
    of_kind = lambda k: lambda c: c["kind"] == k
    short = lambda spans: F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", *[F.size(F.filter(base, of_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE], F.sha2(written(short(base)), 256).alias("base_sha256"), written(short(F.concat(base, extra))).alias("spans"))
