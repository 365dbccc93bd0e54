"""Personal data by weak supervision, in DataFrame functions only.

Patterns give the base spans (e-mail, IP, card, phone). Wider patterns give candidates:
groups of digits, spelled-out e-mail addresses and everything that a base pattern
matched. Labelers vote on each candidate (1: personal, -1: not, 0: no opinion): shapes
(regex), lists of words near it (gazetteers) and its surroundings (context).
Expectation-maximisation estimates from the votes alone how reliable each labeler is.
With the resulting probabilities a naive Bayes classifier over features of the span is
trained; the gazetteers' votes enter it with the weight of their estimated reliability,
the other labelers see what the features hold and act through the probabilities.
Its score alone decides on candidates outside the base spans, no single vote does; those
that it accepts are added as kind ``other``.

Votes are aggregated to vote patterns first, at most 3 to the power of the number of
labelers, so estimation works on a table of bounded size, in one expression. What comes
to the driver is the model: a number per labeler and per feature value.

Positions are counted without markers in the text: ``split`` gives what lies between
the matches, ``regexp_extract_all`` the matches, and lengths add up.

Defined cases: a null or empty text has no spans; rows that occur twice come out twice
and count twice in the estimation; without any candidate the labelers keep their
starting reliability; an empty table gives an empty result. Extra columns are not read.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import settle

KINDS = ("email", "ip", "card", "phone", "other")
#: The patterns begin where a run begins or the last match ended, and never give characters back, so long runs cost one pass.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPELLED = r"(?i)\b[a-z0-9._%+-]{2,40}\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]{2,40}\x20?(?:(?:\(dot\)|\[dot\]|\.)\x20?[a-z]{2,10})"
GROUPS = r"(?:\G|(?<![0-9A-Za-z]))\(?[0-9]{2,}+(?:[\x20./()-]{1,2}[0-9]{2,}+)++"
#: Words that speak for and against personal data.
FOR = "phone|tel|call|fax|mobile|cell|contact|ssn|social security|card|visa|account|iban|passport|email|e-mail|mail|reach"
AGAINST = "isbn|issn|doi|version|page|pages|figure|table|section|chapter|total|price|usd|eur|items|count|sum|order"
LABELERS = ("base", "shape", "gazetteer_for", "gazetteer_against", "context", "plain")
WORDS = (2, 3)  # the labelers that see what no feature holds
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_BLOCK = 256


def _starts(gaps: Column, lens: Column) -> Column:
    """Where each match starts, given the lengths of gaps before and of matches; sums by blocks keep long lists cheap."""
    both = F.zip_with(F.slice(gaps, 1, F.size(lens)), lens, lambda a, b: a + b)
    plus = lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _BLOCK).cast("int")), lambda b: plus(F.slice(both, 1, b * _BLOCK)))
    place = F.transform(F.array(blocks), lambda sums: F.transform(lens, lambda _, i: (
        F.get(sums, F.floor(i / _BLOCK).cast("int")) + plus(F.slice(both, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), i % _BLOCK)) + F.get(gaps, i))))
    return F.when(F.size(lens) > 0, F.element_at(place, 1)).otherwise(F.array().cast("array<int>"))


_SPAN = "array<struct<start:int,end:int,value:string>>"


def _bound(x: Column, use) -> Column:
    """``use(x)`` with ``x`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


def spans_of(text: Column, pattern: str, may: Column) -> Column:
    """(start, end, value) of all matches; texts for which ``may`` is false are not searched."""
    def placed(found: Column, gaps: Column) -> Column:
        return F.zip_with(found, _starts(gaps, F.transform(found, lambda m: F.length(m))),
                          lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))

    spans = _bound(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda found: F.when(F.size(found) > 0, _bound(
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p)), lambda gaps: placed(found, gaps))))
    return F.coalesce(F.when(may, spans), F.array().cast(_SPAN)).cast(_SPAN)


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end), by start and then kind."""
    digit, may = text.rlike("[0-9]"), {"email": text.contains("@"), "phone": text.contains("+")}
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        parts.append(_of_kind(spans_of(text, PATTERNS[kind], may.get(kind, digit)), k))
    return F.array_sort(F.concat(*parts))


def _of_kind(spans: Column, k: int) -> Column:
    good = F.filter(spans, lambda s: _valid(KINDS[k], s["value"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))


def candidates(text: Column) -> Column:
    """Array of (start, end, value, left, right): wider matches with 32 characters before and 8 after."""
    digit = text.rlike("[0-9]")
    found = [spans_of(text, PATTERNS["card"], digit), spans_of(text, GROUPS, digit),
             spans_of(text, PATTERNS["email"], text.contains("@")), spans_of(text, PATTERNS["phone"], text.contains("+")),
             spans_of(text, SPELLED, text.rlike(r"(?i)[(\[]at[)\]]"))]
    around = lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        F.lower(F.substring(text, F.greatest(s["start"] - 31, F.lit(1)), F.least(s["start"], F.lit(32)))).alias("left"),
        F.substring(text, s["end"] + 1, F.lit(8)).alias("right"))
    return F.transform(F.array_distinct(F.concat(*found)), around)


def _digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c["value"], "[^0-9]", ""))


def votes(c: Column, base: Column) -> Column:
    """One vote of each labeler on a candidate."""
    n, value = _digits(c), c["value"]
    covered = F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    shape = (F.when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|(?i)[(\[]at[)\]]"), 1)
             .when(value.contains("@"), 1).when((n < 7) | (n > 19), -1).otherwise(0))
    cue = lambda words: c["left"].rlike(rf"\b(?:{words})\b[^.\n]*$")
    context = F.when(c["left"].rlike(r"[$#%*&€£]\s*$") | c["right"].rlike(r"^\s*[$#%*&€£]"), -1).when(c["left"].rlike(r"[:+]\s*$"), 1).otherwise(0)
    plain = F.when(value.rlike(r"^[0-9]+$"), -1).otherwise(0)
    return F.array(*(x.cast("int") for x in (F.when(covered, 1).otherwise(0), shape, F.when(cue(FOR), 1).otherwise(0),
                                             F.when(cue(AGAINST), -1).otherwise(0), context, plain)))


FEATURES = ("digits", "mark", "before", "after")


def features(c: Column) -> Column:
    """Values of ``FEATURES``, each from a short list."""
    n, value = _digits(c), c["value"]
    mark = (F.when(value.contains("@"), "at").when(value.rlike(r"(?i)[(\[]at[)\]]"), "spelled").when(value.startswith("+"), "plus")
            .when(value.contains("("), "paren").when(value.contains("-"), "dash").when(value.contains("."), "dot").when(value.contains(" "), "blank").otherwise("none"))
    last = F.regexp_extract(c["left"], r"(\S)\s*$", 1)
    kind = lambda x: F.when(x == "", "none").when(x.rlike(r"^\p{L}"), "letter").when(x.rlike("^[:=+(]"), "lead").when(x.rlike("^[.,;!?)]"), "stop").otherwise("sign")
    return F.array(F.least(n, F.lit(20)).cast("string"), mark, kind(last), kind(F.regexp_extract(c["right"], r"^\s*(\S)", 1)))


def reliabilities(patterns: DataFrame, rounds: int = 25) -> DataFrame:
    """(prior, acc): one row from (v, n), the vote patterns and their counts.

    ``acc[j]`` is how often labeler j is right when it votes, both classes weighing the same, with a start of 0.8 that counts as
    eight votes. Weighed by their numbers, one that always says no would pass for reliable wherever most candidates are no.
    """
    table = patterns.agg(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n"))).alias("p"))
    m = len(LABELERS)
    odds = "ln(s.prior / (1 - s.prior)) + aggregate(zip_with(x.v, s.acc, (v, a) -> v * ln(a / (1 - a))), 0D, (t, y) -> t + y)"
    judged = f"transform(p, x -> struct(x.v as v, x.n as n, 1 / (1 + exp(-greatest(-30D, least(30D, {odds})))) as q))"
    ones, zeros = "aggregate(g, 1D, (t, x) -> t + x.n * x.q)", "aggregate(g, 1D, (t, x) -> t + x.n * (1 - x.q))"
    right = "aggregate(g, 0D, (t, x) -> t + x.n * CASE x.v[j] WHEN 1 THEN x.q / c.ones WHEN -1 THEN (1 - x.q) / c.zeros ELSE 0D END)"
    wrong = "aggregate(g, 0D, (t, x) -> t + x.n * CASE x.v[j] WHEN 1 THEN (1 - x.q) / c.zeros WHEN -1 THEN x.q / c.ones ELSE 0D END)"
    heard = "aggregate(g, 0D, (t, x) -> t + CASE WHEN x.v[j] <> 0 THEN x.n ELSE 0D END)"
    share = f"coalesce(({heard}) * ({right}) / nullif(({right}) + ({wrong}), 0D), 0D)"
    prior = "(aggregate(g, 1D, (t, x) -> t + x.n * x.q) / aggregate(g, 2D, (t, x) -> t + x.n))"
    step = (f"element_at(transform(array({judged}), g -> struct(greatest(0.02D, least(0.98D, {prior})) as prior, "
            f"element_at(transform(array(struct({ones} as ones, {zeros} as zeros)), c -> "
            f"transform(sequence(0, {m - 1}), j -> greatest(0.55D, least(0.99D, ({share} + 6.4D) / ({heard} + 8D))))), 1) as acc)), 1)")
    start = f"struct(0.5D as prior, array_repeat(0.8D, {m}) as acc)"
    return table.select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step})").alias("s")).select("s.prior", "s.acc")


def _count(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")


def _log_odds(p: float) -> float:
    return math.log(p / (1 - p))


def find_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.9) -> DataFrame:
    """One row per document: counts per kind, all spans and the digest of the base ones."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    read = docs.select(F.col(f"`{id}`").alias("doc_id"), base_spans(t).alias("base"), candidates(t).alias("c"))
    read = settle(read.withColumn("c", F.transform("c", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), votes(c, F.col("base")).alias("v"), features(c).alias("f")))))

    one = read.select(F.explode("c").alias("c")).select("c.v", "c.f")
    seen = settle(one.groupBy("v", "f").count())  # bounded: vote patterns by feature values
    patterns = seen.groupBy("v").agg(F.sum("count").alias("n"))
    prior, acc = reliabilities(patterns).first()
    weight = [_log_odds(a) for a in acc]
    said = F.lit(_log_odds(prior))
    for j, w in enumerate(weight):
        said = said + F.col("v")[j] * w
    q = 1 / (1 + F.exp(-said))
    soft = seen.withColumn("q", q * F.col("count")).withColumn("r", (1 - q) * F.col("count"))
    learnt = (soft.select("q", "r", F.posexplode(F.concat(F.array(F.lit("")), F.col("f"))).alias("k", "x"))
              .groupBy("k", "x").agg(F.sum("q").alias("q"), F.sum("r").alias("r")).collect())  # a row per feature value
    total = next(((r["q"], r["r"]) for r in learnt if r["k"] == 0), (0.0, 0.0))
    ratio = {f"{r['k'] - 1}:{r['x']}": math.log((r["q"] + 1) / (total[0] + 10)) - math.log((r["r"] + 1) / (total[1] + 10)) for r in learnt if r["k"] > 0}
    table = F.create_map(*(F.lit(x) for pair in (ratio or {"": 0.0}).items() for x in pair))

    def accepted(c: Column) -> Column:
        score = F.lit(math.log((total[0] + 1) / (total[1] + 1)))
        for k in range(len(FEATURES)):
            score = score + F.coalesce(table[F.concat(F.lit(f"{k}:"), c["f"][k])], F.lit(0.0))
        for j in WORDS:
            score = score + c["v"][j] * weight[j]
        return (c["v"][0] == 0) & (score >= _log_odds(threshold))

    more = F.transform(F.filter("c", accepted), lambda c: F.struct(c["start"].alias("start"), F.lit(4).alias("kind"), c["end"].alias("end")))
    out = read.withColumn("all", F.array_sort(F.array_distinct(F.concat("base", more))))
    names = F.array(*(F.lit(k) for k in KINDS))
    spell = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", *(_count("all", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
                      F.sha2(spell("base"), 256).alias("base_sha256"), spell("all").alias("spans"))
