"""News text: cleaning, lexicon scores and entity mentions."""
from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tapeworks.functions.core import col

# Sentiment weights, negations and entity aliases.
LEXICON = {
    "bullish": 2.0, "moon": 1.5, "rocket": 1.5, "pump": 1.2, "surge": 1.5, "rally": 1.5, "breakout": 1.3, "gain": 1.0, "gains": 1.0, "soar": 1.5,
    "buy": 0.8, "long": 0.6, "accumulate": 1.0, "uptrend": 1.2, "ath": 1.5, "partnership": 1.2, "listing": 1.2, "adoption": 1.2, "green": 0.6,
    "upgrade": 1.0, "optimistic": 1.0, "strong": 0.7, "win": 1.0,
    "bearish": -2.0, "dump": -1.5, "crash": -2.0, "plunge": -1.8, "fall": -1.0, "drop": -1.0, "dumps": -1.5, "sell": -0.8, "short": -0.6, "scam": -2.0,
    "rug": -2.5, "rugpull": -2.5, "ponzi": -2.0, "hack": -2.0, "exploit": -1.8, "delisting": -1.8, "lawsuit": -1.5, "sec": -0.8, "fud": -1.2, "red": -0.6,
    "downgrade": -1.0, "bankrupt": -2.5, "collapse": -2.0, "weak": -0.7, "loss": -1.0, "losses": -1.0, "ban": -1.3, "warning": -0.8,
}
NEGATIONS = ("not", "no", "never", "isn't", "isnt", "dont", "don't", "won't", "wont", "cant", "can't", "without", "fail", "failed", "unlikely")
ENTITIES = {
    "XRP": ("xrp", "ripple"), "BTC": ("btc", "bitcoin", "xbt"), "TRX": ("trx", "tron"), "DOGE": ("doge", "dogecoin"), "PUMP": ("pump", "pump.fun", "pumpfun"),
    "KAITO": ("kaito",), "UNI": ("uni", "uniswap"), "JTO": ("jto", "jito"), "HYPE": ("hype", "hyperliquid"), "SOL": ("sol", "solana"), "ADA": ("ada", "cardano"),
}


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML entities to characters; Spark has no built-in for the full entity table."""
    return s.map(html.unescape, na_action="ignore")


def clean(text: str | Column) -> Column:
    """Tags to spaces, entities to characters, runs of white space to one space."""
    flat = unescape(F.regexp_replace(col(text), "<[^>]+>", " "))
    return F.regexp_replace(F.regexp_replace(flat, r"(?U)[\s\x1c-\x1f]+", " "), "^ | $", "")


def item_text(xml: str | Column) -> Column:
    """Title, description, summary and content of a feed item as one clean text."""
    parts = [F.xpath_string(col(xml), F.lit(f"/item/{tag}")) for tag in ("title", "description", "summary", "content")]
    return clean(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))


def lexicon_score(text: str | Column, lexicon: Mapping[str, float] = LEXICON, negations: Sequence[str] = NEGATIONS) -> Column:
    """Sum of word weights; a weight flips its sign after a negation.

    The lexicon is a short literal, so a text is scored where it lies, without a join.
    """
    words = F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z.]+)"), 1)
    weights = F.create_map(*[F.lit(v) for kv in lexicon.items() for v in kv])

    def score(ws: Column) -> Column:
        sign = lambda i: F.when(F.get(ws, i - 1).isin(*negations), -1.0).otherwise(1.0)
        each = F.transform(ws, lambda w, i: F.when(w.isin(*lexicon), F.try_element_at(weights, w) * sign(i)).otherwise(0.0))
        return F.aggregate(each, F.lit(0.0), lambda a, v: a + v)

    # the one-element array names the word list once, so that it is split once per text
    return F.get(F.transform(F.array(words), score), F.lit(0))


def mentions(text: str | Column, entities: Mapping[str, Sequence[str]] = ENTITIES, default: str = "BTC") -> Column:
    """Entities any of whose aliases occur in the text; the default one when none does."""
    def named(low: Column) -> Column:
        found = []
        for name, aliases in entities.items():
            hit = low.contains(aliases[0])
            for a in aliases[1:]:
                hit = hit | low.contains(a)
            found.append(F.when(hit, F.lit(name)))
        return F.filter(F.array(*found), lambda v: v.isNotNull())

    hits = F.get(F.transform(F.array(F.lower(col(text))), named), F.lit(0))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))


def sentiment(docs: DataFrame, lexicon: Mapping[str, float] = LEXICON, negations: Sequence[str] = NEGATIONS,
              entities: Mapping[str, Sequence[str]] = ENTITIES, default: str = "BTC", block: float = -0.15, leave: float = -0.55) -> DataFrame:
    """Sentiment per entity: mean text score squashed to (-1, 1), sample size, sources and flags."""
    s = docs.select("source", lexicon_score("text", lexicon, negations).alias("score"), F.explode(mentions("text", entities, default)).alias("entity"))
    g = s.groupBy("entity").agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))
    squash = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("avg_score") / (F.abs("avg_score") + 2)))
    g = g.withColumn("score", F.round(squash, 3))
    return g.withColumns({"blocks_buy": F.col("score") <= block, "triggers_exit": F.col("score") <= leave})
