"""Mixing documents to target weights by iterative proportional fitting.

Documents are counted once into cells (source, language, topic) of token sums. The
cells' weights are raked: scaled in turn to the target shares of sources, languages
and topics until all three hold. A document's expected number of copies is its cell's
weight times the wanted tokens, over the cell's tokens; whole copies are certain and
the rest is drawn by a hash of the document, so the draw repeats and needs no order.

Only the cell table enters the iterations. It has a row per combination that occurs
and is small beside the documents, but its size is not bounded, so the raking is
windows over the cell table, settled every few sweeps; only its largest deviation
comes to the driver. The cells meet the documents again in a join on three columns
whose one side has a row per cell: broadcast if the cells, counted, are few, else
shuffled, where adaptive execution splits heavy cells.

Targets are (value, share) rows per column. Shares of values that do not occur are
spread over the others in proportion; values without a target keep their own share.

Defined cases: null source, language or text count as the values "" and 0 tokens;
documents without tokens have weight 0 and are not drawn; a row that occurs twice is
two documents with the same draw; an empty table gives an empty result.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import WORD, settle

AXES = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: tables, shouting, data and prose. Any other topic column may be used instead."""
    n = F.length(text)
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return (F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(share(r"[|<>{}]") > 0.02, "table").when(share("[A-Z]") > 0.3, "shout")
            .when(share("[0-9#$%&*]") > 0.03, "data").otherwise("prose"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tempered(cells: DataFrame, axis: str, power: float) -> DataFrame:
    """(value, share) targets: the values' own token shares raised to ``power`` and normalised."""
    own = cells.groupBy(F.col(axis).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0")
    total = own.agg(F.sum(F.pow(F.col("n").cast("double"), power))).scalar()
    return own.select("value", (F.pow(F.col("n").cast("double"), power) / total).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-9) -> DataFrame:
    """Adds ``weight`` (sums to 1), scaled to the targets of every axis from ``tokens`` of the cells, and ``deviation``.

    Sweeps go on until no axis misses a target by ``tolerance``, or until the largest miss
    no longer falls: targets that contradict each other cannot all be met. ``deviation`` is
    that largest miss, the same in every row.
    """
    out = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for axis in AXES:
        goal = targets[axis].groupBy(F.col("value").alias(axis)).agg(F.sum("share").alias(f"goal_{axis}"))
        out = out.join(goal, axis, "left")
        own = F.sum("tokens").over(Window.partitionBy(axis)) / cells.agg(F.sum("tokens")).scalar()
        out = out.withColumn(f"goal_{axis}", F.coalesce(F.col(f"goal_{axis}"), own))
    ends = {a: out.groupBy(a).agg(F.first(f"goal_{a}").alias("g")).agg(F.sum("g")).scalar() for a in AXES}
    out = settle(out.withColumns({f"goal_{a}": F.col(f"goal_{a}") / ends[a] for a in AXES}))
    worst, falls = float("inf"), True
    while falls:
        for _ in range(4):
            for a in AXES:
                out = out.withColumn("weight", F.col("weight") * F.col(f"goal_{a}") / F.sum("weight").over(Window.partitionBy(a)))
        out = settle(out)
        off = [out.groupBy(a).agg(F.abs(F.sum("weight") - F.first(f"goal_{a}")).alias("d")).agg(F.max("d").alias("d")) for a in AXES]
        now = reduce(DataFrame.unionAll, off).agg(F.max("d")).first()[0]
        now = 0.0 if now is None else now
        falls, worst = tolerance < now < 0.99 * worst, now
    return out.withColumn("deviation", F.lit(float(worst)))


def mix_to_targets(docs: DataFrame, targets=None, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
                   topic: Column | None = None, share: float = 0.5, power: float = 0.5, seed: str = "mix", keep: tuple[str, ...] = (),
                   max_broadcast: int = 100_000) -> DataFrame:
    """One row per document: cell, ``weight``, ``expected`` copies, ``copies`` drawn, ``kept``, and how far the weights miss the targets (``deviation``).

    ``targets``: function from the cell table to {axis: DataFrame(value, share)}; by default every axis is tempered by
    ``power``. ``share``: wanted tokens as a part of all tokens. ``keep``: columns of ``docs`` to carry along.
    """
    txt = F.col(f"`{text}`")
    own = docs.select(F.col(f"`{id}`").alias("doc_id"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source"),
                      F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang"), (topic if topic is not None else topic_of(txt)).alias("topic"),
                      n_words(txt).alias("n_words"), *(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep))
    cells = settle(own.groupBy(*AXES).agg(F.sum("n_words").alias("tokens"), F.count(F.lit(1)).alias("n_docs")))
    goals = targets(cells) if targets else {a: tempered(cells, a, power) for a in AXES}
    raked = rake(cells, goals).select(*AXES, "weight", "tokens", "deviation")
    size = raked.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).first()
    total = float(size["tokens"] or 0)
    raked = F.broadcast(raked) if size["n"] <= max_broadcast else raked
    out = own.join(raked, list(AXES), "left")
    expected = F.when(F.col("n_words") > 0, F.col("weight") * total * share / F.col("tokens")).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out = out.withColumn("expected", F.coalesce(expected, F.lit(0.0)))
    whole = F.floor("expected")
    out = out.withColumn("copies", (whole + F.when(draw < F.col("expected") - whole, 1).otherwise(0)).cast("long"))
    return out.select("doc_id", *AXES, "n_words", F.coalesce("weight", F.lit(0.0)).alias("cell_weight"), "expected", "copies",
                      (F.col("copies") > 0).alias("kept"), F.coalesce("deviation", F.lit(0.0)).alias("deviation"), *(F.col(f"kept_{c}") for c in keep))
