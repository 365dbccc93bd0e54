"""Exact quantiles per group without gathering a group's values.

A group's range is cut into bins of equal width. Counts per bin, added up on the map
side, name the bin that holds the wanted rank; the least and largest value in it are the
next range. Ranges shrink by the number of bins each time and end at a single value, so
the state of an aggregation is three numbers per bin, whatever the group holds.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.session import pin

BINS = 4096


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, name: str, q: float = 0.5, bins: int = BINS, max_broadcast: int = 100_000) -> DataFrame:
    """(keys, ``name``): the quantile ``q`` of every group, between its two neighbours in proportion; NULLs and NaN do not count.

    Keys may be NULL. Ranges are broadcast up to ``max_broadcast`` groups, counted first, and else joined.
    """
    keys = list(keys)
    rows = pin(df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    place = (F.col("_n") - 1) * F.lit(q)
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), f(place).cast("long").alias("_rank")) for k, f in enumerate((F.floor, F.ceil))]))
    state = pin(ends.withColumn("_r", ranks).select(*keys, "_n", "_r.*", "_lo", "_hi"))
    while groups := state.where("_lo < _hi").count():
        open_ = state.where("_lo < _hi").withColumnsRenamed({k: f"_{k}_" for k in keys})
        open_ = F.broadcast(open_) if groups <= max_broadcast else open_
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys], F.col("_v").between(F.col("_lo"), F.col("_hi")))
        finite = lambda c: F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), F.col(c))) / 2  # noqa: E731  halves, so that the width of a range cannot overflow
        part = (finite("_v") - finite("_lo")) / (finite("_hi") - finite("_lo"))
        bin_ = F.when(F.col("_v") <= F.col("_lo"), 0).when(F.col("_v") >= F.col("_hi"), bins - 1).otherwise(F.least(F.lit(bins - 1), F.floor(part * bins)))
        by = [*keys, "_n", "_k", "_rank"]
        counts = rows.join(open_, same).groupBy(*by, bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_k").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        mine = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
        mine = mine.withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_c")).select(state.columns)
        state = pin(state.where("_lo = _hi").unionByName(mine))
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col("_lo")))
    both = state.groupBy(*keys, "_n").agg(at(0).alias("_a"), at(1).alias("_b"))
    share = place - F.floor(place)
    return both.select(*keys, F.when(share == 0, F.col("_a")).otherwise((1 - share) * F.col("_a") + share * F.col("_b")).alias(name))
