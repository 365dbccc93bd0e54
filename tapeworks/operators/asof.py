"""Backward as-of join without a range join."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators.scan import range_blocks, running


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str,
              cols: Sequence[str], span: int | None = None, block: str | None = None) -> DataFrame:
    """For each left row the last right row with ``right_on <= left_on`` (inclusive).

    Both sides are stacked on one time axis and the last right row is carried
    forward; on equal times the right row comes first.  ``span`` is the width
    of a block on the time axis; without it the axis is cut into range blocks.
    ``block`` names a column to keep the row's block in: blocks follow one another
    in time within a key, and rows of equal times share one.
    """
    lrow, rrow = F.struct(*left.columns), F.struct(*cols)
    ltype = left.select(lrow.alias("x")).schema["x"].dataType
    rtype = right.select(rrow.alias("x")).schema["x"].dataType
    a = left.select(*keys, F.col(left_on).alias("_t"), F.lit(1).alias("_k"), lrow.alias("_l"),
                    F.lit(None).cast(rtype).alias("_r"))
    b = right.select(*keys, F.col(right_on).alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(ltype).alias("_l"),
                     rrow.alias("_r"))
    both = a.unionByName(b)
    if span is None:
        both = range_blocks(both, keys, ["_t", "_k"], "_blk")
    else:
        both = both.withColumn("_blk", F.floor(F.col("_t") / span).cast("long"))
    out = running(both, list(keys), "_blk", ["_t", "_k"], {"_hit": ("last", F.col("_r"))})
    kept = [F.col("_blk").alias(block)] if block else []
    return out.where(F.col("_l").isNotNull()).select("_l.*", *kept, *[F.col(f"_hit.{c}").alias(c) for c in cols])
