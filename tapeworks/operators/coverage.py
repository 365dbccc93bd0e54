"""Which stretches of a trade stream are provably complete."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.core import day_text, epoch_us
from tapeworks.operators.scan import BLOCK_ROWS, block_no, previous
from tapeworks.session import pin


def id_gaps(ticks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Missing id ranges ``lo..hi`` with the times before and after, per symbol."""
    slim = ticks.select("symbol", "trade_id", epoch_us("ts").alias("ts_us"),
                        block_no("trade_id", block_rows).alias("blk"))
    prev = previous(slim, ["symbol"], "blk", ["trade_id"], {"trade_id": "before_id", "ts_us": "before_us"})
    return (prev.where(F.col("trade_id") > F.col("before_id") + 1)
            .select("symbol", (F.col("before_id") + 1).alias("lo"), (F.col("trade_id") - 1).alias("hi"),
                    "before_us", F.col("ts_us").alias("after_us")))


def open_gaps(gaps: DataFrame, verified: DataFrame | None) -> DataFrame:
    """Gaps the exchange did not confirm as never published."""
    return gaps if verified is None else gaps.join(verified, ["symbol", "lo", "hi"], "left_anti")


def store_ends(ticks: DataFrame) -> DataFrame:
    """Oldest and newest trade per symbol."""
    us = epoch_us("ts")
    return ticks.groupBy("symbol").agg(
        F.min("trade_id").alias("first_id"), F.min_by(us, "trade_id").alias("first_us"),
        F.max("trade_id").alias("last_id"), F.max_by(us, "trade_id").alias("last_us"))


def coverage_runs(ticks: DataFrame, verified: DataFrame | None = None, status: DataFrame | None = None,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stretches ``start_us..end_us`` without a missing trade.

    A run starts at the first trade and after every open gap; it ends at the
    trade before the next gap.  A feed heartbeat extends only the newest run,
    and only while the feed is in sync and knows no newer trade.  The gap table
    is kept: it is small next to the trades and read more than once.
    """
    gaps = open_gaps(id_gaps(ticks, block_rows), verified)
    ends = pin(store_ends(ticks))
    starts = gaps.select("symbol", F.col("hi").alias("at"), F.col("after_us").alias("start_us"), "before_us")
    heads = ends.select("symbol", F.col("first_id").alias("at"), F.col("first_us").alias("start_us"),
                        F.lit(None).cast("long").alias("before_us"))
    marks = starts.unionByName(heads).withColumn("rev", -F.col("at"))
    marks = pin(marks.withColumn("rblk", block_no("rev", block_rows)))
    runs = previous(marks, ["symbol"], "rblk", ["rev"], {"before_us": "end_us", "at": "next_at"})
    runs = runs.join(ends.select("symbol", "last_us", "last_id"), "symbol")
    newest = F.col("next_at").isNull()
    end = F.when(newest, F.col("last_us")).otherwise(F.col("end_us"))
    if status is not None:
        beat = status.select("symbol", "in_sync", F.col("live_through_us"), F.col("last_trade_id"))
        runs = runs.join(beat, "symbol", "left")
        alive = (newest & F.coalesce("in_sync", F.lit(True)) & (F.col("last_trade_id") <= F.col("last_id"))
                 & (F.col("live_through_us") > F.col("last_us")))
        end = F.when(alive, F.col("live_through_us")).otherwise(end)
    return runs.select("symbol", "start_us", end.alias("end_us"))


def day_summary(ticks: DataFrame, verified: DataFrame | None = None,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per stored day: rows, first and last trade, and open holes inside the day."""
    us = epoch_us("ts")
    days = ticks.groupBy("symbol", day_text(us).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("trade_id").alias("first_id"),
        F.min_by(us, "trade_id").alias("first_us"), F.max("trade_id").alias("last_id"),
        F.max_by(us, "trade_id").alias("last_us"))
    holes = open_gaps(id_gaps(ticks, block_rows), verified)
    per_day = (holes.where(day_text("before_us") == day_text("after_us"))
               .groupBy("symbol", day_text("before_us").alias("day"))
               .agg(F.count(F.lit(1)).alias("holes"), F.min("before_us").alias("first_hole_us")))
    return days.join(per_day, ["symbol", "day"], "left").withColumn("holes", F.coalesce("holes", F.lit(0)))


def continuity(ticks: DataFrame, verified: DataFrame | None = None,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Whole-store check per symbol: days, rows, id range, open and verified gaps."""
    per_day = ticks.groupBy("symbol", day_text(epoch_us("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("trade_id").alias("lo"), F.max("trade_id").alias("hi"))
    store = per_day.groupBy("symbol").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"),
                                          F.sum("n").alias("rows"), F.min("lo").alias("first_id"), F.max("hi").alias("last_id"))
    gaps = id_gaps(ticks, block_rows)
    if verified is None:
        gaps = gaps.withColumn("ok", F.lit(False))
    else:
        gaps = gaps.join(verified.withColumn("ok", F.lit(True)), ["symbol", "lo", "hi"], "left")
    found = gaps.groupBy("symbol").agg(
        F.count_if(F.col("ok").isNull() | ~F.col("ok")).alias("open_gaps"),
        F.count_if("ok").alias("verified_holes"))
    out = store.join(found, "symbol", "left")
    return (out.withColumn("open_gaps", F.coalesce("open_gaps", F.lit(0)))
            .withColumn("verified_holes", F.coalesce("verified_holes", F.lit(0)))
            .withColumn("contiguous", F.col("open_gaps") == 0))
