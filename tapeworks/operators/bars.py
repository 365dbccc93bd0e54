"""Ticks to minute bars to larger bars, and stitching of bar sources."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.core import bar_open, epoch_us, grid, ratio
from tapeworks.operators.scan import previous, running
from tapeworks.schemas import BAR, BAR_FLOW

BARS_PER_BLOCK = 4096


def minute_spread(quotes: DataFrame) -> DataFrame:
    """Mean quoted spread in bps per minute; quotes without a positive mid are ignored."""
    mid = (F.col("bid") + F.col("ask")) / 2
    bps = F.when(mid > 0, (F.col("ask") - F.col("bid")) / mid * 1e4)
    return (quotes.groupBy("symbol", bar_open(epoch_us("ts"), 60).alias("t"))
            .agg(F.avg(bps).alias("spread_bps")))


def ticks_to_1m(ticks: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """Minute bars (only minutes that traded); open and close follow trade ids."""
    buy = F.col("side") == "b"
    m1 = ticks.groupBy("symbol", bar_open(epoch_us("ts"), 60).alias("t")).agg(
        F.min_by("price", "trade_id").alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", "trade_id").alias("close"),
        F.sum(F.col("price") * F.col("qty")).alias("pq"), F.sum("qty").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
        F.sum(F.when(buy, F.col("qty")).otherwise(0.0)).alias("buy_vol"),
        F.sum(F.when(buy, 0.0).otherwise(F.col("qty"))).alias("sell_vol"),
        F.count_if(buy).alias("buy_count"), F.count_if(~buy).alias("sell_count"))
    m1 = (m1.withColumn("vwap", ratio("pq", "volume"))
          .withColumn("ofi", ratio(F.col("buy_vol") - F.col("sell_vol"), "volume")))
    if quotes is None:
        m1 = m1.withColumn("spread_bps", F.lit(None).cast("double"))
    else:
        m1 = m1.join(minute_spread(quotes), ["symbol", "t"], "left")
    return m1.select("symbol", "t", *BAR)


def _bucket_aggs():
    return [F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "t").alias("close"),
            F.sum(F.coalesce("vwap", "close") * F.col("volume")).alias("pq"),
            F.avg("spread_bps").alias("spread_bps"), *[F.sum(c).alias(c) for c in BAR_FLOW]]


def covered_buckets(runs: DataFrame, tf_minutes: int, now_s: int) -> DataFrame:
    """Closed grid bars that lie inside a run: run start < open, close <= run end."""
    s = tf_minutes * 60
    lo = bar_open("start_us", s) + s
    hi = bar_open(F.least("end_us", F.lit(now_s * 1_000_000)), s)
    return (runs.where(hi > lo).select("symbol", F.explode(F.sequence(lo, hi - s, F.lit(s).cast("long"))).alias("t"))
            .distinct())


def resample(m1: DataFrame, runs: DataFrame, tf_minutes: int, now_s: int) -> DataFrame:
    """Fully covered closed bars; a covered but quiet bar is flat at the previous close."""
    s = tf_minutes * 60
    traded = m1.groupBy("symbol", grid("t", s).alias("t")).agg(*_bucket_aggs())
    bars = covered_buckets(runs, tf_minutes, now_s).join(traded, ["symbol", "t"], "left")
    bars = bars.withColumn("blk", F.floor(F.col("t") / (s * BARS_PER_BLOCK)).cast("long"))
    bars = running(bars, ["symbol"], "blk", ["t"], {"prev_close": ("last", F.col("close"))})
    flat = {c: F.coalesce(c, "prev_close") for c in ("open", "high", "low", "close")}
    bars = bars.where(F.col("prev_close").isNotNull()).withColumns({**flat, **{c: F.coalesce(c, F.lit(0)) for c in BAR_FLOW}})
    ofi = ratio(F.col("buy_vol") - F.col("sell_vol"), "volume")
    return (bars.withColumns({"vwap": ratio("pq", "volume"), "ofi": ofi}).select("symbol", F.lit(tf_minutes).cast("long").alias("tf"), "t", *BAR))


def plain_resample(bars: DataFrame, tf_minutes: int, now_s: int) -> DataFrame:
    """Larger OHLCV bars without the coverage rule; only buckets in the past."""
    s = tf_minutes * 60
    out = bars.groupBy("symbol", grid("t", s).alias("t")).agg(
        F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "t").alias("close"), F.sum("volume").alias("volume"))
    return out.where(F.col("t") < now_s // s * s)


def trade_bars(ticks: DataFrame, tf_minutes: int) -> DataFrame:
    """OHLCV bars straight from trades, first and last by time then id."""
    at = F.struct("ts", "trade_id")
    return ticks.groupBy("symbol", bar_open(epoch_us("ts"), tf_minutes * 60).alias("t")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"))


def contiguous_tail(bars: DataFrame, tf_minutes: int, max_step: int = 1,
                    keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars after the last break; a break is a step of more than ``max_step`` bars."""
    s = tf_minutes * 60
    cut = bars.withColumn("_blk", F.floor(F.col("t") / (s * BARS_PER_BLOCK)).cast("long"))
    steps = previous(cut.select(*keys, "t", "_blk"), keys, "_blk", ["t"], {"t": "before"})
    last = (steps.where(F.col("t") - F.col("before") > s * max_step)
            .groupBy(*keys).agg(F.max("t").alias("_from"), F.count(F.lit(1)).alias("holes")))
    out = bars.join(last, list(keys), "left")
    return (out.where(F.col("_from").isNull() | (F.col("t") >= F.col("_from")))
            .withColumn("holes", F.coalesce("holes", F.lit(0))).drop("_from"))


def overlay(ohlc: DataFrame, local: DataFrame) -> DataFrame:
    """OHLC bars with tick-built bars laid over them.

    A local bar replaces the OHLC bar of the same open and may extend the
    series, but never before the first OHLC bar.  ``src`` tells them apart.
    """
    first = ohlc.groupBy("symbol").agg(F.min("t").alias("_first"))
    mine = local.join(first, "symbol", "left")
    mine = mine.where(F.col("_first").isNull() | (F.col("t") >= F.col("_first"))).drop("_first")
    both = (ohlc.select("symbol", "t", F.struct(*[c for c in ohlc.columns if c not in ("symbol", "t")]).alias("o"))
            .join(mine.select("symbol", "t", F.struct(*[c for c in local.columns if c not in ("symbol", "t")]).alias("m")),
                  ["symbol", "t"], "full_outer"))
    has = F.col("m").isNotNull()
    cols = [F.when(has, F.col(f"m.{c}") if c in local.columns else F.lit(None))
            .otherwise(F.col(f"o.{c}") if c in ohlc.columns else F.lit(None)).alias(c)
            for c in dict.fromkeys([c for c in (*ohlc.columns, *local.columns) if c not in ("symbol", "t")])]
    return both.select("symbol", "t", *cols, F.when(has, "ticks").otherwise("ohlc").alias("src"))


def merge_daily(public: DataFrame, ticks: DataFrame) -> DataFrame:
    """Longest daily history: public bars win, tick-built days only fill."""
    cols = public.columns
    extra = ticks.join(public.select("symbol", "t"), ["symbol", "t"], "left_anti")
    return public.unionByName(extra.select(*cols))


def newest_wins(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of parts; the last part listed wins on an equal key."""
    tagged = [p.withColumn("_prio", F.lit(n)) for n, p in enumerate(parts)]
    both = tagged[0]
    for p in tagged[1:]:
        both = both.unionByName(p)
    rest = [c for c in parts[0].columns if c not in keys]
    return (both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_prio").alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}") for c in rest]))
