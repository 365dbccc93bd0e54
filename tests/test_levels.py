"""Searches through levels of block summaries against plain loops."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import levels as V
from tapeworks.operators import scan


def series(n, seed):
    rng = np.random.default_rng(seed)
    mid = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return pd.DataFrame({"symbol": "A", "i": np.arange(n), "t": np.arange(n) * 60, "open": mid, "high": mid * (1 + rng.uniform(0, 0.01, n)), "low": mid * (1 - rng.uniform(0, 0.01, n))})


def candidates(p, every, seed):
    rng, rows = np.random.default_rng(seed), []
    for s in range(0, len(p), every):
        last = int(rng.integers(s, len(p)))
        stop, target = float(p.low[s] * (1 - rng.uniform(0, 0.3))), float(p.high[s] * (1 + rng.uniform(0, 0.3)))
        rows.append(("A", s, s, last, None if s % 5 == 0 else stop, None if s % 7 == 0 else target, float(p.high[s]), float(p.high[s] * rng.uniform(0.001, 0.3))))
    return pd.DataFrame(rows, columns=["symbol", "s", "entry_i", "last_i", "stop", "target", "peak", "drop"])


@pytest.mark.parametrize("n, fan", [(1, 4), (63, 64), (900, 3), (900, 64)])
def test_first_hit_and_fall(spark, n, fan):
    p = series(n, n)
    c = candidates(p, max(1, n // 150), 1)
    bars, cands = spark.createDataFrame(p), spark.createDataFrame(c).withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in ("stop", "target")})
    hits = {r.s: r.hit for r in V.first_hit(cands, bars, ["symbol"], ["symbol", "s"], fan).collect()}
    falls = {r.s: r for r in V.first_fall(cands.withColumn("from_i", F.col("entry_i") + 1), bars, ["symbol"], ["symbol", "s"], fan).collect()}
    for r in c.itertuples():
        d = p.iloc[r.entry_i:r.last_i + 1]
        touch = d[(d.low <= (np.nan if r.stop is None else r.stop)) | (d.high >= (np.nan if r.target is None else r.target))]
        assert (hits[r.s].i, hits[r.s].low) == (touch.i.iloc[0], touch.low.iloc[0]) if len(touch) else r.s not in hits
        peak, want = r.peak, None
        for b in p.iloc[r.entry_i + 1:r.last_i + 1].itertuples():
            if peak - b.low >= r.drop:
                want = (b.i, b.open, peak)
                break
            peak = max(peak, b.high)
        got = falls.get(r.s)
        assert (None if got is None else (got.fall_i, got.fall_open, got.peak)) == want


def test_rows_per_candidate_do_not_grow_with_the_series(spark):
    """A level that nothing reaches: every candidate probes as many groups as there are levels, and no node passes."""
    for n, levels in ((4_000, 2), (40_000, 3)):
        probes = spark.range(n).select(F.size(V._probes(F.col("id"), F.lit(n - 1), levels, V.FAN)).alias("p"))
        assert probes.agg(F.max("p")).first()[0] == levels and V.n_levels(spark.range(n).withColumnRenamed("id", "i")) == levels
        bars = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("i"), F.col("id").alias("t"), *[F.lit(1.0).alias(x) for x in ("open", "high", "low")])
        cands = bars.select("symbol", F.col("i").alias("s"), F.col("i").alias("entry_i"), F.lit(n - 1).alias("last_i"), F.lit(0.5).alias("stop"), F.lit(2.0).alias("target"))
        assert V.first_hit(cands, bars, ["symbol"], ["symbol", "s"]).count() == 0


@pytest.mark.parametrize("hold", [2, 70])
def test_chain_over_many_blocks(spark, hold):
    """A dense key over 50 blocks, with equal starts that straddle blocks and rows that stop nobody."""
    rng = np.random.default_rng(hold)
    start = np.sort(np.repeat(np.arange(800), rng.integers(1, 4, 800)))[:1600]
    p = pd.DataFrame({"k": "hot", "n": np.arange(len(start)), "s": start, "r": start + rng.integers(0, hold + 1, len(start))})
    p = pd.concat([p, p.iloc[:40].assign(k="cold"), p.iloc[1000:1010].assign(k="late")])
    df = spark.createDataFrame(p).withColumn("blk", scan.block_no("n", 32))
    assert df.groupBy("k", "blk").count().agg(F.max("count")).first()[0] <= 32
    got = {(r.k, r.n): r.accepted for r in scan.greedy_chain(df, ["k"], "blk", "s", "r", ["n"]).collect()}
    for k, d in p.groupby("k"):
        free = -1
        for x in d.itertuples():
            assert got[k, x.n] == (x.s >= free), (k, x)
            free = x.r if x.s >= free else free


def test_quantile_by_counting(spark):
    from tapeworks.operators.select import exact_quantile
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(0, 1, 999), "b": 10.0 ** rng.integers(-3, 4, 40), "c": np.full(50, 3.5), None: rng.integers(0, 4, 400).astype(float), "d": np.array([-1.7e308, 1.7e308]), "e": np.array([1.0, np.nan])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("f", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q, bins in ((0.5, 4096), (0.05, 16)):
        got = {r.k: r.m for r in exact_quantile(df, ["k"], "v", "m", q, bins).collect()}
        want = {r.k: r.m for r in df.where("not isnan(v)").groupBy("k").agg(F.percentile("v", q).alias("m")).collect()}
        want.pop("f", None)
        assert got == pytest.approx(want, rel=1e-12) and set(got) == {"a", "b", "c", "d", "e", None}
