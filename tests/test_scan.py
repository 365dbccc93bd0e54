"""Blocked scans against plain restatements; one key holds most of the rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import scan


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", i, float(v)) for i, v in enumerate(rng.normal(0, 1, 900))] + [("cold", i * 3, float(v)) for i, v in enumerate(rng.normal(0, 1, 40))]
    pdf = pd.DataFrame(rows, columns=["k", "n", "x"])
    pdf.loc[pdf.n % 7 == 0, "x"] = np.nan
    df = spark.createDataFrame(pdf.astype({"n": "int64"})).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, df


def by_key(df, cols):
    return df.orderBy("k", "n").toPandas()[cols].reset_index(drop=True)


@pytest.mark.parametrize("cut", ["ids", "range"])
def test_running_matches_pandas(series, cut):
    pdf, df = series
    b = df.withColumn("blk", scan.block_no("n", 16)) if cut == "ids" else scan.range_blocks(df, ["k"], ["n"], blocks=7)
    out = scan.running(b, ["k"], "blk", ["n"], {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "lo": ("min", F.col("x")), "l": ("last", F.col("x"))})
    got = by_key(out, ["s", "m", "lo", "l"])
    p = pdf.sort_values(["k", "n"])
    g = p.groupby("k").x
    want = pd.DataFrame({"s": g.transform(lambda v: v.fillna(0).cumsum()), "m": g.cummax().groupby(p.k).ffill(), "lo": g.cummin().groupby(p.k).ffill(), "l": g.ffill()}).reset_index(drop=True)
    for c in ("m", "lo", "l"):
        np.testing.assert_allclose(got[c].astype(float), want[c], atol=1e-12)
    np.testing.assert_allclose(got.s.astype(float), want.s, atol=1e-9)


def test_hot_key_is_cut_into_many_blocks(series):
    _, df = series
    b = scan.range_blocks(df, ["k"], ["n"], blocks=7)
    sizes = b.groupBy("blk").count().toPandas()["count"]
    assert len(sizes) >= 6 and sizes.max() < 0.4 * sizes.sum()


def test_range_blocks_stay_bounded_as_the_table_grows(spark, monkeypatch):
    monkeypatch.setattr(scan, "RANGE_ROWS", 500)
    for n in (4_000, 16_000):
        b = scan.range_blocks(spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("n")), ["k"], ["n"])
        sizes = b.groupBy("blk").count().toPandas()["count"]
        assert sizes.sum() == n and sizes.max() < 1_000


def test_ordinals_and_previous(series):
    pdf, df = series
    b = df.withColumn("blk", scan.block_no("n", 10))
    o = by_key(scan.ordinals(b, ["k"], "blk", ["n"]), ["i"])
    assert o.i.tolist() == pdf.sort_values(["k", "n"]).groupby("k").cumcount().tolist()
    p = by_key(scan.previous(b, ["k"], "blk", ["n"], {"n": "pn"}), ["pn"])
    want = pdf.sort_values(["k", "n"]).groupby("k").n.shift().tolist()
    assert [None if pd.isna(v) else int(v) for v in p.pn] == [None if pd.isna(v) else int(v) for v in want]


def test_linear_scan_is_ewm(spark):
    x = pd.Series(np.random.default_rng(1).lognormal(0, 1, 700))
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": np.arange(700), "x": x})).withColumn("blk", scan.block_no("i", 32))
    a = 2 / 21
    c = F.when(F.col("i") == 0, F.col("x")).otherwise(F.col("x") * a)
    got = scan.linear_scan(df, ["k"], "i", "blk", {"y": (c, 1 - a)}, 32).orderBy("i").toPandas().y
    np.testing.assert_allclose(got, x.ewm(span=20, adjust=False).mean(), rtol=1e-12)


def test_halo_frames_cross_blocks(spark):
    from pyspark.sql import Window
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": np.arange(300), "x": np.arange(300) ** 1.5}))
    h = scan.with_halo(df, "i", 45, rows=20)
    w = Window.partitionBy("k", "hblk").orderBy("i").rowsBetween(-44, 0)
    got = h.withColumn("m", F.avg("x").over(w)).where("home").orderBy("i").toPandas()
    assert len(got) == 300
    np.testing.assert_allclose(got.m, (pd.Series(np.arange(300)) ** 1.5).rolling(45, min_periods=1).mean())


@pytest.mark.parametrize("gap", [1, 5, 60, 500])
def test_greedy_chain_is_the_sequential_walk(spark, gap):
    rng = np.random.default_rng(gap)
    rows, want = [], {}
    for key, n in (("hot", 800), ("cold", 30)):
        starts = np.sort(rng.choice(np.arange(3000), n, replace=False))
        ends = starts + 1 + rng.integers(0, gap + 1, n)
        free = -1
        for s, e in zip(starts, ends):
            want[(key, int(s))] = bool(s >= free)
            free = e if s >= free else free
            rows.append((key, int(s), int(e)))
    df = spark.createDataFrame(rows, "k string, s long, r long").withColumn("blk", scan.block_no("s", 64))
    got = {(r.k, r.s): r.accepted for r in scan.greedy_chain(df, ["k"], "blk", "s", "r").collect()}
    assert got == want


def test_composed_maps_over_more_levels_than_two(spark):
    rng = np.random.default_rng(9)
    rows = [(k, i, float(a), float(b)) for k, n in (("hot", 150), ("cold", 3)) for i, (a, b) in enumerate(rng.uniform(-1, 1, (n, 2)))]
    df = spark.createDataFrame(rows, "k string, n long, a double, b double").withColumn("blk", scan.block_no("n", 4))
    affine = lambda p, q: F.struct((p["a"] * q["a"]).alias("a"), (q["a"] * p["b"] + q["b"]).alias("b"))
    out = scan.compose_scan(df, ["k"], "blk", ["n"], F.struct("a", "b"), affine, "m", 4)  # 38 blocks, 10 groups, 3 groups of groups, 1
    got = {(r.k, r.n): r.m.b for r in out.collect()}
    assert set(out.columns) == {*df.columns, "m"} and len(got) == len(rows)
    state = {}
    for k, n, a, b in rows:
        state[k] = a * state.get(k, 0.0) + b
        assert got[k, n] == pytest.approx(state[k], abs=1e-12)


def test_next_trade_and_block_come_along(spark, monkeypatch):
    """The next row's value across block edges, and blocks of an as-of join that follow one another in time."""
    from tapeworks.operators import asof, scan, stats
    rows = [("a" if k % 3 else "b", 10 * (k // 2), k, float(k % 7)) for k in range(60)]
    trades = spark.createDataFrame(rows, "key string, ts long, id long, net_bps double")
    cut = lambda d, k, o, name="blk": scan.range_blocks(d, k, o, name, blocks=5)
    monkeypatch.setattr(stats, "range_blocks", cut)
    monkeypatch.setattr(asof, "range_blocks", cut)
    got = stats.rolling_bounds(trades, ["key"], ["ts", "id"], rows=8, following={"ts": "next"}).collect()
    for key in "ab":
        own = sorted((r for r in got if r.key == key), key=lambda r: r.i)
        assert [r.i for r in own] == list(range(len(own))) and [r.next for r in own] == [r.ts for r in own[1:]] + [None]
    ask = trades.select("key", (F.col("ts") + 5).alias("now"), "id")
    hits = asof.asof_join(ask, trades.groupBy("key", "ts").agg(F.max("id").alias("last")), ["key"], "now", "ts", ["last"], block="b").collect()
    for key in "ab":
        own = sorted((r for r in hits if r.key == key), key=lambda r: r.now)
        assert [r.b for r in own] == sorted(r.b for r in own) and len({(r.now, r.b) for r in own}) == len({r.now for r in own})
        assert all(r.last == max(x[2] for x in rows if x[0] == key and x[1] <= r.now) for r in own)
    assert len({r.b for r in hits}) > 1
