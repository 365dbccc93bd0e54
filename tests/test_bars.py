"""Bars, coverage and stitching on hand-made ticks."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import bars as B
from tapeworks.operators import coverage as C

DDL = "symbol string, trade_id long, ts timestamp_ntz, price double, qty double, side string, ord_type string"
T0 = dt.datetime(2024, 1, 1, 12, 0)


def tick(i, sec, price, qty=1.0, side="b"):
    return ("S", i, T0 + dt.timedelta(seconds=sec), price, qty, side, "l")


def epoch(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds())


def test_minute_bar_values(spark):
    t = spark.createDataFrame([tick(3, 30, 11.0, 1.0, "s"), tick(1, 10, 10.0, 2.0), tick(2, 20, 10.0, 1.0, "s"), tick(4, 70, 12.0, 1.0)], DDL)
    a, b = B.ticks_to_1m(t).orderBy("t").collect()
    assert (a.open, a.high, a.low, a.close, a.volume, a.trades) == (10.0, 11.0, 10.0, 11.0, 4.0, 3)
    assert a.vwap == pytest.approx(10.25) and a.ofi == pytest.approx(0.0) and a.buy_count == 1
    assert b.ofi == pytest.approx(1.0)


def stream(spark, skip=()):
    rows = [tick(i, -30 + 15 * i, 100 + i * 0.1, 1.0, "b" if i % 2 else "s") for i in range(1, 600) if i not in skip]
    return spark.createDataFrame(rows, DDL)


@pytest.mark.parametrize("rows", [8, 1 << 16])
def test_gaps_runs_and_verified_holes(spark, rows):
    t = stream(spark, {100, 101, 300})
    gaps = {(r.lo, r.hi) for r in C.id_gaps(t, rows).collect()}
    assert gaps == {(100, 101), (300, 300)}
    assert C.coverage_runs(t, block_rows=rows).count() == 3
    ok = spark.createDataFrame([("S", 300, 300)], "symbol string, lo long, hi long")
    runs = C.coverage_runs(t, ok, block_rows=rows).orderBy("start_us").collect()
    assert len(runs) == 2 and all(r.start_us < r.end_us for r in runs)
    # a range only counts as verified when it matches exactly
    near = spark.createDataFrame([("S", 100, 100)], "symbol string, lo long, hi long")
    assert C.coverage_runs(t, near, block_rows=rows).count() == 3


def test_heartbeat_extends_only_a_synced_newest_run(spark):
    t = stream(spark)
    last = C.store_ends(t).first()
    def end(sync, known, beat=10 ** 9):
        st = spark.createDataFrame([("S", sync, last.last_us + beat, known)], "symbol string, in_sync boolean, live_through_us long, last_trade_id long")
        return C.coverage_runs(t, None, st).first().end_us
    assert end(True, last.last_id) == last.last_us + 10 ** 9
    assert end(False, last.last_id) == last.last_us
    assert end(True, last.last_id + 1) == last.last_us
    assert end(True, last.last_id, -5) == last.last_us


def test_bars_over_a_hole_are_withheld(spark):
    full, holed = stream(spark), stream(spark, {200})
    now = epoch(T0) + 10 ** 6
    a = {r.t for r in B.resample(B.ticks_to_1m(full), C.coverage_runs(full), 15, now).collect()}
    b = {r.t for r in B.resample(B.ticks_to_1m(holed), C.coverage_runs(holed), 15, now).collect()}
    assert b < a and len(a - b) == 1
    assert min(a) == epoch(T0) + 0 and all(t % 900 == 0 for t in a)


def test_quiet_covered_bar_is_flat(spark):
    t = spark.createDataFrame([tick(1, -10, 10.0), tick(2, 30, 11.0), tick(3, 3000, 12.0)], DDL)
    out = B.resample(B.ticks_to_1m(t), C.coverage_runs(t), 15, epoch(T0) + 10 ** 6).orderBy("t").collect()
    assert [(r.close, r.volume, r.trades) for r in out] == [(11.0, 1.0, 1), (11.0, 0.0, 0), (11.0, 0.0, 0)]
    assert out[1].vwap is None and out[1].ofi is None


def test_overlay_keeps_local_bars(spark):
    ddl = "symbol string, t long, open double, close double, volume double"
    ohlc = spark.createDataFrame([("S", t, 1.0, 1.0, 1.0) for t in (900, 1800, 3600)], ddl)
    mine = spark.createDataFrame([("S", 0, 2.0, 2.0, 2.0), ("S", 1800, 2.0, 2.0, 2.0), ("S", 4500, 2.0, 2.0, 2.0)], ddl).withColumn("ofi", F.lit(0.5))
    out = {r.t: (r.src, r.close, r.ofi) for r in B.overlay(ohlc, mine).collect()}
    assert out == {900: ("ohlc", 1.0, None), 1800: ("ticks", 2.0, 0.5), 3600: ("ohlc", 1.0, None), 4500: ("ticks", 2.0, 0.5)}
