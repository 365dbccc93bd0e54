"""Trades as joins against a bar-by-bar walk written for the test."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.functions.costs import Costs
from tapeworks.operators import features as X
from tapeworks.operators import labels as L
from tapeworks.operators import signals as G
from tests.test_features import make

SPECS = [G.Spec("breakout", {"lookback": 20, "stop": 0.01, "tp": 0.02}, "b"), G.Spec("breakout", {"lookback": 20, "stop": 0.02, "tp": 0.03, "entry": "limit", "limit_offset": 0.002}, "b"),
         G.Spec("meanrev", {"rsi_os": 45.0, "rsi_exit": 55.0, "stop": 0.01, "tp": 0.25}, "m"), G.Spec("momentum", {"adx_enter": 25.0, "stop": 0.02, "tp": 0.04}, "mo"),
         G.Spec("regime", {"lookback": 20, "atr_mult": 2.0, "stop": 0.03, "tp": 0.25}, "r"), G.Spec("trendhold", {"ema_slow": 100, "warm": 100}, "t"),
         G.Spec("breakout", {"lookback": 20, "stop": 0.05, "tp": 0.2, "trail_activate_atr": 1.0, "trail_atr": 1.5}, "tr")]


def walk(d, spec, entry, leave, costs):
    """One position at a time, bar by bar."""
    out, n, i = [], len(d), int(spec.get("warm", 210))
    o, h, lo, c = (d[k].to_numpy() for k in ("open", "high", "low", "close"))
    limit = spec.get("entry") == "limit"
    act, mult = float(spec.get("trail_activate_atr") or 0), float(spec.get("trail_atr") or 1)
    while i < n - 1:
        if not entry[i]:
            i += 1
            continue
        e, px = i + 1, o[i + 1]
        if limit:
            lim = c[i] * (1 - spec["limit_offset"])
            if lo[e] > lim:
                i += 1
                continue
            px = min(o[e], lim)
        stop = px * (1 - spec["stop"]) if spec.name != "trendhold" else -np.inf
        target = px * (1 + spec["tp"]) if spec.name != "trendhold" else np.inf
        peak, done = px, None
        for j in range(e, n):
            armed = act > 0 and peak - px + 1e-12 >= act * d.atr[i]
            trail = peak - mult * d.atr[i]
            if j > e and o[j] <= stop:
                done = (j, o[j], "stop_gap")
            elif lo[j] <= stop:
                done = (j, stop, "stop")
            elif armed and o[j] <= trail:
                done = (j, o[j], "trail_gap")
            elif armed and lo[j] <= trail:
                done = (j, trail, "trail")
            elif j > e and o[j] >= target:
                done = (j, o[j], "tp_gap")
            elif h[j] >= target:
                done = (j, target, "tp")
            elif leave[j] is not None and j + 1 < n:
                done = (j + 1, o[j + 1], leave[j])
            if done:
                break
            peak = max(peak, h[j])
        j, xp, why = done or (n - 1, c[n - 1], "eod_mark")
        slip, fee = 0 if limit else costs.slippage_bps / 1e4, (costs.maker_bps if limit else costs.fee_bps) / 1e4
        xslip, xfee = (0, costs.maker_bps / 1e4) if why == "tp" else (costs.slippage_bps / 1e4, costs.fee_bps / 1e4)
        out.append((i, e, j, round(px, 9), round(xp, 9), why, round(xp * (1 - xslip) * (1 - xfee) / (px * (1 + slip) * (1 + fee)) - 1, 9)))
        i = j + 1
    return out


@pytest.fixture(scope="module")
def frame(spark):
    a, b = make(700, 11), make(700, 12).assign(symbol="T")
    return X.add_technicals(spark.createDataFrame(pd.concat([a, b])))


def test_trades_match_the_walk(frame):
    costs = Costs()
    got = L.trades(frame, SPECS, costs).toPandas()
    total = 0
    for k, spec in enumerate(SPECS):
        f = frame.select("*", G.entry_mask(spec).alias("e"), G.exit_reason(spec).alias("x")).orderBy("symbol", "i").toPandas()
        for sym, d in f.groupby("symbol"):
            d = d.reset_index(drop=True)
            want = walk(d, spec, d.e.tolist(), [None if pd.isna(v) else v for v in d.x], costs)
            mine = got[(got.k == k) & (got.symbol == sym)].sort_values("s")
            have = [(r.s, r.entry_i, r.exit_i, round(r.entry_px, 9), round(r.exit_px, 9), r.reason, round(r.net, 9)) for r in mine.itertuples()]
            assert [w[:6] for w in want] == [h[:6] for h in have], (spec.label(), sym)
            np.testing.assert_allclose([w[6] for w in want], [h[6] for h in have], atol=1e-8)
            total += len(want)
    assert total > 60 and {"stop", "tp", "reverted", "trail"} <= set(got.reason)


def test_daily_filter_gates_entries_only(frame):
    spec = G.Spec("trendhold", {"ema_slow": 100, "warm": 100, "d1": True}, "t")
    unknown = frame.withColumn("d1_riskon", F.lit(None).cast("boolean"))
    assert L.candidates(unknown, [spec]).count() == 0
    on = frame.withColumn("d1_riskon", F.lit(True))
    assert L.candidates(on, [spec]).count() == L.candidates(frame, [SPECS[5]]).count() > 0
