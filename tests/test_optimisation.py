"""The rolling optimisation against a loop over slices, specs and bars."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import features as X
from tapeworks.operators import signals as G
from tapeworks.operators import studies as W
from tapeworks.plans.strategies import OPT_GRID, OPT_PARAMS
from tapeworks.session import pin
from tests.test_features import make

IS, OOS, STEP, EMBARGO = 240, 80, 80, 6


def featurize(parts):
    return X.add_trailing(X.add_state(X.add_adx(pin(X.add_smooth(parts))))).drop("sblk")


def graded(d, entry, leave, share, bars):
    """One position at a time at closes; Sharpe less penalties."""
    c, rets, weights, i = d.close.to_numpy(), [], [], 0
    while i < len(c) - 1:
        if not entry[i]:
            i += 1
            continue
        px, j = c[i] * 1.001, i + 1
        while j < len(c) - 1 and not (c[j] * 0.999 <= px * 0.96 or c[j] * 0.999 >= px * 1.08 or isinstance(leave[j], str)):
            j += 1
        move = c[j] * 0.999 / px
        rets.append(move - 1 - (1 + move) * 0.004)
        weights.append(min(share[i], 1.0))
        i = j + 1
    curve = 1000 * np.cumprod(1 + np.array(weights) * np.array(rets)) if rets else np.array([1000.0])
    peak = np.maximum.accumulate(np.concatenate([[1000.0], curve]))[1:]
    sharpe = np.mean(rets) / np.std(rets) * 365 ** 0.5 if len(rets) >= 3 and np.std(rets) > 0 else 0.0
    dd = max(0.0, ((peak - curve) / peak).max())
    score = -10.0 if len(rets) < 3 else sharpe - 1.5 * dd - 0.15 * len(rets) / bars
    return len(rets), score


def plateau(rows):
    """Majority strategy of the best three, the earlier wins ties; medians of its parameters."""
    best = sorted(rows, key=lambda r: (-r[1], r[0]))[:3]
    names = [OPT_GRID[k].name for k, _ in best]
    lead = max(names, key=lambda n: (names.count(n), -names.index(n)))
    return lead, tuple(float(np.median([OPT_GRID[k][p] for k, _ in best if OPT_GRID[k].name == lead])) for p in OPT_PARAMS)


def test_rolling_optimisation(spark):
    frames = {"A": make(700, 31).assign(symbol="A"), "B": make(640, 32).assign(symbol="B")}
    r = W.rolling_optimisation(spark.createDataFrame(pd.concat(frames.values())), OPT_GRID, OPT_PARAMS, IS, OOS, STEP, EMBARGO, featurize)
    metrics = {(m.base, m.part, m.fold, m.k): (m.trades, m.score) for m in r["metrics"].collect()}
    chosen = {(c.base, c.fold): (c.strategy, tuple(c[p] for p in OPT_PARAMS)) for c in r["chosen"].collect()}
    deployed = {(d.base, d.part, d.fold): (d.trades, d.score) for d in r["deployed"].collect()}

    slices, bounds = [], {}
    for base, d in frames.items():
        hold = max(int(len(d) * 0.15), OOS)
        for fold in range((len(d) - hold - IS - EMBARGO - OOS) // STEP + 1):
            a = fold * STEP
            bounds[base, "is", fold], bounds[base, "oos", fold] = (a, a + IS), (a + IS + EMBARGO, a + IS + EMBARGO + OOS)
        bounds[base, "hold", 0] = (len(d) - hold, len(d))
    for (base, part, fold), (a, b) in bounds.items():
        slices.append(frames[base].iloc[a:b].assign(symbol=f"{base}|{part}|{fold}", i=np.arange(b - a)))
    sized = W.with_volatility(featurize(spark.createDataFrame(pd.concat(slices))))
    cols = [c.alias(f"{n}{k}") for k, s in enumerate(OPT_GRID) for n, c in (("e", G.entry_mask(s)), ("x", G.exit_reason(s)), ("w", W.position_share(F.lit(s["atr_stop"]))))]
    seen = {n: d.reset_index(drop=True) for n, d in sized.select("symbol", "i", "close", "rsi", "ema50", "ema200", "adx_on25", "atr", "vol", *cols).orderBy("symbol", "i").toPandas().groupby("symbol")}

    assert {(b, p, f) for b, p, f, _ in metrics} == set(bounds) and len(metrics) == len(bounds) * len(OPT_GRID)
    total = 0
    for base, part, fold, k in metrics:
        d = seen[f"{base}|{part}|{fold}"]
        want = graded(d, d[f"e{k}"], d[f"x{k}"], d[f"w{k}"], len(d))
        assert metrics[base, part, fold, k] == pytest.approx(want, rel=1e-9), (base, part, fold, k)
        total += want[0]
    assert total > 300 and {OPT_GRID[k]["atr_stop"] for k in range(len(OPT_GRID))} == {1.5, 1.8, 2.0}

    agreed = {}
    for base in frames:
        folds = sorted(f for b, p, f in bounds if b == base and p == "is")
        for f in folds:
            assert chosen[base, f] == plateau([(k, metrics[base, "is", f, k][1]) for k in range(len(OPT_GRID))])
        sets = [chosen[base, f] for f in folds]
        top = max(sets.count(x) for x in sets)
        lead = {x for x in sets if sets.count(x) == top}
        if len(lead) == 1:
            agreed[base] = lead.pop()
        else:
            names = [x[0] for x in sets]
            name = max(names, key=lambda n: (names.count(n), -names.index(n)))
            agreed[base] = name, tuple(float(np.median([x[1][j] for x in sets if x[0] == name])) for j in range(len(OPT_PARAMS)))
    for (base, part, fold), got in deployed.items():
        name, values = chosen[base, fold] if part == "oos" else agreed[base]
        v, d = dict(zip(OPT_PARAMS, values)), seen[f"{base}|{part}|{fold}"]
        if name == "meanrev":
            entry, out = (d.rsi <= v["rsi_os"]) & (d.close < d.ema50), (d.rsi >= v["rsi_exit"]) | (d.close >= d.ema50)
        else:
            entry, out = d.adx_on25 & d.rsi.between(v["rsi_min"], v["rsi_max"]) & (d.close > d.ema200), d.close < d.ema50
        share = spark.createDataFrame(d[["i", "close", "atr", "vol"]]).select("i", W.position_share(F.lit(v["atr_stop"])).alias("w")).orderBy("i").toPandas().w
        assert got == pytest.approx(graded(d, entry, ["signal" if x else None for x in out], share, len(d)), rel=1e-9), (base, part, fold)
    assert len(deployed) == len([1 for b in bounds if b[1] != "is"])
    report = {x.base: x for x in r["report"].collect()}
    for base, x in report.items():
        folds = [deployed[b] for b in deployed if b[0] == base and b[1] == "oos"]
        assert x.folds == len(folds) and x.median_trades == np.median([t for t, _ in folds]) and x.thin_frac == pytest.approx(np.mean([t < 5 for t, _ in folds]))
        assert (x.hold_trades, x.hold_score) == pytest.approx(deployed[base, "hold", 0])
