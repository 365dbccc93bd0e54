"""Features against pandas, on prefixes, and with unknown data."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import features as X


def make(n=520, seed=7):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    open_ = np.concatenate([[100], close[:-1]])
    high, low = np.maximum(open_, close) * (1 + rng.random(n) * 0.004), np.minimum(open_, close) * (1 - rng.random(n) * 0.004)
    vol = rng.random(n) * 10 + 1
    buy = vol * rng.random(n)
    return pd.DataFrame({"symbol": "S", "tf": 60, "t": np.arange(n) * 3600, "i": np.arange(n), "open": open_, "high": high, "low": low, "close": close,
                         "volume": vol, "buy_vol": buy, "sell_vol": vol - buy})


def wilder(x, n):
    out = np.full(len(x), np.nan)
    out[n - 1] = np.mean(x[:n])
    for i in range(n, len(x)):
        out[i] = out[i - 1] - out[i - 1] / n + x[i] / n
    return out


def restate(d):
    c, h, lo = d.close, d.high, d.low
    r = pd.DataFrame({f"ema{n}": c.ewm(span=n, adjust=False).mean() for n in (20, 50, 200)})
    step = c.diff()
    up, dn = step.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-step.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    r["rsi"] = (100 - 100 / (1 + up / dn.replace(0, np.nan))).fillna(50)
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    r["atr"] = tr.ewm(alpha=1 / 14, adjust=False).mean()
    u, v = h.diff(), -lo.diff()
    pdm, mdm = np.where((u > v) & (u > 0), u, 0.0), np.where((v > u) & (v > 0), v, 0.0)
    w = wilder(tr.to_numpy(), 14)
    p, m = 100 * wilder(pdm, 14) / w, 100 * wilder(mdm, 14) / w
    r["adx"] = wilder(np.nan_to_num(100 * np.abs(p - m) / (p + m)), 14)
    r["atr_rank"] = (r.atr / c).rolling(200, min_periods=50).rank(pct=True)
    r["vol_z"] = (d.volume - d.volume.rolling(20, min_periods=10).mean()) / d.volume.rolling(20, min_periods=10).std(ddof=0)
    net, tot = d.buy_vol - d.sell_vol, d.buy_vol + d.sell_vol
    r["flow3"] = net.rolling(3).sum() / tot.rolling(3).sum()
    r["cvd"] = net.cumsum()
    r["prior_high20"] = h.shift().rolling(20).max()
    r["hh22"] = h.rolling(22, min_periods=1).max()
    return r


@pytest.fixture(scope="module")
def both(spark):
    d = make()
    out = X.add_technicals(spark.createDataFrame(d)).orderBy("i").toPandas()
    return d, out


def test_features_match_pandas(both):
    d, out = both
    for name, want in restate(d).items():
        np.testing.assert_allclose(out[name].astype(float), want.astype(float), rtol=1e-9, atol=1e-9, err_msg=name)


def test_hysteresis_state(both):
    _, out = both
    on, want = False, []
    for v in out.adx:
        on = True if v > 25 else False if v < 20 else on
        want.append(on)
    assert out.adx_on25.tolist() == want


def test_no_look_ahead(spark, both):
    d, out = both
    cut = 301
    part = X.add_technicals(spark.createDataFrame(d.head(cut))).orderBy("i").toPandas()
    for c in ("ema200", "rsi", "atr", "adx", "atr_rank", "vol_z", "ofi_z", "flow3", "cvd", "prior_high55"):
        np.testing.assert_allclose(part[c].astype(float), out[c].head(cut).astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_filters_fail_closed(spark):
    rows = [(1, None, None), (2, 0.5, None), (3, 0.5, 0.1), (4, -0.5, 0.1)]
    df = spark.createDataFrame(rows, "id int, ofi double, prev_ofi double")
    out = {r.id: (r.a, r.b) for r in df.select("id", X.flow_filter("ofi_pos").alias("a"), X.flow_filter("ofi_rising").alias("b")).collect()}
    assert out == {1: (False, False), 2: (True, False), 3: (True, True), 4: (False, False)}
    with pytest.raises(ValueError):
        X.flow_filter("no_such_filter")


def test_nan_never_passes(spark):
    from tapeworks.functions.core import finite, known
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(known(finite("x") > 0)).collect()] == [False, True, False]


def test_daily_value_is_known_only_after_the_day(spark):
    daily = spark.createDataFrame([("S", k * 86400, 100.0 + k) for k in range(80)], "symbol string, t long, close double")
    table = X.riskon_table(daily, 80 * 86400)
    bars = spark.createDataFrame([("S", 60, 70 * 86400 - 3600), ("S", 60, 70 * 86400 - 7200), ("S", 60, 10 * 86400)], "symbol string, tf long, t long")
    out = {r.t: (r.d1_sma50, r.d1_riskon) for r in X.attach_daily(bars, table).collect()}
    sma = lambda k: np.mean([100.0 + j for j in range(k - 49, k + 1)])
    assert out[70 * 86400 - 3600] == (sma(69), True)     # closes together with day 69
    assert out[70 * 86400 - 7200] == (sma(68), True)     # closes an hour before
    assert out[10 * 86400] == (None, None)
