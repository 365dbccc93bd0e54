"""Pattern masks against an evaluation of every bar's own window."""
import numpy as np
import pandas as pd
import pytest

from tapeworks.operators import features as X
from tapeworks.operators import patterns as P
from tests.test_features import make


def broke(px, level, atr, a, p):
    d = px - level
    if d <= 0:
        return False
    if a <= 0 and p <= 0:
        return d / max(level, 1e-12) >= 0.001
    return (a <= 0 or (atr > 0 and d >= atr * a)) and (p <= 0 or d / max(level, 1e-12) >= p)


def flip_at(d, look=120, k=3):
    f = d.tail(look).reset_index(drop=True)
    h, lo, c, n = f.high.to_numpy(), f.low.to_numpy(), f.close.to_numpy(), len(f)
    tr = pd.concat([f.high - f.low, (f.high - f.close.shift()).abs(), (f.low - f.close.shift()).abs()], axis=1).max(axis=1)
    atr, px = tr.ewm(alpha=1 / 14, adjust=False).mean().iloc[-1], c[-1]
    tops = [i for i in range(k, n - k) if h[i] == h[i - k:i + k + 1].max() and h[i] > h[i - k:i].max()]
    for i in reversed(tops):
        if i >= n - (k + 3):
            continue
        level = h[i]
        b = next((j for j in range(i + 1, n) if broke(max(h[j], c[j]), level, atr, 0.25, 0.002)), None)
        if b is None or px <= level:
            continue
        tol = max(atr * 0.5, level * 0.005)
        if any(c[b:j].max() > level and lo[j] <= level + tol for j in range(b + 1, n)):
            return "flip", level
    for i in reversed(tops):
        if c[-2] <= h[i] < px and broke(px, h[i], atr, 0.25, 0.002):
            return "fresh", h[i]
    return None, None


@pytest.fixture(scope="module")
def smooth(spark):
    d = make(330, 5)
    return d, X.add_smooth(spark.createDataFrame(d))


def test_sr_flip(smooth):
    d, f = smooth
    got = P.sr_flip(f).orderBy("i").toPandas()
    seen = set()
    for n in range(30, len(d)):
        kind, level = flip_at(d.head(n + 1))
        r = got.iloc[n]
        assert (bool(r.flip), bool(r.fresh)) == (kind == "flip", kind == "fresh"), n
        if kind:
            assert r.level == pytest.approx(level)
            seen.add(kind)
    assert seen == {"flip", "fresh"}
    assert got.lost_support.any()


def test_double_bottom(smooth):
    d, f = smooth
    got = P.double_bottom(f).orderBy("i").toPandas()
    low, high, close = d.low.to_numpy(), d.high.to_numpy(), d.close.to_numpy()
    hits = 0
    for n in range(39, len(d)):
        a = max(0, n - 119)
        piv = [i for i in range(a + 2, n - 1) if low[i] <= low[i - 2:i + 3].min()]
        want = None
        for y in range(len(piv) - 1, 0, -1):
            for x in range(y - 1, -1, -1):
                i1, i2 = piv[x], piv[y]
                if i2 - i1 < 4 or abs(low[i1] - low[i2]) / ((low[i1] + low[i2]) / 2) > 0.02:
                    continue
                neck, trough = high[i1 + 1:i2].max(), min(low[i1], low[i2])
                if neck > trough and broke(close[n], neck, 0, 0, 0.001) and close[n - 1] <= neck:
                    want = (neck, trough)
                    break
            if want:
                break
        r = got.iloc[n]
        assert bool(r.double_bottom) == (want is not None), n
        if want:
            assert (r.neckline, r.trough) == pytest.approx(want)
            hits += 1
    assert hits > 3
