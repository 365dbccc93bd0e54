"""Queries on bar features."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.functions.core import ratio, rounded
from tapeworks.operators import features as X
from tapeworks.plans.inputs import NOW, Inputs
from tapeworks.plans.registry import query

DAILY_NOW = 1_009_843_200  # 2002-01-01, after the last order


def pick(df, **cols):
    return df.select("symbol", "t", *rounded(**{k: (k, n) for k, n in cols.items()}))


@query("e1_previous_bar", """SELECT symbol, t, round(pc, 6) AS prev_close, round(ph, 6) AS prev_high, round(pl, 6) AS prev_low,
    round(close - pc, 6) AS step FROM lag_60""", "lag_60")
def e1(x: Inputs):
    b = X.previous_bar(x.indexed(60)).withColumn("step", F.col("close") - F.col("prev_close"))
    return pick(b, prev_close=6, prev_high=6, prev_low=6, step=6)


@query("e2_ema", """SELECT symbol, t, round(ema20, 6) AS ema20, round(ema50, 6) AS ema50, round(ema100, 6) AS ema100,
    round(ema200, 6) AS ema200 FROM feat_60""", "feat_60")
def e2(x: Inputs):
    return pick(X.add_smooth(x.indexed(60)), ema20=6, ema50=6, ema100=6, ema200=6)


@query("e3_rsi", "SELECT symbol, t, round(rsi, 6) AS rsi FROM feat_60", "feat_60")
def e3(x: Inputs):
    return pick(X.add_smooth(x.indexed(60)), rsi=6)


@query("e3b_rsi_simple", """SELECT symbol, t, round(CASE WHEN i >= 14 THEN 100 - 100 / (1 + g / CASE WHEN l = 0 THEN 1 ELSE l END) END, 6)
    AS rsi_simple FROM (SELECT symbol, t, i, avg(up) OVER w AS g, avg(dn) OVER w AS l FROM lag_60
    WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))""", "lag_60")
def e3b(x: Inputs):
    return pick(X.simple_rsi(X.previous_bar(x.indexed(60))), rsi_simple=6)


@query("e4_atr", "SELECT symbol, t, round(tr, 6) AS tr, round(atr, 6) AS atr, round(atr_pct, 6) AS atr_pct FROM feat_60", "feat_60")
def e4(x: Inputs):
    b = X.add_smooth(x.indexed(60)).withColumn("tr", X.true_range())
    return pick(b, tr=6, atr=6, atr_pct=6)


@query("e5_adx", "SELECT symbol, t, round(adx, 6) AS adx FROM feat_60", "feat_60")
def e5(x: Inputs):
    return pick(X.add_adx(X.add_smooth(x.indexed(60))), adx=6)


@query("e6_zscore", "SELECT symbol, t, round(vol_z, 6) AS vol_z, round(ofi_z, 6) AS ofi_z FROM feat_60", "feat_60")
def e6(x: Inputs):
    return pick(x.features(60), vol_z=6, ofi_z=6)


@query("e7_atr_rank", "SELECT symbol, t, round(atr_rank, 6) AS atr_rank FROM feat_60", "feat_60")
def e7(x: Inputs):
    return pick(x.features(60), atr_rank=6)


@query("e8_flow3", "SELECT symbol, t, round(flow3, 6) AS flow3 FROM feat_60", "feat_60")
def e8(x: Inputs):
    return pick(x.features(60), flow3=6)


@query("e9_cvd", "SELECT symbol, t, round(cvd, 6) AS cvd FROM feat_60", "feat_60")
def e9(x: Inputs):
    return pick(x.features(60), cvd=6)


@query("e10_prior_range", """SELECT symbol, t, round(prior_high20, 6) AS prior_high20, round(prior_vol20, 6) AS prior_vol20,
    round(volume / nullif(prior_vol20, 0), 6) AS volume_ratio, round(prior_high55, 6) AS prior_high55 FROM feat_60""", "feat_60")
def e10(x: Inputs):
    return pick(x.features(60).withColumn("volume_ratio", ratio("volume", "prior_vol20")),
                prior_high20=6, prior_vol20=6, volume_ratio=6, prior_high55=6)


@query("e11_chandelier", """SELECT symbol, t, round(hh22 - 3.0 * atr, 6) AS chandelier,
    close < hh22 - 3.0 * atr AS below FROM feat_60""", "feat_60")
def e11(x: Inputs):
    level = F.col("hh22") - 3.0 * F.col("atr")
    return x.features(60).select("symbol", "t", F.round(level, 6).alias("chandelier"), (F.col("close") < level).alias("below"))


@query("e12_hysteresis", "SELECT symbol, t, adx_on25, adx_on30 FROM feat_60", "feat_60")
def e12(x: Inputs):
    return X.add_state(X.add_adx(X.add_smooth(x.indexed(60)))).select("symbol", "t", "adx_on25", "adx_on30")


@query("e12_features_15m", """SELECT symbol, t, round(ema200, 6) AS ema200, round(rsi, 6) AS rsi, round(atr, 6) AS atr,
    round(adx, 6) AS adx, round(atr_rank, 6) AS atr_rank, round(vol_z, 6) AS vol_z, round(flow3, 6) AS flow3, adx_on25 FROM feat_15""",
       "feat_15")
def e12_15(x: Inputs):
    """The whole feature frame on 15-minute bars."""
    f = x.features(15)
    return f.select("symbol", "t", *rounded(ema200=("ema200", 6), rsi=("rsi", 6), atr=("atr", 6), adx=("adx", 6),
                                            atr_rank=("atr_rank", 6), vol_z=("vol_z", 6), flow3=("flow3", 6)), "adx_on25")


RISKON = """SELECT symbol, t + 86400 AS close_time, close, sma50, lag(sma50, 5) OVER (PARTITION BY symbol ORDER BY t) AS sma50_prev
    FROM (SELECT *, CASE WHEN count(*) OVER w = 50 THEN avg(close) OVER w END AS sma50 FROM daily
    WHERE t + 86400 <= {now} WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""
RISKON_FLAG = "CASE WHEN sma50 IS NOT NULL AND sma50_prev IS NOT NULL THEN close > sma50 AND sma50 > sma50_prev END"


@query("e13_riskon", f"""SELECT symbol, close_time, round(close, 6) AS close, round(sma50, 6) AS sma50, round(sma50_prev, 6) AS sma50_prev,
    {RISKON_FLAG} AS riskon FROM ({RISKON.format(now=DAILY_NOW)})""", "daily")
def e13(x: Inputs):
    r = X.riskon_table(x.daily(), DAILY_NOW)
    return r.select("symbol", "close_time", *rounded(close=("close", 6), sma50=("sma50", 6), sma50_prev=("sma50_prev", 6)), "riskon")


def daily_on_bars(x: Inputs):
    """Daily closes of 1995-2001 moved so that the newest falls on the end of the event month."""
    return x.daily().withColumn("t", F.col("t") + (NOW - DAILY_NOW) // 86400 * 86400 + 86400 * 153)


SHIFTED = f"(SELECT symbol, t + {(NOW - DAILY_NOW) // 86400 * 86400 + 86400 * 153} AS t, close FROM daily)"


@query("c1_asof_daily", f"""WITH r AS (SELECT *, {RISKON_FLAG} AS riskon FROM ({RISKON.format(now=NOW).replace("FROM daily", f"FROM {SHIFTED}")}))
    SELECT b.symbol, b.t, round(b.close, 6) AS close, r.riskon AS d1_riskon, round(r.sma50, 6) AS d1_sma50
    FROM bars_60 b ASOF LEFT JOIN r ON r.symbol = b.symbol AND b.t + 3600 >= r.close_time""", "bars_60 daily")
def c1(x: Inputs):
    out = X.attach_daily(x.bars(60), X.riskon_table(daily_on_bars(x), NOW))
    return out.select("symbol", "t", F.round("close", 6).alias("close"), "d1_riskon", F.round("d1_sma50", 6).alias("d1_sma50"))


@query("b4_closed_bars", f"""SELECT symbol, t, round(close, 6) AS close FROM bars_60 WHERE t + 3600 <= {NOW} - 1800""", "bars_60")
def b4(x: Inputs):
    b = x.bars(60)
    return b.where(F.col("t") + F.col("tf") * 60 <= NOW - 1_800).select("symbol", "t", F.round("close", 6).alias("close"))


@query("b5_flow_filters", """SELECT symbol, t, coalesce(ofi > 0, false) AS ofi_pos, coalesce(ofi_z > 0, false) AS ofi_z_pos,
    coalesce(flow3 > 0, false) AS flow3_pos, coalesce(ofi > prev_ofi, false) AS ofi_rising FROM feat_60""", "feat_60")
def b5(x: Inputs):
    return x.features(60).select("symbol", "t", *[X.flow_filter(n).alias(n) for n in
                                                  ("ofi_pos", "ofi_z_pos", "flow3_pos", "ofi_rising")])


REGIME = """CASE WHEN i < 59 THEN 'unknown' WHEN adx_on25 THEN 'trend' WHEN atr_rank >= 0.7 THEN 'volatile_chop' ELSE 'chop' END"""


@query("b13_regime_label", f"SELECT symbol, t, {REGIME} AS regime FROM feat_60", "feat_60")
def b13(x: Inputs):
    return x.features(60).select("symbol", "t", X.regime_label(min_bars=60).alias("regime"))


@query("e17_bull_flag", """SELECT symbol, t, coalesce(i >= 15 AND (pole_end / greatest(pole_start, 1e-12) - 1) * 1.0 >= 0.03
      AND (fh - fl) / greatest(close, 1e-12) <= 0.025 AND pc <= fh AND (close - fh) > 0
      AND (close - fh) / greatest(fh, 1e-12) >= 0.001, false) AS flag FROM (
    SELECT *, lag(close, 7) OVER o AS pole_end, lag(close, 14) OVER o AS pole_start,
      max(high) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS fh,
      min(low) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS fl FROM lag_15
    WINDOW o AS (PARTITION BY symbol ORDER BY i))""", "lag_15")
def e17(x: Inputs):
    from tapeworks.operators.patterns import bull_flag
    return bull_flag(x.indexed(15)).select("symbol", "t", "flag")


@query("e18_momentum", """SELECT symbol, t, round(CASE WHEN i >= 4 THEN close / first - 1 END, 6) AS change,
    round(CASE WHEN i >= 4 THEN CASE WHEN av > 0 THEN volume / av ELSE 1 END END, 6) AS volume_ratio FROM (
    SELECT *, first_value(close) OVER w AS first, avg(volume) OVER w AS av FROM bars_60
    WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))""", "bars_60")
def e18(x: Inputs):
    return pick(X.momentum(x.indexed(60), 60), change=6, volume_ratio=6)


@query("e23_realized_vol", """SELECT symbol, t, round(greatest(0.05, CASE WHEN i >= 29 THEN 0.4 * v10 + 0.6 * v30 WHEN i >= 9 THEN v10
    ELSE 0.05 END), 6) AS vol FROM (SELECT symbol, t, i,
      stddev_samp(r) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * sqrt(365) AS v10,
      stddev_samp(r) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) * sqrt(365) AS v30
      FROM (SELECT symbol, t, i, coalesce(close / pc - 1, 0) AS r FROM lag_60))""", "lag_60")
def e23(x: Inputs):
    b = X.previous_bar(x.indexed(60))
    b = b.withColumn("ret", F.coalesce(ratio("close", "prev_close") - 1, F.lit(0.0)))
    return pick(X.realized_vol(b), vol=6)


@query("e33_latest_snapshot", f"""SELECT symbol, tf, t, round(close, 6) AS close, round(ema200, 6) AS ema200, round(rsi, 6) AS rsi,
    round(adx, 6) AS adx, round(atr_rank, 6) AS atr_rank, {NOW} - (t + 3600) AS data_age_s FROM feat_60
    WHERE (symbol, i) IN (SELECT symbol, max(i) FROM feat_60 GROUP BY symbol)""", "feat_60")
def e33(x: Inputs):
    f = X.latest_rows(x.features(60))
    return f.select("symbol", F.col("tf").cast("int").alias("tf"), "t",
                    *rounded(close=("close", 6), ema200=("ema200", 6), rsi=("rsi", 6), adx=("adx", 6), atr_rank=("atr_rank", 6)),
                    (NOW - (F.col("t") + F.col("tf") * 60)).alias("data_age_s"))


@query("f2_last_bars", """SELECT symbol, t, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol
    ORDER BY t DESC) AS rn FROM bars_60) WHERE rn <= 50""", "bars_60")
def f2(x: Inputs):
    w = Window.partitionBy("symbol", "tf").orderBy(F.desc("t"))
    b = x.bars(60).withColumn("rn", F.row_number().over(w)).where("rn <= 50")
    return b.select("symbol", "t", F.round("close", 6).alias("close"))
