"""Queries on signals, trade labels, walk-forward selection and studies."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.functions.core import known, rounded
from tapeworks.functions.costs import Costs
from tapeworks.operators import features as X
from tapeworks.operators import labels as L
from tapeworks.operators import signals as G
from tapeworks.operators import stats as S
from tapeworks.operators import studies as W
from tapeworks.operators.scan import block_no, previous
from tapeworks.plans.features import RISKON, RISKON_FLAG, SHIFTED, daily_on_bars
from tapeworks.plans.inputs import NOW, Inputs, TABLES
from tapeworks.plans.registry import query
from tapeworks.plans.stats import t_sql
from tapeworks.session import pin

COSTS, STRESS = Costs(), Costs(80.0, 10.0, 25.0)
GRID = G.default_grid()
DIPS = [G.Spec("meanrev", {"rsi_os": o, "rsi_exit": 55.0, "stop": 0.3, "tp": 0.5}, "dip") for o in (50.0, 47.0, 44.0)]

# ---- SQL twins of the rules --------------------------------------------------------------

TABLES["d1_60"] = ("feat_60 daily", f"""SELECT f.*, r.riskon AS d1_riskon FROM feat_60 f ASOF LEFT JOIN (
    SELECT *, {RISKON_FLAG} AS riskon FROM ({RISKON.format(now=NOW).replace("FROM daily", f"FROM {SHIFTED}")})) r
    ON r.symbol = f.symbol AND f.t + 3600 >= r.close_time""")


def d1_frame(x: Inputs, tf: int = 60):
    return pin(X.attach_daily(x.features(tf), X.riskon_table(daily_on_bars(x), NOW)))


def entry_sql(s: G.Spec) -> str:
    on = f"adx_on{int(s.get('adx_enter', 25.0))}"
    d1 = " AND coalesce(d1_riskon, false)" if s.get("d1") else ""
    flt = {None: "", "ofi_pos": " AND ofi > 0", "ofi_z_pos": " AND ofi_z > 0", "flow3_pos": " AND flow3 > 0", "ofi_rising": " AND ofi > prev_ofi"}[s.get("flt")]
    if s.name == "regime":
        rank = float(s.get("min_atr_rank", 0.0))
        calm = f" AND coalesce(atr_rank, -1) >= {rank}" if rank > 0 else ""
        body = f"{on}{calm} AND close > ema200 AND ema20 > ema50 AND close > prior_high{s.get('lookback', 20)}"
    elif s.name == "meanrev":
        body = f"rsi <= {s.get('rsi_os', 38.0)} AND close < ema{s.get('ema', 50)}"
    elif s.name == "trendhold":
        n = s.get("ema_slow", 100)
        body = f"i >= {n} AND close > ema{n} AND ema{s.get('ema_fast', 20)} > ema{n}"
    elif s.name == "breakout":
        body = f"close > prior_high{s['lookback']} AND volume > prior_vol{s['lookback']}"
    elif s.name == "momentum":
        body = f"{on} AND rsi BETWEEN {s.get('rsi_min', 35)} AND {s.get('rsi_max', 75)} AND close > ema200"
    else:
        n = s.get("ema_slow", 100)
        body = f"i >= {n} AND close < ema{n} AND ema{s.get('ema_fast', 20)} < ema{n} AND NOT d1_riskon"
    return f"coalesce({body}{flt}{d1}, false)"


def exit_sql(s: G.Spec) -> str:
    on = f"adx_on{int(s.get('adx_enter', 25.0))}"
    if s.name == "regime":
        return f"CASE WHEN close < hh22 - {s.get('atr_mult', 3.0)} * atr THEN 'chandelier' WHEN NOT {on} THEN 'regime_chop' END"
    if s.name == "meanrev":
        return f"CASE WHEN rsi >= {s.get('rsi_exit', 55.0)} OR close >= ema{s.get('ema', 50)} THEN 'reverted' END"
    if s.name == "trendhold":
        return f"CASE WHEN close < ema{s.get('ema_slow', 100)} THEN 'below_ema100' END"
    if s.name == "momentum":
        return "CASE WHEN close < ema50 THEN 'below_ema50' END"
    return "CAST(NULL AS VARCHAR)"


def net_sql(c: Costs, maker: str) -> str:
    b = f"entry_px * CASE WHEN {maker} THEN 1 ELSE 1 + {c.slippage_bps} / 1e4 END * (1 + CASE WHEN {maker} THEN {c.maker_bps} / 1e4 ELSE {c.fee_bps} / 1e4 END)"
    s = f"exit_px * CASE WHEN reason = 'tp' THEN 1 ELSE 1 - {c.slippage_bps} / 1e4 END * (1 - CASE WHEN reason = 'tp' THEN {c.maker_bps} / 1e4 ELSE {c.fee_bps} / 1e4 END)"
    return f"({s}) / ({b}) - 1"


def labels_sql(specs, feat: str, costs: Costs = COSTS) -> str:
    """All candidates with their exits, by a plain range join: tables ``lab``."""
    parts = []
    for k, s in enumerate(specs):
        lim = s.get("entry") == "limit"
        if s.name == "trendhold":
            stop, tp, frac = "NULL", "NULL", 0.25
        else:
            frac = s.get("stop", G.DEFAULT_STOP[s.name])
            stop, tp = f"entry_px * (1 - {frac})", f"entry_px * (1 + {s.get('tp', G.DEFAULT_TARGET[s.name])})"
        px = f"least(o1, close * (1 - {s.get('limit_offset', 0.001)}))" if lim else "o1"
        ok = f" AND l1 <= close * (1 - {s.get('limit_offset', 0.001)})" if lim else ""
        on = f"adx_on{int(s.get('adx_enter', 25.0))}"
        parts.append(f"""SELECT symbol, tf, {k} AS k, i AS s, i + 1 AS e, t1 AS entry_t, {px} AS entry_px, CAST({frac} AS DOUBLE) AS stop_frac, {lim} AS lim,
            CASE WHEN {on} THEN 'trend' WHEN atr_rank >= 0.7 THEN 'volatile_chop' ELSE 'chop' END AS regime, '{s.family or s.name}' AS family
            FROM f WHERE i >= {s.get('warm', 210)} AND i < n - 1{ok} AND {entry_sql(s)}""")
    stops = "CASE k " + " ".join(f"WHEN {k} THEN " + ("NULL" if s.name == "trendhold" else f"entry_px * (1 - {s.get('stop', G.DEFAULT_STOP[s.name])})") for k, s in enumerate(specs)) + " END"
    tps = "CASE k " + " ".join(f"WHEN {k} THEN " + ("NULL" if s.name == "trendhold" else f"entry_px * (1 + {s.get('tp', G.DEFAULT_TARGET[s.name])})") for k, s in enumerate(specs)) + " END"
    exits = " UNION ALL ".join(f"SELECT symbol, {k} AS k, i, {exit_sql(s)} AS why FROM f" for k, s in enumerate(specs))
    return f"""f AS MATERIALIZED (SELECT *, lead(open) OVER o AS o1, lead(low) OVER o AS l1, lead(t) OVER o AS t1, count(*) OVER (PARTITION BY symbol) AS n FROM {feat}
        WINDOW o AS (PARTITION BY symbol ORDER BY i)),
      c AS MATERIALIZED (SELECT *, {stops} AS stop, {tps} AS tp FROM ({' UNION ALL '.join(parts)})),
      x AS MATERIALIZED (SELECT symbol, k, i, why FROM ({exits}) WHERE why IS NOT NULL),
      ev AS (SELECT c.symbol, c.k, c.s, min(b.i * 10 + CASE WHEN b.i > c.e AND b.open <= c.stop THEN 0 WHEN b.low <= c.stop THEN 1 WHEN b.i > c.e AND b.open >= c.tp THEN 2 ELSE 3 END) AS code
        FROM c JOIN f b ON b.symbol = c.symbol AND b.i >= c.e AND (b.low <= c.stop OR b.high >= c.tp) GROUP BY 1, 2, 3),
      sx AS (SELECT c.symbol, c.k, c.s, min(x.i) AS xi FROM c JOIN x ON x.symbol = c.symbol AND x.k = c.k AND x.i >= c.e JOIN f ON f.symbol = x.symbol AND f.i = x.i AND f.i < f.n - 1 GROUP BY 1, 2, 3),
      j AS (SELECT c.*, ev.code, sx.xi, CASE WHEN ev.code IS NOT NULL AND (sx.xi IS NULL OR ev.code // 10 <= sx.xi) THEN 'level' WHEN sx.xi IS NOT NULL THEN 'signal' ELSE 'end' END AS how
        FROM c LEFT JOIN ev USING (symbol, k, s) LEFT JOIN sx USING (symbol, k, s)),
      lab AS MATERIALIZED (SELECT *, exit_px / entry_px - 1 AS gross, {net_sql(costs, 'lim')} AS net FROM (SELECT j.symbol, j.tf, j.k, j.s, j.family, j.regime, j.stop_frac, j.lim, j.e AS entry_i, j.entry_t, j.entry_px, b.i AS exit_i, b.t AS exit_t,
        CASE how WHEN 'end' THEN b.close WHEN 'signal' THEN b.open ELSE CASE code % 10 WHEN 0 THEN b.open WHEN 1 THEN stop WHEN 2 THEN b.open ELSE tp END END AS exit_px,
        CASE how WHEN 'end' THEN 'eod_mark' WHEN 'signal' THEN xr.why ELSE ['stop_gap', 'stop', 'tp_gap', 'tp'][code % 10 + 1] END AS reason
        FROM j JOIN f b ON b.symbol = j.symbol AND b.i = CASE how WHEN 'level' THEN code // 10 WHEN 'signal' THEN xi + 1 ELSE b.n - 1 END
        LEFT JOIN x xr ON xr.symbol = j.symbol AND xr.k = j.k AND xr.i = j.xi))"""


THIN = """th AS (SELECT symbol, k, CAST(-1 AS BIGINT) AS s, CAST(-1 AS BIGINT) AS exit_i FROM lab GROUP BY 1, 2
      UNION ALL SELECT th.symbol, th.k, n.s, n.exit_i FROM th, LATERAL (SELECT lab.s, lab.exit_i FROM lab WHERE lab.symbol = th.symbol AND lab.k = th.k AND lab.s > th.exit_i ORDER BY lab.s LIMIT 1) n),
    tr AS (SELECT lab.* FROM lab JOIN th ON th.symbol = lab.symbol AND th.k = lab.k AND th.s = lab.s)"""


def trades_sql(specs, feat, tail, costs: Costs = COSTS) -> str:
    return f"WITH RECURSIVE {labels_sql(specs, feat, costs)},\n{THIN}\n{tail}"


LABEL_OUT = """symbol, k, s, entry_i, exit_i, entry_t, exit_t, round(entry_px, 6) AS entry_px, round(exit_px, 6) AS exit_px, round(net, 6) AS net, reason, regime"""


def label_out(df):
    return df.select("symbol", "k", "s", "entry_i", "exit_i", "entry_t", "exit_t", *rounded(entry_px=("entry_px", 6), exit_px=("exit_px", 6), net=("net", 6)), "reason", "regime")


# ---- masks -------------------------------------------------------------------------------

def mask_query(key: str, spec: G.Spec, tf: int = 60):
    feat = f"d1_{tf}" if spec.get("d1") or spec.name == "short" else f"feat_{tf}"

    @query(key, f"SELECT symbol, t, {entry_sql(spec)} AS entry, {exit_sql(spec) if spec.name != 'short' else 'CASE WHEN close > ema100 THEN ' + repr('above_ema') + ' END'} AS leave FROM {feat}", feat)
    def run(x: Inputs):
        f = d1_frame(x, tf) if feat.startswith("d1") else x.features(tf)
        return f.select("symbol", "t", G.entry_mask(spec).alias("entry"), G.exit_reason(spec).alias("leave"))


mask_query("k1a_regime_masks", GRID["regime"][0].with_(flt="ofi_pos"), 60)
mask_query("k1a_regime_masks_d1", G.library()["regime"][0], 60)
mask_query("k1b_meanrev_masks", GRID["meanrev"][0], 15)
mask_query("k1c_trendhold_masks", G.Spec("trendhold", {"ema_fast": 20, "ema_slow": 100}), 60)
mask_query("k1d_breakout_masks", GRID["breakout"][0], 15)
mask_query("k1e_momentum_masks", GRID["momentum"][0], 15)
mask_query("k1k_short_masks", G.Spec("short", {"ema_fast": 20, "ema_slow": 100}), 60)


@query("k1l_d1_blocked", f"""SELECT symbol, t FROM d1_60 WHERE {entry_sql(G.Spec('trendhold', {'ema_slow': 80}))} AND NOT coalesce(d1_riskon, false)""", "d1_60")
def k1l(x: Inputs):
    """Rules that fired while the daily filter said no: candidates for later scoring."""
    raw = G.entry_mask(G.Spec("trendhold", {"ema_slow": 80}))
    return d1_frame(x).where(raw & ~known(F.col("d1_riskon"))).select("symbol", "t")


VARIANT_SQL = {"current": ("rsi BETWEEN 45 AND 68", "close < ema50"), "mean_reversion": ("rsi < 32 AND close < ema50", "rsi > 55 OR close >= ema50"),
               "mean_reversion_loose": ("rsi < 38 AND close < ema50", "rsi > 55 OR close >= ema50"), "mean_reversion_aggressive": ("rsi < 40 AND close < ema50", "rsi > 55 OR close >= ema50"),
               "mean_reversion_sentiment": ("rsi < 32 AND close < ema50 AND symbol <> 'S1'", "rsi > 55 OR close >= ema50"),
               "combined_mr_momentum": ("rsi < 32 AND close < ema50 OR rsi BETWEEN 45 AND 68 AND close > ema50", "rsi > 55 OR close < ema50"),
               "regime_trend": ("rsi BETWEEN 45 AND 68 AND close > ema200", "close < ema50"), "trend_follow": ("ema20 > ema50 AND close > ema200", "ema20 < ema50")}


@query("k1j_variants", "SELECT symbol, t, " + ", ".join(f"coalesce({e}, false) AS {n}_in, coalesce({o}, false) AS {n}_out" for n, (e, o) in VARIANT_SQL.items()) + " FROM feat_15", "feat_15")
def k1j(x: Inputs):
    """Eight comparison rule pairs; the sentiment of S1 is bearish."""
    f = x.features(15).withColumn("sentiment", F.when(F.col("symbol") == "S1", -0.3).otherwise(0.1))
    return f.select("symbol", "t", *[known(c).alias(f"{n}_{d}") for n, pair in G.comparison_variants().items() for d, c in zip(("in", "out"), pair)])


def held():
    """Every third bar is judged as of an open position."""
    return F.col("i") % 3 == 1


def decision_out(df, decision):
    d = df.select("symbol", "t", decision.alias("d"))
    return d.select("symbol", "t", "d.action", "d.score", F.round("d.stop_price", 6).alias("stop_price"), F.trim(F.regexp_extract("d.reason", "^[^(;+]*", 0)).alias("note"))


@query("k1f_momentum_decision", """SELECT symbol, t, CASE WHEN coalesce(atr, 0) <= 0 THEN 'WAIT' WHEN held AND close < ema50 THEN 'SELL' WHEN held OR NOT adx_on25 OR NOT band OR NOT above THEN 'WAIT' ELSE 'BUY' END AS action,
    CASE WHEN coalesce(atr, 0) <= 0 THEN 0 WHEN held AND close < ema50 THEN 90 WHEN held THEN 60 WHEN NOT adx_on25 THEN 15 ELSE CAST(band AS INT) * 20 + 5 * (CAST(above AS INT) + CAST(trend AS INT) + CAST(res AS INT) + CAST(busy AS INT)) END AS score,
    round(CASE WHEN atr > 0 AND NOT held AND adx_on25 AND band AND above THEN greatest(close - 1.5 * atr, 0) END, 6) AS stop_price,
    CASE WHEN coalesce(atr, 0) <= 0 THEN 'ATR unavailable' WHEN held AND close < ema50 THEN 'Price closed below slow trend EMA' WHEN held THEN 'Position remains above slow trend EMA' WHEN NOT adx_on25 THEN 'ADX sit-out: chop'
      WHEN NOT band THEN 'Filters failed: momentum' WHEN NOT above THEN 'Momentum blocked: counter-trend' ELSE 'Momentum confirmed' END AS note FROM (
    SELECT *, i % 3 = 1 AS held, rsi BETWEEN 35 AND 75 AS band, close > ema200 AS above, ema20 > ema50 AS trend, coalesce(close >= prior_high20 - atr, false) AS res,
      coalesce(volume / nullif(prior_vol20, 0) >= 1.1, false) AS busy FROM feat_15)""", "feat_15")
def k1f(x: Inputs):
    return decision_out(x.features(15), G.momentum_decision(held=held()))


@query("k1g_meanrev_decision", """SELECT symbol, t, CASE WHEN held AND back THEN 'SELL' WHEN held THEN 'WAIT' WHEN dip THEN 'BUY' ELSE 'WAIT' END AS action, CASE WHEN held AND back THEN 80 WHEN held THEN 55 WHEN dip THEN 60 ELSE 10 END AS score,
    round(CASE WHEN NOT held AND dip THEN greatest(close - 1.5 * greatest(atr, close * 1e-4), 0) END, 6) AS stop_price,
    CASE WHEN held AND back THEN 'Mean reversion complete' WHEN held THEN 'Holding reversion' WHEN dip THEN 'Oversold reversion' ELSE 'Not oversold' END AS note FROM (
    SELECT *, i % 3 = 1 AS held, coalesce(rsi >= 55 OR close >= ema50, false) AS back, coalesce(rsi <= 38 AND close < ema50, false) AS dip FROM feat_15)""", "feat_15")
def k1g(x: Inputs):
    return decision_out(x.features(15), G.meanrev_decision(held=held()))


ROT = """WITH a AS (SELECT f.symbol, f.t, f.i, f.close, f.atr, f.ema200, f.volume, l.up, l.dn FROM feat_15 f JOIN lag_15 l ON l.symbol = f.symbol AND l.i = f.i),
    b AS (SELECT *, CASE WHEN i >= 14 THEN 100 - 100 / (1 + avg(up) OVER w / CASE WHEN avg(dn) OVER w = 0 THEN 1 ELSE avg(dn) OVER w END) END AS r,
      CASE WHEN i >= 4 THEN close / first_value(close) OVER m - 1 END AS chg, CASE WHEN avg(volume) OVER m > 0 THEN volume / avg(volume) OVER m ELSE 1 END AS vr FROM a
      WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), m AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
    c AS (SELECT *, chg > 0.005 AS up_ok, r < 40 AND chg > -0.02 AS dip, close > ema200 AS above FROM b WHERE i >= 19)"""


@query("k1h_rotation_decision", f"""{ROT}, g AS (SELECT *, i % 3 = 1 AS held, CASE WHEN i % 3 = 1 THEN 1 / (1 + (i % 11 - 4) * 0.01) - 1 END AS gain, lag(r) OVER (PARTITION BY symbol ORDER BY i) AS pr FROM c)
    SELECT symbol, t, CASE WHEN held THEN CASE WHEN gain >= 0.03 OR gain <= -0.02 OR coalesce(r < 40 AND pr > 50, false) OR vr < 0.5 THEN 'SELL' ELSE 'WAIT' END WHEN (up_ok OR dip) AND above THEN 'BUY' ELSE 'WAIT' END AS action,
    CASE WHEN held THEN CASE WHEN gain >= 0.03 THEN 90 WHEN gain <= -0.02 THEN 95 WHEN coalesce(r < 40 AND pr > 50, false) THEN 70 WHEN vr < 0.5 THEN 60 ELSE 50 END
      WHEN (up_ok OR dip) AND NOT above THEN 15 WHEN up_ok THEN least(95, CAST(trunc(least(50, chg * 200) + least(20, (vr - 1) * 10) + greatest(0, 30 - abs(r - 55)) + 30) AS INT))
      WHEN dip THEN 35 ELSE 5 END AS score,
    round(CASE WHEN NOT held AND (up_ok OR dip) AND above THEN close - least(greatest(atr * 1.5, close * 0.02), close * 0.12) END, 6) AS stop_price,
    CASE WHEN held THEN CASE WHEN gain >= 0.03 THEN 'Profit target hit' WHEN gain <= -0.02 THEN 'Stop loss hit' WHEN coalesce(r < 40 AND pr > 50, false) THEN 'Momentum reversing' WHEN vr < 0.5 THEN 'Volume drying up' ELSE 'Holding' END
      WHEN (up_ok OR dip) AND NOT above THEN 'Momentum blocked: counter-trend' WHEN up_ok THEN 'Momentum' WHEN dip THEN 'Oversold' ELSE 'Waiting' END AS note FROM g WHERE i >= 20""", "feat_15 lag_15")
def k1h(x: Inputs):
    """Every third bar as of a position entered at a price around the close."""
    f = X.momentum(X.simple_rsi(X.previous_bar(x.features(15))), 60).withColumn("_b", block_no("i", 4096))
    f = previous(f, list(X.SERIES), "_b", ["i"], {"rsi_simple": "prev_rsi_simple"})
    entry = F.when(held(), F.col("close") * (1 + (F.col("i") % 11 - 4) * 0.01))
    return decision_out(f.where("i >= 20"), G.rotation_decision(entry))


# ---- labels, thinning, selection ---------------------------------------------------------

LABELLED = [DIPS[0], GRID["meanrev_mk"][2], GRID["breakout"][0], GRID["momentum"][1], GRID["regime"][8], G.Spec("trendhold", {"ema_slow": 100}, "trendhold")]


@query("k2_trade_labels", f"WITH {labels_sql(LABELLED, 'feat_15')} SELECT {LABEL_OUT} FROM lab", "feat_15")
def k2(x: Inputs):
    """Every candidate of six rule sets with its first exit."""
    f = x.features(15)
    return label_out(L.label(L.candidates(f, LABELLED), f, COSTS))


@query("k3_trades", trades_sql(LABELLED, "feat_15", f"SELECT {LABEL_OUT} FROM tr"), "feat_15")
def k3(x: Inputs):
    return label_out(L.trades(x.features(15), LABELLED, COSTS))


@query("c9_first_touch", f"""WITH c AS (SELECT symbol, i, i + 1 AS e, n AS last, close * 0.7 AS stop, close * 1.6 AS target FROM (SELECT *, max(i) OVER (PARTITION BY symbol) AS n FROM bars_15))
    SELECT c.symbol, c.i AS s, min(b.i) AS hit_i FROM c JOIN bars_15 b ON b.symbol = c.symbol AND b.i BETWEEN c.e AND c.last AND (b.low <= c.stop OR b.high >= c.target) GROUP BY 1, 2""", "bars_15")
def c9(x: Inputs):
    """First later bar that leaves a wide price band around each close."""
    b = x.indexed(15)
    end = b.groupBy(*X.SERIES).agg(F.max("i").alias("n"))
    c = b.join(end, list(X.SERIES)).select(
        *X.SERIES, F.lit(0).alias("k"), F.col("i").alias("s"), (F.col("i") + 1).alias("entry_i"), F.col("n").alias("last_i"),
        (F.col("close") * 0.7).alias("stop"), (F.col("close") * 1.6).alias("target"))
    return L.first_touch(c.where("entry_i <= last_i"), b).select("symbol", "s", F.col("hit.i").alias("hit_i"))


WF_SPECS = [*GRID["breakout"], *GRID["breakout_mk"], *DIPS]
SEG = "cast(" + " + ".join(f"(entry_i >= 210 + (n - 210) * {k} // 5)::INT" for k in range(5)) + " - 1 AS INT)"
WF_SQL = f"""nn AS (SELECT symbol, count(*) AS n FROM f GROUP BY 1), sg AS (SELECT tr.*, {SEG} AS seg FROM tr JOIN nn USING (symbol) WHERE n - 210 >= 100),
    sc AS (SELECT symbol, family, seg + 1 AS fold, k, count(*) AS c, avg(net) AS score FROM sg GROUP BY 1, 2, 3, 4),
    bs AS (SELECT symbol, family, fold, k FROM (SELECT *, row_number() OVER (PARTITION BY symbol, family, fold ORDER BY score DESC, k) AS rk FROM sc WHERE c >= 3 AND fold <= 4) WHERE rk = 1),
    ch AS (SELECT s.symbol, d.family, o.fold, coalesce(bs.k, d.k) AS k, bs.k IS NULL AS defaulted FROM (SELECT symbol FROM nn WHERE n - 210 >= 100) s
      CROSS JOIN (VALUES {{defaults}}) d(family, k) CROSS JOIN (VALUES (1), (2), (3), (4)) o(fold) LEFT JOIN bs ON bs.symbol = s.symbol AND bs.family = d.family AND bs.fold = o.fold)"""


def defaults_sql(specs) -> str:
    first = {}
    for k, s in enumerate(specs):
        first.setdefault(s.family, k)
    return ", ".join(f"('{f}', {k})" for f, k in first.items())


def wf_sql(specs, feat, tail, costs: Costs = COSTS):
    return trades_sql(specs, feat, f", {WF_SQL.format(defaults=defaults_sql(specs))}\n{tail}", costs)


@query("f5_best_spec", wf_sql(WF_SPECS, "feat_15", "SELECT symbol, family, fold, k, defaulted FROM ch"), "feat_15")
def f5(x: Inputs):
    f = x.features(15)
    t = pin(L.trades(f, WF_SPECS, COSTS))
    return W.select_specs(t, L.series_ends(f), WF_SPECS).select("symbol", "family", "fold", "k", "defaulted")


OOS_SQL = "SELECT sg.*, sg.seg AS fold FROM sg JOIN ch ON ch.symbol = sg.symbol AND ch.family = sg.family AND ch.fold = sg.seg AND ch.k = sg.k"


@query("k7_walk_forward", wf_sql(WF_SPECS, "feat_15", f"SELECT symbol, family, count(*) AS n, round(avg(net) * 1e4, 4) AS oos_bps, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) AS win FROM ({OOS_SQL}) GROUP BY 1, 2"), "feat_15")
def k7(x: Inputs):
    """Pick the best spec on one segment, score it on the next."""
    f = x.features(15)
    t = pin(L.trades(f, WF_SPECS, COSTS))
    o = W.walk_forward(t, L.series_ends(f), WF_SPECS).where("part = 'oos'")
    return o.groupBy("symbol", "family").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("net") * 1e4, 4).alias("oos_bps"),
                                             F.round(F.avg((F.col("net") > 0).cast("double")), 6).alias("win"))


@query("c12_fold_of_trade", trades_sql(LABELLED, "feat_15", f", nn AS (SELECT symbol, count(*) AS n FROM f GROUP BY 1) SELECT symbol, k, s, {SEG} AS seg FROM tr JOIN nn USING (symbol) WHERE n - 210 >= 100"), "feat_15")
def c12(x: Inputs):
    f = x.features(15)
    return W.attach_segment(L.trades(f, LABELLED, COSTS), L.series_ends(f)).select("symbol", "k", "s", "seg")


@query("e34_fold_edges", """SELECT symbol, tf, seg, 210 + (n - 210) * seg // 5 AS lo, 210 + (n - 210) * (seg + 1) // 5 AS hi FROM (
    SELECT symbol, 15 AS tf, count(*) AS n FROM bars_15 GROUP BY 1 UNION ALL SELECT symbol, 60, count(*) FROM bars_60 GROUP BY 1), (SELECT unnest([0, 1, 2, 3, 4]) AS seg) WHERE n - 210 >= 100""", "bars_15 bars_60")
def e34(x: Inputs):
    ends = L.series_ends(x.indexed(15)).unionByName(L.series_ends(x.indexed(60)))
    return W.edge_table(ends).select("symbol", F.col("tf").cast("int").alias("tf"), "seg", "lo", "hi")


@query("e35_rolling_splits", """SELECT symbol, f AS fold, f * 100 AS is_start, f * 100 + 300 AS is_end, f * 100 + 306 AS oos_start, f * 100 + 406 AS oos_end FROM (
    SELECT symbol, count(*) AS n FROM bars_60 GROUP BY 1), LATERAL (SELECT unnest(generate_series(0, (n - 406) // 100)) AS f) WHERE n >= 406""", "bars_60")
def e35(x: Inputs):
    return W.rolling_splits(L.series_ends(x.indexed(60)), 300, 100, 100, 6).drop("tf")


@query("e35_validation_folds", """SELECT symbol, f AS fold, f * z AS from_bar, 250 + f * z AS test_start, CASE WHEN f = 3 THEN n ELSE 250 + (f + 1) * z END AS test_end FROM (
    SELECT symbol, count(*) AS n, (count(*) - 250) // 4 AS z FROM bars_60 GROUP BY 1), (SELECT unnest([0, 1, 2, 3]) AS f) WHERE n - 250 > 4""", "bars_60")
def e35b(x: Inputs):
    return W.validation_folds(L.series_ends(x.indexed(60))).drop("tf")


@query("c14_spec_grid", "SELECT symbol, k, n FROM (SELECT symbol, k, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT symbol, {k} AS k FROM feat_15 WHERE i >= 210 AND {entry_sql(s)}" for k, s in enumerate(s for v in GRID.values() for s in v if s.get("entry") != "limit")) + ") GROUP BY 1, 2)", "feat_15")
def c14(x: Inputs):
    """How often each taker spec of the whole grid fires."""
    specs = [s for v in GRID.values() for s in v if s.get("entry") != "limit"]
    fired = F.filter(F.array(*[F.when(G.entry_mask(s), F.lit(k)) for k, s in enumerate(specs)]), lambda v: v.isNotNull())
    return x.features(15).where("i >= 210").select("symbol", F.explode(fired).alias("k")).groupBy("symbol", "k").agg(F.count(F.lit(1)).alias("n"))


@query("k13_report", wf_sql(WF_SPECS, "feat_15", f"""SELECT symbol, family, coalesce(regime, 'all') AS regime, count(*) AS trades, round(avg(net) * 1e4, 4) AS avg_net_bps, round(avg(gross) * 1e4, 4) AS avg_gross_bps
    FROM ({OOS_SQL}) GROUP BY GROUPING SETS ((symbol, family), (symbol, family, regime), (family))""".replace("SELECT symbol, family, coalesce", "SELECT coalesce(symbol, 'all') AS symbol, family, coalesce")), "feat_15")
def k13(x: Inputs):
    """Out-of-sample results per symbol and family, split by regime, and rolled up over symbols."""
    f = x.features(15)
    t = pin(L.trades(f, WF_SPECS, COSTS))
    o = W.walk_forward(t, L.series_ends(f), WF_SPECS).where("part = 'oos'")
    g = o.groupingSets([("symbol", "family"), ("symbol", "family", "regime"), ("family",)], "symbol", "family", "regime").agg(
        F.count(F.lit(1)).alias("trades"), F.round(F.avg("net") * 1e4, 4).alias("avg_net_bps"), F.round(F.avg("gross") * 1e4, 4).alias("avg_gross_bps"))
    return g.withColumn("symbol", F.coalesce("symbol", F.lit("all"))).withColumn("regime", F.coalesce("regime", F.lit("all")))


# ---- patterns ----------------------------------------------------------------------------

@query("e14_pivots", """SELECT symbol, t, i + 3 AS confirmed_i, high >= hw AND high > hl AS pivot_high, low <= lw AND low < ll AS pivot_low FROM (
    SELECT *, max(high) OVER w AS hw, min(low) OVER w AS lw, max(high) OVER l AS hl, min(low) OVER l AS ll, count(*) OVER w AS n FROM bars_15
    WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), l AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
    WHERE n = 7 AND (high >= hw AND high > hl OR low <= lw AND low < ll)""", "bars_15")
def e14(x: Inputs):
    from tapeworks.operators.patterns import pivots
    return pivots(x.indexed(15), 3).where("pivot_high or pivot_low").select("symbol", "t", "confirmed_i", "pivot_high", "pivot_low")


BROKE = "({px}) - level > 0 AND ({px}) - level >= a * 0.25 AND (({px}) - level) / greatest(level, 1e-12) >= 0.002"
FLIP_SQL = f"""fb AS MATERIALIZED (SELECT symbol, t, i, high, low, close, lag(close) OVER o AS pc, CASE WHEN fa > 0 THEN fa ELSE greatest(close * 0.01, 1e-8) END AS a FROM (
      SELECT *, atr + pow(13.0 / 14, 119) * coalesce(lag(high - low, 119) OVER o - lag(atr, 119) OVER o, 0) AS fa FROM feat_60 WINDOW o AS (PARTITION BY symbol ORDER BY i)) WINDOW o AS (PARTITION BY symbol ORDER BY i)),
    pv AS MATERIALIZED (SELECT symbol, i, high, low, high >= max(high) OVER w AND high > max(high) OVER l AS top, low <= min(low) OVER w AND low < min(low) OVER l AS bottom, count(*) OVER w AS n FROM fb
      WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), l AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
    hp AS MATERIALIZED (SELECT b.symbol, b.i, b.a, b.close, b.pc, p.i AS p, p.high AS level FROM fb b JOIN pv p ON p.symbol = b.symbol AND p.n = 7 AND p.top AND p.i <= b.i - 3 AND p.i >= greatest(b.i - 119, 0) + 3),
    br AS (SELECT hp.symbol, hp.i, hp.p, hp.a, hp.level, min(x.i) AS bi FROM hp JOIN fb x ON x.symbol = hp.symbol AND x.i > hp.p AND x.i <= hp.i WHERE hp.p <= hp.i - 6 AND hp.close > hp.level
      AND greatest(x.high, x.close) - level > 0 AND greatest(x.high, x.close) - level >= hp.a * 0.25 AND (greatest(x.high, x.close) - level) / greatest(level, 1e-12) >= 0.002 GROUP BY 1, 2, 3, 4, 5),
    ab AS (SELECT br.symbol, br.i, br.p, br.a, br.level, min(x.i) AS ci FROM br JOIN fb x ON x.symbol = br.symbol AND x.i >= br.bi AND x.i <= br.i AND x.close > br.level GROUP BY 1, 2, 3, 4, 5),
    fl AS (SELECT ab.symbol, ab.i, max(ab.p) AS p FROM ab JOIN fb x ON x.symbol = ab.symbol AND x.i > ab.ci AND x.i <= ab.i AND x.low <= ab.level + greatest(ab.a * 0.5, ab.level * 0.005) GROUP BY 1, 2),
    fr AS (SELECT symbol, i, max(p) AS p FROM hp WHERE pc <= level AND level < close AND {BROKE.format(px='close')} GROUP BY 1, 2),
    su AS (SELECT b.symbol, b.i, max(p.i) AS p FROM fb b JOIN pv p ON p.symbol = b.symbol AND p.n = 7 AND p.bottom AND p.i <= b.i - 3 AND p.i >= greatest(b.i - 119, 0) + 3 GROUP BY 1, 2),
    ls AS (SELECT su.symbol, su.i, max(x.close) AS top FROM su JOIN fb x ON x.symbol = su.symbol AND x.i > su.p AND x.i <= su.i GROUP BY 1, 2),
    sf AS (SELECT b.symbol, b.t, b.i >= 29 AND fl.p IS NOT NULL AS flip, b.i >= 29 AND fl.p IS NULL AND fr.p IS NOT NULL AS fresh, h.high AS level, b.a,
      coalesce(b.i >= 29 AND ls.top >= q.low AND q.low - b.close > 0 AND q.low - b.close >= b.a * 0.25 AND (q.low - b.close) / greatest(q.low, 1e-12) >= 0.002, false) AS lost_support
      FROM fb b LEFT JOIN fl ON fl.symbol = b.symbol AND fl.i = b.i LEFT JOIN fr ON fr.symbol = b.symbol AND fr.i = b.i LEFT JOIN su ON su.symbol = b.symbol AND su.i = b.i LEFT JOIN ls ON ls.symbol = b.symbol AND ls.i = b.i
      LEFT JOIN pv q ON q.symbol = b.symbol AND q.i = su.p LEFT JOIN pv h ON h.symbol = b.symbol AND h.i = coalesce(fl.p, fr.p))"""


@query("e15_sr_flip", f"""WITH {FLIP_SQL} SELECT symbol, t, flip, fresh, lost_support, round(CASE WHEN flip OR fresh THEN level END, 6) AS level,
    round(CASE WHEN flip OR fresh THEN greatest(level - a * 1.5, 0) END, 6) AS stop_price FROM sf WHERE flip OR fresh OR lost_support""", "feat_60")
def e15(x: Inputs):
    """Broken resistance that was retested and held, fresh breaks, and lost support."""
    from tapeworks.operators.patterns import sr_flip
    f = sr_flip(X.add_smooth(x.indexed(60)))
    return f.where("flip or fresh or lost_support").select("symbol", "t", "flip", "fresh", "lost_support", *rounded(level=("level", 6), stop_price=("stop_price", 6)))


BOTTOM_SQL = """WITH p AS (SELECT symbol, i, low, high FROM (SELECT *, min(low) OVER w AS lw, count(*) OVER w AS n FROM bars_60
      WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE n = 5 AND low <= lw),
    q AS (SELECT a.symbol, a.i AS i1, b.i AS i2, least(a.low, b.low) AS trough, (SELECT max(high) FROM bars_60 h WHERE h.symbol = a.symbol AND h.i > a.i AND h.i < b.i) AS neck
      FROM p a JOIN p b ON b.symbol = a.symbol AND b.i - a.i BETWEEN 4 AND 119 WHERE abs(a.low - b.low) <= 0.02 * (a.low + b.low) / 2),
    c AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY i) AS pc FROM bars_60)
    SELECT symbol, t, round(neck, 6) AS neckline, round(trough, 6) AS trough FROM (SELECT c.symbol, c.t, q.*, row_number() OVER (PARTITION BY c.symbol, c.t ORDER BY q.i2 DESC, q.i1 DESC) AS rk
      FROM c JOIN q ON q.symbol = c.symbol AND q.i2 <= c.i - 2 AND q.i1 >= greatest(c.i - 119, 0) + 2 AND c.i >= 39 AND q.neck > q.trough AND c.pc <= q.neck
        AND c.close > q.neck AND (c.close - q.neck) / q.neck >= 0.001) WHERE rk = 1"""


@query("e16_double_bottom", BOTTOM_SQL, "bars_60")
def e16(x: Inputs):
    from tapeworks.operators.patterns import double_bottom
    return double_bottom(x.indexed(60)).where("double_bottom").select("symbol", "t", *rounded(neckline=("neckline", 6), trough=("trough", 6)))


@query("k1i_pattern_entries", f"""WITH {FLIP_SQL}, db AS ({BOTTOM_SQL}),
    bf AS (SELECT symbol, t, coalesce(i >= 15 AND pole_end / greatest(pole_start, 1e-12) - 1 >= 0.03 AND (fh - fl) / greatest(close, 1e-12) <= 0.025 AND pc <= fh AND close - fh > 0 AND (close - fh) / greatest(fh, 1e-12) >= 0.001, false) AS flag FROM (
      SELECT *, lag(close) OVER o AS pc, lag(close, 7) OVER o AS pole_end, lag(close, 14) OVER o AS pole_start, max(high) OVER w AS fh, min(low) OVER w AS fl FROM bars_60
      WINDOW o AS (PARTITION BY symbol ORDER BY i), w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)))
    SELECT sf.symbol, sf.t, flip OR fresh AS sr_flip, db.t IS NOT NULL AS double_bottom, bf.flag AS bull_flag FROM sf JOIN bf ON bf.symbol = sf.symbol AND bf.t = sf.t
    LEFT JOIN db ON db.symbol = sf.symbol AND db.t = sf.t WHERE flip OR fresh OR db.t IS NOT NULL OR bf.flag""", "feat_60 bars_60")
def k1i(x: Inputs):
    """Support flip, double bottom and bull flag as entry masks side by side."""
    from tapeworks.operators.patterns import bull_flag, double_bottom, sr_flip
    f = X.add_smooth(x.indexed(60))
    a = sr_flip(f).select("symbol", "t", (F.col("flip") | F.col("fresh")).alias("sr_flip"))
    b = double_bottom(f).select("symbol", "t", "double_bottom")
    c = bull_flag(f).select("symbol", "t", F.col("flag").alias("bull_flag"))
    return a.join(b, ["symbol", "t"]).join(c, ["symbol", "t"]).where("sr_flip or double_bottom or bull_flag")


# ---- trails, shorts, replays -------------------------------------------------------------

TRAILED = G.Spec("breakout", {"lookback": 20, "stop": 0.95, "tp": 9.0, "trail_activate_atr": 0.5, "trail_atr": 0.5}, "trail")


@query("k4_trail_exits", f"""WITH f AS (SELECT *, lead(open) OVER (PARTITION BY symbol ORDER BY i) AS o1, count(*) OVER (PARTITION BY symbol) AS n FROM feat_15),
    c AS (SELECT symbol, i AS s, i + 1 AS e, o1 AS entry, atr, n FROM f WHERE i >= 210 AND i < n - 1 AND {entry_sql(TRAILED)}),
    h AS (SELECT c.*, b.i, b.open, b.low, greatest(c.entry, max(b.high) OVER (PARTITION BY c.symbol, c.s ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS peak
      FROM c JOIN f b ON b.symbol = c.symbol AND b.i BETWEEN c.e AND c.n - 1)
    SELECT symbol, s, i AS exit_i, round(CASE WHEN open <= peak - 0.5 * atr THEN open ELSE peak - 0.5 * atr END, 6) AS px, CASE WHEN open <= peak - 0.5 * atr THEN 'trail_gap' ELSE 'trail' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol, s ORDER BY i) AS rk FROM h WHERE atr > 0 AND peak - entry + 1e-12 >= 0.5 * atr AND (open <= peak - 0.5 * atr OR low <= peak - 0.5 * atr)) WHERE rk = 1""", "feat_15")
def k4(x: Inputs):
    """Where an ATR trail would have ended each breakout candidate."""
    f = x.features(15)
    c = L.candidates(f, [TRAILED]).join(L.series_ends(f), list(X.SERIES)).withColumn("last_i", F.coalesce("x.i", F.col("n") - 1))
    t = L.trail_exits(c, f)
    return t.select("symbol", "s", F.col("tr.i").alias("exit_i"), F.round("tr.px", 6).alias("px"), F.col("tr.reason").alias("reason"))


def funding(x: Inputs):
    """Hourly funding prints per symbol, made from the quote stream."""
    q = x.quotes()
    from tapeworks.functions.core import epoch_us
    return q.select("symbol", (epoch_us("ts") / 1_000_000).cast("long").alias("t"), ((F.col("event_id") % 21 - 10) * 1e-5).alias("rate"))


FUNDING_SQL = "SELECT symbol, us // 1000000 // 3600 * 3600 AS t, avg((event_id % 21 - 10) * 1e-5) AS rate FROM quotes GROUP BY 1, 2"


def bar_funding(x: Inputs, frame, tf: int = 60):
    from tapeworks.functions.core import grid
    f = funding(x).groupBy("symbol", grid("t", tf * 60).alias("t")).agg(F.avg("rate").alias("funding"))
    return frame.join(f, ["symbol", "t"], "left")


@query("c7_bar_funding", f"SELECT b.symbol, b.t, round(coalesce(r.rate, 0) * 1e4, 6) + 0 AS rate_bps FROM bars_60 b LEFT JOIN ({FUNDING_SQL}) r ON r.symbol = b.symbol AND r.t = b.t", "bars_60 quotes")
def c7(x: Inputs):
    """Mean hourly funding rate inside each bar, zero without a print."""
    f = bar_funding(x, x.bars(60))
    return f.select("symbol", "t", (F.round(F.coalesce("funding", F.lit(0.0)) * 1e4, 6) + 0.0).alias("rate_bps"))


SHORT = G.Spec("short", {"ema_fast": 20, "ema_slow": 100}, "short")


@query("k5_short_trades", f"""WITH RECURSIVE f AS MATERIALIZED (SELECT d.*, coalesce(r.rate, 0) AS rate, lead(open) OVER o AS o1, lead(d.t) OVER o AS t1, count(*) OVER (PARTITION BY d.symbol) AS n FROM d1_60 d
      LEFT JOIN ({FUNDING_SQL}) r ON r.symbol = d.symbol AND r.t = d.t WINDOW o AS (PARTITION BY d.symbol ORDER BY i)),
    c AS (SELECT symbol, i AS s, i + 1 AS e, o1 AS entry_px, o1 * (1 + 0.5 - 0.01) AS liq, n FROM f WHERE i >= 210 AND i < n - 1 AND {entry_sql(SHORT)}),
    ev AS (SELECT c.symbol, c.s, min(b.i * 10 + CASE WHEN b.i > c.e AND b.open >= c.liq THEN 0 ELSE 1 END) AS code FROM c JOIN f b ON b.symbol = c.symbol AND b.i >= c.e AND b.high >= c.liq GROUP BY 1, 2),
    x AS (SELECT c.symbol, c.s, min(b.i) AS xi FROM c JOIN f b ON b.symbol = c.symbol AND b.i >= c.e AND b.i < b.n - 1 AND b.close > b.ema100 GROUP BY 1, 2),
    j AS (SELECT c.*, code, xi, CASE WHEN code IS NOT NULL AND (xi IS NULL OR code // 10 <= xi) THEN 'l' WHEN xi IS NOT NULL THEN 's' ELSE 'e' END AS how FROM c LEFT JOIN ev USING (symbol, s) LEFT JOIN x USING (symbol, s)),
    lab AS MATERIALIZED (SELECT j.symbol, 0 AS k, j.s, j.e AS entry_i, j.entry_px, b.i AS exit_i, CASE how WHEN 'e' THEN b.close WHEN 's' THEN b.open ELSE CASE code % 10 WHEN 0 THEN b.open ELSE liq END END AS exit_px,
        CASE how WHEN 'e' THEN 'eod_mark' WHEN 's' THEN 'above_ema' ELSE CASE code % 10 WHEN 0 THEN 'liquidation_gap' ELSE 'liquidation' END END AS reason,
        (SELECT sum(g.rate) FROM f g WHERE g.symbol = j.symbol AND g.i BETWEEN j.e AND CASE how WHEN 'l' THEN code // 10 - 1 WHEN 's' THEN xi ELSE j.n - 1 END) AS fund
      FROM j JOIN f b ON b.symbol = j.symbol AND b.i = CASE how WHEN 'l' THEN code // 10 WHEN 's' THEN xi + 1 ELSE b.n - 1 END),
    {THIN} SELECT symbol, s, exit_i, round(entry_px, 6) AS entry_px, round(exit_px, 6) AS exit_px, reason, round((entry_px - exit_px) / entry_px - 0.001 + coalesce(fund, 0), 8) AS net FROM tr""", "d1_60 quotes")
def k5(x: Inputs):
    """Perpetual short at 2x on hourly bars, with funding."""
    t = W.short_trades(bar_funding(x, d1_frame(x)), SHORT, leverage=2.0)
    return t.select("symbol", "s", "exit_i", *rounded(entry_px=("entry_px", 6), exit_px=("exit_px", 6)), "reason", F.round("net", 8).alias("net"))


REPLAYED = [G.Spec("meanrev", {"rsi_os": 47.0, "rsi_exit": 55.0, "warm": 0}, "meanrev"), G.Spec("momentum", {"rsi_min": 35, "rsi_max": 75, "warm": 0}, "momentum")]


def replay_sql(specs) -> str:
    parts = " UNION ALL ".join(f"SELECT symbol, {k} AS k, i AS s, t AS entry_t, close * 1.001 AS entry_px, n FROM f WHERE i < n - 1 AND {entry_sql(s)}" for k, s in enumerate(specs))
    exits = " UNION ALL ".join(f"SELECT symbol, {k} AS k, i FROM f WHERE {exit_sql(s)} IS NOT NULL" for k, s in enumerate(specs))
    return f"""WITH RECURSIVE f AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM feat_15), c AS MATERIALIZED ({parts}), x AS MATERIALIZED ({exits}),
      lv AS (SELECT c.symbol, c.k, c.s, min(b.i) AS i FROM c JOIN f b ON b.symbol = c.symbol AND b.i > c.s AND (b.close * 0.999 <= c.entry_px * 0.96 OR b.close * 0.999 >= c.entry_px * 1.08) GROUP BY 1, 2, 3),
      sx AS (SELECT c.symbol, c.k, c.s, min(x.i) AS i FROM c JOIN x ON x.symbol = c.symbol AND x.k = c.k AND x.i > c.s GROUP BY 1, 2, 3),
      lab AS MATERIALIZED (SELECT c.symbol, c.k, c.s, c.entry_px, b.i AS exit_i, b.close * 0.999 AS exit_px FROM c LEFT JOIN lv USING (symbol, k, s) LEFT JOIN sx USING (symbol, k, s)
        JOIN f b ON b.symbol = c.symbol AND b.i = coalesce(least(lv.i, sx.i), lv.i, sx.i, c.n - 1)),
      {THIN} SELECT symbol, k, s, exit_i, round(entry_px, 6) AS entry_px, round(exit_px, 6) AS exit_px, round(exit_px / entry_px - 1 - (1 + exit_px / entry_px) * 0.004, 8) AS ret FROM tr"""


@query("k6_close_fill_replay", replay_sql(REPLAYED), "feat_15")
def k6(x: Inputs):
    """Entries and exits at closes with percent levels."""
    t = W.replay(x.features(15), REPLAYED)
    return t.select("symbol", "k", "s", "exit_i", *rounded(entry_px=("entry_px", 6), exit_px=("exit_px", 6), ret=("ret", 8)))


# Fixed values of the rolling optimisation: strategy, rsi_min, rsi_max, rsi_os, rsi_exit, atr_stop, lookback.
OPT_TABLE = (
    ("meanrev", 35, 75, 32.0, 52.0, 1.5, 20), ("meanrev", 35, 75, 35.0, 55.0, 1.5, 20), ("meanrev", 35, 75, 38.0, 55.0, 1.8, 20), ("meanrev", 35, 75, 38.0, 58.0, 1.5, 14),
    ("momentum", 35, 70, 38.0, 55.0, 1.5, 20), ("momentum", 38, 72, 38.0, 55.0, 1.8, 20), ("momentum", 32, 75, 38.0, 55.0, 1.5, 14), ("momentum", 35, 75, 38.0, 55.0, 2.0, 24),
)
OPT_PARAMS = ("rsi_min", "rsi_max", "rsi_os", "rsi_exit", "atr_stop", "lookback")
OPT_GRID = [G.Spec(name, dict(zip(OPT_PARAMS, values)), "opt") for name, *values in OPT_TABLE]


def optimised(x: Inputs):
    def featurize(parts):
        prev = X.add_state(X.add_adx(pin(X.add_smooth(parts))))
        return X.add_trailing(prev).drop("sblk")
    return W.rolling_optimisation(x.indexed(15), OPT_GRID, OPT_PARAMS, 960, 320, 320, 6, featurize)


@query("k8_rolling_optimisation")
def k8(x: Inputs):
    """Per symbol and fold: what the plateau deploys, and how that did out of sample."""
    r = optimised(x)
    oos = r["deployed"].where("part = 'oos'").select("base", "fold", "trades", *rounded(score=("score", 6), sharpe=("sharpe", 6), total_return=("total_return", 6)))
    return r["chosen"].join(oos, ["base", "fold"]).select("base", "fold", "strategy", *[F.round(p, 3).alias(p) for p in OPT_PARAMS], "trades", "score", "sharpe", "total_return")


@query("k8_deploy_report")
def k8r(x: Inputs):
    """Per symbol: the parameters most folds agree on, the out-of-sample folds, the hold-out and the verdict."""
    r = optimised(x)["report"]
    return r.select("base", "strategy", *[F.round(p, 3).alias(p) for p in OPT_PARAMS], "folds", "median_trades", *rounded(
        thin_frac=("thin_frac", 6), median_sharpe=("median_sharpe", 6), p5_sharpe=("p5_sharpe", 6), win_frac=("win_frac", 6), hold_score=("hold_score", 6)), "hold_trades", "verdict")


def scored_specs(x: Inputs):
    """Scores of the whole grid per sleeve-symbol, from the closed-trade log."""
    k = (F.col("id") % len(OPT_GRID)).cast("int")
    t = x.closed_trades().groupBy("sleeve", "symbol", k.alias("k")).agg(F.round(F.avg("net_bps"), 6).alias("score"))
    table = x.spark.createDataFrame([(i, s.name, *[float(s[p]) for p in OPT_PARAMS]) for i, s in enumerate(OPT_GRID)], "k int, strategy string, " + ", ".join(f"{p} double" for p in OPT_PARAMS))
    return t.join(F.broadcast(table), "k")


OPT_SQL = "(VALUES " + ", ".join(f"({i}, '{s.name}', " + ", ".join(f"{float(s[p])}::DOUBLE" for p in OPT_PARAMS) + ")" for i, s in enumerate(OPT_GRID)) + ") g(k, strategy, " + ", ".join(OPT_PARAMS) + ")"
SCORED_SQL = f"SELECT c.*, g.* EXCLUDE (k) FROM (SELECT sleeve, symbol, CAST(id % {len(OPT_GRID)} AS INT) AS k, round(avg(net_bps), 6) AS score FROM closed_trades GROUP BY 1, 2, 3) c JOIN {OPT_SQL} ON g.k = c.k"


@query("f6_plateau_pick", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY sleeve, symbol ORDER BY score DESC, k) AS rk FROM ({SCORED_SQL})), t AS (SELECT * FROM r WHERE rk <= 3),
    v AS (SELECT sleeve, symbol, strategy, count(*) AS c, min(rk) AS f FROM t GROUP BY 1, 2, 3), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sleeve, symbol ORDER BY c DESC, f) AS p FROM v) WHERE p = 1)
    SELECT t.sleeve, t.symbol, t.strategy, {', '.join(f'median(t.{p}) AS {p}' for p in OPT_PARAMS)} FROM t JOIN l ON l.sleeve = t.sleeve AND l.symbol = t.symbol AND l.strategy = t.strategy GROUP BY 1, 2, 3""", "closed_trades")
def f6(x: Inputs):
    return W.plateau_pick(scored_specs(x), ["sleeve", "symbol"], OPT_PARAMS)


@query("f7_consensus", f"""WITH r AS (SELECT sleeve, symbol AS s, CAST(substr(symbol, 2) AS INT) AS fold, strategy, {', '.join(OPT_PARAMS)} FROM (SELECT *, row_number() OVER (PARTITION BY sleeve, symbol ORDER BY score DESC, k) AS rk FROM ({SCORED_SQL})) WHERE rk = 1),
    n AS (SELECT sleeve, strategy, {', '.join(OPT_PARAMS)}, count(*) AS c FROM r GROUP BY ALL), m AS (SELECT n.* FROM n JOIN (SELECT sleeve, max(c) AS b FROM n GROUP BY 1) q ON q.sleeve = n.sleeve AND n.c = q.b),
    ties AS (SELECT sleeve, count(*) AS ties FROM m GROUP BY 1), v AS (SELECT sleeve, strategy, count(*) AS c, min(fold) AS f FROM r GROUP BY 1, 2), l AS (SELECT sleeve, strategy FROM (SELECT *, row_number() OVER (PARTITION BY sleeve ORDER BY c DESC, f) AS p FROM v) WHERE p = 1)
    SELECT t.sleeve, t.ties, CASE WHEN t.ties = 1 THEN o.strategy ELSE a.strategy END AS strategy, {', '.join(f'CASE WHEN t.ties = 1 THEN o.{p} ELSE a.{p} END AS {p}' for p in OPT_PARAMS)} FROM ties t
      LEFT JOIN m o ON o.sleeve = t.sleeve AND t.ties = 1 JOIN (SELECT r.sleeve, r.strategy, {', '.join(f'median({p}) AS {p}' for p in OPT_PARAMS)} FROM r JOIN l ON l.sleeve = r.sleeve AND l.strategy = r.strategy GROUP BY 1, 2) a ON a.sleeve = t.sleeve""", "closed_trades")
def f7(x: Inputs):
    """Folds are the symbols; each fold chose its best-scored set."""
    from pyspark.sql import Window
    w = Window.partitionBy("sleeve", "symbol").orderBy(F.desc("score"), "k")
    best = scored_specs(x).withColumn("rk", F.row_number().over(w)).where("rk = 1").withColumn("fold", F.substring("symbol", 2, 9).cast("int"))
    return W.consensus(best.drop("rk", "score", "symbol", "k"), ["sleeve"], OPT_PARAMS)


# ---- scoring, studies, books -------------------------------------------------------------

SCORED = [DIPS[0], DIPS[0].with_(entry="limit", limit_offset=0.001), GRID["breakout"][0]]
SCORE_NOW = 1_706_400_000


def blocked_signals(x: Inputs):
    """Every 15-minute bar is a blocked signal of one of four rules in turn; the fourth has no family."""
    b = x.indexed(15)
    k = (F.col("i") % 4).cast("int")
    return b.select(F.concat_ws("|", "symbol", "t").alias("id"), "symbol", "tf", F.when(k < 3, k).alias("k"), F.col("t").alias("t0"))


@query("k9_score_signals", f"""WITH {labels_sql([s.with_(warm=0) for s in SCORED], 'feat_15')}, g AS (SELECT symbol || '|' || t AS id, symbol, t, i, n, CASE WHEN i % 4 < 3 THEN i % 4 END AS k FROM f),
    z AS (SELECT g.*, lab.reason, lab.net, CASE WHEN {SCORE_NOW} < g.t + 1800 THEN 'open' WHEN {SCORE_NOW} - g.t > 20 * 86400 THEN 'expired' WHEN g.k IS NULL THEN 'unscorable' WHEN g.i < 60 THEN 'not_reproduced'
      WHEN lab.reason = 'eod_mark' THEN 'open' WHEN lab.reason IS NOT NULL THEN 'scored' WHEN g.i + 1 >= g.n THEN 'open' WHEN g.k = 1 THEN 'no_fill' ELSE 'not_reproduced' END AS status
      FROM g LEFT JOIN lab ON lab.symbol = g.symbol AND lab.k = g.k AND lab.s = g.i)
    SELECT id, status, round(CASE status WHEN 'scored' THEN net * 1e4 WHEN 'no_fill' THEN 0 END, 4) AS net_bps FROM z""", "feat_15")
def k9(x: Inputs):
    out = W.score_signals(blocked_signals(x), x.features(15), SCORED, SCORE_NOW, COSTS, expire_days=20)
    return out.select("id", "status", F.round("net_bps", 4).alias("net_bps"))


@query("d26_buy_and_hold", """SELECT symbol, bars, round(entry, 6) AS entry, round(exit, 6) AS exit, round(dd, 6) AS max_dd_pct, round((exit * (1 - 5 / 1e4) * (1 - 40 / 1e4) / (entry * (1 + 5 / 1e4) * (1 + 40 / 1e4)) - 1) * 1e4, 4) AS net_bps FROM (
    SELECT symbol, count(*) AS bars, min_by(open, i) AS entry, max_by(close, i) AS exit, max((peak - close) / peak) * 100 AS dd FROM (
      SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS peak FROM bars_60 WHERE i >= 210) GROUP BY 1)""", "bars_60")
def d26(x: Inputs):
    h = W.buy_and_hold(x.indexed(60), COSTS)
    return h.select("symbol", "bars", *rounded(entry=("entry", 6), exit=("exit", 6), max_dd_pct=("max_dd_pct", 6), net_bps=("net_bps", 4)))


SEARCHED = [s for v in G.library().values() for s in v]


@query("k10_family_search", wf_sql(SEARCHED, "d1_60", f""", o AS MATERIALIZED (SELECT *, net * 1e4 AS bps, least(500 * 0.01 / greatest(stop_frac, 1e-6), 500 * 0.40) * net AS pnl FROM ({OOS_SQL})),
      g AS (SELECT family, count(*) AS n, avg(bps) AS mean, avg(bps) - {t_sql('count(*)')} * stddev_samp(bps) / sqrt(count(*)) AS lower, sum(pnl) AS pnl, CASE WHEN count(*) > 2 THEN (sum(bps) - sum(bps) FILTER (rk <= 2)) / (count(*) - 2) END AS ex
        FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY bps DESC) AS rk FROM o) GROUP BY 1),
      eq AS (SELECT *, 500 * exp(sum(ln(1 + least(0.01 / greatest(stop_frac, 1e-6), 0.4) * net)) OVER (PARTITION BY family ORDER BY entry_t, symbol, s ROWS UNBOUNDED PRECEDING)) AS equity, row_number() OVER (PARTITION BY family ORDER BY entry_t, symbol, s) AS rn FROM o),
      pk AS (SELECT *, greatest(500, max(equity) OVER (PARTITION BY family ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS peak FROM eq),
      m AS (SELECT family, (max_by(equity, rn) / 500 - 1) * 100 AS ret, max((peak - equity) / peak) * 100 AS dd FROM pk GROUP BY 1),
      hd AS (SELECT avg(x * (1 - {COSTS.slippage_bps} / 1e4) * (1 - {COSTS.fee_bps} / 1e4) / (e * (1 + {COSTS.slippage_bps} / 1e4) * (1 + {COSTS.fee_bps} / 1e4)) - 1) * 1e4 AS hold FROM (
        SELECT symbol, count(*) AS c, min_by(open, i) AS e, max_by(close, i) AS x FROM f WHERE i >= 210 GROUP BY 1) WHERE c >= 2 AND e > 0 AND x > 0)
    SELECT CAST(60 AS BIGINT) AS tf, family, n AS trades, round(mean, 4) AS avg_net_bps, round(ret, 4) AS total_return_pct, round(dd, 4) AS max_dd_pct, round(mean, 4) AS mean, round(lower, 4) AS lower, round(hold, 4) AS hold_bps,
      concat_ws(',', CASE WHEN n < 30 THEN 'min_trades' END, CASE WHEN mean <= 0 THEN 'mean_positive' END, CASE WHEN NOT coalesce(lower > 0, false) THEN 'lower_bound_positive' END,
        CASE WHEN NOT coalesce(ex > 0, false) THEN 'ex_best_2_positive' END, CASE WHEN pnl < 0 THEN 'beats_cash' END) AS failed,
      n >= 30 AND mean > 0 AND coalesce(lower > 0, false) AND coalesce(ex > 0, false) AND pnl >= 0 AS passes FROM g JOIN m USING (family), hd"""), "d1_60")
def k10(x: Inputs):
    """The library on hourly and 4-hour bars, pooled over symbols; a month of 4-hour bars is too short for folds, so the SQL has the hourly ones."""
    f = d1_frame(x).unionByName(X.attach_daily(x.features(240), X.riskon_table(daily_on_bars(x), NOW)))
    s = W.family_search(pin(f), G.library(), COSTS)
    return s.select("tf", "family", "trades", *rounded(avg_net_bps=("avg_net_bps", 4), total_return_pct=("total_return_pct", 4), max_dd_pct=("max_dd_pct", 4), mean=("mean", 4), lower=("lower", 4), hold_bps=("hold_bps", 4)),
                    F.array_join("failed", ",").alias("failed"), "passes")


FLT = ["ofi_pos", "flow3_pos", "ofi_rising"]
FLT_SPECS = W.as_variants(DIPS[:2], {"none": {}, **{f: {"flt": f} for f in FLT}})
STRESS_SQL = net_sql(STRESS, "lim")


@query("k11_filter_study", wf_sql(FLT_SPECS, "feat_15", f"""SELECT a.variant, a.n, round(a.mean, 4) AS mean, round(a.ex, 4) AS ex_best2, round(a.stress, 4) AS stress_mean, c.coins AS coins_positive, b.better AS folds_better, round(w.wf, 4) AS wf_mean,
      CAST(a.n >= 30 AS INT) + CAST(coalesce(a.mean > 0 AND round(a.mean, 6) > round(z.mean, 6), false) AS INT) + CAST(b.better >= 3 AS INT) + CAST(coalesce(a.ex > 0, false) AS INT) + CAST(a.stress > 0 AS INT) + CAST(c.coins >= 2 AS INT) + CAST(coalesce(w.wf > 0, false) AS INT) AS checks_passed FROM (
      SELECT family AS variant, count(*) AS n, avg(net) * 1e4 AS mean, avg({STRESS_SQL}) * 1e4 AS stress, CASE WHEN count(*) > 2 THEN (sum(net) - sum(net) FILTER (rk <= 2)) * 1e4 / (count(*) - 2) END AS ex
      FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY net DESC) AS rk FROM sg WHERE seg >= 1 AND k % 2 = 0) GROUP BY 1) a
      JOIN (SELECT family AS variant, count(*) FILTER (round(m, 1) > 0) AS coins FROM (SELECT family, symbol, avg(net) * 1e4 AS m FROM sg WHERE seg >= 1 AND k % 2 = 0 GROUP BY 1, 2) GROUP BY 1) c USING (variant)
      JOIN (SELECT m.family AS variant, count(*) FILTER (m.m > coalesce(n.m, -1e18)) AS better FROM (SELECT family, seg, round(avg(net) * 1e4, 6) AS m FROM sg WHERE seg >= 1 AND k % 2 = 0 GROUP BY 1, 2) m
        LEFT JOIN (SELECT seg, round(avg(net) * 1e4, 6) AS m FROM sg WHERE seg >= 1 AND k = 0 GROUP BY 1) n USING (seg) GROUP BY 1) b USING (variant)
      LEFT JOIN (SELECT family AS variant, avg(net) * 1e4 AS wf FROM ({OOS_SQL}) GROUP BY 1) w USING (variant)
      CROSS JOIN (SELECT avg(net) * 1e4 AS mean FROM sg WHERE seg >= 1 AND k = 0) z"""), "feat_15")
def k11(x: Inputs):
    """Order-flow filters on mean reversion against the unfiltered rule."""
    r = W.filter_study(x.features(15), DIPS[:2], FLT, COSTS, STRESS)
    return r.select("variant", "n", *rounded(mean=("mean", 4), ex_best2=("ex_best2", 4), stress_mean=("stress_mean", 4), wf_mean=("wf_mean", 4)), "coins_positive", "folds_better", "checks_passed")


GRID_SPECS = [G.Spec("meanrev", {"rsi_os": o, "rsi_exit": e, "stop": 0.3, "tp": 0.5, "entry": "limit", "limit_offset": 0.001}, "all") for o in (46.0, 50.0) for e in (52.0, 55.0)]
GRID_BASE = f"15_{GRID_SPECS[3].label()}"
GRID_NAMES = "(VALUES " + ", ".join(f"({k}, '{s.label()}')" for k, s in enumerate(GRID_SPECS)) + ") nm(k, label)"


def both_frames(tail: str) -> str:
    """``tail`` over the walk-forward tables of the 15-minute and the hourly frame."""
    return " UNION ALL ".join(f"SELECT * FROM ({wf_sql(GRID_SPECS, f'feat_{tf}', tail)})" for tf in (15, 60))


@query("d30_grid_study", f"""WITH tr AS MATERIALIZED ({both_frames('SELECT * FROM tr')}), wf AS ({both_frames(f'SELECT tf, avg(net) * 1e4 AS wf_mean FROM ({OOS_SQL}) GROUP BY 1')}),
    n60 AS (SELECT symbol, count(*) AS n FROM bars_60 GROUP BY 1), ed AS (SELECT symbol, n, seg, 210 + (n - 210) * seg // 5 AS lo, 210 + (n - 210) * (seg + 1) // 5 AS hi FROM n60, (SELECT unnest([1, 2, 3, 4]) AS seg) WHERE n - 210 >= 100),
    et AS (SELECT ed.symbol, ed.seg, a.t AS from_t, b.t AS to_t FROM ed JOIN bars_60 a ON a.symbol = ed.symbol AND a.i = ed.lo LEFT JOIN bars_60 b ON b.symbol = ed.symbol AND b.i = ed.hi),
    o AS MATERIALIZED (SELECT tr.*, et.seg AS fold, tr.tf || '_' || nm.label AS variant, net * 1e4 AS bps, ({STRESS_SQL}) * 1e4 AS hard FROM tr JOIN {GRID_NAMES} USING (k)
      JOIN et ON et.symbol = tr.symbol AND et.from_t <= tr.entry_t AND (et.to_t IS NULL OR tr.entry_t < et.to_t)),
    fm AS (SELECT variant, fold, round(avg(bps), 6) AS m FROM o GROUP BY 1, 2),
    a AS (SELECT variant, tf, count(*) AS n, avg(bps) AS mean, quantile_cont(bps, 0.5) AS median, avg(hard) AS stress_mean, CASE WHEN count(*) > 2 THEN (sum(bps) - sum(bps) FILTER (rk <= 2)) / (count(*) - 2) END AS ex
      FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY bps DESC) AS rk FROM o) GROUP BY 1, 2),
    c AS (SELECT variant, count(*) FILTER (round(m, 1) > 0) AS coins FROM (SELECT variant, symbol, avg(bps) AS m FROM o GROUP BY 1, 2) GROUP BY 1),
    b AS (SELECT a.variant, count(*) FILTER (coalesce(x.m, 0) > coalesce(y.m, 0)) AS better FROM a CROSS JOIN (VALUES (1), (2), (3), (4)) f(fold)
      LEFT JOIN fm x ON x.variant = a.variant AND x.fold = f.fold LEFT JOIN fm y ON y.variant = '{GRID_BASE}' AND y.fold = f.fold GROUP BY 1),
    z AS (SELECT a.*, wf.wf_mean, b.better, c.coins, CAST(n >= 30 AS INT) + CAST(mean > 0 AND median > 0 AS INT) + CAST(coalesce(ex > 0, false) AS INT) + CAST(stress_mean > 0 AS INT) + CAST(better >= 3 AS INT) + CAST(coins >= 2 AS INT)
      + CAST(coalesce(wf_mean > 0, false) AS INT) AS passed FROM a JOIN b USING (variant) JOIN c USING (variant) LEFT JOIN wf ON wf.tf = a.tf)
    SELECT variant, tf, n, round(mean, 4) AS mean, round(median, 4) AS median, round(stress_mean, 4) AS stress_mean, round(wf_mean, 4) AS wf_mean, better AS folds_better, coins AS coins_positive,
      passed AS checks_passed, variant <> '{GRID_BASE}' AND passed = 7 AS promote FROM z""", "feat_15 feat_60 bars_60")
def d30(x: Inputs):
    """Mean-reversion parameter grid on two timeframes against its baseline, folds by time."""
    f = pin(x.features(15).unionByName(x.features(60)))
    r = W.grid_study(f, GRID_SPECS, GRID_BASE, COSTS, STRESS, W.time_edges(x.indexed(60)))
    return r.select("variant", "tf", "n", *rounded(mean=("mean", 4), median=("median", 4), stress_mean=("stress_mean", 4), wf_mean=("wf_mean", 4)), "folds_better", "coins_positive", "checks_passed", "promote")


HELD_TRENDS = [G.Spec("trendhold", {"ema_fast": 20, "ema_slow": n}) for n in (100, 80)]


@query("k11_daily_filter_study", wf_sql(W.as_variants(HELD_TRENDS, {"none": {"d1": False}, "d1": {"d1": True}}), "d1_60", f""", o AS (SELECT *, family AS variant FROM sg WHERE seg >= 1 AND k % 2 = 0),
      fm AS (SELECT variant, seg, round(avg(net) * 1e4, 6) AS m FROM o GROUP BY 1, 2),
      a AS (SELECT variant, count(*) AS n, avg(net) * 1e4 AS mean, sum(net) * 1e4 AS total, avg({STRESS_SQL}) * 1e4 AS stress_mean FROM o GROUP BY 1),
      b AS (SELECT v.variant, count(*) FILTER (coalesce(x.m, 0) > coalesce(y.m, 0)) AS folds_better, count(*) FILTER (coalesce(x.m, 0) < coalesce(y.m, 0)) AS folds_worse
        FROM a v CROSS JOIN (VALUES (1), (2), (3), (4)) f(seg) LEFT JOIN fm x ON x.variant = v.variant AND x.seg = f.seg LEFT JOIN fm y ON y.variant = 'none' AND y.seg = f.seg GROUP BY 1)
    SELECT a.variant, n, round(mean, 4) AS mean, round(total, 4) AS total, round(stress_mean, 4) AS stress_mean, folds_better, folds_worse,
      coalesce(a.variant = 'd1' AND round(total, 6) < (SELECT round(total, 6) FROM a WHERE variant = 'none') AND folds_worse >= 3, false) AS clearly_hurts FROM a JOIN b USING (variant)"""), "d1_60")
def k11_d1(x: Inputs):
    r = W.daily_filter_study(d1_frame(x), HELD_TRENDS, COSTS, STRESS)
    return r.select("variant", "n", *rounded(mean=("mean", 4), total=("total", 4), stress_mean=("stress_mean", 4)), "folds_better", "folds_worse", "clearly_hurts")


WIDE = G.Spec("breakout", {"lookback": 20, "stop": 0.6, "tp": 2.0})
TRAILS = ((0.5, 0.5), (1.0, 1.0), (2.0, 1.0))
OVERLAY = [G.Spec("breakout", WIDE.params, "base"), *[G.Spec("breakout", {**WIDE.params, "trail_activate_atr": a, "trail_atr": m}, f"trail_{a:g}_{m:g}") for a, m in TRAILS]]


@query("k11_trailing_study", f"""WITH RECURSIVE {labels_sql(OVERLAY, "feat_15").replace("lab AS MATERIALIZED", "lab0 AS MATERIALIZED")},
      g(k, act, dist) AS (VALUES {', '.join(f'({k}, {a}, {m})' for k, (a, m) in enumerate(TRAILS, 1))}),
      h AS (SELECT c.symbol, c.k, c.s, e.atr, g.act, g.dist, c.entry_px, b.i, b.t, b.open, b.low, greatest(c.entry_px, max(b.high) OVER (PARTITION BY c.symbol, c.k, c.s ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS peak
        FROM c JOIN g ON g.k = c.k JOIN f e ON e.symbol = c.symbol AND e.i = c.s JOIN f b ON b.symbol = c.symbol AND b.i >= c.e),
      tl AS (SELECT symbol, k, s, i, t, CASE WHEN open <= peak - dist * atr THEN open ELSE peak - dist * atr END AS px, CASE WHEN open <= peak - dist * atr THEN 'trail_gap' ELSE 'trail' END AS why
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol, k, s ORDER BY i) AS rk FROM h WHERE atr > 0 AND peak - entry_px + 1e-12 >= act * atr AND (open <= peak - dist * atr OR low <= peak - dist * atr)) WHERE rk = 1),
      l2 AS (SELECT lab0.* EXCLUDE (exit_i, exit_t, exit_px, reason, gross, net), tl.i AS ti, tl.t AS tt, tl.px, tl.why, lab0.exit_i AS xi, lab0.exit_t AS xt, lab0.exit_px AS xp, lab0.reason AS xw,
        tl.i IS NOT NULL AND (lab0.reason = 'eod_mark' OR tl.i < lab0.exit_i OR tl.i = lab0.exit_i AND lab0.reason IN ('tp', 'tp_gap')) AS wins FROM lab0 LEFT JOIN tl USING (symbol, k, s)),
      l3 AS (SELECT * EXCLUDE (ti, tt, px, why, xi, xt, xp, xw, wins), CASE WHEN wins THEN ti ELSE xi END AS exit_i, CASE WHEN wins THEN tt ELSE xt END AS exit_t, CASE WHEN wins THEN px ELSE xp END AS exit_px, CASE WHEN wins THEN why ELSE xw END AS reason FROM l2),
      lab AS MATERIALIZED (SELECT *, exit_px / entry_px - 1 AS gross, {net_sql(COSTS, 'lim')} AS net FROM l3),
    {THIN}, nn AS (SELECT symbol, count(*) AS n FROM f GROUP BY 1), sg AS (SELECT tr.*, {SEG} AS seg FROM tr JOIN nn USING (symbol) WHERE n - 210 >= 100),
      eq AS (SELECT *, 500 * exp(sum(ln(1 + least(0.01 / greatest(stop_frac, 1e-6), 0.4) * net)) OVER (PARTITION BY family ORDER BY entry_t, symbol, s ROWS UNBOUNDED PRECEDING)) AS equity,
        row_number() OVER (PARTITION BY family ORDER BY entry_t, symbol, s) AS rn FROM sg WHERE seg >= 1),
      pk AS (SELECT *, greatest(500, max(equity) OVER (PARTITION BY family ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS peak FROM eq),
      m AS (SELECT family, count(*) AS trades, avg(net) * 1e4 AS bps, (max_by(equity, rn) / 500 - 1) * 100 AS ret, max((peak - equity) / peak) * 100 AS dd FROM pk GROUP BY 1)
    SELECT m.family, m.trades, round(m.bps, 4) AS avg_net_bps, round(m.ret, 4) AS total_return_pct, round(m.dd, 4) AS max_dd_pct,
      coalesce(m.family <> 'base' AND m.trades >= 8 AND m.bps > b.bps AND m.ret > b.ret AND m.dd <= b.dd + 1, false) AS promote FROM m, (SELECT * FROM m WHERE family = 'base') b""", "feat_15")
def k11_trail(x: Inputs):
    r = W.overlay_study(x.features(15), WIDE, TRAILS, COSTS)
    return r.select("family", "trades", *rounded(avg_net_bps=("avg_net_bps", 4), total_return_pct=("total_return_pct", 4), max_dd_pct=("max_dd_pct", 4)), "promote")


BOOK = [DIPS[0]]


@query("k12_portfolio_curve", trades_sql(BOOK, "feat_15", """, q AS (SELECT symbol, entry_t, exit_t, 50 * (1 - 40 / 1e4) / (entry_px * (1 + 5 / 1e4)) AS qty, exit_px FROM tr),
    tt AS (SELECT DISTINCT t FROM f), lc AS (SELECT a.t, a.symbol, f.close FROM (SELECT tt.t, s.symbol FROM tt, (SELECT DISTINCT symbol FROM f) s) a ASOF JOIN f ON f.symbol = a.symbol AND a.t >= f.t),
    op AS (SELECT lc.t, sum(q.qty * lc.close - 50) AS v FROM lc JOIN q ON q.symbol = lc.symbol AND q.entry_t <= lc.t AND q.exit_t > lc.t GROUP BY 1),
    e AS (SELECT tt.t, 500 + coalesce((SELECT sum(qty * exit_px * (1 - 5 / 1e4) * (1 - 40 / 1e4) - 50) FROM q WHERE q.exit_t <= tt.t), 0) AS realized, coalesce(op.v, 0) AS v FROM tt LEFT JOIN op ON op.t = tt.t)
    SELECT t, round(realized + v, 5) AS equity, round(realized, 5) AS realized, round(max(realized + v) OVER (ORDER BY t), 5) AS peak FROM e"""), "feat_15")
def k12(x: Inputs):
    """The mean-reversion trades at 50 dollars each, valued at every bar; a symbol without one keeps its last close."""
    f = x.features(15)
    return W.portfolio_curve(L.trades(f, BOOK, COSTS), f, 15, 50.0, COSTS).select("t", *rounded(equity=("equity", 5), realized=("realized", 5), peak=("peak", 5)))


@query("k14_latest_scan", "SELECT symbol, rule, t, round(close, 6) AS signal_px FROM (" + " UNION ALL ".join(
    f"SELECT symbol, {n!r} AS rule, t, close FROM d1_60 WHERE {entry_sql(s)} AND (symbol, i) IN (SELECT symbol, max(i) FROM d1_60 GROUP BY 1)" for n, s in (
        ("trendhold", G.Spec("trendhold", {"ema_slow": 100})), ("meanrev", G.Spec("meanrev", {"rsi_os": 60.0})), ("short", SHORT))) + ") WHERE NOT (rule = 'meanrev' AND symbol = 'S0')", "d1_60")
def k14(x: Inputs):
    """Which registered rules fire on the newest bar and are not logged yet."""
    rules = {"trendhold": G.Spec("trendhold", {"ema_slow": 100}), "meanrev": G.Spec("meanrev", {"rsi_os": 60.0}), "short": SHORT}
    last = X.latest_rows(d1_frame(x))
    fired = F.filter(F.array(*[F.when(G.entry_mask(s), F.lit(n)) for n, s in rules.items()]), lambda v: v.isNotNull())
    now = last.select("symbol", F.explode(fired).alias("rule"), "t", F.round("close", 6).alias("signal_px"))
    logged = last.where("symbol = 'S0'").select("symbol", F.lit("meanrev").alias("rule"), "t")
    return now.join(logged, ["symbol", "rule", "t"], "left_anti")


@query("a22_study_bars", """SELECT symbol, t, src, round(close, 6) AS close, round(rsi, 6) AS rsi FROM (SELECT f.symbol, f.t, 'ticks' AS src, f.close, f.rsi FROM feat_60 f)""", "feat_60")
def a22(x: Inputs):
    """Tick-built bars where a series has any, else the OHLC cache; then features."""
    ticks = x.bars(60).select("symbol", "tf", "t", "open", "high", "low", "close", "volume", "buy_vol", "sell_vol", F.lit("ticks").alias("src"))
    cache = ticks.withColumn("close", F.col("close") * 2).withColumn("src", F.lit("ohlc")).withColumn("buy_vol", F.lit(None).cast("double")).withColumn("sell_vol", F.lit(None).cast("double"))
    have = ticks.select("symbol", "tf").distinct()
    both = pin(X.index_bars(ticks.unionByName(cache.join(have, ["symbol", "tf"], "left_anti"))))
    return X.add_smooth(both).select("symbol", "t", "src", *rounded(close=("close", 6), rsi=("rsi", 6)))


@query("d29_bootstrap", f"""WITH pool AS (SELECT sleeve, net_bps - 15 AS v, row_number() OVER (PARTITION BY sleeve ORDER BY id) - 1 AS pick, count(*) OVER (PARTITION BY sleeve) AS size FROM closed_trades),
    d AS (SELECT sleeve, sim, no, CAST('0x' || substr(md5(sim || '|' || no), 1, 12) AS BIGINT) % size AS pick FROM (SELECT DISTINCT sleeve, size FROM pool), range(400) a(sim), range(60) b(no)),
    w AS (SELECT sleeve, sim, no, v, count(*) OVER o AS n, avg(v) OVER o AS m, stddev_samp(v) OVER o AS sd FROM d JOIN pool USING (sleeve, pick) WINDOW o AS (PARTITION BY sleeve, sim ORDER BY no ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
    s AS (SELECT sleeve, sim, max(CAST(coalesce(n >= 30 AND m + {t_sql('n')} * sd / sqrt(n) < 0 AND no < 59, false) AS INT)) AS hit, avg(v) AS m FROM w GROUP BY 1, 2)
    SELECT sleeve, count(*) AS sims, round(avg(hit), 6) AS p_any_bench, round(avg(m), 4) AS mean_bps FROM s GROUP BY 1""", "closed_trades")
def d29(x: Inputs):
    """How often a bench would fire in resampled trade sequences of every sleeve."""
    pool = x.closed_trades().select("id", "sleeve", (F.col("net_bps") - 15).alias("net_bps"))
    b = W.bench_bootstrap(pool, sims=400, trades=60)
    return b.select("sleeve", "sims", *rounded(p_any_bench=("p_any_bench", 6), mean_bps=("mean_bps", 4)))
