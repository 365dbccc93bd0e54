"""Queries on trade, decision and equity logs."""
from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.functions.core import epoch_us, ratio, rounded
from tapeworks.operators import stats as S
from tapeworks.operators.scan import block_no, previous, range_blocks, running
from tapeworks.plans.inputs import Inputs
from tapeworks.plans.registry import query

NOW_TRADES = 996_624_000  # 2001-08-01
Z = NormalDist().inv_cdf(0.9)


def t_sql(n: str) -> str:
    g = [(Z ** 3 + Z) / 4, (5 * Z ** 5 + 16 * Z ** 3 + 3 * Z) / 96, (3 * Z ** 7 + 19 * Z ** 5 + 17 * Z ** 3 - 15 * Z) / 384]
    return f"({Z!r} + {g[0]!r} / ({n} - 1) + {g[1]!r} / pow({n} - 1, 2) + {g[2]!r} / pow({n} - 1, 3))"


STATS = """count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, round(100.0 * count(*) FILTER (pnl > 0) / count(*), 6) AS win_pct,
    round(sum(pnl), 4) AS net_pnl, round(avg(net_bps), 6) AS avg_bps, round(quantile_cont(net_bps, 0.5), 6) AS median_bps,
    max(net_bps) AS best_bps, min(net_bps) AS worst_bps, max(ts) AS last_ts"""


def stats_out(df, *keys):
    return df.select(*keys, "trades", "wins", F.round("win_pct", 6).alias("win_pct"), F.round("net_pnl", 4).alias("net_pnl"),
                     F.round("avg_bps", 6).alias("avg_bps"), F.round("median_bps", 6).alias("median_bps"), "best_bps", "worst_bps", "last_ts")


@query("d6_scorecard", f"""SELECT sleeve, symbol, CASE grouping(sleeve) + grouping(symbol) WHEN 2 THEN 'all' WHEN 1 THEN 'sleeve'
      ELSE 'sleeve_symbol' END AS scope, {STATS} FROM closed_trades GROUP BY GROUPING SETS ((), (sleeve), (sleeve, symbol))
    UNION ALL SELECT NULL, NULL, 'last_24h', {STATS} FROM closed_trades WHERE ts >= {NOW_TRADES} - 86400""", "closed_trades")
def d6(x: Inputs):
    return stats_out(S.scorecard(x.closed_trades(), NOW_TRADES), "sleeve", "symbol", "scope")


def rich(x: Inputs):
    """Closed trades with fill detail taken from the row's own numbers."""
    return x.closed_trades().withColumns({
        "fees": F.col("notional") * 0.004, "entry_maker": F.col("id") % 3 == 0,
        "entry_slip_bps": F.when(F.col("id") % 5 != 0, (F.col("id") % 17).cast("double")),
        "mae_bps": -(F.col("id") % 211).cast("double"), "mfe_bps": (F.col("id") % 307).cast("double"),
        "hold_s": (F.col("id") % 90_000).cast("double"),
        "exit_reason": F.when(F.col("net_bps") > 150, "tp").when(F.col("net_bps") < -100, "stop").otherwise("reverted")})


@query("d7_fill_detail", """SELECT sleeve, count(*) AS rich_trades, round(sum(notional * 0.004), 3) AS fees,
    round(100.0 * count(*) FILTER (id % 3 = 0) / count(*), 6) AS maker_entry_pct,
    round(avg(CASE WHEN id % 5 <> 0 THEN id % 17 END), 6) AS entry_slip_bps, round(avg(-(id % 211)), 6) AS mae_bps,
    round(avg(id % 307), 6) AS mfe_bps, round(avg(id % 90000) / 3600, 6) AS hold_h,
    count(*) FILTER (net_bps > 150) AS n_tp, count(*) FILTER (net_bps < -100) AS n_stop,
    count(*) FILTER (net_bps BETWEEN -100 AND 150) AS n_reverted FROM closed_trades WHERE source = 'fill' GROUP BY 1""", "closed_trades")
def d7(x: Inputs):
    d = S.fill_detail(rich(x))
    return d.select("sleeve", "rich_trades", F.round("fees", 3).alias("fees"),
                    *rounded(**{c: (c, 6) for c in ("maker_entry_pct", "entry_slip_bps", "mae_bps", "mfe_bps", "hold_h")}),
                    *[F.coalesce(F.col("exit_reasons")[r], F.lit(0)).alias(f"n_{r}") for r in ("tp", "stop", "reverted")])


STUDY_SQL = """SELECT {k}, n, round(win, 6) AS win, round(mean, 6) AS mean, round(median, 6) AS median, round(total, 6) AS total,
    round(CASE WHEN n > 2 THEN (total - top2) / (n - 2) END, 6) AS ex_best2,
    round(CASE WHEN total > 0 AND n >= 2 THEN top2 / total END, 6) AS top2_share FROM (
    SELECT {k}, count(*) AS n, avg(CASE WHEN net_bps > 0 THEN 1.0 ELSE 0 END) AS win, avg(net_bps) AS mean,
      quantile_cont(net_bps, 0.5) AS median, sum(net_bps) AS total, sum(net_bps) FILTER (rk <= 2) AS top2 FROM (
      SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY net_bps DESC, id) AS rk FROM {t}) GROUP BY {k})"""


def study_out(df, *keys):
    return df.select(*keys, "n", *rounded(**{c: (c, 6) for c in ("win", "mean", "median", "total", "ex_best2", "top2_share")}))


@query("d9_study_stats", STUDY_SQL.format(k="sleeve, symbol", t="closed_trades"), "closed_trades")
def d9(x: Inputs):
    return study_out(S.study_stats(x.closed_trades(), ["sleeve", "symbol"]), "sleeve", "symbol")


def with_net(x: Inputs):
    return x.closed_trades().withColumn("net", F.col("net_bps") / 1e4).withColumn("gross", (F.col("net_bps") + 90) / 1e4)


EQUITY_SQL = """SELECT *, 500 * exp(sum(ln(1 + w * net)) OVER (PARTITION BY sleeve, symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) AS equity
    FROM (SELECT *, net_bps / 1e4 AS net, (net_bps + 90) / 1e4 AS gross, least(0.01 / greatest(stop_frac, 1e-6), 0.4) AS w FROM closed_trades)"""


@query("e22_equity_curve", f"""SELECT id, sleeve, symbol, round(equity, 6) AS equity, round(equity - equity / (1 + w * net), 6) AS pnl_usd
    FROM ({EQUITY_SQL.replace("PARTITION BY sleeve, symbol", "PARTITION BY sleeve, symbol, year(make_timestamp(ts * 1000000))")})""", "closed_trades")
def e22(x: Inputs):
    t = with_net(x).withColumn("year", F.year(F.timestamp_seconds("ts")))
    c = S.compound(t, ["sleeve", "symbol", "year"], ["ts", "id"])
    return c.select("id", "sleeve", "symbol", *rounded(equity=("equity", 6), pnl_usd=("pnl_usd", 6)))


@query("d10_metrics", f"""WITH e AS ({EQUITY_SQL}), p AS (SELECT *, equity - equity / (1 + w * net) AS pnl_usd,
      greatest(500, max(equity) OVER (PARTITION BY sleeve, symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) AS peak FROM e)
    SELECT sleeve, symbol, count(*) AS trades, count(*) FILTER (net > 0) AS wins, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate,
      round(avg(net) * 1e4, 6) AS avg_net_bps, round(avg(gross) * 1e4, 6) AS avg_gross_bps, round(avg(pnl_usd), 5) AS expectancy_usd,
      round((max_by(equity, ts * 1000000000 + id) / 500 - 1) * 100, 5) AS total_return_pct, round(max((peak - equity) / peak) * 100, 5) AS max_dd_pct,
      round(sum(greatest(pnl_usd, 0)) / -sum(least(pnl_usd, 0)), 5) AS profit_factor FROM p GROUP BY 1, 2""", "closed_trades")
def d10(x: Inputs):
    m = S.metrics(with_net(x), ["sleeve", "symbol"], ["ts", "id"])
    return m.select("sleeve", "symbol", "trades", "wins", *rounded(
        win_rate=("win_rate", 6), avg_net_bps=("avg_net_bps", 6), avg_gross_bps=("avg_gross_bps", 6),
        expectancy_usd=("expectancy_usd", 5), total_return_pct=("total_return_pct", 5), max_dd_pct=("max_dd_pct", 5), profit_factor=("profit_factor", 5)))


@query("d11_mean_bounds", f"""SELECT sleeve, n, round(mean, 6) AS mean, round(mean - {t_sql('n')} * sd / sqrt(n), 6) AS lower,
    round(mean + {t_sql('n')} * sd / sqrt(n), 6) AS upper FROM (SELECT sleeve, count(*) AS n, avg(net_bps) AS mean, stddev_samp(net_bps) AS sd
    FROM closed_trades GROUP BY 1)""", "closed_trades")
def d11(x: Inputs):
    b = x.closed_trades().groupBy("sleeve").agg(*[c.alias(k) for k, c in S.mean_bounds("net_bps").items()])
    return b.select("sleeve", "n", *rounded(mean=("mean", 6), lower=("lower", 6), upper=("upper", 6)))


@query("d12_promotion", f"""WITH g AS (SELECT sleeve, regime, count(*) AS n, avg(net_bps) AS mean, avg(net_bps) - {t_sql('count(*)')} * stddev_samp(net_bps) / sqrt(count(*)) AS lower,
      sum(pnl) AS pnl, sum(net_bps) AS total, sum(net_bps) FILTER (rk <= 2) AS top2 FROM (SELECT *, row_number() OVER (PARTITION BY sleeve, regime ORDER BY net_bps DESC, id) AS rk
      FROM closed_trades) GROUP BY 1, 2), c AS (SELECT *, coalesce((total - top2) / nullif(n - 2, 0) > 0, false) AS ex FROM g)
    SELECT sleeve, regime, n, round(mean, 6) AS mean, round(lower, 6) AS lower, round(pnl, 4) AS pnl,
      concat_ws(',', CASE WHEN n < 30 THEN 'min_trades' END, CASE WHEN mean <= 0 THEN 'mean_positive' END, CASE WHEN NOT coalesce(lower > 0, false) THEN 'lower_bound_positive' END,
        CASE WHEN NOT ex THEN 'ex_best_2_positive' END, CASE WHEN pnl < 0 THEN 'beats_cash' END) AS failed,
      n >= 30 AND mean > 0 AND coalesce(lower > 0, false) AND ex AND pnl >= 0 AS passes FROM c""", "closed_trades")
def d12(x: Inputs):
    p = S.promotion(x.closed_trades(), ["sleeve", "regime"])
    return p.select("sleeve", "regime", "n", *rounded(mean=("mean", 6), lower=("lower", 6), pnl=("pnl", 4)),
                    F.array_join("failed", ",").alias("failed"), "passes")


@query("d13_weighted_rollup", """SELECT sleeve, sum(n) AS n, round(sum(bps * n) / sum(n), 6) AS bps, round(sum(w) * 1.0 / sum(n), 6) AS win_rate FROM (
    SELECT sleeve, symbol, count(*) AS n, round(avg(net_bps), 4) AS bps, count(*) FILTER (net_bps > 0) AS w FROM closed_trades GROUP BY 1, 2) GROUP BY 1""", "closed_trades")
def d13(x: Inputs):
    per = x.closed_trades().groupBy("sleeve", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("net_bps"), 4).alias("bps"), F.count_if(F.col("net_bps") > 0).alias("w"))
    return per.groupBy("sleeve").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("bps") * F.col("n")) / F.sum("n"), 6).alias("bps"),
                                     F.round(F.sum("w") / F.sum("n"), 6).alias("win_rate"))


FILTER_SQL = """SELECT filter, failures, total, round(failures * 1.0 / total, 6) AS failure_rate, round(coalesce(score, 0), 6) AS avg_score_failed,
    coalesce(buys, 0) > 0.3 AS correlated_with_buy FROM (SELECT f.filter, count(*) AS total, count(*) FILTER (bad) AS failures,
    avg(score) FILTER (bad) AS score, avg(CASE WHEN action = 'BUY' THEN 1.0 ELSE 0 END) FILTER (NOT bad) AS buys FROM (
      SELECT f.filter, d.score, d.action, d.reason LIKE 'Filters failed:%' AND list_contains(string_split(replace(replace(d.reason, 'Filters failed:', ''), ' ', ''), ','), f.filter) AS bad
      FROM decisions d, (SELECT unnest(['breakout', 'momentum', 'regime', 'trend', 'volume']) AS filter) f) f GROUP BY 1)"""


@query("d14_filter_analysis", FILTER_SQL, "decisions")
def d14(x: Inputs):
    return S.filter_analysis(x.decisions()).select(
        "filter", "failures", "total", *rounded(failure_rate=("failure_rate", 6), avg_score_failed=("avg_score_failed", 6)), "correlated_with_buy")


@query("d15_signal_quality", """SELECT symbol, count(*) AS n, round(avg(score), 6) AS avg_score, round(var_samp(score), 6) AS score_variance,
    round(avg(CASE WHEN action = 'BUY' THEN 1.0 ELSE 0 END), 6) AS buy_rate, round(avg(CASE WHEN action = 'SELL' THEN 1.0 ELSE 0 END), 6) AS sell_rate,
    round(avg(CASE WHEN action = 'WAIT' THEN 1.0 ELSE 0 END), 6) AS wait_ratio FROM decisions GROUP BY 1""", "decisions")
def d15(x: Inputs):
    q = S.signal_quality(x.decisions(), ["symbol"])
    return q.select("symbol", "n", *rounded(**{c: (c, 6) for c in ("avg_score", "score_variance", "buy_rate", "sell_rate", "wait_ratio")}))


REGIME_SQL = """SELECT symbol, round(trend, 6) AS trend, round(vol, 6) AS volatility, CASE WHEN trend > 2 THEN 'bull_trend' WHEN trend < -2 THEN 'bear_trend'
    WHEN vol < 1.5 THEN 'sideways' ELSE 'range_bound' END AS regime, round(least(0.95, CASE WHEN abs(trend) > 2 THEN abs(trend) / 10
    WHEN vol < 1.5 THEN (1.5 - vol) / 1.5 ELSE vol / 5 END), 6) AS confidence FROM (
    SELECT symbol, (avg(close) FILTER (rn <= 20) / avg(close) FILTER (rn > 20) - 1) * 100 AS trend,
      stddev_samp(close) FILTER (rn <= 20) / avg(close) FILTER (rn <= 20) * 100 AS vol FROM (
      SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS rn FROM bars_60) WHERE rn <= 60 GROUP BY 1)"""


@query("d20_market_regime", REGIME_SQL, "bars_60")
def d20(x: Inputs):
    r = S.market_regime(x.bars(60))
    return r.select("symbol", *rounded(trend=("trend", 6), volatility=("volatility", 6)), "regime", F.round("confidence", 6).alias("confidence"))


SETTINGS = {"regime_ema": 200, "min_volume_ratio": 1.10, "breakout_lookback": 20, "risk_per_trade": 0.01, "cooldown_minutes": 60}


@query("d16_suggestions", f"""WITH f AS ({FILTER_SQL}), q AS (SELECT count(*) AS n, avg(CASE WHEN action = 'WAIT' THEN 1.0 ELSE 0 END) AS w FROM decisions),
    r AS ({REGIME_SQL}), one AS (SELECT r.symbol, rf, vf, bf, r.regime, r.confidence AS conf, q.n, q.w FROM r, q, (SELECT max(failures * 1.0 / total) FILTER (filter = 'regime') AS rf,
      max(failures * 1.0 / total) FILTER (filter = 'volume') AS vf, max(failures * 1.0 / total) FILTER (filter = 'breakout') AS bf FROM f))
    SELECT symbol, parameter, current_value, suggested_value, round(confidence, 6) AS confidence, fires FROM (
      SELECT symbol, 'regime_ema' AS parameter, 200.0 AS current_value, CASE WHEN conf < 0.5 THEN 200.0 ELSE 180.0 END AS suggested_value, rf AS confidence, rf > 0.3 AS fires FROM one
      UNION ALL SELECT symbol, 'min_volume_ratio', 1.1, 1.05, vf, vf > 0.6 FROM one UNION ALL SELECT symbol, 'breakout_lookback', 20, 20, bf, bf > 0.6 FROM one
      UNION ALL SELECT symbol, 'risk_per_trade', 0.01, 0.015, conf, regime IN ('bull_trend', 'sideways') AND conf > 0.6 FROM one
      UNION ALL SELECT symbol, 'cooldown_minutes', 60, 30, w, n > 5 AND w > 0.9 FROM one)""", "decisions bars_60")
def d16(x: Inputs):
    d = x.decisions()
    out = S.suggestions(S.filter_analysis(d), S.signal_quality(d), S.market_regime(x.bars(60)), SETTINGS)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("d17_decision_analytics", """SELECT a.*, b.avg_score, b.max_score, b.min_score, b.regime FROM (SELECT symbol, count(*) AS signals, count(*) FILTER (action = 'BUY') AS buy,
      count(*) FILTER (action = 'SELL') AS sell, count(*) FILTER (action = 'WAIT') AS wait, max_by(action, ts_us) AS last_action, max_by(score, ts_us) AS last_score,
      max_by(reason, ts_us) AS last_reason, max(ts_us) AS last_ts_us FROM decisions GROUP BY 1) a JOIN (
    SELECT symbol, round(avg(score), 6) AS avg_score, max(score) AS max_score, min(score) AS min_score,
      CASE WHEN sum(score) FILTER (rn <= 5) / 5.0 > 50 THEN 'bull' ELSE 'bear' END AS regime FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_us DESC) AS rn FROM decisions)
    WHERE rn <= 60 GROUP BY 1) b ON b.symbol = a.symbol""", "decisions")
def d17(x: Inputs):
    return S.decision_analytics(x.decisions()).withColumn("avg_score", F.round("avg_score", 6))


@query("d19_confirmed_stats", """SELECT sleeve, count(*) AS total, count(p) AS pnl_known, count(*) - count(p) AS pnl_unknown, count(*) FILTER (p > 0) AS wins,
    count(*) FILTER (p < 0) AS losses, round(count(*) FILTER (p > 0) * 1.0 / count(p), 6) AS win_rate, round(sum(p), 4) AS total_pnl,
    round(avg(p) FILTER (p > 0), 6) AS average_win, round(avg(p) FILTER (p < 0), 6) AS average_loss FROM (
    SELECT *, CASE WHEN source = 'fill' THEN pnl END AS p FROM closed_trades) GROUP BY 1""", "closed_trades")
def d19(x: Inputs):
    """Trades whose pnl is not known (synced ones) are counted but never averaged."""
    t = x.closed_trades().withColumn("p", F.when(F.col("source") == "fill", F.col("pnl")))
    win, loss = F.when(F.col("p") > 0, F.col("p")), F.when(F.col("p") < 0, F.col("p"))
    return t.groupBy("sleeve").agg(
        F.count(F.lit(1)).alias("total"), F.count("p").alias("pnl_known"), (F.count(F.lit(1)) - F.count("p")).alias("pnl_unknown"),
        F.count(win).alias("wins"), F.count(loss).alias("losses"), F.round(ratio(F.count(win), F.count("p")), 6).alias("win_rate"),
        F.round(F.sum("p"), 4).alias("total_pnl"), F.round(F.avg(win), 6).alias("average_win"), F.round(F.avg(loss), 6).alias("average_loss"))


@query("d21_learning_totals", """WITH p AS (SELECT symbol, regime, count(*) AS n, count(*) FILTER (pnl > 0) AS w, sum(pnl) AS p, max(ts * 1000000000 + id) AS l FROM closed_trades GROUP BY 1, 2)
    SELECT symbol, sum(n) AS trades, sum(w) AS wins, round(sum(p), 4) AS pnl, round(sum(p) / sum(n), 6) AS expectancy, max_by(regime, p) AS best_regime,
      round(sum(p) FILTER (regime = 'trend'), 4) AS trend_pnl FROM p GROUP BY 1""", "closed_trades")
def d21(x: Inputs):
    t = S.learning_totals(x.closed_trades())
    return t.select("symbol", "trades", "wins", *rounded(pnl=("pnl", 4), expectancy=("expectancy", 6)), "best_regime",
                    F.round(F.col("regime_pnl")["trend"], 4).alias("trend_pnl"))


@query("d21_best_worst", """SELECT * FROM (SELECT sleeve, symbol, round(expectancy, 6) AS expectancy, CASE WHEN up <= 5 THEN 'best' ELSE 'worst' END AS side, least(up, down) AS place FROM (
    SELECT *, row_number() OVER (ORDER BY expectancy DESC, sleeve, symbol) AS up, row_number() OVER (ORDER BY expectancy, sleeve, symbol) AS down FROM (
    SELECT sleeve, symbol, avg(pnl) AS expectancy FROM closed_trades GROUP BY 1, 2)) WHERE up <= 5 OR down <= 3)""", "closed_trades")
def d21b(x: Inputs):
    """The five best and three worst sleeve-symbols by mean pnl."""
    e = x.closed_trades().groupBy("sleeve", "symbol").agg(F.avg("pnl").alias("expectancy"))
    best = e.orderBy(F.desc("expectancy"), "sleeve", "symbol").limit(5).withColumn("side", F.lit("best"))
    worst = e.orderBy("expectancy", "sleeve", "symbol").limit(3).withColumn("side", F.lit("worst"))
    sign = F.when(F.col("side") == "best", -F.col("expectancy")).otherwise(F.col("expectancy"))
    place = F.row_number().over(Window.partitionBy("side").orderBy(sign, "sleeve", "symbol"))
    return best.unionByName(worst).select("sleeve", "symbol", F.round("expectancy", 6).alias("expectancy"), "side", place.cast("bigint").alias("place"))


@query("d22_watchlist", """SELECT *, row_number() OVER (ORDER BY abs(change_pct) DESC, symbol) = 1 AS leader FROM (SELECT symbol, round(max_by(price, trade_id), 6) AS price, round(max(price), 6) AS high_24h, round(min(price), 6) AS low_24h,
    round(sum(qty), 6) AS volume_24h, count(*) AS trades_24h, round((max_by(price, trade_id) / min_by(price, trade_id) - 1) * 100, 6) AS change_pct
    FROM ticks WHERE us >= 1706486400000000 AND us < 1706572800000000 GROUP BY 1)""", "ticks")
def d22(x: Inputs):
    w = S.watchlist(x.ticks().withColumn("us", epoch_us("ts")), 1_706_572_800_000_000)
    first = w.agg(F.min_by("symbol", F.struct(-F.abs(F.round("change_pct", 6)), "symbol")).alias("symbol")).withColumn("leader", F.lit(True))
    w = w.join(first, "symbol", "left")
    lead = F.coalesce("leader", F.lit(False))
    return w.select("symbol", *rounded(**{c: (c, 6) for c in ("price", "high_24h", "low_24h", "volume_24h", "change_pct")}), "trades_24h", lead.alias("leader"))


FOLDS_SQL = """SELECT sleeve, year(make_timestamp(ts * 1000000)) AS fold, count(*) AS n_trades, CASE WHEN count(*) >= 3 AND stddev_pop(net_bps) > 0 THEN avg(net_bps) / stddev_pop(net_bps) * sqrt(365) ELSE 0 END AS sharpe,
    sum(net_bps) / 1e4 AS total_return, CASE WHEN sum(least(pnl, 0)) < 0 THEN sum(greatest(pnl, 0)) / -sum(least(pnl, 0)) END AS profit_factor FROM closed_trades GROUP BY 1, 2"""


def year_of_trade(x: Inputs):
    return x.closed_trades().withColumn("fold", F.year(F.timestamp_seconds("ts")))


def yearly_folds(x: Inputs):
    t = year_of_trade(x)
    gain, loss = F.sum(F.greatest("pnl", F.lit(0.0))), -F.sum(F.least("pnl", F.lit(0.0)))
    return t.groupBy("sleeve", "fold").agg(F.count(F.lit(1)).alias("n_trades"), S.sharpe("net_bps", 365).alias("sharpe"),
                                           (F.sum("net_bps") / 1e4).alias("total_return"), F.when(loss > 0, gain / loss).otherwise(float("inf")).alias("profit_factor"))


@query("d23_sharpe", f"SELECT sleeve, fold, n_trades, round(sharpe, 6) AS sharpe FROM ({FOLDS_SQL})", "closed_trades")
def d23(x: Inputs):
    return yearly_folds(x).select("sleeve", F.col("fold").cast("bigint").alias("fold"), "n_trades", F.round("sharpe", 6).alias("sharpe"))


@query("d24_fold_summary", f"""SELECT sleeve, folds, median_trades, round(thin_frac, 6) AS thin_frac, round(median_sharpe, 6) AS median_sharpe, round(p5_sharpe, 6) AS p5_sharpe, round(win_frac, 6) AS win_frac,
    CASE WHEN thin_frac > 0.5 THEN 'FOLDS_TOO_THIN' WHEN median_sharpe > 0.4 AND p5_sharpe > -0.3 AND win_frac >= 0.5 THEN 'PAPER_DEPLOY' WHEN median_sharpe > 0 THEN 'WATCH_ONLY' ELSE 'DO_NOT_DEPLOY' END AS verdict
    FROM (SELECT sleeve, count(*) AS folds, quantile_cont(n_trades, 0.5) AS median_trades, avg(CASE WHEN n_trades < 5 THEN 1.0 ELSE 0 END) AS thin_frac, quantile_cont(sharpe, 0.5) AS median_sharpe,
      quantile_cont(sharpe, 0.05) AS p5_sharpe, avg(CASE WHEN total_return > 0 THEN 1.0 ELSE 0 END) AS win_frac FROM ({FOLDS_SQL}) GROUP BY 1)""", "closed_trades")
def d24(x: Inputs):
    s = S.fold_summary(yearly_folds(x), ["sleeve"])
    return s.select("sleeve", "folds", "median_trades", *rounded(**{c: (c, 6) for c in ("thin_frac", "median_sharpe", "p5_sharpe", "win_frac")}),
                    S.verdict(F.lit(10), F.lit(0.0)).alias("verdict"))


@query("d25_readiness", f"""SELECT sleeve, folds, total_trades, profitable, round(worst_dd, 6) AS worst_dd, round(pf, 6) AS avg_profit_factor,
    total_trades >= 30 AND profitable > folds / 2.0 AND worst_dd <= 0.10 AND pf >= 1.10 AS live_ready FROM (
    SELECT sleeve, count(*) AS folds, CAST(sum(n_trades) AS BIGINT) AS total_trades, count(*) FILTER (total_return > 0) AS profitable, max(dd) AS worst_dd,
      coalesce(avg(profit_factor), 0) AS pf FROM ({FOLDS_SQL}) JOIN (SELECT sleeve, fold, max((peak - equity) / peak) AS dd FROM (SELECT sleeve, fold, equity, greatest(500, max(equity) OVER w) AS peak FROM (
        SELECT sleeve, ts, id, year(make_timestamp(ts * 1000000)) AS fold, 500 * exp(sum(ln(1 + least(0.01 / greatest(stop_frac, 1e-6), 0.4) * net_bps / 1e4)) OVER (PARTITION BY sleeve, year(make_timestamp(ts * 1000000)) ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) AS equity FROM closed_trades)
        WINDOW w AS (PARTITION BY sleeve, fold ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2) USING (sleeve, fold) GROUP BY 1)""", "closed_trades")
def d25(x: Inputs):
    """Yearly folds, each with the drawdown of its own equity curve."""
    curve = S.metrics(year_of_trade(x).withColumns({"net": F.col("net_bps") / 1e4, "gross": F.col("net_bps") / 1e4}), ["sleeve", "fold"], ["ts", "id"])
    dd = curve.select("sleeve", "fold", (F.col("max_dd_pct") / 100).alias("max_dd"))
    r = S.readiness(yearly_folds(x).join(dd, ["sleeve", "fold"]), ["sleeve"])
    return r.select("sleeve", "folds", "total_trades", "profitable", *rounded(worst_dd=("worst_dd", 6), avg_profit_factor=("avg_profit_factor", 6)), "live_ready")


@query("d27_last_quarter", """SELECT sleeve, n, round(avg(pnl), 6) AS oos_expectancy FROM (SELECT *, count(*) OVER (PARTITION BY sleeve) AS n,
    row_number() OVER (PARTITION BY sleeve ORDER BY ts DESC, id DESC) AS rd FROM closed_trades) WHERE n >= 4 AND rd <= greatest(n // 4, 1) GROUP BY 1, 2""", "closed_trades")
def d27(x: Inputs):
    q = S.last_quarter(x.closed_trades(), ["sleeve"], ["ts", "id"], "pnl")
    return q.select("sleeve", "n", F.round("oos_expectancy", 6).alias("oos_expectancy"))


CURVE_SQL = "SELECT *, 500 + sum(pnl) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS equity FROM closed_trades"


def equity_log(x: Inputs):
    """Equity after every closed trade: 500 plus the running pnl of the whole log."""
    t = range_blocks(x.closed_trades().select("ts", "id", "sleeve", "pnl"), [], ["ts", "id"])
    return running(t, [], "blk", ["ts", "id"], {"s": ("sum", F.col("pnl"))}).withColumn("equity", 500 + F.col("s"))


@query("e21_drawdown", f"""SELECT count(*) AS points, round(max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END), 6) AS max_dd, round(max_by(equity, ts * 1000000000 + id), 3) AS last_equity
    FROM (SELECT *, max(equity) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS peak FROM ({CURVE_SQL}))""", "closed_trades")
def e21(x: Inputs):
    e = running(equity_log(x), [], "blk", ["ts", "id"], {"peak": ("max", F.col("equity"))})
    dd = F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0)
    return e.agg(F.count(F.lit(1)).alias("points"), F.round(F.max(dd), 6).alias("max_dd"),
                 F.round(F.max_by("equity", F.struct("ts", "id")), 3).alias("last_equity"))


@query("d31_risk_row", f"""WITH c AS ({CURVE_SQL}), s AS (SELECT max_by(equity, ts * 1000000000 + id) AS cur, greatest(500, max(equity)) AS peak, sum(pnl) FILTER (ts >= {NOW_TRADES}) AS today,
      count(*) FILTER (ts >= {NOW_TRADES}) AS orders_today, max(ts) AS last_ts FROM c)
    SELECT round(cur, 2) AS current_equity, round(peak, 2) AS peak_equity, round((1 - cur / greatest(peak, 0.01)) * 100, 1) AS drawdown_pct, round(abs(coalesce(today, 0)), 2) AS daily_loss,
      round(least(cur, 500) * 0.03, 2) AS max_daily_loss, orders_today, {NOW_TRADES} + 300 < last_ts + 600 AS cooldown_active,
      greatest(0, (last_ts + 600 - ({NOW_TRADES} + 300)) // 60) AS cooldown_left_min FROM s""", "closed_trades")
def d31(x: Inputs):
    """Session risk five minutes into the last day."""
    now = NOW_TRADES + 300
    today = F.col("ts") >= NOW_TRADES
    s = equity_log(x).agg(F.max_by("equity", F.struct("ts", "id")).alias("cur"), F.greatest(F.lit(500.0), F.max("equity")).alias("peak"),
                          F.sum(F.when(today, F.col("pnl"))).alias("today"), F.count_if(today).alias("orders_today"), F.max("ts").alias("last_ts"))
    left = F.col("last_ts") + 600 - now
    return s.select(*rounded(current_equity=("cur", 2), peak_equity=("peak", 2)),
                    F.round((1 - F.col("cur") / F.greatest("peak", F.lit(0.01))) * 100, 1).alias("drawdown_pct"),
                    F.round(F.abs(F.coalesce("today", F.lit(0.0))), 2).alias("daily_loss"),
                    F.round(F.least("cur", F.lit(500.0)) * 0.03, 2).alias("max_daily_loss"), "orders_today", (left > 0).alias("cooldown_active"),
                    F.greatest(F.floor(left / 60), F.lit(0)).alias("cooldown_left_min"))


@query("e25_changed_decisions", """SELECT event_id, symbol, action, hour FROM (SELECT *, lag(action) OVER w AS pa, lag(hour) OVER w AS ph FROM (
    SELECT *, ts_us // 3600000000 AS hour FROM decisions) WINDOW w AS (PARTITION BY symbol ORDER BY event_id)) WHERE pa IS NULL OR pa <> action OR ph <> hour""", "decisions")
def e25(x: Inputs):
    d = x.decisions().select("event_id", "symbol", F.col("signal.action").alias("action"), F.expr("ts_us div 3600000000").alias("hour"), block_no("event_id").alias("blk"))
    return S.changed_decisions(d, "blk", ["event_id"], ["symbol"], ["action", "hour"]).drop("blk")


@query("e26_wait_streak", """SELECT d.symbol, count(*) FILTER (event_id > coalesce(stop, -1)) AS streak FROM decisions d JOIN (
    SELECT symbol, max(event_id) FILTER (NOT (action = 'WAIT' AND NOT approved)) AS stop FROM decisions GROUP BY 1) s ON s.symbol = d.symbol GROUP BY 1""", "decisions")
def e26(x: Inputs):
    d = x.decisions()
    return S.leading_streak(d, ["symbol"], "event_id", (F.col("signal.action") == "WAIT") & ~F.col("risk.approved"))


@query("e27_rapid_trades", """SELECT symbol, trade_id, round((us - pu) / 1e6, 6) AS elapsed_s FROM (SELECT *, lag(us) OVER (PARTITION BY symbol ORDER BY trade_id) AS pu FROM ticks)
    WHERE us - pu BETWEEN 0 AND 1999999""", "ticks")
def e27(x: Inputs):
    t = x.ticks().select("symbol", "trade_id", epoch_us("ts").alias("us"), block_no("trade_id").alias("blk"))
    p = previous(t, ["symbol"], "blk", ["trade_id"], {"us": "pu"})
    gap = F.col("us") - F.col("pu")
    return p.where((gap >= 0) & (gap < 2_000_000)).select("symbol", "trade_id", F.round(gap / 1e6, 6).alias("elapsed_s"))


@query("e27_pnl_swings", """SELECT sleeve, symbol, count(*) AS n, round(avg(pnl), 6) AS mean, count(*) >= 3 AND abs(avg(pnl)) > 50 AS flagged FROM (
    SELECT *, row_number() OVER (PARTITION BY sleeve, symbol ORDER BY ts DESC, id DESC) AS rn FROM closed_trades) WHERE rn <= 5 AND pnl <> 0 GROUP BY 1, 2""", "closed_trades")
def e27b(x: Inputs):
    """Mean pnl of the last five trades with a known, non-zero pnl."""
    w = Window.partitionBy("sleeve", "symbol").orderBy(F.desc("ts"), F.desc("id"))
    last = x.closed_trades().withColumn("rn", F.row_number().over(w)).where("rn <= 5 and pnl <> 0")
    return last.groupBy("sleeve", "symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pnl"), 6).alias("mean"),
                                                ((F.count(F.lit(1)) >= 3) & (F.abs(F.avg("pnl")) > 50)).alias("flagged"))


ROLL_SQL = f"""SELECT *, CASE WHEN n >= 2 THEN mean + {t_sql('n')} * sd / sqrt(n) END AS upper, CASE WHEN n >= 2 THEN mean - {t_sql('n')} * sd / sqrt(n) END AS lower FROM (
    SELECT *, count(*) OVER w AS n, avg(net_bps) OVER w AS mean, stddev_samp(net_bps) OVER w AS sd FROM closed_trades
    WINDOW w AS (PARTITION BY sleeve, symbol, regime ORDER BY ts, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""


@query("e28_rolling_bounds", f"SELECT id, n AS live_n, round(mean, 6) AS live_mean, round(lower, 6) AS live_lower, round(upper, 6) AS live_upper FROM ({ROLL_SQL})", "closed_trades")
def e28(x: Inputs):
    r = S.rolling_bounds(x.closed_trades(), ["sleeve", "symbol", "regime"], ["ts", "id"])
    return r.select("id", "live_n", *rounded(live_mean=("live_mean", 6), live_lower=("live_lower", 6), live_upper=("live_upper", 6)))


@query("t6_bench_states", f"""WITH RECURSIVE r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sleeve, symbol ORDER BY ts, id) AS i FROM (
      {ROLL_SQL.replace('sleeve, symbol, regime', 'sleeve, symbol')})),
    c AS (SELECT sleeve, symbol, CAST(-1 AS BIGINT) AS i, CAST(-1000000000000 AS BIGINT) AS until FROM closed_trades GROUP BY 1, 2
      UNION ALL SELECT c.sleeve, c.symbol, n.i, n.ts + 259200 FROM c, LATERAL (SELECT r.i, r.ts FROM r WHERE r.sleeve = c.sleeve AND r.symbol = c.symbol
        AND r.n >= 30 AND r.upper < 0 AND r.ts >= c.until ORDER BY r.ts, r.i LIMIT 1) n)
    SELECT r.id, CASE WHEN r.ts < b.until THEN 'benched' WHEN r.mean < 0 THEN 'negative' WHEN r.mean < 25 THEN 'weak' ELSE 'ok' END AS state, b.until
    FROM r ASOF LEFT JOIN (SELECT * FROM c WHERE i > 0) b ON b.sleeve = r.sleeve AND b.symbol = r.symbol AND r.i >= b.i""", "closed_trades")
def t6(x: Inputs):
    """Benches over the closed-trade log, per sleeve and symbol."""
    return S.bench_states(x.closed_trades(), ["sleeve", "symbol"]).select("id", "state", "until")


GATE_SQL = f"""WITH RECURSIVE t AS (SELECT sleeve, symbol, s.scope, ts, id, net_bps FROM closed_trades, LATERAL (SELECT unnest(['', regime]) AS scope) s),
    r AS MATERIALIZED (SELECT *, CASE WHEN n >= 2 THEN mean + {t_sql('n')} * sd / sqrt(n) END AS upper FROM (SELECT sleeve, symbol, scope, ts, id, row_number() OVER o AS closed, count(*) OVER w AS n, avg(net_bps) OVER w AS mean, stddev_samp(net_bps) OVER w AS sd
      FROM t WINDOW o AS (PARTITION BY sleeve, symbol, scope ORDER BY ts, id), w AS (PARTITION BY sleeve, symbol, scope ORDER BY ts, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))),
    l AS (SELECT sleeve, symbol, scope, ts, max(closed) AS closed FROM r GROUP BY 1, 2, 3, 4),
    a AS (SELECT c.sleeve, c.symbol, s.scope, c.ts + c.id % 5 * 86400 + 1800 AS now, c.id FROM closed_trades c, LATERAL (SELECT unnest(['', regime]) AS scope) s),
    q AS MATERIALIZED (SELECT a.*, row_number() OVER (PARTITION BY a.sleeve, a.symbol, a.scope ORDER BY a.now, a.id) AS j, coalesce(l.closed, 0) AS closed, r.mean, coalesce(r.n >= 30 AND r.upper < 0, false) AS bad
      FROM a ASOF LEFT JOIN l ON l.sleeve = a.sleeve AND l.symbol = a.symbol AND l.scope = a.scope AND a.now >= l.ts
      LEFT JOIN r ON r.sleeve = a.sleeve AND r.symbol = a.symbol AND r.scope = a.scope AND r.closed = l.closed),
    b AS (SELECT sleeve, symbol, scope, CAST(0 AS BIGINT) AS j, CAST(-1 AS BIGINT) AS until, CAST(-1 AS BIGINT) AS at FROM q GROUP BY 1, 2, 3
      UNION ALL SELECT b.sleeve, b.symbol, b.scope, n.j, n.now + 259200, n.closed FROM b, LATERAL (SELECT q.j, q.now, q.closed FROM q WHERE q.sleeve = b.sleeve AND q.symbol = b.symbol AND q.scope = b.scope
        AND q.bad AND q.now >= b.until AND q.closed > b.at ORDER BY q.j LIMIT 1) n),
    v AS (SELECT q.*, CASE WHEN q.now < b.until THEN 'benched' WHEN q.closed <= b.at THEN 'probation' WHEN mean IS NULL THEN 'neutral' WHEN mean < 0 THEN 'negative' WHEN mean < 25 THEN 'weak' ELSE 'ok' END AS state
      FROM q ASOF JOIN b ON b.sleeve = q.sleeve AND b.symbol = q.symbol AND b.scope = q.scope AND q.j >= b.j),
    z AS (SELECT *, state <> 'benched' AS allow, CASE state WHEN 'benched' THEN 0.0 WHEN 'probation' THEN 0.5 WHEN 'negative' THEN 0.5 WHEN 'weak' THEN 0.75 ELSE 1.0 END AS size_mult FROM v),
    m AS (SELECT s.id, s.now, s.allow AS sa, s.size_mult AS ss, s.state AS st, g.allow AS ga, g.size_mult AS gs, g.state AS gt FROM z s JOIN z g ON g.sleeve = s.sleeve AND g.symbol = s.symbol AND g.id = s.id AND g.scope <> '' WHERE s.scope = '')
    SELECT id, now, sa AND ga AS allow, CASE WHEN NOT (sa AND ga) THEN 0.0 ELSE least(ss, gs) END AS size_mult, CASE WHEN NOT ga OR sa AND gs < ss THEN gt ELSE st END AS state FROM m"""


def entry_requests(x: Inputs):
    """An entry of the same regime is asked for some days after each closed trade."""
    return x.closed_trades().select("sleeve", "symbol", "regime", (F.col("ts") + F.col("id") % 5 * 86_400 + 1_800).alias("now"), "id")


@query("t6_gate_verdicts", GATE_SQL, "closed_trades")
def t6g(x: Inputs):
    """Symbol and regime verdict, with probation and size, on every request for an entry."""
    return S.gate_verdicts(x.closed_trades(), entry_requests(x)).select("id", "now", "allow", "size_mult", "state")


PRIORS = {"S0": (40, -30.0), "S1": (1, 55.0), "S9": (12, 80.0)}
PRIOR_SQL = "(VALUES " + ", ".join(f"('{k}', {n}, {b})" for k, (n, b) in PRIORS.items()) + ") p(symbol, prior_n, prior_bps)"


@query("c18_blend_prior", f"""SELECT sleeve, symbol, live_n, round(b, 6) AS blended_bps, CASE WHEN b IS NULL THEN 'neutral' WHEN b < 0 THEN 'negative' WHEN b < 25 THEN 'weak' ELSE 'ok' END AS state,
    CASE WHEN b IS NULL THEN 1.0 WHEN b < 0 THEN 0.5 WHEN b < 25 THEN 0.75 ELSE 1.0 END AS size_mult FROM (
    SELECT coalesce(l.sleeve, p.sleeve) AS sleeve, coalesce(l.symbol, p.symbol) AS symbol, coalesce(l.n, 0) AS live_n, (coalesce(p.prior_bps, 0) * coalesce(least(p.prior_n, 2), 0) + coalesce(l.s, 0)) / nullif(coalesce(least(p.prior_n, 2), 0) + coalesce(l.n, 0), 0) AS b
    FROM (SELECT sleeve, symbol, count(*) AS n, sum(net_bps) AS s FROM closed_trades GROUP BY 1, 2) l FULL JOIN (SELECT sleeve, p.* FROM (SELECT DISTINCT sleeve FROM closed_trades), {PRIOR_SQL}) p ON p.symbol = l.symbol AND p.sleeve = l.sleeve)""", "closed_trades")
def c18(x: Inputs):
    live = x.closed_trades().groupBy("sleeve", "symbol").agg(F.count(F.lit(1)).alias("live_n"), F.sum("net_bps").alias("live_sum"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("symbol"), F.lit(float(n)).alias("prior_n"), F.lit(b).alias("prior_bps")) for k, (n, b) in PRIORS.items()]))
    priors = live.select("sleeve").distinct().select("sleeve", rows.alias("p")).select("sleeve", "p.*")
    b = S.blend_prior(live, priors, ["sleeve", "symbol"])
    return b.select("sleeve", "symbol", F.coalesce("live_n", F.lit(0)).alias("live_n"), F.round("blended_bps", 6).alias("blended_bps"), "state", "size_mult")


@query("h23_size_mult", """SELECT sleeve, symbol, round(avg(net_bps), 6) AS bps, CASE WHEN avg(net_bps) < 0 THEN 0.5 WHEN avg(net_bps) < 25 THEN 0.75 ELSE 1.0 END AS size_mult
    FROM closed_trades GROUP BY 1, 2""", "closed_trades")
def h23(x: Inputs):
    g = x.closed_trades().groupBy("sleeve", "symbol").agg(F.avg("net_bps").alias("m"))
    return g.select("sleeve", "symbol", F.round("m", 6).alias("bps"), S.size_mult(F.col("m")).alias("size_mult"))


@query("f1_newest_rows", "SELECT event_id, symbol, action, score FROM decisions ORDER BY event_id DESC LIMIT 30", "decisions")
def f1(x: Inputs):
    d = x.decisions().orderBy(F.desc("event_id")).limit(30)
    return d.select("event_id", "symbol", F.col("signal.action").alias("action"), F.col("signal.score").alias("score"))


def shadow_log(x: Inputs):
    """Blocked signals are the BUY decisions; two of three have an outcome."""
    d = x.decisions().where("signal.action = 'BUY'")
    gate = F.when(F.col("signal.score") < 33, "d1").when(F.col("signal.score") < 66, "exposure").otherwise("fee_edge")
    signals = d.select(F.col("event_id").alias("id"), F.col("symbol").alias("strategy"), gate.alias("gate"))
    status = F.when(F.col("event_id") % 7 == 0, "unscorable").when(F.col("event_id") % 5 == 0, "no_fill").otherwise("scored")
    outcomes = d.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), status.alias("status"),
                                                   F.when(status != "unscorable", ((F.col("event_id") * 31) % 400 - 180).cast("double")).alias("net_bps"))
    return signals, outcomes


SHADOW = """s AS (SELECT event_id AS id, symbol AS strategy, CASE WHEN score < 33 THEN 'd1' WHEN score < 66 THEN 'exposure' ELSE 'fee_edge' END AS gate FROM decisions WHERE action = 'BUY'),
    o AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'unscorable' WHEN event_id % 5 = 0 THEN 'no_fill' ELSE 'scored' END AS status,
      CASE WHEN event_id % 7 <> 0 THEN (event_id * 31) % 400 - 180 END AS net_bps FROM decisions WHERE action = 'BUY' AND event_id % 3 <> 0)"""


@query("c5_open_signals", f"WITH {SHADOW} SELECT id, strategy, gate FROM s WHERE id NOT IN (SELECT id FROM o)", "decisions")
def c5(x: Inputs):
    signals, outcomes = shadow_log(x)
    return signals.join(outcomes, "id", "left_anti")


@query("d8_shadow_summary", f"""WITH {SHADOW} SELECT strategy, gate, count(*) AS signals, count(net_bps) AS scored, count(*) FILTER (status IS NULL) AS open,
    count(*) FILTER (status IS NOT NULL AND net_bps IS NULL) AS unscorable, round(avg(net_bps), 6) AS avg_bps, round(coalesce(sum(net_bps), 0), 6) AS sum_bps
    FROM s LEFT JOIN o ON o.id = s.id GROUP BY 1, 2""", "decisions")
def d8(x: Inputs):
    signals, outcomes = shadow_log(x)
    both = signals.join(outcomes, "id", "left")
    good = F.when(F.col("status").isin("scored", "no_fill"), F.col("net_bps"))
    return both.groupBy("strategy", "gate").agg(
        F.count(F.lit(1)).alias("signals"), F.count(good).alias("scored"), F.count_if(F.col("status").isNull()).alias("open"),
        F.count_if(F.col("status").isNotNull() & good.isNull()).alias("unscorable"), F.round(F.avg(good), 6).alias("avg_bps"),
        F.round(F.coalesce(F.sum(good), F.lit(0.0)), 6).alias("sum_bps"))


@query("c6_unseen_trades", """SELECT id, symbol, round(pnl, 8) AS pnl FROM closed_trades c WHERE NOT EXISTS (SELECT 1 FROM closed_trades l WHERE l.id % 3 <> 0 AND l.symbol = c.symbol
    AND l.ts = c.ts AND round(l.pnl, 6) = round(c.pnl, 6))""", "closed_trades")
def c6(x: Inputs):
    """Trades not yet in the ledger, by symbol, time to the millisecond and pnl to the micro-dollar."""
    t = x.closed_trades()
    key = F.concat_ws("|", "symbol", F.round(F.col("ts") * 1000).cast("bigint"), F.round(F.col("pnl") * 1e6).cast("bigint"))
    keyed = t.withColumn("k", key)
    return keyed.join(keyed.where("id % 3 <> 0").select("k"), "k", "left_anti").select("id", "symbol", F.round("pnl", 8).alias("pnl"))


@query("b3_prefer_fill", """SELECT sleeve, symbol, ts, arg_min(source, rk) AS source, arg_min(id, rk) AS id FROM (SELECT *, row_number() OVER (PARTITION BY sleeve, symbol, ts
    ORDER BY CASE WHEN source = 'fill' THEN 0 ELSE 1 END, CASE WHEN source = 'fill' THEN -id ELSE id END) AS rk FROM closed_trades) GROUP BY 1, 2, 3""", "closed_trades")
def b3(x: Inputs):
    """One row per key: the newest fill row if there is one, else the first row."""
    fill = F.col("source") == "fill"
    rank = F.struct(F.when(fill, 0).otherwise(1), F.when(fill, -F.col("id")).otherwise(F.col("id")))
    return x.closed_trades().groupBy("sleeve", "symbol", "ts").agg(F.min_by(F.struct("source", "id"), rank).alias("r")).select("sleeve", "symbol", "ts", "r.source", "r.id")
