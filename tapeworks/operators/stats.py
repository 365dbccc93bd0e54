"""Scorecards and statistics over trade, decision and equity logs.

Groups are reduced by partial aggregates.  Anything that needs the order of a
log (equity curves, rolling windows, last quarter) runs over range blocks, so
one sleeve may hold most of the log.  Exact medians are selected by counting
(``operators.select``); ``percentile`` is left for folds, of which there are few.
"""
from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.core import ratio
from tapeworks.operators.asof import asof_join
from tapeworks.operators.scan import block_no, greedy_chain, ordinals, previous, range_blocks, running, with_halo
from tapeworks.operators.select import exact_quantile
from tapeworks.session import pin

CONFIDENCE = 0.90
MIN_SAMPLE, WINDOW, BENCH_HOURS = 30, 50, 72
WEAK_BPS = 25.0
PROBATION_SIZE = 0.5


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def trade_stats() -> list[Column]:
    """Aggregates of a group of closed trades."""
    return [F.count(F.lit(1)).alias("trades"), count_where(F.col("pnl") > 0).alias("wins"),
            (100.0 * F.avg((F.col("pnl") > 0).cast("double"))).alias("win_pct"), F.sum("pnl").alias("net_pnl"),
            F.avg("net_bps").alias("avg_bps"),
            F.max("net_bps").alias("best_bps"), F.min("net_bps").alias("worst_bps"), F.max("ts").alias("last_ts")]


def scorecard(trades: DataFrame, now_s: int) -> DataFrame:
    """All trades, the last 24 hours, per sleeve, per sleeve and symbol."""
    cube = trades.rollup("sleeve", "symbol").agg(F.grouping_id().alias("g"), *trade_stats())
    scope = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "sleeve").otherwise("sleeve_symbol")
    out = cube.withColumn("scope", scope).drop("g")
    recent = F.col("ts") >= now_s - 86_400
    day = trades.where(recent).agg(*trade_stats())
    none = F.lit(None).cast("string")
    out = out.unionByName(day.select(none.alias("sleeve"), none.alias("symbol"), "*", F.lit("last_24h").alias("scope")))
    of = lambda name, sleeve, symbol: F.struct(F.lit(name).alias("m_scope"), sleeve.alias("m_sleeve"), symbol.alias("m_symbol"))
    scopes = F.array(of("all", none, none), of("sleeve", F.col("sleeve"), none), of("sleeve_symbol", F.col("sleeve"), F.col("symbol")), F.when(recent, of("last_24h", none, none)))
    each = trades.select("net_bps", F.explode(scopes).alias("s")).where("s is not null").select("net_bps", "s.*")
    mid = exact_quantile(each, ["m_scope", "m_sleeve", "m_symbol"], "net_bps", "median_bps")
    same = (F.col("scope") == F.col("m_scope")) & F.col("sleeve").eqNullSafe(F.col("m_sleeve")) & F.col("symbol").eqNullSafe(F.col("m_symbol"))
    return out.join(mid, same, "left").drop("m_scope", "m_sleeve", "m_symbol")


def fill_detail(trades: DataFrame) -> DataFrame:
    """Costs, slippage and excursions of measured trades, with a count per exit reason."""
    rich = trades.where(F.col("source") == "fill")
    base = rich.groupBy("sleeve").agg(
        F.count(F.lit(1)).alias("rich_trades"), F.sum(F.coalesce("fees", F.lit(0.0))).alias("fees"),
        (100.0 * F.avg(F.coalesce("entry_maker", F.lit(False)).cast("double"))).alias("maker_entry_pct"),
        F.avg("entry_slip_bps").alias("entry_slip_bps"), F.avg("mae_bps").alias("mae_bps"),
        F.avg("mfe_bps").alias("mfe_bps"), (F.avg("hold_s") / 3600).alias("hold_h"))
    reasons = (rich.groupBy("sleeve", "exit_reason").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("sleeve").agg(F.map_from_entries(F.array_sort(F.collect_list(
                   F.struct("exit_reason", "n")))).alias("exit_reasons")))
    return base.join(reasons, "sleeve")


def best_two(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """Sum of the two largest values of a group; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    top = df.withColumn("_rk", F.row_number().over(w)).where("_rk <= 2")
    return top.groupBy(*keys).agg(F.sum(value).alias("top2"))


def study_stats(df: DataFrame, keys: Sequence[str], value: str = "net_bps", tie: str = "id") -> DataFrame:
    """n, win share, mean, median, mean without the best two, their share, and the sum."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg((F.col(value) > 0).cast("double")).alias("win"), F.avg(value).alias("mean"),
        F.sum(value).alias("total"))
    out = base.join(best_two(df, keys, value, tie), list(keys)).join(exact_quantile(df, keys, value, "median"), list(keys), "left")
    return (out.withColumn("ex_best2", F.when(F.col("n") > 2, (F.col("total") - F.col("top2")) / (F.col("n") - 2)))
            .withColumn("top2_share", F.when((F.col("total") > 0) & (F.col("n") >= 2), F.col("top2") / F.col("total")))
            .drop("top2"))


# ---- confidence bounds -------------------------------------------------------------------

def t_quantile(n: str | Column, conf: float = CONFIDENCE) -> Column:
    """One-sided Student-t quantile for ``n - 1`` degrees of freedom (Cornish-Fisher)."""
    z = NormalDist().inv_cdf(conf)
    df = (F.col(n) if isinstance(n, str) else n) - 1
    terms = ((z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96,
             (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384)
    out = F.lit(z)
    for k, g in enumerate(terms, 1):
        out = out + F.lit(g) / F.pow(df, F.lit(k))
    return out


def mean_bounds(value: str, over=None, conf: float = CONFIDENCE) -> dict[str, Column]:
    """Mean with one-sided lower and upper bound; bounds need two values."""
    agg = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    n, m, sd = agg(F.count(value)), agg(F.avg(value)), agg(F.stddev_samp(value))
    half = F.when(n >= 2, t_quantile(n, conf) * sd / F.sqrt(n))
    return {"n": n, "mean": m, "lower": m - half, "upper": m + half}


def promotion(trades: DataFrame, keys: Sequence[str], tie: str = "id") -> DataFrame:
    """The bar for going live, per group, with the names of the failed checks."""
    b = mean_bounds("net_bps")
    base = trades.groupBy(*keys).agg(*[c.alias(k) for k, c in b.items()], F.sum("pnl").alias("pnl"),
                                     F.sum("net_bps").alias("total"))
    base = base.join(best_two(trades, keys, "net_bps", tie), list(keys))
    base = base.withColumn("ex_best2", F.when(F.col("n") > 2, (F.col("total") - F.col("top2")) / (F.col("n") - 2)))
    checks = {"min_trades": F.col("n") >= MIN_SAMPLE, "mean_positive": F.col("mean") > 0,
              "lower_bound_positive": F.col("lower") > 0, "ex_best_2_positive": F.col("ex_best2") > 0,
              "beats_cash": (F.col("pnl") >= 0) & (F.col("n") > 0)}
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]),
                      lambda v: v.isNotNull())
    return base.drop("total", "top2").withColumn("failed", failed).withColumn("passes", F.size("failed") == 0)


# ---- curves ------------------------------------------------------------------------------

def drawdown(curve: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Largest fall below the running peak, as a fraction of the peak."""
    b = range_blocks(curve.select(*keys, *order, value), keys, order)
    b = running(b, keys, "blk", order, {"peak": ("max", F.col(value))})
    dd = F.when(F.col("peak") > 0, (F.col("peak") - F.col(value)) / F.col("peak")).otherwise(0.0)
    return b.groupBy(*keys).agg(F.max(dd).alias("max_dd"), F.count(F.lit(1)).alias("points"))


def compound(trades: DataFrame, keys: Sequence[str], order: Sequence[str], equity: float = 500.0,
             risk: float = 0.01, cap: float = 0.40) -> DataFrame:
    """Equity before and after each trade when size is a share of equity.

    The share is ``min(risk / stop, cap)``, so equity is a running product:
    the exponential of a running sum of logs.
    """
    w = F.least(F.lit(risk) / F.greatest("stop_frac", F.lit(1e-6)), F.lit(cap))
    b = range_blocks(trades.withColumn("w", w), keys, order)
    grow = F.log(F.greatest(1 + F.col("w") * F.col("net"), F.lit(1e-12)))
    b = running(b, keys, "blk", order, {"_log": ("sum", grow)})
    after = equity * F.exp("_log")
    return (b.withColumn("equity", after).withColumn("pnl_usd", after - after / (1 + F.col("w") * F.col("net")))
            .drop("_log", "w"))


def metrics(trades: DataFrame, keys: Sequence[str], order: Sequence[str], equity: float = 500.0,
            risk: float = 0.01, cap: float = 0.40) -> DataFrame:
    """Backtest metrics of trade lists, compounding in entry order."""
    c = compound(trades, keys, order, equity, risk, cap)
    c = running(c, keys, "blk", order, {"_peak": ("max", F.col("equity"))})
    peak = F.greatest("_peak", F.lit(equity))
    gains = F.sum(F.when(F.col("pnl_usd") > 0, F.col("pnl_usd")).otherwise(0.0))
    losses = -F.sum(F.when(F.col("pnl_usd") < 0, F.col("pnl_usd")).otherwise(0.0))
    factor = F.when(losses > 0, gains / losses).when(gains > 0, F.lit(float("inf"))).otherwise(0.0)
    return c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), count_where(F.col("net") > 0).alias("wins"),
        F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), (F.avg("net") * 1e4).alias("avg_net_bps"),
        (F.avg("gross") * 1e4).alias("avg_gross_bps"), F.avg("pnl_usd").alias("expectancy_usd"),
        ((F.max_by("equity", F.struct(*order)) / equity - 1) * 100).alias("total_return_pct"),
        (F.max((peak - F.col("equity")) / peak) * 100).alias("max_dd_pct"), factor.alias("profit_factor"))


def sharpe(value: str, periods: int) -> Column:
    """Mean over population deviation, annualised; 0 under three values or without spread."""
    sd = F.stddev_pop(value)
    return F.when((F.count(value) >= 3) & (sd > 0), F.avg(value) / sd * periods ** 0.5).otherwise(0.0)


def last_quarter(trades: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Mean over the last quarter of each ordered group; needs four trades."""
    b = ordinals(range_blocks(trades.select(*keys, *order, value), keys, order), keys, "blk", order)
    n = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    late = b.join(n, list(keys)).where((F.col("n") >= 4) & (F.col("i") >= F.col("n") - F.greatest(F.floor(F.col("n") / 4), F.lit(1))))
    return late.groupBy(*keys).agg(F.first("n").alias("n"), F.avg(value).alias("oos_expectancy"))


# ---- rolling learner statistics ----------------------------------------------------------

def rolling_bounds(trades: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "net_bps",
                   window: int = WINDOW, rows: int = 4096, following: dict[str, str] | None = None) -> DataFrame:
    """Count, mean and bounds of the last ``window`` closed trades at every trade; ``following``: values of the next trade, ``{source column: new name}``."""
    b = ordinals(range_blocks(trades, keys, order), keys, "blk", order).drop("blk")
    h = with_halo(b, "i", window - 1, rows, ahead=1 if following else 0)
    here = Window.partitionBy(*keys, "hblk").orderBy("i")
    w = here.rowsBetween(-(window - 1), 0)
    cols = {f"live_{k}": c for k, c in mean_bounds(value, w).items()}
    cols |= {name: F.lead(c).over(here) for c, name in (following or {}).items()}
    return h.withColumns(cols).where("home").drop("home", "hblk")


def bench_states(trades: DataFrame, keys: Sequence[str], min_sample: int = MIN_SAMPLE,
                 bench_hours: int = BENCH_HOURS, rows: int = 4096) -> DataFrame:
    """Gate state after every closed trade of a log.

    A key is benched when its rolling upper bound falls below zero on enough
    trades; the bench lasts a fixed time, and the next losing verdict after it
    starts another.  Which verdicts start a bench is a greedy chain.
    """
    r = rolling_bounds(trades, keys, ["ts", "id"])
    bad = F.coalesce((F.col("live_n") >= min_sample) & (F.col("live_upper") < 0), F.lit(False))
    r = pin(r.withColumns({"_blk": block_no("i", rows), "bad": bad}))
    span = bench_hours * 3600
    slim = r.where("bad").select(*keys, "_blk", "ts", "i", (F.col("ts") + span).alias("ready"))
    starts = greedy_chain(slim, keys, "_blk", "ts", "ready", ["i"]).where("accepted")
    r = r.join(starts.select(*keys, "i", F.lit(True).alias("starts")), [*keys, "i"], "left")
    r = running(r, keys, "_blk", ["i"], {"until": ("last", F.when(F.col("starts"), F.col("ts") + span))})
    state = (F.when(F.col("ts") < F.col("until"), "benched").when(F.col("live_mean") < 0, "negative")
             .when(F.col("live_mean") < WEAK_BPS, "weak").otherwise("ok"))
    return r.withColumn("state", state).drop("_blk", "starts", "bad")


def size_mult(bps: Column) -> Column:
    """Size multiplier for a blended expectancy."""
    return F.when(bps.isNull(), 1.0).when(bps < 0, 0.5).when(bps < WEAK_BPS, 0.75).otherwise(1.0)


def learner_state(bps: Column) -> Column:
    return (F.when(bps.isNull(), "neutral").when(bps < 0, "negative").when(bps < WEAK_BPS, "weak").otherwise("ok"))


def blend_prior(live: DataFrame, priors: DataFrame, keys: Sequence[str], max_weight: float = 2.0) -> DataFrame:
    """Live mean blended with a back-test prior that counts as at most two trades."""
    both = live.join(priors, list(keys), "full_outer")
    w = F.coalesce(F.least("prior_n", F.lit(max_weight)), F.lit(0.0))
    n, total = F.coalesce("live_n", F.lit(0)), F.coalesce("live_sum", F.lit(0.0))
    bps = F.when(w + n > 0, (F.coalesce("prior_bps", F.lit(0.0)) * w + total) / (w + n))
    return both.withColumn("blended_bps", bps).withColumn("state", learner_state(bps)).withColumn("size_mult", size_mult(bps))


def gate_verdicts(trades: DataFrame, requests: DataFrame, keys: Sequence[str] = ("sleeve", "symbol"), priors: DataFrame | None = None,
                  min_sample: int = MIN_SAMPLE, bench_hours: int = BENCH_HOURS, rows: int = 4096) -> DataFrame:
    """Verdict on every request for an entry: ``allow``, ``size_mult`` and ``state`` from the symbol and its regime together.

    ``requests``: keys, regime, now, id; ``priors``: keys, ``scope`` ('' or a regime), prior_n, prior_bps. Each
    request is judged on two levels, all closed trades of the symbol and those of the
    regime. A request with enough losing trades starts a bench; once its time is over and
    until a trade has closed, entries are on probation at half size; then the window is
    judged again. So a bench is free again at the later of its end and the next close, and
    the requests that start one are a greedy chain. The regime's verdict wins where it
    denies or sizes down further.
    """
    keys, level = list(keys), [*keys, "scope"]
    scopes = F.explode(F.array(F.lit(""), F.col("regime"))).alias("scope")
    r = pin(rolling_bounds(trades.select(*keys, scopes, "ts", "id", "net_bps"), level, ["ts", "id"], following={"ts": "next_close"}).withColumn("closed", F.col("i") + 1))
    # What a request sees of the trades: the newest ones closed by then, and before the first one only when that closes.
    # Pinned, as cutting blocks reads its input more than once.
    seen = ("closed", "live_n", "live_mean", "live_upper", "next_close")
    newest = r.groupBy(*level, "ts").agg(F.max_by(F.struct(*seen), "i").alias("l"))
    none = r.where("i = 0").select(*level, F.lit(-(1 << 62)).alias("before"), F.col("ts").alias("next_close"), *[F.lit(0 if c in seen[:2] else None).cast(r.schema[c].dataType).alias(c) for c in seen[:4]])
    newest = pin(newest.unionByName(none.select(*level, F.col("before").alias("ts"), F.struct(*seen).alias("l"))))
    q = asof_join(requests.select(*keys, scopes, "now", "id"), newest, level, "now", "ts", ["l"], block="blk")
    zero = F.lit(0).cast("long")
    q = pin(q.select(*level, "now", "id", "blk", F.coalesce("l.closed", zero).alias("closed"), F.coalesce("l.live_n", zero).alias("live_n"), "l.live_mean", "l.live_upper", "l.next_close"))
    q = ordinals(q, level, "blk", ["now", "id"], "j").drop("blk")
    span, never = bench_hours * 3600, 1 << 60
    bad = F.coalesce((F.col("live_n") >= min_sample) & (F.col("live_upper") < 0), F.lit(False))
    q = pin(q.withColumns({"bad": bad, "blk": block_no("j", rows), "ready": F.greatest(F.col("now") + span, F.coalesce("next_close", F.lit(never)))}))
    starts = greedy_chain(q.where("bad").select(*level, "blk", "now", "j", "ready"), level, "blk", "now", "ready", ["j"]).where("accepted")
    q = q.join(starts.select(*level, "j", F.lit(True).alias("starts")), [*level, "j"], "left")
    bench = F.when(F.col("starts"), F.struct((F.col("now") + span).alias("until"), F.col("closed").alias("at")))
    q = running(q, level, "blk", ["j"], {"bench": ("last", bench)})
    q = q.join(priors, level, "left") if priors is not None else q.withColumns({"prior_n": F.lit(0.0), "prior_bps": F.lit(0.0)})
    w = F.coalesce(F.least("prior_n", F.lit(2.0)), F.lit(0.0))
    bps = F.when(w + F.col("live_n") > 0, (F.coalesce("prior_bps", F.lit(0.0)) * w + F.coalesce("live_mean", F.lit(0.0)) * F.col("live_n")) / (w + F.col("live_n")))
    benched, waits = F.col("now") < F.col("bench.until"), F.col("closed") <= F.col("bench.at")
    state = F.when(benched, "benched").when(waits, "probation").otherwise(learner_state(bps))
    size = F.when(benched, 0.0).when(waits, PROBATION_SIZE).otherwise(size_mult(bps))
    v = F.struct((~F.coalesce(benched, F.lit(False))).alias("allow"), size.alias("size_mult"), state.alias("state"))
    both = q.groupBy(*keys, "now", "id").agg(F.max(F.when(F.col("scope") == "", v)).alias("s"), F.max(F.when(F.col("scope") != "", v)).alias("r"))
    return both.select(*keys, "now", "id", merged_verdict(F.col("s"), F.col("r")).alias("v")).select(*keys, "now", "id", "v.*")


def merged_verdict(symbol: Column, regime: Column) -> Column:
    """The regime's verdict where it denies the entry or, both allowing, sizes it down further; else the symbol's."""
    stricter = regime.isNotNull() & (~regime["allow"] | (symbol["allow"] & (regime["size_mult"] < symbol["size_mult"])))
    allow = symbol["allow"] & regime["allow"]
    size = F.when(allow, F.least(symbol["size_mult"], regime["size_mult"])).otherwise(0.0)
    return F.when(stricter, F.struct(allow.alias("allow"), size.alias("size_mult"), regime["state"].alias("state"))).otherwise(symbol)


def learning_totals(trades: DataFrame) -> DataFrame:
    """Per symbol: trades, wins, pnl, pnl per regime and the best regime (ties: latest trade)."""
    per = trades.groupBy("symbol", "regime").agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col("pnl") > 0).alias("w"), F.sum("pnl").alias("p"),
        F.max(F.struct("ts", "id")).alias("last"))
    return per.groupBy("symbol").agg(
        F.sum("n").alias("trades"), F.sum("w").alias("wins"), F.sum("p").alias("pnl"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("regime", "p")))).alias("regime_pnl"),
        F.max_by("regime", F.struct("p", "last")).alias("best_regime")).withColumn("expectancy", ratio("pnl", "trades"))


# ---- decisions ---------------------------------------------------------------------------

FILTERS = ("breakout", "momentum", "regime", "trend", "volume")


def filter_analysis(decisions: DataFrame) -> DataFrame:
    """How often each entry filter fails, the mean score then, and whether passing goes with buying."""
    reason, sig = F.coalesce("signal.reason", F.lit("")), F.col("signal")
    listed = F.when(reason.contains("Filters failed:"),
                    F.transform(F.split(F.trim(F.replace(reason, F.lit("Filters failed:"), F.lit(""))), ","), lambda v: F.trim(v)))
    slim = decisions.select(F.coalesce(sig["score"], F.lit(0)).alias("score"),
                            (F.coalesce(sig["action"], F.lit("WAIT")) == "BUY").alias("buy"),
                            F.coalesce(listed, F.array().cast("array<string>")).alias("failed"))
    aggs = [F.count(F.lit(1)).alias("total")]
    for f in FILTERS:
        bad = F.array_contains("failed", f)
        aggs += [F.count_if(bad).alias(f"{f}_n"), F.avg(F.when(bad, F.col("score"))).alias(f"{f}_s"),
                 F.avg(F.when(~bad, F.col("buy").cast("double"))).alias(f"{f}_b")]
    one = slim.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"{f}_n").alias("failures"),
                                        F.col(f"{f}_s").alias("score"), F.col(f"{f}_b").alias("buys")) for f in FILTERS]))
    out = one.select("total", rows.alias("r"))
    return out.select("r.filter", "r.failures", "total", (F.col("r.failures") / F.greatest("total", F.lit(1))).alias("failure_rate"),
                      F.coalesce("r.score", F.lit(0.0)).alias("avg_score_failed"),
                      (F.coalesce("r.buys", F.lit(0.0)) > 0.3).alias("correlated_with_buy"))


def signal_quality(decisions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    score, action = F.coalesce("signal.score", F.lit(0)), F.coalesce("signal.action", F.lit("WAIT"))
    share = {"buy_rate": "BUY", "sell_rate": "SELL", "wait_ratio": "WAIT"}
    return decisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("avg_score"),
        F.coalesce(F.var_samp(score), F.lit(0.0)).alias("score_variance"),
        *[F.avg((action == a).cast("double")).alias(k) for k, a in share.items()])


def decision_analytics(decisions: DataFrame, tail: int = 60) -> DataFrame:
    """Per symbol: action counts, score summary of the newest rows, and the newest signal."""
    act = F.col("signal.action")
    base = decisions.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("signals"), *[F.count_if(act == a).alias(a.lower()) for a in ("BUY", "SELL", "WAIT")],
        F.max_by(F.struct("signal.action", "signal.score", "signal.reason", "ts_us"), F.struct("ts_us", "event_id")).alias("last"))
    w = Window.partitionBy("symbol").orderBy(F.desc("ts_us"), F.desc("event_id"))
    newest = (decisions.select("symbol", "ts_us", "event_id", F.col("signal.score").alias("score"))
              .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= tail)
              .groupBy("symbol").agg(F.avg("score").alias("avg_score"), F.max("score").alias("max_score"),
                                     F.min("score").alias("min_score"),
                                     (F.sum(F.when(F.col("rn") <= 5, F.col("score"))) / 5).alias("last5")))
    out = base.join(newest, "symbol")
    return out.select("symbol", "signals", "buy", "sell", "wait", "avg_score", "max_score", "min_score",
                      F.col("last.action").alias("last_action"), F.col("last.score").alias("last_score"),
                      F.col("last.reason").alias("last_reason"), F.col("last.ts_us").alias("last_ts_us"),
                      F.when(F.col("last5") > 50, "bull").otherwise("bear").alias("regime"))


def market_regime(bars: DataFrame) -> DataFrame:
    """Regime of each symbol from its last 60 closes: trend of 20 against the 40 before, and volatility."""
    w = Window.partitionBy("symbol").orderBy(F.desc("t"))
    last = bars.select("symbol", "t", "close", F.row_number().over(w).alias("rn")).where("rn <= 60")
    n = F.count(F.lit(1))
    recent = F.when(F.col("rn") <= 20, F.col("close"))
    agg = last.groupBy("symbol").agg(n.alias("n"), F.avg(recent).alias("recent"), F.stddev_samp(recent).alias("sd"),
                                     F.avg(F.when(F.col("rn") > 20, F.col("close"))).alias("older60"),
                                     F.array_sort(F.collect_list(F.struct("t", "close"))).alias("all"))
    first20 = F.aggregate(F.slice("all", 1, 20), F.lit(0.0), lambda a, v: a + v["close"]) / 20
    older = F.when(F.col("n") >= 60, F.col("older60")).otherwise(first20)
    trend = F.when(older > 0, (F.col("recent") / older - 1) * 100).otherwise(0.0)
    agg = agg.withColumn("trend", trend).withColumn("volatility", F.coalesce(ratio("sd", "recent") * 100, F.lit(0.0)))
    regime = (F.when(F.col("n") < 20, "unknown").when(F.col("trend") > 2, "bull_trend").when(F.col("trend") < -2, "bear_trend")
              .when(F.col("volatility") < 1.5, "sideways").otherwise("range_bound"))
    conf = (F.when(F.col("n") < 20, 0.0).when(F.abs("trend") > 2, F.least(F.abs("trend") / 10, F.lit(0.95)))
            .when(F.col("volatility") < 1.5, F.least((1.5 - F.col("volatility")) / 1.5, F.lit(0.95)))
            .otherwise(F.least(F.col("volatility") / 5, F.lit(0.95))))
    return agg.select("symbol", "trend", "volatility", regime.alias("regime"), conf.alias("confidence"))


def suggestions(filters: DataFrame, quality: DataFrame, regime: DataFrame, settings: dict[str, float]) -> DataFrame:
    """Parameter changes that the failure rates, the regime and the wait share may call for, per symbol.

    One row per symbol and rule; ``fires`` says whether the evidence reaches the rule's
    threshold.  Filters and quality are summaries of five rows and one; regimes have a row
    per symbol.
    """
    rates = [F.max(F.when(F.col("filter") == f, F.col("failure_rate"))).alias("regime_fail" if f == "regime" else f)
             for f in FILTERS]
    one = filters.agg(*rates, F.lit(1).alias("_all"))
    one = one.join(quality.select("n", "wait_ratio", F.lit(1).alias("_all")), "_all")
    one = regime.select("symbol", "regime", "confidence", F.lit(1).alias("_all")).join(F.broadcast(one), "_all")
    s = {k: F.lit(float(v)) for k, v in settings.items()}

    def row(name: str, when: Column, value: Column, conf: Column) -> Column:
        return F.struct(F.lit(name).alias("parameter"), s[name].alias("current_value"), value.alias("suggested_value"),
                        conf.cast("double").alias("confidence"), F.coalesce(when, F.lit(False)).alias("fires"))
    rows = F.array(
        row("regime_ema", F.col("regime_fail") > 0.3,
            F.when(F.col("confidence") < 0.5, s["regime_ema"]).otherwise(F.greatest(s["regime_ema"] - 20, F.lit(50.0))), F.col("regime_fail")),
        row("min_volume_ratio", F.col("volume") > 0.6, F.round(s["min_volume_ratio"] - 0.05, 2), F.col("volume")),
        row("breakout_lookback", F.col("breakout") > 0.6, s["breakout_lookback"], F.col("breakout")),
        row("risk_per_trade", F.col("regime").isin("bull_trend", "sideways") & (F.col("confidence") > 0.6),
            F.round(s["risk_per_trade"] * 1.5, 3), F.col("confidence")),
        row("cooldown_minutes", (F.col("n") > 5) & (F.col("wait_ratio") > 0.9),
            F.greatest(s["cooldown_minutes"] - 30, F.lit(15.0)), F.col("wait_ratio")))
    return one.select("symbol", F.explode(rows).alias("r")).select("symbol", "r.*")


def changed_decisions(decisions: DataFrame, block: str, order: Sequence[str], keys: Sequence[str], sig: Sequence[str]) -> DataFrame:
    """Rows whose signature differs from the previous row of the same key."""
    p = previous(decisions, keys, block, order, {c: f"_p_{c}" for c in sig})
    same = F.struct(*[F.col(c) for c in sig]).eqNullSafe(F.struct(*[F.col(f"_p_{c}").alias(c) for c in sig]))
    return p.where(~same).select(*decisions.columns)


def leading_streak(decisions: DataFrame, keys: Sequence[str], order: str, holds: Column) -> DataFrame:
    """How many of the newest rows in a row satisfy ``holds``."""
    flagged = decisions.select(*keys, F.col(order).alias("_o"), F.coalesce(holds, F.lit(False)).alias("_h"))
    stop = flagged.groupBy(*keys).agg(F.max(F.when(~F.col("_h"), F.col("_o"))).alias("_stop"))
    return (flagged.join(stop, list(keys)).groupBy(*keys)
            .agg(F.count_if(F.col("_stop").isNull() | (F.col("_o") > F.col("_stop"))).alias("streak")))


# ---- folds -------------------------------------------------------------------------------

def fold_summary(folds: DataFrame, keys: Sequence[str], min_trades: int = 5) -> DataFrame:
    """Out-of-sample fold statistics and the verdict; ``folds`` has one row per fold."""
    thin = (F.col("n_trades") < min_trades).cast("double")
    out = folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.percentile("n_trades", 0.5).alias("median_trades"), F.avg(thin).alias("thin_frac"),
        F.percentile("sharpe", 0.5).alias("median_sharpe"), F.percentile("sharpe", 0.05).alias("p5_sharpe"),
        F.avg((F.col("total_return") > 0).cast("double")).alias("win_frac"))
    return out


def verdict(hold_trades: Column, hold_score: Column) -> Column:
    return (F.when(F.col("folds") == 0, "INSUFFICIENT_FOLDS").when(F.col("thin_frac") > 0.5, "FOLDS_TOO_THIN")
            .when(hold_trades < 3, "HOLD_OUT_TOO_THIN")
            .when((F.col("median_sharpe") > 0.4) & (F.col("p5_sharpe") > -0.3) & (F.col("win_frac") >= 0.5) & (hold_score > -0.5), "PAPER_DEPLOY")
            .when(F.col("median_sharpe") > 0, "WATCH_ONLY").otherwise("DO_NOT_DEPLOY"))


def readiness(folds: DataFrame, keys: Sequence[str], min_trades: int = 30, max_dd: float = 0.10, min_pf: float = 1.10) -> DataFrame:
    """Whether a set of folds is good enough to trade."""
    pf = F.when(F.col("profit_factor") != float("inf"), F.col("profit_factor"))
    out = folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.sum("n_trades").alias("total_trades"), F.count_if(F.col("total_return") > 0).alias("profitable"),
        F.max("max_dd").alias("worst_dd"), F.coalesce(F.avg(pf), F.lit(0.0)).alias("avg_profit_factor"))
    ready = ((F.col("total_trades") >= min_trades) & (F.col("profitable") > F.col("folds") / 2)
             & (F.col("worst_dd") <= max_dd) & (F.col("avg_profit_factor") >= min_pf))
    return out.withColumn("live_ready", ready)


def watchlist(ticks: DataFrame, now_us: int) -> DataFrame:
    """24-hour change, range and volume per symbol, with a flag on the largest mover."""
    day = ticks.where((F.col("us") >= now_us - 86_400_000_000) & (F.col("us") < now_us))
    out = day.groupBy("symbol").agg(
        F.max_by("price", "trade_id").alias("price"), F.min_by("price", "trade_id").alias("open_24h"),
        F.max("price").alias("high_24h"), F.min("price").alias("low_24h"), F.sum("qty").alias("volume_24h"),
        F.count(F.lit(1)).alias("trades_24h"))
    return out.withColumn("change_pct", F.coalesce((ratio("price", "open_24h") - 1) * 100, F.lit(0.0)))
