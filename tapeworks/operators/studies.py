"""Walk-forward selection, rolling optimisation and rule studies over trade tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.core import known, ratio
from tapeworks.functions.costs import Costs
from tapeworks.operators import labels as L
from tapeworks.operators import signals as G
from tapeworks.operators import stats as S
from tapeworks.operators.features import SERIES, realized_vol

FOLDS, WARM, MIN_IS = 4, 210, 3


# ---- fold edges --------------------------------------------------------------------------

def fold_edges(n: Column, folds: int = FOLDS, warm: int = WARM) -> list[Column]:
    """Bar numbers where fold segments start, plus the end."""
    return [warm + F.floor((n - warm) * k / (folds + 1)) for k in range(folds + 2)]


def edge_table(ends: DataFrame, folds: int = FOLDS, warm: int = WARM) -> DataFrame:
    """Segments ``lo <= bar < hi`` of every series that is long enough."""
    edges = fold_edges(F.col("n"), folds, warm)
    segs = F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), edges[k].alias("lo"), edges[k + 1].alias("hi")) for k in range(folds + 1)]))
    return (ends.where(F.col("n") - warm >= (folds + 1) * 20).select(*SERIES, "n", segs.alias("e"))
            .select(*SERIES, "n", "e.*"))


def attach_segment(trades: DataFrame, ends: DataFrame, folds: int = FOLDS, warm: int = WARM) -> DataFrame:
    """Segment 0..folds of each trade by its entry bar; short series drop out."""
    t = trades.join(ends.select(*SERIES, "n").where(F.col("n") - warm >= (folds + 1) * 20), list(SERIES))
    edges = fold_edges(F.col("n"), folds, warm)
    seg = F.lit(-1)
    for k in range(folds + 1):
        seg = seg + (F.col("entry_i") >= edges[k]).cast("int")
    return t.withColumn("seg", seg).drop("n")


def rolling_splits(ends: DataFrame, is_bars: int, oos_bars: int, step: int, embargo: int = 4) -> DataFrame:
    """In-sample and out-of-sample bar ranges per series, rolled forward by ``step``."""
    count = F.floor((F.col("n") - is_bars - embargo - oos_bars) / step)
    s = ends.where(F.col("n") >= is_bars + embargo + oos_bars).select(*SERIES, "n", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("fold"))
    start = F.col("fold") * step
    return s.select(*SERIES, "fold", start.alias("is_start"), (start + is_bars).alias("is_end"),
                    (start + is_bars + embargo).alias("oos_start"), (start + is_bars + embargo + oos_bars).alias("oos_end"))


def validation_folds(ends: DataFrame, folds: int = 4, regime_ema: int = 200) -> DataFrame:
    """Equal test ranges, each with enough earlier bars to warm up."""
    least = max(regime_ema + 50, 250)
    size = F.floor((F.col("n") - least) / folds)
    s = ends.where(F.col("n") - least > folds).select(*SERIES, "n", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    start = least + F.col("fold") * F.col("size")
    return s.select(*SERIES, "fold", F.greatest(start - least, F.lit(0)).alias("from_bar"), start.alias("test_start"),
                    F.when(F.col("fold") == folds - 1, F.col("n")).otherwise(start + F.col("size")).alias("test_end"))


def slice_series(bars: DataFrame, ranges: DataFrame, lo: str, hi: str, part: str) -> DataFrame:
    """Bars of each range as a series of its own, numbered from 0.

    A bar belongs to a bounded number of ranges, so this is an equi-join on the
    series with a short list of ranges per series.
    """
    r = ranges.groupBy(*SERIES).agg(F.collect_list(F.struct("fold", F.col(lo).alias("lo"), F.col(hi).alias("hi"))).alias("rs"))
    mine = F.filter("rs", lambda v: (v["lo"] <= F.col("i")) & (F.col("i") < v["hi"]))
    out = bars.join(r, list(SERIES)).withColumn("r", F.explode(mine))
    return (out.withColumn("base", F.col("symbol")).withColumn("fold", F.col("r.fold")).withColumn("part", F.lit(part))
            .withColumn("symbol", F.concat_ws("|", "symbol", F.lit(part), F.col("r.fold"))).withColumn("i", F.col("i") - F.col("r.lo")).drop("r", "rs"))


# ---- selection ---------------------------------------------------------------------------

def select_specs(trades: DataFrame, ends: DataFrame, specs: Sequence[G.Spec], folds: int = FOLDS, warm: int = WARM,
                 min_is: int = MIN_IS) -> DataFrame:
    """For fold f the spec with the best mean net in segment f-1; the family's first spec when none traded enough."""
    first = {}
    for k, s in enumerate(specs):
        first.setdefault(s.family or s.name, k)
    scored = (attach_segment(trades, ends, folds, warm).groupBy(*SERIES, "family", "seg", "k").agg(F.count(F.lit(1)).alias("n_is"), F.avg("net").alias("score"))
              .where((F.col("n_is") >= min_is) & (F.col("seg") < folds)))
    best = scored.groupBy(*SERIES, "family", (F.col("seg") + 1).alias("fold")).agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("best"))
    fams = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(k).alias("default")) for f, k in first.items()]))
    every = (edge_table(ends, folds, warm).where("seg >= 1").select(*SERIES, F.col("seg").alias("fold"), fams.alias("f"))
             .select(*SERIES, "fold", "f.*"))
    out = every.join(best, [*SERIES, "family", "fold"], "left")
    return out.select(*SERIES, "family", "fold", F.coalesce("best", "default").alias("k"), F.col("best").isNull().alias("defaulted"))


def walk_forward(trades: DataFrame, ends: DataFrame, specs: Sequence[G.Spec], folds: int = FOLDS, warm: int = WARM) -> DataFrame:
    """In-sample and out-of-sample trades of the chosen spec of every fold (``part``)."""
    chosen = select_specs(trades, ends, specs, folds, warm).select(*SERIES, "family", "fold", "k")
    t = attach_segment(trades, ends, folds, warm)
    keys = [*SERIES, "family", "k", "fold"]
    oos = t.withColumn("fold", F.col("seg")).join(chosen, keys).withColumn("part", F.lit("oos"))
    ins = t.withColumn("fold", F.col("seg") + 1).join(chosen, keys).withColumn("part", F.lit("is"))
    return oos.unionByName(ins)


def plateau_pick(scored: DataFrame, keys: Sequence[str], params: Sequence[str], top: int | None = 3) -> DataFrame:
    """Median parameters of the majority strategy among the ``top`` best scores."""
    ranked = scored.withColumn("_rk", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "k")))
    best = ranked if top is None else ranked.where(F.col("_rk") <= top)
    votes = best.groupBy(*keys, "strategy").agg(F.count(F.lit(1)).alias("votes"), F.min("_rk").alias("first"))
    lead = votes.groupBy(*keys).agg(F.max_by("strategy", F.struct("votes", -F.col("first"))).alias("strategy"))
    cohort = best.join(lead, [*keys, "strategy"])
    return cohort.groupBy(*keys, "strategy").agg(*[F.percentile(p, 0.5).alias(p) for p in params])


def consensus(chosen: DataFrame, keys: Sequence[str], params: Sequence[str]) -> DataFrame:
    """The most frequent parameter set over folds; a tie goes to the plateau of all of them."""
    sig = ["strategy", *params]
    n = chosen.groupBy(*keys, *sig).agg(F.count(F.lit(1)).alias("c"))
    top = n.groupBy(*keys).agg(F.max("c").alias("best"))
    lead = n.join(top, list(keys)).where(F.col("c") == F.col("best"))
    single = lead.groupBy(*keys).agg(F.count(F.lit(1)).alias("ties"), F.first(F.struct(*sig)).alias("one"))
    plateau = plateau_pick(chosen.withColumn("score", F.lit(1.0)).withColumn("k", F.col("fold")), keys, params, top=None)
    both = single.join(plateau.select(*keys, F.struct(*sig).alias("all")), list(keys))
    return both.select(*keys, F.when(F.col("ties") == 1, F.col("one")).otherwise(F.col("all")).alias("p"), "ties").select(*keys, "p.*", "ties")


# ---- close-fill replay -------------------------------------------------------------------

def close_fill_trades(frame: DataFrame, specs: Sequence[G.Spec], entry_mult: float, exit_mult: float, stop: Column, target: Column | None) -> DataFrame:
    """Trades that enter and leave at closes.

    ``stop`` and ``target`` are levels over ``entry_px, close, atr``, tested on
    the exit price of each later close; a family's own exit leaves on its bar.
    """
    f, rules = L.next_exits(frame.withColumn("nxt", F.struct("i", "t", F.col("close").alias("open"))), specs)
    fired = F.filter(F.array(*[F.when(G.entry_mask(s), F.lit(k)) for k, s in enumerate(specs)]), lambda v: v.isNotNull())
    exits = F.array(*[F.col(rules[G.exit_key(s)]) for s in specs])
    c = f.select(*SERIES, F.col("i").alias("s"), "t", "close", "atr", exits.alias("xs"), F.explode(fired).alias("k"))
    c = c.withColumn("entry_px", F.col("close") * entry_mult).withColumn("x", F.element_at("xs", F.col("k") + 1)).drop("xs")
    levels = c.withColumn("stop", stop).withColumn("target", F.lit(None).cast("double") if target is None else target)
    ends = L.series_ends(frame)
    levels = L.pin(levels.join(ends, list(SERIES)).withColumn("last_i", F.coalesce("x.i", F.col("n") - 1)).withColumn("entry_i", F.col("s") + 1).where("s < n - 1"))
    got = F.col("close") * exit_mult
    flat = frame.select(*SERIES, "i", "t", *[got.alias(p) for p in ("open", "high", "low")])
    out = levels.join(L.first_touch(levels, flat), list(L.ID), "left")
    hit = F.when(F.col("hit").isNotNull(), F.struct(F.col("hit.i").alias("i"), F.col("hit.t").alias("t"), F.col("hit.low").alias("px"),
                                                    F.when(F.col("hit.low") <= F.col("stop"), "stop").otherwise("target").alias("reason")))
    sig = F.when(F.col("x").isNotNull(), F.struct(F.col("x.i").alias("i"), F.col("x.fill_t").alias("t"), (F.col("x.fill_px") * exit_mult).alias("px"), F.col("x.reason").alias("reason")))
    end = F.struct((F.col("n") - 1).alias("i"), F.col("last_t").alias("t"), (F.col("last_close") * exit_mult).alias("px"), F.lit("end").alias("reason"))
    out = out.withColumn("e", F.coalesce(hit, sig, end))
    out = out.select(*L.ID, F.col("t").alias("entry_t"), "entry_px", "stop", F.col("e.i").alias("exit_i"), F.col("e.t").alias("exit_t"),
                     F.col("e.px").alias("exit_px"), F.col("e.reason").alias("reason"))
    return L.thin(out)


def replay(frame: DataFrame, specs: Sequence[G.Spec], fee_rate: float = 0.004, slip: float = 0.001, stop_pct: float = 0.04, target_pct: float = 0.08) -> DataFrame:
    """Close-fill trades with percent levels; ``ret`` is the return on the position after both fees."""
    t = close_fill_trades(frame, specs, 1 + slip, 1 - slip, F.col("entry_px") * (1 - stop_pct), F.col("entry_px") * (1 + target_pct))
    move = F.col("exit_px") / F.col("entry_px")
    return t.withColumn("ret", move - 1 - (1 + move) * fee_rate)


def with_volatility(frame: DataFrame) -> DataFrame:
    """Adds ``vol``, the realised volatility that sizes a position."""
    return realized_vol(frame.withColumn("ret", F.coalesce(ratio("close", "prev_close") - 1, F.lit(0.0))))


def position_share(stop_mult: Column, slip: float = 0.001, max_position: float = 0.25) -> Column:
    """Share of equity a fixed-edge entry would take on a bar (close, atr, vol): volatility target, Kelly and risk at a stop so many ATR away."""
    from tapeworks.functions.costs import kelly, sized_notional
    px = F.col("close") * (1 + slip)
    stop = F.greatest(F.col("close") - F.col("atr") * stop_mult, F.lit(0.0))
    edge = kelly(F.lit(0.52), F.lit(1.2), F.lit(1.0), F.lit(0.6))
    return F.least(sized_notional(F.lit(1.0), px, F.col("vol"), edge, F.greatest(px - stop, px * 0.005)), F.lit(max_position))


# ---- study decisions ---------------------------------------------------------------------

def variant_summary(trades: DataFrame, stress: DataFrame, wf: DataFrame) -> DataFrame:
    """Out-of-sample statistics per variant: pooled, stressed, per coin, per fold, and after selection.

    ``trades`` and ``stress`` carry ``variant, symbol, fold, net_bps, id``; ``wf`` the walk-forward ones.
    """
    base = S.study_stats(trades, ["variant"])
    st = stress.groupBy("variant").agg(F.avg("net_bps").alias("stress_mean"))
    coins = (trades.groupBy("variant", "symbol").agg(F.avg("net_bps").alias("m")).groupBy("variant")
             .agg(F.count_if(F.round("m", 1) > 0).alias("coins_positive")))
    sel = wf.groupBy("variant").agg(F.avg("net_bps").alias("wf_mean"))
    out = base
    for other in (st, coins, sel):
        out = out.join(other, "variant", "left")
    return out.withColumn("coins_positive", F.coalesce("coins_positive", F.lit(0)))


def folds_against(trades: DataFrame, baseline: str, empty: float | None = None) -> DataFrame:
    """In how many folds a variant's mean beats (or trails) the baseline's.

    A fold without trades counts as ``empty`` basis points; with ``None`` it can
    neither beat nor, on the baseline side, be hard to beat.
    """
    m = trades.groupBy("variant", "fold").agg(F.round(F.avg("net_bps"), 6).alias("m"))
    b = m.where(F.col("variant") == baseline).select("fold", F.col("m").alias("bm"))
    variants = trades.select("variant").distinct()
    grid = variants.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(1, FOLDS + 1)])))
    g = grid.join(m, ["variant", "fold"], "left").join(b, "fold", "left")
    fill = float("-inf") if empty is None else empty
    mine, base = F.coalesce("m", F.lit(fill)), F.coalesce("bm", F.lit(fill))
    return g.groupBy("variant").agg(F.count_if(mine > base).alias("folds_better"), F.count_if(mine < base).alias("folds_worse"))


def filter_promotion(summary: DataFrame, folds: DataFrame, baseline: str) -> DataFrame:
    """Seven rules an entry filter must pass against the unfiltered baseline."""
    s = summary.join(folds, "variant", "left")
    b = s.where(F.col("variant") == baseline).select(F.col("mean").alias("base_mean"))
    s = s.withColumn("_all", F.lit(1)).join(b.withColumn("_all", F.lit(1)), "_all", "left").drop("_all")
    above = F.round("mean", 6) > F.round("base_mean", 6)
    checks = [F.col("n") >= 30, (F.col("mean") > 0) & (F.col("base_mean").isNull() | above), F.col("folds_better") >= 3,
              F.col("ex_best2") > 0, F.col("stress_mean") > 0, F.col("coins_positive") >= 2, F.col("wf_mean") > 0]
    return _passed(s, checks, F.col("variant") != baseline)


def variant_promotion(summary: DataFrame, folds: DataFrame, baseline: str) -> DataFrame:
    """Seven rules a parameter variant must pass."""
    s = summary.join(folds, "variant", "left")
    checks = [F.col("n") >= 30, (F.col("mean") > 0) & (F.col("median") > 0), F.col("ex_best2") > 0, F.col("stress_mean") > 0,
              F.col("folds_better") >= 3, F.col("coins_positive") >= 2, F.col("wf_mean") > 0]
    return _passed(s, checks, F.col("variant") != baseline)


def _passed(s: DataFrame, checks: Sequence[Column], eligible: Column) -> DataFrame:
    n = sum((known(c).cast("int") for c in checks[1:]), known(checks[0]).cast("int"))
    return s.withColumn("checks_passed", n).withColumn("promote", eligible & (n == len(checks)))


def improves(base: str, alt: str, min_trades: int = 8) -> Column:
    """Overlay rule on metric structs: mean and return up, drawdown at most one point worse, enough trades."""
    b, a = (lambda c: F.col(f"{base}.{c}")), (lambda c: F.col(f"{alt}.{c}"))
    return known((a("trades") >= min_trades) & (a("avg_net_bps") > b("avg_net_bps")) & (a("total_return_pct") > b("total_return_pct"))
                 & (a("max_dd_pct") <= b("max_dd_pct") + 1.0))


def buy_and_hold(frame: DataFrame, costs: Costs, warm: int = WARM) -> DataFrame:
    """One round trip per series after costs, with the drawdown of the closes held."""
    from tapeworks.operators.scan import block_no, running
    held = frame.where(F.col("i") >= warm).withColumn("_b", block_no("i", 4096))
    held = running(held.select(*SERIES, "i", "open", "close", "_b"), list(SERIES), "_b", ["i"], {"peak": ("max", F.col("close"))})
    out = held.groupBy(*SERIES).agg(F.min_by("open", "i").alias("entry"), F.max_by("close", "i").alias("exit"), F.count(F.lit(1)).alias("bars"),
                                    (F.max((F.col("peak") - F.col("close")) / F.col("peak")) * 100).alias("max_dd_pct"))
    return out.where((F.col("bars") >= 2) & (F.col("entry") > 0) & (F.col("exit") > 0)).withColumn("net_bps", costs.net_return("entry", "exit") * 1e4)


# ---- perpetual short ---------------------------------------------------------------------

def short_trades(frame: DataFrame, spec: G.Spec, leverage: float = 1.0, taker_bps: float = 5.0, bar_hours: float = 1.0) -> DataFrame:
    """Short trades: liquidation first, then a trail, then a close above the slow EMA; net of fees and funding.

    ``frame`` carries ``funding``, the mean hourly rate inside each bar.  Funding
    accrues on every bar held to its close: a difference of two running sums.
    """
    from tapeworks.functions.costs import liquidation_price
    from tapeworks.operators.scan import block_no, running
    f = running(frame.withColumn("_b", block_no("i", 4096)), list(SERIES), "_b", ["i"], {"fund_sum": ("sum", F.coalesce("funding", F.lit(0.0)))}).drop("_b")
    f = L.pin(f)
    c = L.candidates(f, [spec])
    liq = liquidation_price(F.col("entry_px"), F.lit("short"), F.lit(leverage))
    c = c.withColumn("target", liq).withColumn("stop", F.lit(None).cast("double")).withColumn("stop_frac", F.greatest(liq / F.col("entry_px") - 1, F.lit(1e-6)))
    ends = L.series_ends(f)
    c = L.pin(c.join(ends, list(SERIES)).withColumn("last_i", F.coalesce("x.i", F.col("n") - 1)))
    out = c.join(L.first_touch(c, f), list(L.ID), "left").join(short_trail(c, f), list(L.ID), "left")
    h = F.col("hit")
    gap = (h["i"] > F.col("entry_i")) & (h["open"] >= F.col("target"))
    lvl = F.when(h.isNotNull(), F.struct(h["i"].alias("i"), h["t"].alias("t"), F.when(gap, h["open"]).otherwise(F.col("target")).alias("px"),
                                         F.when(gap, "liquidation_gap").otherwise("liquidation").alias("reason")))
    first = F.when(F.col("tr").isNotNull() & (h.isNull() | (F.col("tr.i") < h["i"])), F.col("tr")).otherwise(lvl)
    sig = F.when(F.col("x").isNotNull(), F.struct(F.col("x.fill_i").alias("i"), F.col("x.fill_t").alias("t"), F.col("x.fill_px").alias("px"), F.col("x.reason").alias("reason")))
    end = F.struct((F.col("n") - 1).alias("i"), F.col("last_t").alias("t"), F.col("last_close").alias("px"), F.lit("eod_mark").alias("reason"))
    out = out.withColumn("e", F.coalesce(first, sig, end))
    # bars that were held to their close: up to the signal bar, up to the bar before a level exit, or all of them
    upto = F.when(first.isNotNull(), F.col("e.i") - 1).when(F.col("x").isNotNull(), F.col("x.i")).otherwise(F.col("e.i"))
    out = out.withColumn("upto", upto)
    sums = f.select(*SERIES, F.col("i").alias("j"), "fund_sum")
    out = (out.join(sums.withColumnsRenamed({"j": "upto", "fund_sum": "f1"}), [*SERIES, "upto"], "left")
           .join(sums.select(*SERIES, (F.col("j") + 1).alias("entry_i"), F.col("fund_sum").alias("f0")), [*SERIES, "entry_i"], "left"))
    gross = (F.col("entry_px") - F.col("e.px")) / F.col("entry_px")
    fund = F.when(F.col("upto") >= F.col("entry_i"), F.col("f1") - F.col("f0")).otherwise(0.0) * bar_hours
    out = out.select(*L.ID, "name", "family", "label", "entry_i", F.col("e.i").alias("exit_i"), "entry_t", F.col("e.t").alias("exit_t"), "entry_px",
                     F.col("e.px").alias("exit_px"), "stop_frac", gross.alias("gross"), (gross - 2 * taker_bps / 1e4 + fund).alias("net"),
                     F.col("e.reason").alias("reason"), F.lit("short").alias("regime"))
    return L.thin(out)


def short_trail(cands: DataFrame, bars: DataFrame) -> DataFrame:
    """The ATR trail mirrored for a short: lowest low before the bar, stop above it."""
    mirror = bars.select(*SERIES, "i", "t", (-F.col("open")).alias("open"), (-F.col("low")).alias("high"), (-F.col("high")).alias("low"))
    out = L.trail_exits(cands.withColumn("entry_px", -F.col("entry_px")), mirror)
    return out.select(*L.ID, F.struct(F.col("tr.i").alias("i"), F.col("tr.t").alias("t"), (-F.col("tr.px")).alias("px"), F.col("tr.reason").alias("reason")).alias("tr"))


# ---- signal scoring ----------------------------------------------------------------------

def score_signals(signals: DataFrame, frame: DataFrame, specs: Sequence[G.Spec], now_s: int, costs: Costs = Costs(), expire_days: int = 45) -> DataFrame:
    """What a blocked signal would have earned: scored, no_fill, not_reproduced, expired, unscorable, or still open.

    ``signals``: ``id, symbol, tf, k, t0``; ``k`` is the position of its rule in ``specs``, NULL when none fits.
    """
    scored = L.label(L.candidates(frame, [s.with_(warm=0) for s in specs]), frame, costs)
    bar = frame.select(*SERIES, F.col("t").alias("t0"), F.col("i").alias("s"))
    span = frame.groupBy(*SERIES).agg(F.min("t").alias("t_min"), (F.max("i") + 1).alias("n"))
    limit = F.array(*[F.lit(s.get("entry") == "limit") for s in specs])
    out = signals.join(bar, [*SERIES, "t0"], "left").join(span, list(SERIES), "left")
    out = out.join(scored.select(*L.ID, "entry_px", "exit_px", "exit_t", "entry_t", "reason", "net"), list(L.ID), "left")
    fired, wait = F.col("reason").isNotNull(), F.col("s") + 1 >= F.col("n")
    status = (F.when(now_s < F.col("t0") + 2 * F.col("tf") * 60, "open").when(now_s - F.col("t0") > expire_days * 86_400, "expired")
              .when(F.col("k").isNull(), "unscorable").when(F.col("n").isNull(), "open")
              .when(F.col("s").isNull(), F.when(F.col("t_min") > F.col("t0"), "not_reproduced").otherwise("open"))
              .when(F.col("s") < 60, "not_reproduced").when(fired & (F.col("reason") == "eod_mark"), "open").when(fired, "scored").when(wait, "open")
              .when(F.element_at(limit, F.col("k") + 1), "no_fill").otherwise("not_reproduced"))
    bps = F.when(F.col("status") == "scored", F.col("net") * 1e4).when(F.col("status") == "no_fill", 0.0)
    return out.withColumn("status", status).withColumn("net_bps", bps)


# ---- portfolio curve ---------------------------------------------------------------------

def portfolio_curve(trades: DataFrame, bars: DataFrame, tf_minutes: int, notional: float, costs: Costs, equity: float = 500.0) -> DataFrame:
    """Equity of a given trade list at every bar close of any symbol: cash flows plus positions at their last close.

    Each trade adds its quantity at entry and takes it away at exit, so the
    quantity held is a running sum per symbol, not a join of trades with bars.
    A symbol's worth changes at its own bars only: the book is the running sum of
    these changes over time, and a symbol without a bar keeps what it had.
    """
    from tapeworks.operators.bars import BARS_PER_BLOCK
    from tapeworks.operators.scan import previous, running
    fee, slip, s = costs.fee_bps / 1e4, costs.slippage_bps / 1e4, tf_minutes * 60
    qty = notional * (1 - fee) / (F.col("entry_px") * (1 + slip))
    back = qty * F.col("exit_px") * (1 - slip) * (1 - fee)
    t = trades.select("symbol", "entry_t", "exit_t", qty.alias("q"), back.alias("back"))
    zero = F.lit(0.0)
    flows = (t.select("symbol", F.col("entry_t").alias("t"), F.col("q").alias("dq"), F.lit(-notional).alias("cash"), F.lit(notional).alias("cost"))
             .unionByName(t.select("symbol", F.col("exit_t").alias("t"), (-F.col("q")).alias("dq"), F.col("back").alias("cash"), F.lit(-notional).alias("cost"))))
    flows = flows.groupBy("symbol", "t").agg(F.sum("dq").alias("dq"), F.sum("cash").alias("cash"), F.sum("cost").alias("cost"))
    b = bars.select("symbol", "t", "close").join(flows, ["symbol", "t"], "left").withColumn("blk", F.floor(F.col("t") / (s * BARS_PER_BLOCK)).cast("long"))
    b = running(b, ["symbol"], "blk", ["t"], {"qty": ("sum", F.coalesce("dq", zero)), "bank": ("sum", F.coalesce("cash", zero)), "open_cost": ("sum", F.coalesce("cost", zero))})
    b = b.withColumns({"worth": F.col("bank") + F.col("qty") * F.col("close"), "settled": F.col("bank") + F.col("open_cost")})
    b = previous(b, ["symbol"], "blk", ["t"], {"worth": "worth0", "settled": "settled0"})
    change = lambda c: F.sum(F.col(c) - F.coalesce(f"{c}0", zero)).alias(c)
    out = b.groupBy("t").agg(change("worth"), change("settled")).withColumn("blk", F.floor(F.col("t") / (s * BARS_PER_BLOCK)).cast("long"))
    out = running(out, [], "blk", ["t"], {"equity": ("sum", F.col("worth")), "realized": ("sum", F.col("settled"))}).drop("worth", "settled")
    out = out.withColumns({c: equity + F.col(c) for c in ("equity", "realized")})
    out = running(out, [], "blk", ["t"], {"peak": ("max", F.col("equity")), "rpeak": ("max", F.greatest(F.col("realized"), F.lit(equity)))})
    return out.drop("blk")


# ---- studies -----------------------------------------------------------------------------

def as_variants(specs: Sequence[G.Spec], variants: dict[str, dict]) -> list[G.Spec]:
    """Every spec under every variant's parameters; the variant becomes the family to choose from."""
    return [G.Spec(s.name, {**s.params, **more}, name) for name, more in variants.items() for s in specs]


def study(frame: DataFrame, specs: Sequence[G.Spec], costs: Costs, stress: Costs, folds: int = FOLDS, warm: int = WARM) -> dict[str, DataFrame]:
    """Trades of all variants, out of sample: the fixed first spec, the same under stress costs, and after selection.

    Exits do not depend on costs, so stress returns come from the same trades.
    """
    t = L.pin(L.trades(frame, specs, costs))
    ends = L.series_ends(frame)
    first = {}
    for k, s in enumerate(specs):
        first.setdefault(s.family, k)
    seg = attach_segment(t, ends, folds, warm).where("seg >= 1").withColumn("variant", F.col("family")).withColumn("fold", F.col("seg"))
    seg = seg.withColumn("id", F.concat_ws("|", "symbol", "k", "s"))
    fixed = seg.where(F.col("k").isin(list(first.values())))
    hard = stress.net_return("entry_px", "exit_px", F.col("limit_entry"), F.col("reason") == "tp") * 1e4
    wf = walk_forward(t, ends, specs, folds, warm).where("part = 'oos'").withColumn("variant", F.col("family"))
    return {"fixed": fixed.withColumn("net_bps", F.col("net") * 1e4), "stress": fixed.withColumn("net_bps", hard),
            "selected": wf.withColumn("net_bps", F.col("net") * 1e4), "trades": t}


def filter_study(frame: DataFrame, specs: Sequence[G.Spec], filters: Sequence[str], costs: Costs, stress: Costs) -> DataFrame:
    """Which order-flow filters improve a rule family enough to be switched on."""
    variants = {"none": {}, **{f: {"flt": f} for f in filters}}
    r = study(frame, as_variants(specs, variants), costs, stress)
    s = variant_summary(r["fixed"], r["stress"], r["selected"])
    return filter_promotion(s, folds_against(r["fixed"], "none"), "none")


def daily_filter_study(frame: DataFrame, specs: Sequence[G.Spec], costs: Costs, stress: Costs) -> DataFrame:
    """Whether the daily filter clearly hurts a family: a lower sum and at least three worse folds."""
    r = study(frame, as_variants(specs, {"none": {"d1": False}, "d1": {"d1": True}}), costs, stress)
    s = variant_summary(r["fixed"], r["stress"], r["selected"]).join(folds_against(r["fixed"], "none", 0.0), "variant", "left")
    b = s.where("variant = 'none'").select(F.col("total").alias("base_total"), F.lit(1).alias("_all"))
    s = s.withColumn("_all", F.lit(1)).join(b, "_all", "left").drop("_all")
    return s.withColumn("clearly_hurts", known((F.col("variant") == "d1") & (F.round("total", 6) < F.round("base_total", 6)) & (F.col("folds_worse") >= 3)))


def time_edges(ends_frame: DataFrame, folds: int = FOLDS, warm: int = WARM) -> DataFrame:
    """Fold edges as times, from the bars of one reference timeframe per symbol."""
    e = edge_table(L.series_ends(ends_frame), folds, warm).where("seg >= 1")
    at = ends_frame.select(*SERIES, F.col("i").alias("lo"), F.col("t").alias("from_t"))
    lo = e.join(at, [*SERIES, "lo"])
    hi = ends_frame.select(*SERIES, F.col("i").alias("hi"), F.col("t").alias("to_t"))
    both = lo.join(hi, [*SERIES, "hi"], "left")
    return both.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("from_t", "to_t", F.col("seg").alias("fold")))).alias("edges"))


def fold_by_time(trades: DataFrame, edges: DataFrame) -> DataFrame:
    """Fold of each trade by entry time; trades outside every fold drop out."""
    inside = F.filter("edges", lambda e: (e["from_t"] <= F.col("entry_t")) & (e["to_t"].isNull() | (F.col("entry_t") < e["to_t"])))
    out = trades.join(edges, "symbol").withColumn("fold", F.try_element_at(inside, F.lit(1))["fold"]).drop("edges")
    return out.where(F.col("fold").isNotNull())


def grid_study(frame: DataFrame, specs: Sequence[G.Spec], baseline: str, costs: Costs, stress: Costs, edges: DataFrame) -> DataFrame:
    """Parameter grid against a baseline, folds by time, selection over the whole grid per timeframe."""
    pool = [G.Spec(s.name, s.params, "all") for s in specs]
    t = L.pin(L.trades(frame, pool, costs))
    label = F.concat_ws("_", F.col("tf").cast("string"), F.col("label"))
    timed = fold_by_time(t, edges).withColumn("variant", label).withColumn("id", F.concat_ws("|", "symbol", "k", "s")).withColumn("net_bps", F.col("net") * 1e4)
    hard = timed.withColumn("net_bps", stress.net_return("entry_px", "exit_px", F.col("limit_entry"), F.col("reason") == "tp") * 1e4)
    wf = walk_forward(t, L.series_ends(frame), pool).where("part = 'oos'").groupBy("tf").agg((F.avg("net") * 1e4).alias("wf_mean"))
    none = timed.where("false")
    s = variant_summary(timed, hard, none).drop("wf_mean").join(timed.select("variant", "tf").distinct(), "variant").join(wf, "tf", "left")
    return variant_promotion(s, folds_against(timed, baseline, 0.0), baseline)


def overlay_study(frame: DataFrame, base: G.Spec, grid: Sequence[tuple[float, float]], costs: Costs) -> DataFrame:
    """Out-of-sample metrics of a rule with and without ATR trails, and which trail improves it."""
    specs = [G.Spec(base.name, base.params, "base")] + [G.Spec(base.name, {**base.params, "trail_activate_atr": a, "trail_atr": m}, f"trail_{a:g}_{m:g}") for a, m in grid]
    t = attach_segment(L.trades(frame, specs, costs), L.series_ends(frame)).where("seg >= 1")
    m = S.metrics(t, ["family"], ["entry_t", "symbol", "s"])
    cols = F.struct("trades", "avg_net_bps", "total_return_pct", "max_dd_pct")
    b = m.where("family = 'base'").select(cols.alias("b"), F.lit(1).alias("_all"))
    out = m.select("family", cols.alias("a"), F.lit(1).alias("_all")).join(b, "_all").drop("_all")
    return out.select("family", "a.*", (improves("b", "a") & (F.col("family") != "base")).alias("promote"))


def family_search(frame: DataFrame, library: dict[str, list[G.Spec]], costs: Costs, equity: float = 500.0) -> DataFrame:
    """Pooled walk-forward of every family on every timeframe of an hour or more, with the promotion bar."""
    specs = [s for v in library.values() for s in v]
    slow = frame.where(F.col("tf") >= 60)
    t = L.pin(L.trades(slow, specs, costs))
    oos = L.pin(walk_forward(t, L.series_ends(slow), specs).where("part = 'oos'").withColumn("id", F.concat_ws("|", "symbol", "k", "s")))
    size = F.least(equity * 0.01 / F.greatest("stop_frac", F.lit(1e-6)), F.lit(equity * 0.40))
    rows = oos.withColumn("net_bps", F.col("net") * 1e4).withColumn("pnl", size * F.col("net"))
    bar = S.promotion(rows, ["tf", "family"]).select("tf", "family", "mean", "lower", "ex_best2", "passes", "failed")
    m = S.metrics(oos, ["tf", "family"], ["entry_t", "symbol", "s"], equity).select("tf", "family", "trades", "avg_net_bps", "total_return_pct", "max_dd_pct")
    hold = buy_and_hold(slow, costs).groupBy("tf").agg(F.avg("net_bps").alias("hold_bps"))
    return m.join(bar, ["tf", "family"]).join(hold, "tf", "left")


def rolling_optimisation(bars: DataFrame, specs: Sequence[G.Spec], params: Sequence[str], is_bars: int, oos_bars: int, step: int, embargo: int,
                         featurize, holdout_frac: float = 0.15, lam: float = 1.5, gamma: float = 0.15, periods: int = 365) -> dict[str, DataFrame]:
    """Rolling optimisation with embargo and hold-out.

    Every fold's in-sample and out-of-sample stretch becomes a series of its
    own, so indicators restart in it.  Each spec is replayed on all of them in
    one job.  A fold deploys the plateau of its best three in-sample scores; the
    parameter set most folds agree on is replayed on the hold-out.  Deployed
    parameters are columns of the slice they are replayed on.
    """
    ends = L.series_ends(bars)
    hold_n = F.greatest(F.floor(F.col("n") * holdout_frac), F.lit(oos_bars))
    research = ends.withColumn("n", F.col("n") - hold_n)
    splits = rolling_splits(research, is_bars, oos_bars, step, embargo)
    hold = ends.select(*SERIES, F.lit(0).cast("long").alias("fold"), (F.col("n") - hold_n).alias("lo"), F.col("n").alias("hi"))
    parts = slice_series(bars, splits, "is_start", "is_end", "is").unionByName(slice_series(bars, splits, "oos_start", "oos_end", "oos"))
    parts = L.pin(parts.unionByName(slice_series(bars, hold, "lo", "hi", "hold")))
    sized = L.pin(with_volatility(featurize(parts)))
    grid = range(len(specs))
    table = bars.sparkSession.createDataFrame([(k, s.name, *[float(s.get(p, 0.0)) for p in params]) for k, s in enumerate(specs)],
                                              "k int, strategy string, " + ", ".join(f"{p} double" for p in params))
    mults = F.element_at(F.array(*[F.lit(float(s.get("atr_stop", 1.5))) for s in specs]), F.col("k") + 1)
    m = L.pin(graded_replay(sized, [s.with_(warm=0) for s in specs], grid, mults, lam, gamma, periods))
    scored = m.where("part = 'is'").join(F.broadcast(table), "k")
    chosen = L.pin(plateau_pick(scored, ["base", "fold"], params))
    agreed = consensus(chosen, ["base"], params)
    named = [F.col(c).alias(f"p_{c}") for c in ("strategy", *params)]
    oos = sized.where("part = 'oos'").join(chosen.select("base", "fold", *named), ["base", "fold"])
    hold = sized.where("part = 'hold'").join(agreed.select("base", *named), "base")
    deployed = L.pin(oos.unionByName(hold))
    d = L.pin(graded_replay(deployed, [G.Spec("deployed", {"warm": 0})], range(1), F.col("p_atr_stop") if "atr_stop" in params else F.lit(1.5), lam, gamma, periods).drop("k"))
    folds = S.fold_summary(d.where("part = 'oos'").withColumnRenamed("trades", "n_trades"), ["base"])
    held = d.where("part = 'hold'").select("base", F.col("trades").alias("hold_trades"), F.col("score").alias("hold_score"))
    report = folds.join(held, "base").join(agreed, "base")
    report = report.withColumn("verdict", S.verdict(F.col("hold_trades"), F.col("hold_score")))
    return {"metrics": m, "chosen": chosen, "deployed": d, "report": report, "splits": splits}


def graded_replay(sized: DataFrame, specs: Sequence[G.Spec], grid: Sequence[int], stop_mult: Column, lam: float, gamma: float, periods: int) -> DataFrame:
    """Replay specs on every slice and grade them: Sharpe less penalties for drawdown and turnover; -10 under three trades.

    ``stop_mult``: the stop's distance in ATR, over the columns of ``sized`` and the spec's number ``k``.
    """
    own = [c for c in sized.columns if c in ("close", "atr", "vol", "base", "fold", "part") or c.startswith("p_")]
    t = replay(sized, specs).join(sized.select(*SERIES, F.col("i").alias("s"), *own), [*SERIES, "s"]).withColumn("share", position_share(stop_mult))
    t = L.pin(t.withColumns({"net": F.col("ret"), "gross": F.col("ret"), "stop_frac": F.lit(0.01) / F.greatest("share", F.lit(1e-9))}))
    keys = ["base", "part", "fold", "k"]
    m = S.metrics(t, keys, ["s"], 1000.0, 0.01, 1.0).select(*keys, "trades", "win_rate", (F.col("total_return_pct") / 100).alias("total_return"), (F.col("max_dd_pct") / 100).alias("max_dd"))
    sh = t.groupBy(*keys).agg(S.sharpe("ret", periods).alias("sharpe"), F.avg("ret").alias("expectancy"))
    bars_in = sized.groupBy("base", "part", "fold").agg(F.count(F.lit(1)).alias("bars"))
    ks = F.explode(F.array(*[F.lit(k) for k in grid])).alias("k")
    m = bars_in.select("*", ks).join(m, keys, "left").join(sh, keys, "left").fillna(0, ["trades"]).fillna(0.0, ["win_rate", "total_return", "max_dd", "sharpe", "expectancy"])
    score = F.when(F.col("trades") < 3, -10.0).otherwise(F.col("sharpe") - lam * F.col("max_dd") - gamma * F.col("trades") / F.greatest("bars", F.lit(1)))
    return m.withColumn("score", score)


def bench_bootstrap(pool: DataFrame, sims: int, trades: int, keys: Sequence[str] = ("sleeve",), value: str = "net_bps") -> DataFrame:
    """Per key, the share of resampled trade sequences in which the bench rule fires at least once.

    A draw is a counter-based number, the MD5 of simulation and draw, modulo the pool's
    size; it meets the pool's dense ordinals in an equi-join. So every run and every retry
    picks the same trades, and each sleeve is resampled from its own.
    """
    from tapeworks.operators.scan import ordinals, range_blocks
    keys = list(keys)
    numbered = ordinals(range_blocks(pool, keys, ["id"]), keys, "blk", ["id"], "pick").select(*keys, "pick", value)
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "sim", "no")), 1, 12), 16, 10).cast("bigint")
    draws = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    draws = draws.repartition(*keys, "sim").withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(trades - 1))))
    draws = draws.withColumn("pick", number % F.col("size")).join(numbered, [*keys, "pick"])
    w = Window.partitionBy(*keys, "sim").orderBy("no").rowsBetween(-(S.WINDOW - 1), 0)
    b = draws.withColumns({f"b_{k}": c for k, c in S.mean_bounds(value, w).items()})
    per = b.groupBy(*keys, "sim").agg(F.max(known((F.col("b_n") >= S.MIN_SAMPLE) & (F.col("b_upper") < 0) & (F.col("no") < trades - 1)).cast("int")).alias("hit"), F.avg(value).alias("m"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("sims"), F.avg("hit").alias("p_any_bench"), F.avg("m").alias("mean_bps"))
