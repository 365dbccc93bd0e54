"""Positions, lots, orders and their reconciliation."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.core import known, ratio
from tapeworks.operators.asof import asof_join
from tapeworks.operators.scan import block_no, compose_scan, range_blocks, running, split_blocks
from tapeworks.session import pin

EXACT = "decimal(28,8)"
MAP_ROWS = 1024


# ---- excursions --------------------------------------------------------------------------

def excursions(trades: DataFrame, bars: DataFrame, tf_minutes: int, block_bars: int = 64) -> DataFrame:
    """Worst and best price of each holding period in bps of the entry, entry bar included.

    The first and last block of a holding period are searched bar by bar, the
    blocks between by their low and high.
    """
    s = tf_minutes * 60
    b = bars.select("symbol", "t", "low", "high", block_no(F.col("t") / s, block_bars).alias("b"))
    spans = b.groupBy("symbol", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    first, last = F.floor(F.col("entry_us") / 1e6 / s) * s, F.floor(F.col("exit_us") / 1e6 / s) * s
    t = trades.select("symbol", "entry_id", "entry_px", first.alias("t0"), last.alias("t1"))
    t = t.withColumns({"b0": block_no(F.col("t0") / s, block_bars), "b1": block_no(F.col("t1") / s, block_bars)})
    edges = (t.withColumn("b", F.explode(F.array_distinct(F.array("b0", "b1")))).join(b, ["symbol", "b"])
             .where((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1"))).select("symbol", "entry_id", "low", "high"))
    inner = (t.where(F.col("b1") - F.col("b0") > 1).withColumn("b", F.explode(F.sequence(F.col("b0") + 1, F.col("b1") - 1)))
             .join(spans, ["symbol", "b"]).select("symbol", "entry_id", "low", "high"))
    both = edges.unionByName(inner).groupBy("symbol", "entry_id").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    out = trades.join(both, ["symbol", "entry_id"], "left")
    return out.withColumns({"mae_bps": (F.col("lo") / F.col("entry_px") - 1) * 1e4, "mfe_bps": (F.col("hi") / F.col("entry_px") - 1) * 1e4}).drop("lo", "hi")


# ---- lots --------------------------------------------------------------------------------

def inventory(fills: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Quantity held before and after each fill; a sell beyond it closes only what is there.

    The floor at zero is a reflected walk: the running sum less its running
    minimum below zero.  A block contributes its sum and its lowest prefix, so
    both runs need one carry table.
    """
    b = range_blocks(fills, keys, order)
    on, zero = [*keys, "blk"], F.lit(0.0)
    here = Window.partitionBy(*on).orderBy(*order)
    upto, past = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_d", F.when(F.col("side") == "buy", F.col("vol")).otherwise(-F.col("vol"))).withColumn("_s", F.sum("_d").over(upto))
    carry = b.groupBy(*on).agg(F.sum("_d").alias("_t"), F.min("_s").alias("_low"))
    carry = carry.withColumn("_s0", F.coalesce(F.sum("_t").over(before), zero))
    carry = carry.withColumn("_m0", F.coalesce(F.min(F.col("_s0") + F.col("_low")).over(before), zero)).select(*on, "_s0", "_m0")
    b = b.withColumns({"_lo": F.min("_s").over(upto), "_lo_past": F.min("_s").over(past)}).join(carry, on)
    floor = lambda low: F.least(zero, F.col("_m0"), F.col("_s0") + F.col(low))
    after = F.col("_s0") + F.col("_s")
    b = b.withColumns({"held": after - floor("_lo"), "held_before": after - F.col("_d") - floor("_lo_past")})
    closed = F.when(F.col("side") == "sell", F.col("held_before") - F.col("held")).otherwise(0.0)
    return pin(b.withColumn("closed", closed).drop("_d", "_s", "_lo", "_lo_past", "_s0", "_m0"))


def fifo_pnl(fills: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Realised profit of each sell against the oldest bought units.

    Bought and sold units are numbered on one axis: the cost of the units a sell
    takes is a difference of the cumulative cost curve of the buys, read by an
    as-of join at the two ends of the sell.  The curve is summed in decimals.
    """
    inv = inventory(fills, keys, order)
    buy, paid = F.col("side") == "buy", (F.col("vol") * F.col("price")).cast(EXACT)
    c = pin(running(inv, keys, "blk", order, {
        "bought": ("sum", F.when(buy, F.col("vol")).otherwise(0.0)), "spent": ("sum", F.when(buy, paid).otherwise(0).cast(EXACT)),
        "sold": ("sum", F.col("closed"))}))
    lots = c.where(buy).select(*keys, (F.col("bought") - F.col("vol")).alias("from_unit"), (F.col("spent") - paid).alias("cost0"), "price")
    ends = c.where(~buy & (F.col("closed") > 0)).select(*keys, *order, F.col("closed"), F.col("price").alias("sell_px"),
                                                        F.explode(F.array(F.struct((F.col("sold") - F.col("closed")).alias("x"), F.lit(-1.0).alias("sign")),
                                                                          F.struct(F.col("sold").alias("x"), F.lit(1.0).alias("sign")))).alias("p"))
    ends = ends.select("*", F.col("p.x").alias("x"), F.col("p.sign").alias("sign")).drop("p")
    at = asof_join(ends, lots, keys, "x", "from_unit", ["from_unit", "cost0", "price"])
    whole = F.sum(F.when(F.col("sign") > 0, F.col("cost0")).otherwise(-F.col("cost0"))).cast("double")
    part = F.sum(F.col("sign") * (F.col("x") - F.col("from_unit")) * F.col("price"))
    return (at.groupBy(*keys, *order, "closed", "sell_px").agg((whole + part).alias("cost"))
            .withColumn("pnl", F.col("closed") * F.col("sell_px") - F.col("cost")))


def average_cost(fills: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Average-cost lots: fee-inclusive basis, fee-free entry price and realised profit per sell.

    Quantities come from the reflected walk.  Basis and entry price are then affine in
    their previous value, and so is the basis before the fill: three affine maps of the
    lot, composed in a scan.  ``exceeds`` marks sells larger than the lot.
    """
    inv = split_blocks(inventory(fills, keys, order), keys, "blk", order, MAP_ROWS)
    buy, was, now, zero, one = F.col("side") == "buy", F.col("held_before"), F.col("held"), F.lit(0.0), F.lit(1.0)
    affine = {"basis": (F.when(buy, one).when(was > 0, now / was).otherwise(zero), F.when(buy, F.col("cost") + F.col("fee")).otherwise(zero)),
              "entry": (F.when(buy, was / now).otherwise(one), F.when(buy, F.col("cost") / now).otherwise(zero)), "before": (one, zero)}
    pairs = [(f"{n}_{part}", c) for n, ab in affine.items() for part, c in zip("ab", ab)]

    def compose(p: Column, q: Column) -> Column:
        over = {"basis": "basis", "entry": "entry", "before": "basis"}  # what stood before a fill is the basis up to the one before
        return F.struct(*[x for n, src in over.items() for x in ((p[f"{src}_a"] * q[f"{n}_a"]).alias(f"{n}_a"), (q[f"{n}_a"] * p[f"{src}_b"] + q[f"{n}_b"]).alias(f"{n}_b"))])

    out = compose_scan(inv, keys, "blk", order, F.struct(*[c.cast("double").alias(n) for n, c in pairs]), compose, "_lot", MAP_ROWS)
    out = out.withColumns({"basis": F.col("_lot.basis_b"), "entry_price": F.col("_lot.entry_b")})  # a lot starts at zero
    gain = F.col("closed") * F.col("price") - F.col("fee") - (F.col("_lot.before_b") - F.col("basis"))
    out = out.withColumn("pnl", F.when((F.col("side") == "sell") & (F.col("closed") > 0), gain).otherwise(0.0)).drop("_lot")
    return out.withColumn("exceeds", (F.col("side") == "sell") & (F.col("vol") > F.col("held_before")))


def risk_scale(trades: DataFrame, keys: Sequence[str], order: Sequence[str], start: float = 1.0, step: float = 0.15,
               low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Risk scale that moves up on a win and down on a loss, clamped at every step, with streaks.

    A run of clamped steps is itself one clamped step: a shift, then a floor and a ceiling.
    Streaks are differences of counts since the last trade of the other kind.
    """
    b = split_blocks(range_blocks(trades, keys, order), keys, "blk", order, MAP_ROWS)
    won, lost, inf = F.col("pnl") > 0, F.col("pnl") < 0, F.lit(float("inf"))
    move = F.struct(F.when(won, step).when(lost, -step).otherwise(0.0).alias("d"), F.when(lost, F.lit(low)).otherwise(-inf).alias("lo"), F.when(won, F.lit(high)).otherwise(inf).alias("hi"))
    clamp = lambda x, m: F.least(m["hi"], F.greatest(m["lo"], x + m["d"]))
    both = lambda p, q: F.struct((p["d"] + q["d"]).alias("d"), clamp(p["lo"], q).alias("lo"), clamp(p["hi"], q).alias("hi"))
    out = compose_scan(b, keys, "blk", order, move, both, "_move", MAP_ROWS).withColumn("risk_scale", clamp(F.lit(start), F.col("_move"))).drop("_move")
    out = running(out, keys, "blk", order, {"_w": ("sum", F.coalesce(won, F.lit(False)).cast("int")), "_l": ("sum", F.coalesce(lost, F.lit(False)).cast("int"))})
    out = running(out, keys, "blk", order, {"_w0": ("last", F.when(lost, F.col("_w"))), "_l0": ("last", F.when(won, F.col("_l")))})
    streak = lambda n, n0: (F.col(n) - F.coalesce(n0, F.lit(0))).cast("int")
    return out.withColumns({"win_streak": streak("_w", "_w0"), "loss_streak": streak("_l", "_l0")}).drop("blk", "_w", "_l", "_w0", "_l0")


# ---- valuation ---------------------------------------------------------------------------

def mark_positions(positions: DataFrame, prices: DataFrame, cash: float) -> DataFrame:
    """Open positions at market; without a price at their entry."""
    p = positions.where(F.col("quantity") > 1e-12).join(prices, "symbol", "left")
    p = p.withColumn("market_value", F.col("quantity") * F.coalesce("price", "entry_price"))
    cost = F.col("quantity") * F.col("entry_price") + F.coalesce("fees_paid", F.lit(0.0))
    return p.withColumns({"cost_basis": cost, "unrealized": F.col("market_value") - cost})


def book_summary(marked: DataFrame, cash: float) -> DataFrame:
    out = marked.agg(F.sum("market_value").alias("positions_value"), F.sum(F.col("quantity") * F.col("entry_price")).alias("cost_basis_open"), F.count(F.lit(1)).alias("open_positions"))
    eq = cash + F.coalesce("positions_value", F.lit(0.0))
    return out.withColumns({"equity": eq, "exposure_pct": F.when(eq > 0, F.col("positions_value") / eq * 100)})


# ---- reconciliation ----------------------------------------------------------------------

def violations(*rules: tuple[Column, str, Column, Column]) -> tuple[Column, Column]:
    """Whether any of the rules (condition, name, expected, actual) is broken, and the broken ones as a list of (rule, expected, actual)."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    found = [F.when(known(c), F.struct(F.lit(rule).alias("rule"), text(e).alias("expected"), text(x).alias("actual"))) for c, rule, e, x in rules]
    return reduce(Column.__or__, [known(c) for c, *_ in rules]), F.filter(F.array(*found), lambda v: v.isNotNull())


def reconcile_orders(orders: DataFrame, fills: DataFrame, ledger: DataFrame) -> DataFrame:
    """Three-way check of orders, fills and ledger in exact decimals: one row per violation.

    ``orders(order_id, symbol, side, vol, cost, fee)``, ``fills(fill_id, order_id, symbol, side, vol, cost, fee)``,
    ``ledger(refid, leg, amount, fee)`` with one ``base`` and one ``quote`` leg per fill.

    Amounts are judged where a fill meets its legs, totals where an order meets its fills in one
    aggregate; only ids and what was found travel on to the orders. Texts are made for broken rules alone.
    """
    d = lambda c: F.col(c).cast(EXACT)
    legs = ledger.groupBy("refid").agg(
        F.count(F.lit(1)).alias("legs"), F.count_if(F.col("leg") == "base").alias("base_legs"), F.count_if(F.col("leg") == "quote").alias("quote_legs"),
        F.sum(F.when(F.col("leg") == "base", d("amount"))).alias("base_amount"), F.sum(F.when(F.col("leg") == "quote", d("amount"))).alias("quote_amount"),
        F.sum(F.when(F.col("leg") == "base", d("fee"))).alias("base_fee"), F.sum(F.when(F.col("leg") == "quote", d("fee"))).alias("quote_fee"))
    # Copies are few: dealing fills out first spares a sort before the exchange.
    ids = fills.repartition("fill_id").groupBy("fill_id").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("order_id", "symbol", "side", "vol", "cost", "fee")).alias("f"))
    o = orders.select("order_id", F.col("symbol").alias("o_symbol"), F.col("side").alias("o_side"))
    j = ids.select("fill_id", "copies", "f.*").join(legs, F.col("fill_id") == F.col("refid"), "full_outer")
    has, sign = F.col("fill_id").isNotNull(), F.when(F.col("side") == "buy", 1).otherwise(-1)
    one_one = (F.col("legs") == 2) & (F.col("base_legs") == 1) & (F.col("quote_legs") == 1)
    broken, found = violations(
        (F.col("copies") > 1, "duplicate_fill", F.lit(1), F.col("copies")),
        (~has, "ledger_without_fill", F.lit(None), F.col("refid")),
        (has & ~known(one_one), "ledger_legs", F.lit(2), F.coalesce("legs", F.lit(0))),
        (has & known(one_one) & (F.col("base_amount") != sign * d("vol")), "base_amount", sign * d("vol"), F.col("base_amount")),
        (has & known(one_one) & (F.col("quote_amount") != -sign * d("cost")), "quote_amount", -sign * d("cost"), F.col("quote_amount")),
        (has & known(one_one) & ((F.col("base_fee") != 0) | (F.col("quote_fee") != d("fee"))), "ledger_fee", d("fee"), F.col("quote_fee")))
    j = j.select(F.coalesce("fill_id", "refid").alias("key"), has.alias("has"), "order_id", "symbol", "side", F.when(broken, found).alias("own")).join(o, "order_id", "left")
    broken, found = violations(
        (F.col("has") & F.col("o_symbol").isNull(), "fill_without_order", F.col("order_id"), F.lit(None)),
        ((F.col("o_symbol") != F.col("symbol")) | (F.col("o_side") != F.col("side")), "fill_attribution", F.concat_ws("/", "o_symbol", "o_side"), F.concat_ws("/", "symbol", "side")))
    a = j.where(F.col("own").isNotNull() | broken).select("key", F.explode(F.when(F.col("own").isNull(), found).otherwise(F.concat("own", found))).alias("v"))
    amounts, none = ("vol", "cost", "fee"), F.lit(None).cast(EXACT)
    both = orders.select("order_id", F.lit(True).alias("listed"), *[d(c).alias(c) for c in amounts], *[none.alias(f"f_{c}") for c in amounts]).unionByName(
        fills.where("order_id IS NOT NULL").select("order_id", F.lit(False).alias("listed"), *[none.alias(c) for c in amounts], *[d(c).alias(f"f_{c}") for c in amounts]))
    t = both.groupBy("order_id").agg(*[F.max(c).alias(c) for c in amounts], *[F.sum(f"f_{c}").alias(f"f_{c}") for c in amounts],
                                     F.count_if("listed").alias("copies"), F.count_if(~F.col("listed")).alias("n"))
    broken, found = violations(
        (F.col("copies") > 1, "duplicate_order", F.lit(1), F.col("copies")),
        ((F.col("n") == 0) & (F.col("vol") > 0), "order_without_fills", F.col("vol"), F.lit(None)),
        *[((F.col("n") > 0) & (F.col(c) != F.col(f"f_{c}")), f"total_{c}", F.col(c), F.col(f"f_{c}")) for c in amounts])
    b = t.where((F.col("copies") > 0) & broken).select(F.col("order_id").cast("string").alias("key"), F.explode(found).alias("v"))
    return a.select("key", "v.*").unionByName(b.select("key", "v.*"))


def reconcile_balances(ledger: DataFrame, balances: DataFrame) -> DataFrame:
    """Assets whose ledger sum (amount less fee) differs from the balance."""
    total = ledger.groupBy("asset").agg(F.sum(F.col("amount").cast(EXACT) - F.col("fee").cast(EXACT)).alias("ledger_sum"))
    both = total.join(balances.select("asset", F.col("balance").cast(EXACT).alias("balance")), "asset", "full_outer")
    zero = F.lit(0).cast(EXACT)
    return both.where(F.coalesce("ledger_sum", zero) != F.coalesce("balance", zero))


def unprotected_lots(lots: DataFrame, stops: DataFrame) -> DataFrame:
    """Open lots whose resting stop orders do not add up to the lot."""
    cover = stops.groupBy("symbol").agg(F.sum(F.col("vol").cast(EXACT) - F.col("vol_exec").cast(EXACT)).alias("covered"))
    out = lots.where(F.col("qty") > 0).join(cover, "symbol", "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast(EXACT)))
    return out.where(F.col("covered") != F.col("qty").cast(EXACT))


def order_faults(orders: DataFrame) -> DataFrame:
    """Orders whose own numbers contradict each other."""
    num = lambda c: F.coalesce(F.col(c) >= 0, F.lit(False)) & ~F.isnan(c) & (F.col(c) < float("inf"))
    fault = (F.when(~(num("vol") & num("vol_exec") & num("cost") & num("fee")), "invalid_numbers")
             .when((F.col("vol") <= 0) | (F.col("vol_exec") > F.col("vol")) | ((F.col("vol_exec") > 0) & (F.col("cost") <= 0)), "inconsistent_quantity")
             .when((F.col("vol_exec") == 0) & ((F.col("cost") != 0) | (F.col("fee") != 0)), "unfilled_with_costs")
             .when(~F.col("status").isin("pending", "open", "closed", "canceled", "expired"), "unknown_status"))
    return orders.withColumn("fault", fault).where("fault is not null")


def unmanaged(active: DataFrame, managed: DataFrame) -> DataFrame:
    """Symbols with a position or an open order that nothing manages."""
    flat = F.replace(F.col("symbol"), F.lit("/"), F.lit(""))
    return active.select(flat.alias("symbol")).distinct().join(managed.select(flat.alias("symbol")), "symbol", "left_anti")


def order_executions(fills: DataFrame, signals: DataFrame) -> DataFrame:
    """Per order: filled volume, mean price (cost over volume) and slippage against us in dollars and bps."""
    e = fills.groupBy("order_id", "symbol", "side").agg(*[F.sum(F.col(c).cast(EXACT)).cast("double").alias(n) for c, n in (("vol", "volume"), ("cost", "cost"), ("fee", "fee"))])
    e = e.withColumn("fill_price", ratio("cost", "volume")).join(signals, "order_id", "left")
    signal = F.coalesce("signal_price", F.lit(0.0))
    usd = F.when(F.col("side") == "buy", F.col("fill_price") - signal).otherwise(signal - F.col("fill_price"))
    return e.withColumns({"slippage_usd": usd, "slippage_bps": F.when(signal > 0, usd / signal * 1e4).otherwise(0.0)})


def slippage_summary(executions: DataFrame) -> DataFrame:
    measured = F.col("signal_price") > 0
    return executions.agg(F.count(F.lit(1)).alias("executions"), F.count_if(measured).alias("measured"),
                          F.coalesce(F.avg(F.when(measured, F.col("slippage_usd"))), F.lit(0.0)).alias("avg_usd"),
                          F.coalesce(F.avg(F.when(measured, F.col("slippage_bps"))), F.lit(0.0)).alias("avg_bps"))


# ---- candidates --------------------------------------------------------------------------

def selection_bias(expectancy: Column, trades: Column, min_trades: int = 3) -> Column:
    """Learned multiplier in [0.5, 1.5]; 1 without enough trades."""
    return F.when(F.coalesce(trades, F.lit(0)) < min_trades, 1.0).otherwise(F.round(1 + F.greatest(F.lit(-0.5), F.least(F.lit(0.5), expectancy)), 3))


def regime_penalty(regime_pnl: Column, trades: Column, min_trades: int = 3) -> Column:
    return F.when((F.coalesce(trades, F.lit(0)) >= min_trades) & (F.coalesce(regime_pnl, F.lit(0.0)) < 0), 0.6).otherwise(1.0)


def off_cooldown(candidates: DataFrame, exits: DataFrame, minutes: int) -> DataFrame:
    """Candidates whose symbol was not left within the last ``minutes``: ``exits`` (symbol, sold_us) as of ``ts_us``."""
    last = asof_join(candidates, exits, ["symbol"], "ts_us", "sold_us", ["sold_us"])
    return last.where(F.col("sold_us").isNull() | (F.col("ts_us") - F.col("sold_us") >= minutes * 60_000_000)).drop("sold_us")


def best_candidate(candidates: DataFrame, keys: Sequence[str], threshold: float = 25.0) -> DataFrame:
    """The candidate with the best effective score per key; the first symbol wins ties."""
    best = candidates.groupBy(*keys).agg(F.max(F.struct(F.col("effective"), (-F.col("place")).alias("neg"), F.col("symbol"))).alias("b"))
    return best.select(*keys, F.col("b.symbol").alias("symbol"), F.col("b.effective").alias("effective")).where(F.col("effective") >= threshold)
