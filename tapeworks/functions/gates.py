"""Ordered decision gates as column expressions."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.functions.core import col, known
from tapeworks.functions.costs import spread_bps

# Symbol spellings, gate names in order of precedence, secret key names.
SYMBOLS = ("BTC/USD", "ETH/USD", "SOL/USD")
ALIASES = {"XBTUSD": "BTC/USD", "XXBTZUSD": "BTC/USD", "BTCUSD": "BTC/USD", "ETHUSD": "ETH/USD", "XETHZUSD": "ETH/USD", "SOLUSD": "SOL/USD"}
GATES = (("learner", "learner"), ("max concurrent", "max_positions"), ("exposure", "exposure"), ("another sleeve", "ownership"),
         ("market quality", "market_quality"), ("daily loss", "daily_loss"), ("drawdown", "drawdown"), ("cooldown", "cooldown"),
         ("cash", "cash"), ("fee", "fee_edge"), ("risk", "risk"), ("d1", "d1"))
SECRET_KEYS = ("api_key", "api_secret", "apikey", "apisecret", "secret", "password", "token", "kraken_api_key", "kraken_api_secret",
               "alpaca_api_key", "alpaca_api_secret", "api-key", "api-sign", "authorization", "nonce")


def canonical_symbol(raw: str | Column, aliases: dict[str, str] | None = None) -> Column:
    """One spelling per symbol; unknown spellings become NULL."""
    up = F.upper(F.trim(col(raw)))
    flat = F.regexp_replace(up, "[/_-]", "")
    pairs = aliases or ALIASES
    table = F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])
    names = sorted(set(pairs.values()))
    return F.when(up.isin(names), up).otherwise(F.try_element_at(table, flat))


def gate_name(reason: str | Column) -> Column:
    """Which gate a block reason names; the first match wins."""
    r = F.lower(F.coalesce(col(reason), F.lit("")))
    out = F.when(r.contains(GATES[0][0]), GATES[0][1])
    for key, name in GATES[1:]:
        out = out.when(r.contains(key), name)
    return out.otherwise("other")


def redact(payload: str | Column, kind: T.DataType | None = None) -> Column:
    """Secret-looking keys and fields blanked, also inside records, lists and maps; ``kind`` is the payload's type, a string map by default.

    A secret field becomes text, whatever it held; a secret key of a map whose values are
    not text becomes NULL.
    """
    kind = kind or T.MapType(T.StringType(), T.StringType())
    c = col(payload)
    if isinstance(kind, T.StructType):
        fields = [(F.lit("[REDACTED]") if f.name.lower() in SECRET_KEYS else redact(c[f.name], f.dataType)).alias(f.name) for f in kind]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: redact(v, kind.elementType))
    if isinstance(kind, T.MapType):
        blank = F.lit("[REDACTED]" if isinstance(kind.valueType, T.StringType) else None)
        return F.transform_values(c, lambda k, v: F.when(F.lower(k.cast("string")).isin(*SECRET_KEYS), blank).otherwise(redact(v, kind.valueType)))
    return c


def market_quality(bid: str, ask: str, dollar_volume: str, max_spread_bps: float, min_volume: float) -> Column:
    spread = spread_bps(bid, ask)
    why = (F.when((F.col(bid) <= 0) | (F.col(ask) <= F.col(bid)), "Invalid or crossed market quote")
           .when(spread > max_spread_bps, F.concat(F.lit("Spread too wide: "), F.format_string("%.1f", spread), F.lit(" bps")))
           .when(F.col(dollar_volume) < min_volume, "Recent dollar volume is below minimum").otherwise("Liquidity and spread checks passed"))
    return F.struct((why == "Liquidity and spread checks passed").alias("ok"), why.alias("reason"))


def freshness(last_bar_s: Column, now_s: float, tf_minutes: int, skew_s: Column | None = None, multiple: float = 3.0, max_skew: float = 30.0) -> Column:
    """Verdict on a feed: clock skew, no bars, a bar from the future, too old, or fresh."""
    age, limit = (F.lit(now_s) - last_bar_s) / 60.0, tf_minutes * multiple
    skew = F.lit(0.0) if skew_s is None else F.coalesce(skew_s, F.lit(0.0))
    return (F.when(F.abs(skew) > max_skew, "clock_skew").when(last_bar_s.isNull(), "no_bars").when(age < -tf_minutes, "future_bar")
            .when(age > limit, "stale").otherwise("fresh"))


def bar_faults(bars: DataFrame, order: str = "arrived") -> DataFrame:
    """Out-of-order and repeated bar times per symbol, in arrival order."""
    from tapeworks.operators.scan import block_no, previous
    b = previous(bars.withColumn("_b", block_no(order)), ["symbol"], "_b", [order], {"t": "prev_t"})
    dup = bars.groupBy("symbol", "t").agg(F.count(F.lit(1)).alias("c")).groupBy("symbol").agg(F.sum(F.col("c") - 1).alias("duplicates"))
    out = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("t") < F.col("prev_t")).alias("out_of_order"))
    return out.join(dup, "symbol").withColumn("ok", (F.col("out_of_order") == 0) & (F.col("duplicates") == 0))


@dataclass(frozen=True)
class RiskLimits:
    strategy_equity: float = 500.0
    max_daily_loss: float = 0.03
    max_drawdown: float = 0.10
    max_orders_per_day: int = 0
    cooldown_minutes: int = 10
    max_exposure: float = 0.5
    risk_per_trade: float = 0.01
    max_position: float = 0.4
    min_notional: float = 1.0


# Reasons of a risk verdict and of an order size.
RISK_TEXT = {
    "exit": "Exit signal approved",
    "no_entry": "No entry order requested",
    "daily_loss": "Daily loss circuit breaker is active",
    "small_account": "Account equity below minimum order notional",
    "drawdown": "Maximum drawdown circuit breaker is active",
    "daily_orders": "Daily order limit reached",
    "cooldown": "Trade cooldown is active",
    "stop": "Invalid stop distance",
    "exposure": "Exposure cap reached",
    "small_order": "Calculated order is below minimum notional",
    "passed": "Risk checks passed",
}
SIZE_TEXT = {
    "price": "invalid price",
    "notional": "invalid notional",
    "no_price": "price rounds to zero",
    "no_volume": "volume rounds to zero",
    "min_volume": "below minimum volume",
    "min_cost": "below minimum cost",
    "min_notional": "below configured minimum",
}


def entry_risk(action: Column, price: Column, stop: Column, equity: Column, peak: Column, pnl_today: Column, orders_today: Column,
               last_order_s: Column, exposure: Column, now_s: float | Column, limits: RiskLimits = RiskLimits()) -> Column:
    """Approval, reason, notional and planned loss of an entry; sells are always approved.

    Equity for sizing never exceeds the authorised budget.
    """
    m = limits
    real = F.greatest(equity, F.lit(0.0))
    eq = F.least(real, F.lit(m.strategy_equity))
    draw = 1 - eq / F.greatest(F.least(peak, F.lit(m.strategy_equity)), F.lit(0.01))
    cap = eq * m.max_exposure
    stop_frac = (price - stop) / price
    size = F.least(eq * m.risk_per_trade / stop_frac, eq * m.max_position, eq)
    size = F.when(exposure + size > cap, F.greatest(cap - exposure, F.lit(0.0))).otherwise(size)
    now = now_s if isinstance(now_s, Column) else F.lit(now_s)
    why = (F.when(action == "SELL", RISK_TEXT["exit"]).when(action != "BUY", RISK_TEXT["no_entry"])
           .when(pnl_today <= -(eq * m.max_daily_loss), RISK_TEXT["daily_loss"])
           .when(eq < m.min_notional, RISK_TEXT["small_account"])
           .when(draw >= m.max_drawdown, RISK_TEXT["drawdown"])
           .when((F.lit(m.max_orders_per_day) > 0) & (orders_today >= m.max_orders_per_day), RISK_TEXT["daily_orders"])
           .when(known(now < last_order_s + m.cooldown_minutes * 60), RISK_TEXT["cooldown"])
           .when(stop.isNull() | (price <= stop), RISK_TEXT["stop"]).when(exposure >= cap, RISK_TEXT["exposure"])
           .when(size < m.min_notional, RISK_TEXT["small_order"]).otherwise(RISK_TEXT["passed"]))
    ok = why.isin(RISK_TEXT["exit"], RISK_TEXT["passed"])
    sized = why == RISK_TEXT["passed"]
    return F.struct(ok.alias("approved"), why.alias("reason"), F.when(sized, F.round(size, 2)).alias("notional"),
                    F.when(sized, F.round(size * stop_frac, 2)).alias("planned_loss"))


def size_order(notional: Column, price: Column, lot_decimals: Column, pair_decimals: Column, order_min: Column, cost_min: Column, min_notional: float = 0.0) -> Column:
    """Exchange-ready volume and price, cut down to the pair's decimals, or the reason why not."""
    dec = lambda c: c.cast("decimal(20,8)")

    def cut(c: Column, places: Column) -> Column:
        out = F.when(places == 0, F.floor(c, F.lit(0)).cast("decimal(20,10)"))
        for k in range(1, 11):
            out = out.when(places == k, F.floor(c, F.lit(k)).cast("decimal(20,10)"))
        return out

    px, n = dec(price), dec(notional)
    vol = cut(F.try_divide(n, px), lot_decimals)
    out_px, cost = cut(px, pair_decimals), vol * px
    why = (F.when(px <= 0, SIZE_TEXT["price"]).when(n <= 0, SIZE_TEXT["notional"]).when(out_px <= 0, SIZE_TEXT["no_price"]).when(vol <= 0, SIZE_TEXT["no_volume"])
           .when((order_min > 0) & (vol < order_min), SIZE_TEXT["min_volume"]).when((cost_min > 0) & (cost < cost_min), SIZE_TEXT["min_cost"])
           .when((F.lit(min_notional) > 0) & (cost < min_notional), SIZE_TEXT["min_notional"]).otherwise("ok"))
    ok = why == "ok"
    return F.struct(ok.alias("ok"), why.alias("reason"), F.when(ok, vol.cast("double")).alias("volume"), F.when(ok, out_px.cast("double")).alias("price"), F.when(ok, cost.cast("double")).alias("notional"))
