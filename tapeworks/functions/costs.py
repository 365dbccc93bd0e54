"""Costs, sizing and levels as column expressions."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeworks.functions.core import col, ratio


@dataclass(frozen=True)
class Costs:
    """Fees and slippage in basis points per side."""
    fee_bps: float = 40.0
    slippage_bps: float = 5.0
    maker_bps: float = 25.0

    def net_return(self, entry: str | Column, exit_: str | Column, entry_maker: Column | None = None,
                   exit_maker: Column | None = None) -> Column:
        """Return after both fills; maker fills pay the maker fee and no slippage."""
        slip, no = self.slippage_bps / 1e4, F.lit(False)
        em, xm = entry_maker if entry_maker is not None else no, exit_maker if exit_maker is not None else no
        fee = lambda maker: F.when(maker, self.maker_bps / 1e4).otherwise(self.fee_bps / 1e4)
        paid = col(entry) * F.when(em, 1.0).otherwise(1 + slip) * (1 + fee(em))
        got = col(exit_) * F.when(xm, 1.0).otherwise(1 - slip) * (1 - fee(xm))
        return got / paid - 1


def one_way_fraction(fee_bps: float = 15.0, spread_bps: float = 10.0, slippage_bps: float = 5.0) -> float:
    """Cost of one side: fee, half the spread and slippage."""
    return (fee_bps + spread_bps / 2 + slippage_bps) / 10_000


def simulated_fill(side: str | Column, price: str | Column, volume: str | Column, bid: str | Column, ask: str | Column,
                   maker: Column, taker_bps: float = 40.0, maker_bps: float = 25.0, slippage_bps: float = 10.0,
                   min_spread_bps: float = 5.0) -> Column:
    """A paper fill around the mid: half the spread, slippage unless maker, and the fee."""
    p, v, b, a, buy = col(price), col(volume), col(bid), col(ask), col(side) == "buy"
    quoted = F.coalesce((b.isNotNull()) & (a > b), F.lit(False))
    mid = F.when(quoted, (b + a) / 2).otherwise(p)
    spread = F.when(quoted, (a - b) / mid * 1e4).otherwise(min_spread_bps)
    half = mid * spread / 2 / 1e4
    slip = F.when(maker, 0.0).otherwise(mid * slippage_bps / 1e4)
    sign = F.when(buy, 1.0).otherwise(-1.0) * F.when(maker, -1.0).otherwise(1.0)
    fill = F.greatest(mid + sign * (half + slip), F.lit(1e-12))
    fee = mid * v * F.when(maker, maker_bps / 1e4).otherwise(taker_bps / 1e4)
    ok = (p > 0) & (v > 0)
    return F.when(ok, F.struct(
        F.bround(fill, 8).alias("fill_price"), F.bround(fill * v, 8).alias("notional"), F.bround(fee, 8).alias("fee"),
        F.bround(slip, 8).alias("slippage"), F.bround(spread, 4).alias("spread_bps")))


def limit_entry(side: str | Column, touch: str | Column, offset: float = 0.001) -> Column:
    """Limit price a little inside the spread."""
    return col(touch) * F.when(col(side) == "buy", 1 - offset).otherwise(1 + offset)


def bracket(side: str | Column, entry: str | Column, stop_pct: float, target_pct: float) -> tuple[Column, Column]:
    sign = F.when(col(side) == "buy", 1.0).otherwise(-1.0)
    return col(entry) * (1 - sign * stop_pct), col(entry) * (1 + sign * target_pct)


def atr_stop(side: str | Column, entry: str | Column, atr: str | Column, mult: float = 1.5, stop_pct: float = 0.04,
             low: float = 0.5, high: float = 3.0) -> tuple[Column, Column]:
    """Stop at ``mult`` ATR, kept within 0.5 to 3 times the percent stop; percent stop without an ATR."""
    e, a = col(entry), col(atr)
    sign = F.when(col(side).isin("buy", "long"), -1.0).otherwise(1.0)
    has = F.coalesce(a > 0, F.lit(False)) & F.lit(mult > 0)
    dist = F.least(F.greatest(a * mult, e * (stop_pct * low)), e * (stop_pct * high))
    return F.when(has, e + sign * dist).otherwise(e + sign * e * stop_pct), F.when(has, "atr").otherwise("pct")


def risk_quantity(equity: str | Column, risk: float, entry: str | Column, stop: str | Column) -> Column:
    """Quantity whose loss at the stop is a share of equity, cut to six decimals; 0 if invalid."""
    gap = F.abs(col(entry) - col(stop))
    ok = (col(equity) > 0) & F.lit(0 < risk <= 1) & (col(entry) > 0) & (gap > 0)
    return F.when(ok, F.floor(col(equity) * risk / gap * 1e6) / 1e6).otherwise(0.0)


def kelly(win_prob: str | Column, avg_win: str | Column, avg_loss: str | Column, confidence: str | Column = None,
          fraction: float = 0.25, ceiling: float = 0.25) -> Column:
    """Fractional Kelly share, never above the ceiling."""
    p, w, lo = col(win_prob), col(avg_win), col(avg_loss)
    c = F.lit(1.0) if confidence is None else col(confidence)
    pay = ratio(w, lo)
    full = F.greatest((pay * p - (1 - p)) / pay, F.lit(0.0))
    ok = (lo > 0) & (p > 0) & (p < 1)
    return F.when(ok, F.least(full * fraction * c, F.lit(ceiling))).otherwise(0.0)


def sized_notional(equity: Column, price: Column, vol: Column, kelly_share: Column | None, stop_distance: Column,
                   target_vol: float = 0.12, max_leverage: float = 2.0, max_risk: float = 0.01, normal: float = 0.10) -> Column:
    """Volatility target times Kelly conviction, cut by the risk per trade at the stop."""
    scale = F.least(F.lit(target_vol) / vol, F.lit(max_leverage))
    mult = F.lit(1.0) if kelly_share is None else F.greatest(kelly_share / normal, F.lit(0.0))
    shares = F.coalesce(ratio(F.least(equity * scale * mult, equity * max_leverage), F.when(price > 0, price)), F.lit(0.0))
    capped = F.when(stop_distance > 0, F.least(shares, equity * max_risk / stop_distance)).otherwise(shares)
    return capped * price


# Published futures schedule and margin bands (fixed values).
FUTURES_TAKER_BPS, FUTURES_MAKER_BPS, MAX_LEVERAGE, MAINTENANCE = 5.0, 2.0, 2.0, 0.01
MARGIN_RATES = {"BTC": (0.0002, 0.0002), "ETH": (0.0004, 0.0004), "SOL": (0.0004, 0.0004)}
MARGIN_DEFAULT, ROLLOVER_HOURS = (0.0004, 0.0004), 4.0


def futures_fee(notional: Column, maker: Column) -> Column:
    return F.abs(notional) * F.when(maker, FUTURES_MAKER_BPS / 1e4).otherwise(FUTURES_TAKER_BPS / 1e4)


def clamp_leverage(lev: Column) -> Column:
    return F.least(F.greatest(F.coalesce(lev, F.lit(1.0)), F.lit(1.0)), F.lit(MAX_LEVERAGE))


def liquidation_price(entry: Column, side: Column, leverage: Column, maintenance: float = MAINTENANCE) -> Column:
    """Isolated liquidation: the loss that eats initial margin down to maintenance."""
    room = 1 / clamp_leverage(leverage)
    mm = F.least(F.lit(max(maintenance, 0.0)), room - 1e-9)
    return F.when(side == "short", entry * (1 + room - mm)).otherwise(entry * (1 - room + mm))


def funding_cash(side: Column, notional: Column, hourly_rate: Column, hours: Column) -> Column:
    """Cash to the account: with a positive rate longs pay shorts."""
    return F.when(side == "short", 1.0).otherwise(-1.0) * hourly_rate * F.abs(notional) * hours


def short_pnl(entry: Column, exit_: Column, notional: Column) -> Column:
    return F.when(entry > 0, (entry - exit_) / entry * F.abs(notional)).otherwise(0.0)


def spread_bps(bid: str | Column, ask: str | Column) -> Column:
    """Quoted spread over mid; infinite when the mid is not positive."""
    mid = (col(bid) + col(ask)) / 2
    return F.when(mid > 0, (col(ask) - col(bid)) / mid * 1e4).otherwise(float("inf"))


def slippage_bps(side: str | Column, signal: str | Column, fill: str | Column) -> Column:
    """Slippage against us: paying up on a buy, giving away on a sell."""
    s, f = col(signal), col(fill)
    return F.when(col(side) == "buy", (ratio(f, s) - 1) * 1e4).otherwise((1 - ratio(f, s)) * 1e4)
