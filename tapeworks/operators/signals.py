"""Rule families: entry masks, exit masks and parameter specs.

A family is a pair of functions from a spec to column expressions over the
feature frame.  ``register_family`` adds one.
"""
from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.core import known
from tapeworks.operators.features import flow_filter, regime_label


@dataclass(frozen=True)
class Spec:
    """A rule family with parameters.  ``family`` names the group it is chosen from."""
    name: str
    params: Mapping[str, object] = field(default_factory=dict)
    family: str = ""

    def __getitem__(self, key: str):
        return self.params[key]

    def get(self, key: str, default=None):
        return self.params.get(key, default)

    def label(self) -> str:
        return f"{self.name}({','.join(f'{k}={v}' for k, v in sorted(self.params.items()))})"

    def with_(self, **more) -> "Spec":
        return Spec(self.name, {**self.params, **more}, self.family)


def d1_ok(spec: Spec) -> Column:
    """The daily filter: known and on; always true when the spec does not use it."""
    return known(F.col("d1_riskon")) if spec.get("d1") else F.lit(True)


def adx_on(spec: Spec) -> Column:
    return F.col(f"adx_on{int(spec.get('adx_enter', 25.0))}")


def chandelier(spec: Spec) -> Column:
    return F.col("hh22") - float(spec.get("atr_mult", 3.0)) * F.col("atr")


def ema_of(span: int) -> Column:
    return F.col(f"ema{int(span)}")


def regime_entry(s: Spec) -> Column:
    rank = float(s.get("min_atr_rank", 0.0))
    calm = F.lit(True) if rank <= 0 else F.coalesce("atr_rank", F.lit(-1.0)) >= rank
    rules = ((F.col("close") > F.col("ema200")) & (F.col("ema20") > F.col("ema50"))
             & (F.col("close") > F.col(f"prior_high{int(s.get('lookback', 20))}")) & F.col("atr").isNotNull())
    return known(adx_on(s) & calm & rules & flow_filter(s.get("flt")) & d1_ok(s))


def meanrev_entry(s: Spec) -> Column:
    ema = ema_of(s.get("ema", 50))
    return known((F.col("rsi") <= float(s.get("rsi_os", 38.0))) & (F.col("close") < ema) & flow_filter(s.get("flt")) & d1_ok(s))


def trendhold_entry(s: Spec) -> Column:
    slow = int(s.get("ema_slow", 100))
    return known((F.col("i") >= slow) & (F.col("close") > ema_of(slow)) & (ema_of(s.get("ema_fast", 20)) > ema_of(slow)) & d1_ok(s))


def breakout_entry(s: Spec) -> Column:
    n = int(s.get("lookback", 20))
    return known((F.col("close") > F.col(f"prior_high{n}")) & (F.col("volume") > F.col(f"prior_vol{n}")))


def momentum_entry(s: Spec) -> Column:
    band = F.col("rsi").between(float(s.get("rsi_min", 35)), float(s.get("rsi_max", 75)))
    return known(adx_on(s) & band & (F.col("close") > F.col("ema200")))


def bearish_entry(s: Spec) -> Column:
    """Mirror of trend-hold for a short: daily filter known and off."""
    slow = int(s.get("ema_slow", 100))
    return known((F.col("i") >= slow) & (F.col("close") < ema_of(slow)) & (ema_of(s.get("ema_fast", 20)) < ema_of(slow))
                 & ~F.col("d1_riskon"))


def regime_exit(s: Spec) -> Column:
    low, chop = F.col("close") < chandelier(s), ~adx_on(s) & F.lit(bool(s.get("exit_on_chop", True)))
    return F.when(low, "chandelier").when(chop, "regime_chop")


Rules = tuple[Callable[[Spec], Column], Callable[[Spec], Column]]
FAMILIES: dict[str, Rules] = {
    "regime": (regime_entry, regime_exit),
    "meanrev": (meanrev_entry, lambda s: F.when((F.col("rsi") >= float(s.get("rsi_exit", 55.0)))
                                                | (F.col("close") >= ema_of(s.get("ema", 50))), "reverted")),
    "trendhold": (trendhold_entry, lambda s: F.when(F.col("close") < ema_of(s.get("ema_slow", 100)), "below_ema100")),
    "breakout": (breakout_entry, lambda s: F.lit(None).cast("string")),
    "momentum": (momentum_entry, lambda s: F.when(F.col("close") < F.col("ema50"), "below_ema50")),
    "short": (bearish_entry, lambda s: F.when(F.col("close") > ema_of(s.get("ema_slow", 100)), "above_ema")),
}

# Parameters that shape a family's exit mask; specs that agree on them share one exit column.
EXIT_PARAMS = {"regime": ("atr_mult", "adx_enter", "exit_on_chop"), "meanrev": ("rsi_exit", "ema"), "trendhold": ("ema_slow",),
               "breakout": (), "momentum": (), "short": ("ema_slow",)}
DEFAULT_STOP = {"regime": 0.03, "meanrev": 0.03, "momentum": 0.02, "breakout": 0.02}
DEFAULT_TARGET = {"regime": 0.25, "meanrev": 0.25, "momentum": 0.04, "breakout": 0.04}


def register_family(name: str, entry: Callable[[Spec], Column], leave: Callable[[Spec], Column],
                    exit_params: Sequence[str] = (), stop: float | None = None, target: float | None = None) -> None:
    FAMILIES[name] = (entry, leave)
    EXIT_PARAMS[name] = tuple(exit_params)
    if stop is not None:
        DEFAULT_STOP[name] = stop
    if target is not None:
        DEFAULT_TARGET[name] = target


def entry_mask(spec: Spec) -> Column:
    return FAMILIES[spec.name][0](spec)


def exit_reason(spec: Spec) -> Column:
    return FAMILIES[spec.name][1](spec)


def exit_key(spec: Spec) -> tuple:
    return (spec.name, *[spec.get(p) for p in EXIT_PARAMS[spec.name]])


# What every candidate of a family has, and the values that are tried, the later names varying fastest.
CANDIDATES = {
    "breakout": ({}, {"lookback": (20, 55), "stop,tp": ((0.02, 0.04), (0.03, 0.06), (0.015, 0.045))}),
    "momentum": ({"adx_exit": 20.0}, {"adx_enter": (25.0, 30.0), "stop,tp": ((0.02, 0.04), (0.03, 0.06))}),
    "regime": ({"tp": 0.25, "adx_enter": 25.0, "adx_exit": 20.0},
               {"lookback": (20, 55), "atr_mult": (3.0, 2.0), "min_atr_rank": (0.0, 0.5), "stop": (0.03, 0.05)}),
    "meanrev": ({"rsi_exit": 55.0, "tp": 0.25}, {"rsi_os": (38.0, 30.0), "stop": (0.03, 0.05)}),
}
MAKER, MAKER_FAMILIES = {"entry": "limit", "limit_offset": 0.001}, ("breakout", "regime", "meanrev")
# The family search runs at an hour or slower with the daily filter on.
SEARCH = {
    "regime": ({"min_atr_rank": 0.0, "tp": 0.25, "adx_enter": 25.0, "adx_exit": 20.0, "d1": True},
               {"lookback,atr_mult,stop": ((20, 3.0, 0.03), (55, 3.0, 0.03), (20, 2.0, 0.05))}),
    "meanrev": ({"rsi_exit": 55.0, "stop": 0.03, "tp": 0.25, **MAKER, "d1": True}, {"rsi_os": (38.0, 30.0)}),
    "trendhold": ({"ema_fast": 20, "d1": True}, {"ema_slow": (100, 80)}),
}


def expand(name: str, family: str, fixed: dict, tried: dict) -> list[Spec]:
    """One spec per combination of the tried values; a key may name several parameters that vary together."""
    options = [[dict(zip(key.split(","), v if "," in key else (v,))) for v in values] for key, values in tried.items()]
    return [Spec(name, functools.reduce(lambda a, b: {**a, **b}, choice, dict(fixed)), family) for choice in itertools.product(*options)]


def default_grid() -> dict[str, list[Spec]]:
    """Candidate specs per family, maker entries as families of their own; the first of a family is its default."""
    taker = {f: expand(f, f, *table) for f, table in CANDIDATES.items()}
    return taker | {f"{f}_mk": expand(f, f"{f}_mk", CANDIDATES[f][0] | MAKER, CANDIDATES[f][1]) for f in MAKER_FAMILIES}


def library() -> dict[str, list[Spec]]:
    """Candidates of the family search."""
    return {f: expand(f, f, *table) for f, table in SEARCH.items()}


def deployed_entry(_: Spec) -> Column:
    """Mean reversion or momentum with parameters that lie in the frame as ``p_...`` columns."""
    dip = (F.col("rsi") <= F.col("p_rsi_os")) & (F.col("close") < F.col("ema50"))
    run = F.col("adx_on25") & F.col("rsi").between(F.col("p_rsi_min"), F.col("p_rsi_max")) & (F.col("close") > F.col("ema200"))
    return known(F.when(F.col("p_strategy") == "meanrev", dip).otherwise(run))


def deployed_exit(_: Spec) -> Column:
    back = (F.col("rsi") >= F.col("p_rsi_exit")) | (F.col("close") >= F.col("ema50"))
    out = F.when(F.col("p_strategy") == "meanrev", back).otherwise(F.col("close") < F.col("ema50"))
    return F.when(out, "signal")


register_family("deployed", deployed_entry, deployed_exit, stop=0.04, target=0.08)


# ---- comparison variants: named pairs of entry and exit -----------------------------------

def comparison_variants() -> dict[str, tuple[Column, Column]]:
    """Eight hand-made rule pairs over RSI, the fast and slow EMA and the regime EMA."""
    c, rsi, fast, slow, reg = (F.col(k) for k in ("close", "rsi", "ema20", "ema50", "ema200"))
    band, back = rsi.between(45.0, 68.0), (rsi > 55) | (c >= slow)
    dip = lambda level: (rsi < level) & (c < slow)
    return {
        "current": (band, c < slow), "mean_reversion": (dip(32), back), "mean_reversion_loose": (dip(38), back),
        "mean_reversion_aggressive": (dip(40), back),
        "mean_reversion_sentiment": (dip(32) & F.coalesce(F.col("sentiment") > -0.15, F.lit(True)), back),
        "combined_mr_momentum": (dip(32) | (band & (c > slow)), (rsi > 55) | (c < slow)),
        "regime_trend": (band & (c > reg), c < slow), "trend_follow": ((fast > slow) & (c > reg), fast < slow),
    }


# ---- scored decisions for every bar --------------------------------------------------------

def fee_edge(take_profit: float | Column, min_edge_bps: float) -> Column:
    """Whether a target clears the minimum edge, with the reason."""
    tp = take_profit if isinstance(take_profit, Column) else F.lit(float(take_profit))
    need = min_edge_bps / 10_000
    pct, bps = F.format_string("%.2f", tp * 100), f"{need * 100:.2f}% ({min_edge_bps:.0f} bps"
    bad = F.isnan(tp) | tp.isNull() | (F.abs(tp) == float("inf")) | (tp <= 0)
    return (F.when(bad, F.struct(F.lit(False).alias("ok"), F.lit(f"Fee gate: invalid TP; need >= {bps}) before fees").alias("reason")))
            .when(tp + 1e-15 < need, F.struct(F.lit(False).alias("ok"), F.concat(F.lit("Fee gate: TP "), pct, F.lit(f"% < min edge {bps} before fees)")).alias("reason")))
            .otherwise(F.struct(F.lit(True).alias("ok"), F.concat(F.lit("Fee edge ok: TP "), pct, F.lit(f"% >= min edge {need * 100:.2f}%")).alias("reason"))))


def signal(action, score, reason, stop=None) -> Column:
    s = lambda v, t: v.cast(t) if isinstance(v, Column) else F.lit(v).cast(t)
    return F.struct(s(action, "string").alias("action"), s(score, "int").alias("score"), s(reason, "string").alias("reason"),
                    s(stop, "double").alias("stop_price"))


# What decisions say.
TEXT = {
    "no_atr": "ATR unavailable",
    "below_ema": "Price closed below slow trend EMA",
    "above_ema": "Position remains above slow trend EMA",
    "sit_out": "ADX sit-out: chop (adx=",
    "not_in_band": "Filters failed: momentum",
    "counter_trend": "Momentum blocked: counter-trend",
    "confirmed": "Momentum confirmed",
    "at_resistance": " + at resistance",
    "low_volume": "; low volume (advisory)",
    "reverted": "Mean reversion complete (rsi=",
    "holding_dip": "Holding reversion",
    "dip": "Oversold reversion (rsi=",
    "no_dip": "Not oversold (rsi=",
    "profit": "Profit target hit",
    "loss": "Stop loss hit",
    "reversing": "Momentum reversing",
    "drying": "Volume drying up",
}


def momentum_decision(take_profit: float = 0.04, min_edge_bps: float = 100.0, rsi_min: float = 35.0, rsi_max: float = 75.0,
                      min_volume_ratio: float = 1.10, atr_mult: float = 1.5, held: Column | None = None) -> Column:
    """Momentum decision on every bar: gates and a scored buy for a flat book; where ``held``, out below the slow EMA or stay."""
    c, atr = F.col("close"), F.col("atr")
    edge, in_band = fee_edge(take_profit, min_edge_bps), F.col("rsi").between(rsi_min, rsi_max)
    above, trend = known(c > F.col("ema200")), known(F.col("ema20") > F.col("ema50"))
    at_res = known(c >= F.col("prior_high20") - atr)
    busy = known(F.col("volume") / F.when(F.col("prior_vol20") != 0, F.col("prior_vol20")) >= min_volume_ratio)
    score = F.when(in_band, 20).otherwise(0)
    for part in (above, trend, at_res, busy):
        score = score + F.when(part, 5).otherwise(0)
    adx = F.coalesce(F.format_string("%.1f", F.col("adx")), F.lit("n/a"))
    note = F.concat(F.lit(TEXT["confirmed"]), F.when(at_res, TEXT["at_resistance"]).otherwise(""),
                    F.when(busy, "").otherwise(TEXT["low_volume"]),
                    F.when(F.col("adx").isNotNull(), F.concat(F.lit("; adx="), adx)).otherwise(""))
    held = F.lit(False) if held is None else known(held)
    return (F.when(known(atr <= 0) | atr.isNull(), signal("WAIT", 0, TEXT["no_atr"]))
            .when(held & known(c < F.col("ema50")), signal("SELL", 90, TEXT["below_ema"]))
            .when(held, signal("WAIT", 60, TEXT["above_ema"]))
            .when(~F.col("adx_on25"), signal("WAIT", 15, F.concat(F.lit(TEXT["sit_out"]), adx, F.lit(")"))))
            .when(~edge["ok"], signal("WAIT", 10, edge["reason"]))
            .when(~in_band, signal("WAIT", score, TEXT["not_in_band"]))
            .when(~above, signal("WAIT", score, TEXT["counter_trend"]))
            .otherwise(signal("BUY", score, note, F.greatest(c - atr * atr_mult, F.lit(0.0)))))


def meanrev_decision(oversold: float = 38.0, rsi_exit: float = 55.0, atr_mult: float = 1.5, held: Column | None = None) -> Column:
    """Mean-reversion decision on every bar: a buy of an oversold dip for a flat book; where ``held``, out once it has reverted."""
    c, rsi = F.col("close"), F.col("rsi")
    atr = F.greatest(F.col("atr"), c * 1e-4)
    txt = F.format_string("%.0f", F.bround(rsi, 0))
    held = F.lit(False) if held is None else known(held)
    back = F.when(rsi >= rsi_exit, "recovered").otherwise("reclaimed EMA")
    return (F.when(held & known((rsi >= rsi_exit) | (c >= F.col("ema50"))), signal("SELL", 80, F.concat(F.lit(TEXT["reverted"]), txt, F.lit(" "), back, F.lit(")"))))
            .when(held, signal("WAIT", 55, TEXT["holding_dip"]))
            .when((rsi <= oversold) & (c < F.col("ema50")),
                   signal("BUY", 60, F.concat(F.lit(TEXT["dip"]), txt, F.lit(", below slow EMA)")), F.greatest(c - atr * atr_mult, F.lit(0.0))))
            .otherwise(signal("WAIT", 10, F.concat(F.lit(TEXT["no_dip"]), txt, F.lit(f", oversold<={oversold:.0f})")))))


def rotation_decision(entry_price: Column | None = None) -> Column:
    """Rotation score for a flat book, or exits against a known entry price.

    Needs ``change, volume_ratio, rsi_simple, prev_rsi_simple, ema200, close, atr``.
    """
    from tapeworks.functions.costs import atr_stop
    c, chg, vr, rsi = F.col("close"), F.col("change"), F.col("volume_ratio"), F.col("rsi_simple")
    boost, mom = F.least(F.lit(20.0), (vr - 1) * 10), F.least(F.lit(50.0), chg * 200)
    score = F.least(F.lit(95), (mom + boost + F.greatest(F.lit(0.0), 30 - F.abs(rsi - 55)) + 30).cast("int"))
    rising, dipped = known(chg > 0.005), known((rsi < 40) & (chg > -0.02))
    stop = F.round(atr_stop(F.lit("buy"), c, "atr", 1.5, 0.04)[0], 8)
    flat = (F.when((rising | dipped) & ~known(c > F.col("ema200")), signal("WAIT", 15, TEXT["counter_trend"]))
            .when(rising, signal("BUY", score, "Momentum", stop)).when(dipped, signal("BUY", 35, "Oversold", stop))
            .otherwise(signal("WAIT", 5, "Waiting")))
    if entry_price is None:
        return flat
    gain = F.coalesce((c - entry_price) / F.when(entry_price > 0, entry_price), F.lit(0.0))
    held = (F.when(gain >= 0.03, signal("SELL", 90, TEXT["profit"])).when(gain <= -0.02, signal("SELL", 95, TEXT["loss"]))
            .when(known((rsi < 40) & (F.col("prev_rsi_simple") > 50)), signal("SELL", 70, TEXT["reversing"]))
            .when(known(vr < 0.5), signal("SELL", 60, TEXT["drying"])).otherwise(signal("WAIT", 50, "Holding")))
    return F.when(entry_price.isNotNull(), held).otherwise(flat)


def regime_column(spec: Spec) -> Column:
    return regime_label(f"adx_on{int(spec.get('adx_enter', 25.0))}")


def masks(frame: DataFrame, specs: Mapping[str, Spec]) -> DataFrame:
    """Entry masks of several specs side by side."""
    return frame.select("symbol", "tf", "t", *[entry_mask(s).alias(n) for n, s in specs.items()])
