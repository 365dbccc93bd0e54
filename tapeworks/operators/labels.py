"""Trade labelling as joins: every candidate entry gets its first exit, then overlaps are thinned.

A candidate knows the next bar on which its family wants out (one reverse scan
per exit rule).  Its stop, target or trail is looked up through levels of block
summaries (``operators.levels``), one row per candidate and level.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.core import known
from tapeworks.functions.costs import Costs
from tapeworks.operators import signals as G
from tapeworks.operators.features import FRAME_ROWS, SERIES
from tapeworks.operators.levels import first_fall, first_hit
from tapeworks.operators.scan import block_no, greedy_chain, running, with_halo
from tapeworks.session import pin

WARM = 210
ID = (*SERIES, "k", "s")


def next_bar(frame: DataFrame, rows: int = FRAME_ROWS) -> DataFrame:
    """Add ``nxt``: the following bar of the series."""
    h = with_halo(frame, "i", 0, rows, ahead=1)
    w = Window.partitionBy(*SERIES, "hblk").orderBy("i")
    return h.withColumn("nxt", F.lead(F.struct("i", "t", "open", "high", "low", "close")).over(w)).where("home").drop("home", "hblk")


def next_exits(frame: DataFrame, specs: Sequence[G.Spec], rows: int = FRAME_ROWS) -> tuple[DataFrame, dict[tuple, str]]:
    """Per distinct exit rule, the first bar after this one that fires it (and has a next bar to fill on)."""
    rules: dict[tuple, str] = {}
    specs_by_rule = {}
    for s in specs:
        key = G.exit_key(s)
        rules.setdefault(key, f"x{len(rules)}")
        specs_by_rule.setdefault(key, s)
    back = frame.withColumn("rev", -F.col("i")).withColumn("rblk", block_no("rev", rows))
    wants = {}
    for key, name in rules.items():
        why = G.exit_reason(specs_by_rule[key])
        hit = F.struct(F.col("i").alias("i"), why.alias("reason"), F.col("nxt.i").alias("fill_i"),
                       F.col("nxt.t").alias("fill_t"), F.col("nxt.open").alias("fill_px"))
        wants[name] = ("last", F.when(why.isNotNull() & F.col("nxt").isNotNull(), hit))
    out = running(back, list(SERIES), "rblk", ["rev"], wants, exclusive=True)
    return out.drop("rev", "rblk"), rules


def series_ends(frame: DataFrame) -> DataFrame:
    """Bar count and last bar of every series."""
    return frame.groupBy(*SERIES).agg((F.max("i") + 1).alias("n"), F.max_by("close", "i").alias("last_close"), F.max("t").alias("last_t"))


def spec_table(frame: DataFrame, specs: Sequence[G.Spec]) -> DataFrame:
    """One row per spec; its size is the length of the Python list."""
    rows = []
    for k, s in enumerate(specs):
        if s.name in ("trendhold", "short"):
            stop, frac = (float(s.get("stop") or 0.0) or None), (float(s.get("stop") or 0.0) or 0.25)
            target = float(s["tp"]) if s.get("tp") else None
        else:
            stop = frac = float(s.get("stop", G.DEFAULT_STOP[s.name]))
            target = float(s.get("tp", G.DEFAULT_TARGET[s.name]))
        rows.append((k, s.name, s.family or s.name, s.label(), stop, target, frac, s.get("entry", "market") == "limit",
                     float(s.get("limit_offset", 0.001)), int(s.get("warm", WARM)), float(s.get("trail_activate_atr") or 0.0), float(s.get("trail_atr") or 1.0)))
    return frame.sparkSession.createDataFrame(
        rows, "k int, name string, family string, label string, stop_pct double, target_pct double, stop_frac double, "
              "limit_entry boolean, limit_offset double, warm int, trail_activate double, trail_atr double")


def candidates(frame: DataFrame, specs: Sequence[G.Spec]) -> DataFrame:
    """Bars whose close fires a spec, with entry price, levels and the next signal exit."""
    f, rules = next_exits(next_bar(frame), specs)
    fired = F.filter(F.array(*[F.when(G.entry_mask(s), F.lit(k)) for k, s in enumerate(specs)]), lambda v: v.isNotNull())
    exits = F.array(*[F.col(rules[G.exit_key(s)]) for s in specs])
    regimes = F.array(*[G.regime_column(s) for s in specs])
    f = f.where(F.col("nxt").isNotNull() & F.col("atr").isNotNull()).select(
        *SERIES, "i", "close", "atr", "nxt", exits.alias("exits"), regimes.alias("regimes"), F.explode(fired).alias("k"))
    c = f.join(F.broadcast(spec_table(frame, specs)), "k").where(F.col("i") >= F.col("warm"))
    limit = F.col("close") * (1 - F.col("limit_offset"))
    c = c.where(~F.col("limit_entry") | (F.col("nxt.low") <= limit))
    entry = F.when(F.col("limit_entry"), F.least("nxt.open", limit)).otherwise(F.col("nxt.open"))
    return c.select(*SERIES, "k", F.col("i").alias("s"), "name", "family", "label", "stop_frac", "limit_entry", "trail_activate", "trail_atr", "atr",
                    F.col("nxt.i").alias("entry_i"), F.col("nxt.t").alias("entry_t"), entry.alias("entry_px"),
                    (entry * (1 - F.col("stop_pct"))).alias("stop"), (entry * (1 + F.col("target_pct"))).alias("target"),
                    F.element_at("exits", F.col("k") + 1).alias("x"), F.element_at("regimes", F.col("k") + 1).alias("regime"))


def first_touch(cands: DataFrame, bars: DataFrame) -> DataFrame:
    """The first bar of each holding period that reaches the stop or the target.

    ``cands`` has ``entry_i, last_i, stop, target``; levels may be NULL (never reached).
    """
    return first_hit(cands, bars.select(*SERIES, "i", "t", "open", "high", "low"), SERIES, ID)


def trail_exits(cands: DataFrame, bars: DataFrame) -> DataFrame:
    """First bar on which an armed ATR trail is broken.

    The peak is the highest high before the bar, so the bar that arms the trail
    cannot be stopped by its own wick.  Arming is a first touch; from the next bar
    on the trail breaks at the first fall of its width below the peak so far.
    """
    bars = bars.select(*SERIES, "i", "t", "open", "high", "low")
    on = cands.where((F.col("trail_activate") > 0) & (F.col("atr") > 0))
    arm = on.withColumns({"stop": F.lit(None).cast("double"), "target": F.col("entry_px") + F.col("trail_activate") * F.col("atr") - 1e-12})
    armed = on.select(*ID, "last_i", (F.col("trail_atr") * F.col("atr")).alias("drop")).join(first_touch(arm, bars), list(ID))
    out = first_fall(armed.select(*ID, (F.col("hit.i") + 1).alias("from_i"), "last_i", F.col("hit.high").alias("peak"), "drop"), bars, SERIES, ID)
    out = out.join(armed.select(*ID, "drop"), list(ID)).withColumn("trail", F.col("peak") - F.col("drop"))
    gap = F.col("peak") - F.col("fall_open") >= F.col("drop")
    px, why = F.when(gap, F.col("fall_open")).otherwise(F.col("trail")), F.when(gap, "trail_gap").otherwise("trail")
    return out.select(*ID, F.struct(F.col("fall_i").alias("i"), F.col("fall_t").alias("t"), px.alias("px"), why.alias("reason")).alias("tr"))


def label(cands: DataFrame, bars: DataFrame, costs: Costs = Costs(), trailing: bool = False) -> DataFrame:
    """Exit of every candidate: stop before trail before target before signal exit, else the last close."""
    c = cands.join(series_ends(bars), list(SERIES))
    c = pin(c.withColumn("last_i", F.coalesce("x.i", F.col("n") - 1)))
    out = c.join(first_touch(c, bars), list(ID), "left")
    h, later = F.col("hit"), F.col("hit.i") > F.col("entry_i")
    stopped, gained = known(h["low"] <= F.col("stop")), known(h["high"] >= F.col("target"))
    level = (F.when(later & known(h["open"] <= F.col("stop")), F.struct(h["open"].alias("px"), F.lit("stop_gap").alias("reason")))
             .when(stopped, F.struct(F.col("stop").alias("px"), F.lit("stop").alias("reason")))
             .when(later & known(h["open"] >= F.col("target")), F.struct(h["open"].alias("px"), F.lit("tp_gap").alias("reason")))
             .when(gained, F.struct(F.col("target").alias("px"), F.lit("tp").alias("reason"))))
    out = out.withColumn("lvl", level)
    first = F.when(F.col("lvl").isNotNull(), F.struct(h["i"].alias("i"), h["t"].alias("t"), F.col("lvl.px").alias("px"), F.col("lvl.reason").alias("reason")))
    if trailing:
        held = out.withColumn("last_i", F.coalesce("hit.i", "last_i"))
        out = out.join(trail_exits(held, bars), list(ID), "left")
        wins = F.col("tr").isNotNull() & (F.col("lvl").isNull() | (F.col("tr.i") < h["i"]) | ((F.col("tr.i") == h["i"]) & F.col("lvl.reason").isin("tp", "tp_gap")))
        first = F.when(wins, F.struct(F.col("tr.i").alias("i"), F.col("tr.t").alias("t"), F.col("tr.px").alias("px"), F.col("tr.reason").alias("reason"))).otherwise(first)
    signal = F.when(F.col("x").isNotNull(), F.struct(F.col("x.fill_i").alias("i"), F.col("x.fill_t").alias("t"), F.col("x.fill_px").alias("px"), F.col("x.reason").alias("reason")))
    end = F.struct((F.col("n") - 1).alias("i"), F.col("last_t").alias("t"), F.col("last_close").alias("px"), F.lit("eod_mark").alias("reason"))
    out = out.withColumn("e", F.coalesce(first, signal, end))
    px = F.col("e.px")
    return out.select(*ID, "name", "family", "label", "entry_i", F.col("e.i").alias("exit_i"), "entry_t", F.col("e.t").alias("exit_t"), "entry_px",
                      px.alias("exit_px"), "stop_frac", (px / F.col("entry_px") - 1).alias("gross"),
                      costs.net_return("entry_px", px, F.col("limit_entry"), F.col("e.reason") == "tp").alias("net"),
                      F.col("e.reason").alias("reason"), "regime", "limit_entry")


def thin(labelled: DataFrame, keys: Sequence[str] = (*SERIES, "k"), rows: int = 4096) -> DataFrame:
    """One position at a time: the next entry signal must come after the last exit bar."""
    b = labelled.withColumn("_blk", block_no("s", rows)).withColumn("_ready", F.col("exit_i") + 1)
    return greedy_chain(b, list(keys), "_blk", "s", "_ready").where("accepted").drop("_blk", "_ready", "accepted")


def trades(frame: DataFrame, specs: Sequence[G.Spec], costs: Costs = Costs()) -> DataFrame:
    """All trades of every spec on every series."""
    trailing = any(float(s.get("trail_activate_atr") or 0) > 0 for s in specs)
    return thin(label(candidates(frame, specs), frame, costs, trailing))
