"""Searching ahead in a series through levels of block summaries.

Bars are level 0; a node of level k spans ``FAN ** k`` bars. A search that starts at a
bar looks at the rest of its group on every level, from the bars up, and so covers the
whole series with at most ``FAN`` nodes a level; the first node that can hold a hit is
then opened level by level. A candidate is one row per level, however long the series.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.session import pin

FAN = 64


def n_levels(bars: DataFrame, index: str = "i", fan: int = FAN) -> int:
    """Levels until one group spans the longest series."""
    top, levels = bars.agg(F.max(index)).first()[0] or 0, 1
    while fan ** levels <= top:
        levels += 1
    return levels


def _probes(start: Column, last: Column, levels: int, fan: int) -> Column:
    """(lvl, grp, start): the rest of the start's own group on each level; what would start after ``last`` is left out."""
    rows = []
    for k in range(levels):
        first = start if k == 0 else F.floor(start / fan ** k) + 1
        group = F.floor(start / fan ** (k + 1))
        inside = (F.floor(first / fan) == group) & (first * fan ** k <= last)
        rows.append(F.when(inside, F.struct(F.lit(k).alias("lvl"), group.alias("grp"), first.cast("long").alias("first"))))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def first_hit(cands: DataFrame, bars: DataFrame, keys: Sequence[str], ident: Sequence[str], fan: int = FAN) -> DataFrame:
    """First bar in ``entry_i .. last_i`` with ``low <= stop`` or ``high >= target``: ``ident`` and the bar as ``hit``.

    ``bars``: keys, i, t, open, high, low. Levels that are NULL are never reached. Every
    candidate meets at most ``fan`` nodes of a level, and only those that reach pass the join.
    """
    keys, ident = list(keys), list(ident)
    levels = n_levels(bars, fan=fan)
    nodes = bars.select(*keys, F.lit(0).alias("lvl"), F.col("i").cast("long").alias("node"), "t", "open", "high", "low")
    empty = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("t", "open")]
    tree = nodes
    for k in range(1, levels):
        up = nodes.groupBy(*keys, F.floor(F.col("node") / fan ** k).alias("node")).agg(F.max("high").alias("high"), F.min("low").alias("low"))
        tree = tree.unionByName(up.select(*keys, F.lit(k).alias("lvl"), "node", *empty, "high", "low"))
    tree = tree.withColumn("grp", F.floor(F.col("node") / fan))
    span = F.element_at(F.array(*[F.lit(fan ** k).cast("long") for k in range(levels)]), F.col("lvl") + 1)
    slim = cands.select(*dict.fromkeys([*keys, *ident]), "entry_i", "last_i", "stop", "target")
    carried = [F.first(c).alias(c) for c in dict.fromkeys([*keys, "last_i", "stop", "target"]) if c not in ident]
    reach = F.coalesce((F.col("low") <= F.col("stop")) | (F.col("high") >= F.col("target")), F.col("low") <= F.col("stop"), F.col("high") >= F.col("target"), F.lit(False))
    reach = reach & (F.col("node") * span <= F.col("last_i"))
    first = F.min(F.struct("lvl", "node", "t", "open", "high", "low")).alias("n")

    probes = slim.withColumn("p", F.explode(_probes(F.col("entry_i"), F.col("last_i"), levels, fan))).select("*", "p.*").drop("p", "entry_i")
    found = probes.join(tree, [*keys, "lvl", "grp"]).where((F.col("node") >= F.col("first")) & reach).groupBy(*ident).agg(*carried, first)
    for _ in range(levels - 1):  # nodes above the bars are opened, one level a turn; found bars wait
        open_ = F.col("n.lvl") > 0
        at = found.withColumns({"lvl": F.when(open_, F.col("n.lvl") - 1).otherwise(-1), "grp": F.col("n.node")})
        inside = at.withColumnRenamed("n", "was").join(tree, [*keys, "lvl", "grp"], "left")
        inside = inside.where((F.col("was.lvl") == 0) | reach)
        found = inside.groupBy(*ident).agg(*carried, F.min(F.when(F.col("was.lvl") == 0, F.col("was")).otherwise(F.struct("lvl", "node", "t", "open", "high", "low"))).alias("n"))
    n = F.col("n")
    return found.select(*ident, F.struct(n["node"].alias("i"), n["t"].alias("t"), n["open"].alias("open"), n["high"].alias("high"), n["low"].alias("low")).alias("hit"))


def fall_levels(bars: DataFrame, keys: Sequence[str], levels: int, fan: int = FAN) -> DataFrame:
    """Groups of nodes with what a falling search needs: (keys, lvl, grp, kids of node, t, open, hi, lo, fall).

    ``fall`` is the largest drop from a high to a later bar's low inside the node. Two
    neighbours compose to one: the larger fall, or from the first's high to the second's low.
    """
    keys = list(keys)
    level = bars.select(*keys, F.col("i").cast("long").alias("node"), "t", "open", F.col("high").alias("hi"), F.col("low").alias("lo"), F.lit(None).cast("double").alias("fall"))
    none = [F.lit(None).cast(level.schema[c].dataType).alias(c) for c in ("t", "open")]
    groups = []
    for k in range(levels):
        level = level.withColumn("grp", F.floor(F.col("node") / fan))
        kid = F.struct("node", "t", "open", "hi", "lo", "fall")
        groups.append(level.groupBy(*keys, F.lit(k).alias("lvl"), "grp").agg(F.array_sort(F.collect_list(kid)).alias("kids")))
        before = Window.partitionBy(*keys, "grp").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        drop = F.greatest("fall", F.max("hi").over(before) - F.col("lo"))
        up = level.withColumn("fall", drop).groupBy(*keys, "grp").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("fall").alias("fall"))
        level = up.select(*keys, F.col("grp").alias("node"), *none, "hi", "lo", "fall")
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    return pin(out)


def first_fall(cands: DataFrame, bars: DataFrame, keys: Sequence[str], ident: Sequence[str], fan: int = FAN) -> DataFrame:
    """First bar in ``from_i .. last_i`` whose low is ``drop`` or more below the highest high before it.

    ``cands`` carry ``from_i, last_i, peak`` (the highest price so far) and ``drop``. Gives
    ``ident``, the bar as ``fall_i, fall_t, fall_open`` and the ``peak`` before it. A node
    is passed over if its own largest fall and the fall from the incoming peak to its low
    both stay short; its high then joins the peak. One row per candidate throughout.
    """
    keys, ident = list(keys), list(ident)
    levels = n_levels(bars, fan=fan)
    tree = fall_levels(bars, keys, levels, fan)
    carry = list(dict.fromkeys([*keys, *ident]))
    kid = tree.schema["kids"].dataType.elementType
    cur = cands.select(*carry, "from_i", "last_i", "peak", "drop", F.lit(-1).alias("at"), F.lit(None).cast(kid).alias("hit"))

    def look(cur: DataFrame, level: int, wanted: Column, group: Column, first: Column) -> DataFrame:
        """Folds the nodes of one group into the peak until one holds the fall; other rows wait."""
        here = cur.withColumns({"lvl": F.when(wanted, level).otherwise(-1), "grp": F.when(wanted, group).otherwise(F.col("from_i")), "first": first})
        here = here.join(tree, [*keys, "lvl", "grp"], "left")
        mine = F.filter("kids", lambda n: (n["node"] >= F.col("first")) & (n["node"] * fan ** level <= F.col("last_i")))

        def step(s: Column, n: Column) -> Column:
            falls = F.greatest(n["fall"], s["peak"] - n["lo"]) >= F.col("drop")
            return F.when(s["hit"].isNotNull(), s).when(falls, F.struct(s["peak"].alias("peak"), n.alias("hit"))).otherwise(
                F.struct(F.greatest(s["peak"], n["hi"]).alias("peak"), s["hit"].alias("hit")))

        start = F.struct(F.col("peak"), F.lit(None).cast(kid).alias("hit"))
        folded = F.aggregate(F.coalesce(mine, F.array().cast(tree.schema["kids"].dataType)), start, step)
        looked = F.col("lvl") == level
        out = here.withColumn("_to", F.when(looked, folded))
        return out.select(*carry, "from_i", "last_i", F.when(looked, F.col("_to.peak")).otherwise(F.col("peak")).alias("peak"), "drop",
                          F.when(looked & F.col("_to.hit").isNotNull(), level).otherwise(F.col("at")).alias("at"), F.when(looked, F.col("_to.hit")).otherwise(F.col("hit")).alias("hit"))

    start = F.col("from_i")
    for k in range(levels):
        first, group = (start if k == 0 else F.floor(start / fan ** k) + 1), F.floor(start / fan ** (k + 1))
        cur = look(cur, k, F.col("hit").isNull() & (F.floor(first / fan) == group) & (first * fan ** k <= F.col("last_i")), group, first)
    for k in range(levels - 1, 0, -1):
        cur = look(cur, k - 1, (F.col("at") == k) & F.col("hit").isNotNull(), F.col("hit.node"), F.lit(0).cast("long"))
    return cur.where(F.col("hit").isNotNull()).select(*ident, F.col("hit.node").alias("fall_i"), F.col("hit.t").alias("fall_t"), F.col("hit.open").alias("fall_open"), "peak")
