"""Ordered scans that never put one key's rows into one task.

A series is cut into blocks that hold a bounded number of rows.  Work inside a
block is an ordinary window over ``(keys, block)``; what crosses block edges is
a carry table with one row per block, scanned per key and joined back.  Both
sides of that join are hashed on ``(keys, block)``, the partitioning the block
window needs anyway.

Blocks come from one of two places:

* a number that is unique inside the key (trade ids, bar numbers): ``id div n``
  holds at most ``n`` rows, whatever the key's share of the table;
* ``range_blocks``: range partitions over keys and a unique order, written once.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.session import pin

BLOCK_ROWS = 1 << 16
RANGE_ROWS = 1 << 18
_ALL_BEFORE = Window.unboundedPreceding


def block_no(number: str | Column, rows: int = BLOCK_ROWS) -> Column:
    """Block of a number that is unique within its key: at most ``rows`` rows each."""
    col = F.col(number) if isinstance(number, str) else number
    return F.floor(col / F.lit(rows)).cast("long")


def more_partitions(df: DataFrame) -> int | None:
    """Partitions of ``RANGE_ROWS`` rows, where the session's number of them would hold more; else None."""
    need = math.ceil(df.count() / RANGE_ROWS)
    return need if need > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 name: str = "blk", blocks: int | None = None) -> DataFrame:
    """Blocks from a range partitioning on keys plus a unique order.

    The partitioner samples its bounds, so the result is pinned: both passes of
    a scan must see the same bounds.  A heavy key spans as many blocks as it
    needs; without ``blocks`` adaptive execution sizes them by bytes, and a table
    for which the session's partitions would hold more than ``RANGE_ROWS`` rows
    each gets more of them, as a window keeps its block in memory.
    """
    blocks = blocks or more_partitions(df)
    spread = [blocks] if blocks else []
    cut = df.repartitionByRange(*spread, *keys, *order).withColumn(name, F.spark_partition_id().cast("long"))
    return pin(cut)


def split_blocks(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], rows: int = 50_000) -> DataFrame:
    """Cut blocks further, so that no block of a key holds more than ``rows`` rows.

    For work that loads a block into Python: its size no longer depends on how
    many range partitions there were.
    """
    w = Window.partitionBy(*keys, block).orderBy(*order)
    part = F.floor((F.row_number().over(w) - 1) / rows)
    return df.withColumn(block, (F.col(block) * (1 << 24) + part).cast("long"))


def _shared(keys: Sequence[str], block: str) -> list[str]:
    return [*keys, block]


def running(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str],
            specs: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """Running ``sum | min | max | last`` over the whole key, one new column per spec.

    ``last`` is the last non-null value.  ``exclusive`` leaves out the row itself.
    """
    on = _shared(keys, block)
    stop = -1 if exclusive else Window.currentRow
    here = Window.partitionBy(*on).orderBy(*order).rowsBetween(_ALL_BEFORE, stop)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(_ALL_BEFORE, -1)

    src = df.select("*", *[expr.alias(f"_x_{name}") for name, (_, expr) in specs.items()])
    totals, carries, local, out = [], [], [], []
    for name, (kind, _) in specs.items():
        x, c, v = F.col(f"_x_{name}"), F.col(f"_c_{name}"), F.col(f"_v_{name}")
        if kind == "last":
            total = F.max_by(x, F.when(x.isNotNull(), F.struct(*order)))
            carry, inside, both = F.last(c, True).over(before), F.last(x, True).over(here), F.coalesce(v, c)
        elif kind == "sum":
            total, carry, inside = F.sum(x), F.sum(c).over(before), F.sum(x).over(here)
            both = F.coalesce(v, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif kind in ("min", "max"):
            fn, pick = (F.min, F.least) if kind == "min" else (F.max, F.greatest)
            total, carry, inside, both = fn(x), fn(c).over(before), fn(x).over(here), pick(v, c)
        else:
            raise ValueError(f"unknown running kind {kind!r}")
        totals.append(total.alias(f"_c_{name}"))
        carries.append(carry.alias(f"_c_{name}"))
        local.append(inside.alias(f"_v_{name}"))
        out.append(both.alias(name))
    per_block = src.groupBy(*on).agg(*totals).select(*on, *carries)
    rows = src.select("*", *local).join(per_block, on)
    return rows.select(*[rows[c] for c in df.columns], *out)


def ordinals(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str],
             name: str = "i") -> DataFrame:
    """Dense 0-based row number within the key."""
    out = running(df, keys, block, order, {name: ("sum", F.lit(1).cast("long"))})
    return out.withColumn(name, (F.col(name) - 1).cast("long"))


def previous(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str],
             cols: dict[str, str]) -> DataFrame:
    """The previous row's values, across block edges: ``{source column: new name}``."""
    both = running(df, keys, block, order,
                   {"_prev": ("last", F.struct(*[F.col(c).alias(c) for c in cols]))}, exclusive=True)
    return both.select(*df.columns, *[F.col(f"_prev.{c}").alias(n) for c, n in cols.items()])


def with_halo(df: DataFrame, index: str, reach: int, rows: int = 2048, ahead: int = 0,
              block: str = "hblk", home: str = "home") -> DataFrame:
    """Copy each row into the later blocks that look back at it (``reach`` rows).

    ``index`` is a dense row number, so a block holds ``rows`` own rows and at
    most ``reach + ahead`` borrowed ones.  Filter on ``home`` after the window.
    """
    i = F.col(index)
    first, last = F.floor((i - ahead) / rows), F.floor((i + reach) / rows)
    out = df.withColumn(block, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return out.withColumn(home, F.col(block) == F.floor(i / rows))


def _decayed(weight: float) -> Callable[[Column, Column], Column]:
    return lambda acc, v: acc * F.lit(weight) + v


def linear_scan(df: DataFrame, keys: Sequence[str], index: str, block: str,
                terms: dict[str, tuple[Column, float]], rows: int) -> DataFrame:
    """``y[t] = d*y[t-1] + c[t]`` for every term ``{name: (c, d)}``, with ``block = index div rows``.

    Inside a block the recurrence is a weighted running sum.  The carry is the
    same recurrence over block totals; blocks whose weight has fallen below
    double precision are left out of the frame.
    """
    on = _shared(keys, block)
    here = Window.partitionBy(*on).orderBy(index).rowsBetween(_ALL_BEFORE, Window.currentRow)
    j = F.col(index) - F.col(block) * rows
    src = df.select("*", *[c.alias(f"_x_{name}") for name, (c, _) in terms.items()])
    totals, carries, local, out = [], [], [], []
    for name, (_, d) in terms.items():
        x, c = F.col(f"_x_{name}"), F.col(f"_c_{name}")
        frame = max(1, math.ceil(41.5 / (-math.log(d) * rows)))
        before = Window.partitionBy(*keys).orderBy(block).rowsBetween(-frame, -1)
        totals.append(F.sum(x * F.pow(F.lit(d), F.lit(rows - 1) - j)).alias(f"_c_{name}"))
        carries.append(F.aggregate(F.collect_list(c).over(before), F.lit(0.0),
                                   _decayed(d ** rows)).alias(f"_c_{name}"))
        local.append((F.pow(F.lit(d), j) * F.sum(x * F.pow(F.lit(1 / d), j)).over(here)).alias(f"_v_{name}"))
        out.append((F.col(f"_v_{name}") + c * F.pow(F.lit(d), j + 1)).alias(name))
    per_block = src.groupBy(*on).agg(*totals).select(*on, *carries)
    rows_df = src.select("*", *local).join(per_block, on)
    return rows_df.select(*[rows_df[c] for c in df.columns], *out)


def compose_scan(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], step: Column,
                 compose: Callable[[Column, Column], Column], name: str, rows: int = 1024) -> DataFrame:
    """Adds the composition of every row's ``step`` from the key's first row up to this one.

    ``step`` is a struct that stands for a map of the state; ``compose(first, then)`` is the
    map that does both. Inside a block of at most ``rows`` rows the prefixes are doubled:
    each turn composes a row with the one twice as far back, all over one sort. The blocks'
    last rows are one map each and are scanned the same way, so no task sees a whole key.
    """
    keys, on = list(keys), _shared(keys, block)
    w = Window.partitionBy(*on).orderBy(*order)
    far = lambda p, q: F.when(p.isNull(), q).otherwise(compose(p, q))
    past = f"{name}_upto"  # another name on every level, as a level's rows already carry the one above's
    local = df.withColumn(name, step)
    for k in range(max(1, math.ceil(math.log2(rows)))):
        local = local.withColumn("_back", F.lag(name, 1 << k).over(w)).withColumn(name, far(F.col("_back"), F.col(name))).drop("_back")
    local = pin(local)
    ends = local.groupBy(*on).agg(F.max_by(name, F.struct(*order)).alias("_end"))
    ends = pin(ends.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy(block)) - 1))
    if not ends.agg(F.max("_no")).first()[0]:
        return local
    upto = compose_scan(ends.withColumn("_group", block_no("_no", rows)), keys, "_group", ["_no"], F.col("_end"), compose, past, rows)
    before = ends.select(*on, "_no").join(upto.select(*keys, (F.col("_no") + 1).alias("_no"), past), [*keys, "_no"]).drop("_no")
    return local.join(before, on, "left").withColumn(name, far(F.col(past), F.col(name))).drop(past)


def greedy_chain(df: DataFrame, keys: Sequence[str], block: str, start: str, ready: str,
                 tie: Sequence[str] = (), name: str = "accepted") -> DataFrame:
    """Walk rows in ``start`` order; accept one if ``start >= ready`` of the last accepted row.

    Inside a block every row knows when it is free again after the chain that
    begins with it has left the block; the first start at or after that time is
    the next block's entry.  These pointers are doubled by self-joins until the
    entries of all visited blocks are known, so the work is a few joins per
    doubling and no task walks a whole key.  Then the blocks are finished side by
    side.  A row that is ready again by its own start stops nobody and is left
    out of the pointers.
    """
    keys, order, never = list(keys), [start, *tie], -(2 ** 62)
    on = _shared(keys, block)
    df = pin(df)
    spread = df.groupBy(*keys).agg(F.count_distinct(block).alias("n")).agg(F.max("n")).first()[0] or 0
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*on).schema)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        free, flags = int(pdf["_free"].iloc[0]), []
        for s, r in zip(pdf[start].to_numpy(), pdf[ready].to_numpy()):
            ok = s >= free
            flags.append(ok)
            free = int(r) if ok else free
        return pdf.drop(columns="_free").assign(**{name: flags})

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(start)  # sorted: the first row of a start is the one that the chain meets
        s, out = pdf[start].to_numpy(), pdf[ready].to_numpy().copy()
        nxt = s.searchsorted(out, side="left")
        for k in range(len(s) - 1, -1, -1):
            if nxt[k] < len(s):
                out[k] = out[nxt[k]]
        return pdf[on].assign(_at=s, _out=out)

    if spread <= 1:
        state = df.withColumn("_free", F.lit(never))
    else:
        stops = df.where(F.col(ready) > F.col(start)).select(*on, *order, ready)
        exits = stops.groupBy(*on).applyInPandas(lambda pdf: leave(pdf.sort_values(order, kind="stable")), f"{key_ddl}, _at bigint, _out bigint")
        exits = exits.groupBy(*keys, "_at").agg(F.min(F.struct(block, "_out")).alias("_e"))  # equal starts may straddle blocks: the first counts
        exits = pin(exits.select(*keys, f"_e.{block}", "_at", "_e._out"))
        visited = chain_entries(exits, keys, block)
        before = Window.partitionBy(*keys).orderBy(block).rowsBetween(_ALL_BEFORE, -1)
        per_block = df.select(*on).distinct().join(visited.groupBy(*on).agg(F.max("_out").alias("_out")), on, "left")
        per_block = per_block.select(*on, F.coalesce(F.max("_out").over(before), F.lit(never)).alias("_free"))
        state = df.join(per_block, on)
    return state.groupBy(*on).applyInPandas(mark, f"{ddl}, {name} boolean")


def chain_entries(exits: DataFrame, keys: Sequence[str], block: str) -> DataFrame:
    """Rows of ``exits`` (keys, block, _at, _out) at which the chain of a key enters its blocks, from the key's first row on.

    ``_out`` is the time a chain that enters at ``_at`` is free again beyond the block.
    """
    from tapeworks.operators.asof import asof_join

    keys = list(keys)
    wanted = exits.select(*keys, "_out", (-F.col("_out")).alias("_x")).distinct()
    starts = exits.select(*keys, F.col("_at").alias("_to"), (-F.col("_at")).alias("_y"))
    ahead = asof_join(wanted, starts, keys, "_x", "_y", ["_to"])  # negated times: the first start at or after _out
    jump = exits.join(ahead.where(F.col("_to").isNotNull()).select(*keys, "_out", "_to"), [*keys, "_out"], "left")
    first = exits.groupBy(*keys).agg(F.min("_at").alias("_at"))
    entries = ahead.where(F.col("_to").isNotNull()).select(*keys, F.col("_to").alias("_at")).unionByName(first).distinct()
    jump = pin(jump.join(entries, [*keys, "_at"]).select(*keys, "_at", "_to").where(F.col("_to").isNotNull()))
    reached = pin(first)
    while jump.limit(1).count():  # twice as far each time: reached covers 2^k blocks, jump skips as many
        reached = pin(reached.unionByName(reached.join(jump, [*keys, "_at"]).select(*keys, F.col("_to").alias("_at"))).distinct())
        onward = jump.select(*keys, F.col("_at").alias("_to"), F.col("_to").alias("_next"))
        jump = pin(jump.join(onward, [*keys, "_to"]).select(*keys, "_at", F.col("_next").alias("_to")))
    return exits.join(reached, [*keys, "_at"])
