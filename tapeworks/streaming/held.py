"""Streams whose open positions and orders are a table between batches.

Every batch joins what is open with its prints through the levels of
``operators.levels``, writes what it decided and the table of what stays open, and
commits both. Nothing is keyed by symbol in one task, nothing is forgotten after a
fixed time, and a batch that runs again reads the same table and overwrites the same
folders. The table is rewritten per batch, so its cost follows what is open.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.operators.asof import asof_join
from tapeworks.operators.levels import first_fall, first_hit
from tapeworks.operators.scan import greedy_chain, previous, range_blocks, running
from tapeworks.session import pin
from tapeworks.streaming.ingest import run

Step = Callable[[DataFrame, dict[str, DataFrame]], tuple[dict[str, DataFrame], DataFrame]]


class TableStream:
    """Runs ``step(batch, tables) -> (tables, out)`` per batch; ``tables`` and ``out`` are given by their DDL."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str], out: str):
        self.spark, self.root, self.tables, self.out = spark, root.rstrip("/"), tables, out
        spark.range(0).select(F.lit(None).cast("timestamp").alias("at")).write.mode("ignore").parquet(f"{self.root}/commits/batch=-1")
        spark.createDataFrame([], out).write.mode("ignore").parquet(f"{self.root}/out/batch=-1")

    def committed(self) -> int:
        newest = self.spark.read.schema("at timestamp, batch long").parquet(f"{self.root}/commits").where("at is not null").agg(F.max("batch")).first()[0]
        return -1 if newest is None else newest

    def table(self, name: str, batch: int | None = None) -> DataFrame:
        """What was open after a batch, by default the last committed one."""
        n = self.committed() if batch is None else batch
        return self.spark.createDataFrame([], self.tables[name]) if n < 0 else self.spark.read.schema(self.tables[name]).parquet(f"{self.root}/{name}/batch={n}")

    def results(self) -> DataFrame:
        rows = self.spark.read.schema(f"{self.out}, batch long").parquet(f"{self.root}/out")
        return rows.where(F.col("batch") <= self.committed()).drop("batch")

    def run(self, stream: DataFrame, checkpoint: str, step: Step) -> DataFrame:
        def each(batch: DataFrame, n: int) -> None:
            after, out = step(pin(batch), {name: self.table(name, n - 1) for name in self.tables})
            for name, rows in {**after, "out": out}.items():
                rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={n}")
            done = self.spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1)
            done.write.mode("overwrite").parquet(f"{self.root}/commits/batch={n}")
        run(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        return self.results()


def place(prints: DataFrame, marks: DataFrame, tie: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Prints numbered in their symbol (``i``), and for every mark how many prints come before it (``n``).

    ``prints``: symbol, us and more; ``marks``: symbol, us, ``after`` (prints of the same
    microsecond count as before it) and more. One scan over both.
    """
    mine, theirs = F.struct(*prints.columns), F.struct(*marks.columns)
    kind = lambda df, s: df.select(s.alias("x")).schema["x"].dataType
    a = prints.select("symbol", "us", F.lit(1).alias("_side"), (F.struct(*tie) if tie else F.lit(0)).alias("_tie"), mine.alias("_p"), F.lit(None).cast(kind(marks, theirs)).alias("_m"))
    b = marks.select("symbol", "us", F.when(F.col("after"), 2).otherwise(0).alias("_side"), F.lit(None).cast(a.schema["_tie"].dataType).alias("_tie"),
                     F.lit(None).cast(kind(prints, mine)).alias("_p"), theirs.alias("_m"))
    order = ["us", "_side", "_tie"]
    both = range_blocks(a.unionByName(b), ["symbol"], order)
    both = pin(running(both, ["symbol"], "blk", order, {"n": ("sum", F.when(F.col("_side") == 1, 1).otherwise(0).cast("long"))}))
    return (both.where("_side = 1").select("_p.*", (F.col("n") - 1).alias("i")),
            both.where("_side <> 1").select("_m.*", "n"))


def as_bars(prints: DataFrame) -> DataFrame:
    return prints.select("symbol", "i", F.col("us").alias("t"), *[F.col("price").alias(c) for c in ("open", "high", "low")])


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


# ---- quotes --------------------------------------------------------------------------------


def quote_throttle(every_us: int) -> tuple[dict[str, str], str, Step]:
    """Passes a quote of a symbol when ``every_us`` have gone by since the last one passed: a greedy chain from batch to batch."""
    def step(batch: DataFrame, was: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
        quotes = batch.select("symbol", "us", "bid", "ask").join(was["passed"], "symbol", "left")
        free = quotes.where(F.col("last_us").isNull() | (F.col("us") >= F.col("last_us") + every_us)).drop("last_us")
        blocks = range_blocks(free.withColumn("ready", F.col("us") + every_us), ["symbol"], ["us", "bid", "ask"])
        out = pin(greedy_chain(blocks, ["symbol"], "blk", "us", "ready", ["bid", "ask"]).where("accepted").select("symbol", "us", "bid", "ask"))
        last = was["passed"].unionByName(out.select("symbol", F.col("us").alias("last_us"))).groupBy("symbol").agg(F.max("last_us").alias("last_us"))
        return {"passed": last}, out
    return {"passed": "symbol string, last_us bigint"}, "symbol string, us bigint, bid double, ask double", step


# ---- missing ids ---------------------------------------------------------------------------

MISSING = "symbol string, lo bigint, hi bigint, first bigint, last bigint"


def gap_ranges(order: str = "us") -> tuple[dict[str, str], str, Step]:
    """Ranges of trade ids that a jump leaves out ('open'), and each again once late trades have brought all of it ('filled').

    Batch rows are trades (symbol, trade_id, us) that arrive by ``order``. What is missing
    is kept as exact ranges that late ids split, so a replayed id changes nothing. Ids
    before a symbol's first row are not missing.
    """
    tables = {"newest": "symbol string, trade_id bigint", "missing": MISSING}

    def step(batch: DataFrame, was: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
        came = batch.select("symbol", F.col(order).alias("_at"), "trade_id", "us")
        newest = was["newest"].select("symbol", F.lit(None).cast(came.schema["_at"].dataType).alias("_at"), "trade_id", _none("bigint").alias("us"))  # a null sorts first
        by = ["_at", "trade_id"]
        rows = range_blocks(came.unionByName(newest), ["symbol"], by)
        rows = pin(running(rows, ["symbol"], "blk", by, {"top": ("max", F.col("trade_id"))}, exclusive=True))
        opened = rows.where("trade_id > top + 1").select("symbol", (F.col("top") + 1).alias("lo"), (F.col("trade_id") - 1).alias("hi"), "us")
        missing = pin(was["missing"].unionByName(opened.select("symbol", "lo", "hi", F.col("lo").alias("first"), F.col("hi").alias("last"))))
        late = rows.where("trade_id <= top").groupBy("symbol", "trade_id").agg(F.min(F.struct("_at", "us")).alias("came"))
        late = late.select("symbol", "trade_id", F.struct("came._at", "trade_id", "came.us").alias("came"))
        span = ["lo", "hi", "first", "last"]
        hits = pin(asof_join(late, missing, ["symbol"], "trade_id", "lo", span).where("trade_id <= hi"))
        touched = pin(hits.select("symbol", *span).distinct())
        # Between two neighbours among a range's ends and its late ids lies what is still missing.
        ends = touched.select("symbol", *span, F.explode(F.array(F.col("lo") - 1, F.col("hi") + 1)).alias("id"))
        points = range_blocks(hits.select("symbol", *span, F.col("trade_id").alias("id")).unionByName(ends), ["symbol"], ["lo", "id"])
        pairs = previous(points, ["symbol"], "blk", ["lo", "id"], {"lo": "lo_before", "id": "id_before"})
        rest = pairs.where("lo = lo_before and id > id_before + 1").select("symbol", (F.col("id_before") + 1).alias("lo"), (F.col("id") - 1).alias("hi"), "first", "last")
        stays = pin(missing.join(touched.select("symbol", "lo"), ["symbol", "lo"], "left_anti").unionByName(rest))
        whole = hits.groupBy("symbol", "first", "last").agg(F.max("came").alias("came")).join(stays.select("symbol", "first").distinct(), ["symbol", "first"], "left_anti")
        filled = whole.select("symbol", F.col("first").alias("lo"), F.col("last").alias("hi"), F.lit("filled").alias("status"), "came.us")
        after = {"newest": rows.groupBy("symbol").agg(F.max("trade_id").alias("trade_id")), "missing": stays}
        return after, opened.select("symbol", "lo", "hi", F.lit("open").alias("status"), "us").unionByName(filled)
    return tables, "symbol string, lo bigint, hi bigint, status string, us bigint", step


# ---- resting limit orders ------------------------------------------------------------------

ORDERS = "order_id string, symbol string, limit_px double, placed_us bigint, expires_us bigint, filled_us bigint"
ORDER_OUT = "order_id string, symbol string, status string, filled_us bigint"


def limit_orders(late_us: int = 0) -> tuple[dict[str, str], str, Step]:
    """Resting buys: filled by the first print at or below the limit from placement to before ``expires_us``, else expired.

    Batch rows are orders (``kind`` 'order') and prints ('print') in any mix. Prints and
    orders may be late by up to ``late_us`` against the newest event: an outcome is final,
    and leaves the table, when that much time has passed it.
    """
    tables = {"orders": ORDERS, "recent": "symbol string, us bigint, price double", "clock": "us bigint"}

    def step(batch: DataFrame, was: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
        clock = was["clock"].unionByName(batch.select("us")).agg(F.max("us")).first()[0]
        final = (clock or 0) - late_us
        new = batch.where("kind = 'order'").select("order_id", "symbol", "limit_px", F.col("us").alias("placed_us"), "expires_us", _none("bigint").alias("filled_us"))
        orders = pin(was["orders"].unionByName(new))
        prints = was["recent"].unionByName(batch.where("kind = 'print'").select("symbol", "us", "price"))
        ends = F.explode(F.array(F.struct(F.lit(True).alias("from_"), F.col("placed_us").alias("us")), F.struct(F.lit(False).alias("from_"), F.col("expires_us").alias("us"))))
        marks = orders.select("order_id", "symbol", ends.alias("e")).select("order_id", "symbol", "e.from_", "e.us", F.lit(False).alias("after"))
        numbered, at = place(prints, marks)
        span = at.groupBy("order_id").agg(F.max(F.when(F.col("from_"), F.col("n"))).alias("entry_i"), (F.max(F.when(~F.col("from_"), F.col("n"))) - 1).alias("last_i"))
        cands = orders.join(span, "order_id").withColumnRenamed("limit_px", "stop").withColumn("target", _none("double"))
        hit = first_hit(cands, as_bars(numbered), ["symbol"], ["order_id"]).select("order_id", F.col("hit.t").alias("touch_us"))
        seen = pin(orders.join(hit, "order_id", "left").withColumn("filled_us", F.least("filled_us", "touch_us")).drop("touch_us"))
        decided = F.coalesce("filled_us", "expires_us") <= final
        status = F.when(F.col("filled_us").isNotNull(), "filled").otherwise("expired")
        after = {"orders": seen.where(~decided), "recent": prints.where(F.col("us") >= final), "clock": batch.sparkSession.createDataFrame([(clock,)], "us bigint")}
        return after, seen.where(decided).select("order_id", "symbol", status.alias("status"), "filled_us")
    return tables, ORDER_OUT, step


def still_open(stream: TableStream) -> DataFrame:
    """Orders without a final outcome: touched, past their expiry, or open as of the newest event."""
    clock = stream.table("clock").first()
    over = F.col("expires_us") <= F.lit(clock["us"] if clock else None).cast("bigint")
    status = F.when(F.col("filled_us").isNotNull(), "filled").when(over, "expired").otherwise("open")
    return stream.table("orders").select("order_id", "symbol", status.alias("status"), "filled_us")


# ---- exits of open positions ---------------------------------------------------------------

HELD = ("position_id string, symbol string, opened_us bigint, entry double, stop double, target double, atr double, activate_atr double, "
        "trail_atr double, peak double")


def exit_alerts() -> tuple[dict[str, str], str, Step]:
    """One alert per position at its first print beyond the stop, the target or an armed trail, in this order; held until then.

    Batch rows are opens (``kind`` 'open', ``us`` the opening) and prints ('print', with
    ``trade_id``). The trail is tested before the peak moves. Prints count on arrival.
    """
    def step(batch: DataFrame, was: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
        new = batch.where("kind = 'open'").withColumns({"opened_us": F.col("us"), "peak": F.col("entry")}).select(was["held"].columns)
        held = pin(was["held"].unionByName(new))
        prints = batch.where("kind = 'print' and price > 0").select("symbol", "us", "price", "trade_id")
        marks = held.select("position_id", "symbol", F.col("opened_us").alias("us"), F.lit(True).alias("after"))
        numbered, at = place(prints, marks, ["trade_id"])
        bars = as_bars(numbered)
        size = bars.groupBy("symbol").agg((F.max("i")).alias("last_i"))
        cands = pin(held.join(at.select("position_id", F.col("n").alias("entry_i")), "position_id").join(size, "symbol").where("entry_i <= last_i"))
        me = ["position_id"]
        level = first_hit(cands, bars, ["symbol"], me).select("position_id", F.col("hit.i").alias("level_i"), F.col("hit.t").alias("level_us"), F.col("hit.low").alias("level_px"))
        armed_at = F.col("entry") + F.col("activate_atr") * F.col("atr") - 1e-12
        trailed = cands.where("atr > 0").withColumns({"drop": F.col("trail_atr") * F.col("atr"), "arm": armed_at})
        on = trailed.where("peak >= arm").select("symbol", *me, F.col("entry_i").alias("from_i"), "last_i", "peak", "drop")
        off = trailed.where("peak < arm").withColumns({"stop": _none("double"), "target": F.col("arm")})
        off = off.join(first_hit(off, bars, ["symbol"], me), me).select("symbol", *me, (F.col("hit.i") + 1).alias("from_i"), "last_i", F.greatest("peak", "hit.high").alias("peak"), "drop")
        trail = first_fall(on.unionByName(off), bars, ["symbol"], me).select(*me, "fall_i", F.col("fall_t").alias("fall_us"), F.col("fall_open").alias("fall_px"))
        out = pin(cands.join(level, me, "left").join(trail, me, "left"))
        first = F.col("level_i").isNotNull() & (F.col("fall_i").isNull() | (F.col("level_i") <= F.col("fall_i")))
        why = F.when(first, F.when(F.col("level_px") <= F.col("stop"), "stop").otherwise("target")).when(F.col("fall_i").isNotNull(), "trail")
        alerts = pin(out.withColumn("reason", why).where("reason is not null").select(
            *me, "reason", F.when(first, F.col("level_us")).otherwise(F.col("fall_us")).alias("us"), F.when(first, F.col("level_px")).otherwise(F.col("fall_px")).alias("price")))
        back = numbered.select("symbol", "i", "price", (-F.col("i")).alias("rev"), F.floor(-F.col("i") / 4096).alias("blk"))
        ahead = running(back, ["symbol"], "blk", ["rev"], {"top": ("max", F.col("price"))}).select("symbol", F.col("i").alias("entry_i"), "top")
        tops = cands.select(*me, "symbol", "entry_i").join(ahead, ["symbol", "entry_i"]).select(*me, "top")
        stays = held.join(alerts.select(*me), me, "left_anti").join(tops, me, "left").withColumn("peak", F.greatest("peak", "top")).select(held.columns)
        return {"held": stays}, alerts
    return {"held": HELD}, "position_id string, reason string, us bigint, price double", step


# ---- funding of open positions -------------------------------------------------------------

FUNDED = "position_id string, symbol string, opened_us bigint, side string, notional double, hours bigint, closed_us bigint"
HOUR_US = 3_600_000_000


def funding_accrual() -> tuple[dict[str, str], str, Step]:
    """Funding in whole hours since the last accrual, at the first rate print after each hour held, from opening to closing.

    Batch rows are opens, closes and rates (``kind``). A position stays in the table until
    a batch holds its close; an hour without a print yet waits for the next one.
    """
    def step(batch: DataFrame, was: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
        new = batch.where("kind = 'open'").select("position_id", "symbol", F.col("us").alias("opened_us"), "side", "notional", F.lit(0).cast("long").alias("hours"), _none("bigint").alias("closed_us"))
        closes = batch.where("kind = 'close'").groupBy("position_id").agg(F.min("us").alias("_closed"))
        held = was["held"].unionByName(new).join(closes, "position_id", "left").withColumn("closed_us", F.coalesce("closed_us", "_closed")).select(was["held"].columns)
        held = pin(held)
        rates = batch.where("kind = 'rate'").select("symbol", F.col("us").alias("rate_us"), "rate")
        newest = rates.groupBy("symbol").agg(F.max("rate_us").alias("newest"))
        due = held.join(newest, "symbol").withColumn("most", F.floor((F.least("newest", "closed_us") - F.col("opened_us")) / HOUR_US)).where("most > hours")
        due = due.withColumn("k", F.explode(F.sequence(F.col("hours") + 1, "most"))).withColumn("x", -(F.col("opened_us") + F.col("k") * HOUR_US))
        ahead = asof_join(due.select("position_id", "symbol", "opened_us", "closed_us", "side", "notional", "hours", "x"), rates.withColumn("y", -F.col("rate_us")), ["symbol"], "x", "y", ["rate_us", "rate"])
        paid = ahead.where("rate_us is not null and (closed_us is null or rate_us <= closed_us)").groupBy("position_id", "rate_us").agg(
            F.first("rate").alias("rate"), F.first("side").alias("side"), F.first("notional").alias("notional"), F.first("hours").alias("base"),
            F.floor((F.col("rate_us") - F.first("opened_us")) / HOUR_US).alias("h"))
        by = Window.partitionBy("position_id").orderBy("rate_us")
        paid = pin(paid.withColumn("step", F.col("h") - F.coalesce(F.lag("h").over(by), "base")))
        sign = F.when(F.col("side") == "short", 1.0).otherwise(-1.0)
        out = paid.select("position_id", F.col("rate_us").alias("us"), F.col("step").alias("hours"), (sign * F.col("rate") * F.abs("notional") * F.col("step")).alias("cash"))
        done = paid.groupBy("position_id").agg(F.max("h").alias("_h"))
        stays = held.where("closed_us is null").join(done, "position_id", "left").withColumn("hours", F.coalesce("_h", "hours")).select(held.columns)
        return {"held": stays}, out
    return {"held": FUNDED}, "position_id string, us bigint, hours bigint, cash double", step
