"""Domain inputs derived from the driver tables, in Spark and in SQL.

Each input exists twice: as a method of ``Inputs`` (Spark) and as an entry of
``TABLES`` (SQL, used only by the checks).
"""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.core import bar_open, epoch_us
from tapeworks.operators.bars import resample, ticks_to_1m
from tapeworks.operators.coverage import coverage_runs
from tapeworks.operators.features import add_technicals, index_bars
from tapeworks.operators.scan import block_no, more_partitions, ordinals
from tapeworks.session import pin

NOW = 1_706_745_600  # 2024-02-01 00:00 UTC, after the last event


def stored(fn):
    """Keep a derived table as files, the way a tick or bar store would, once per query."""
    @functools.wraps(fn)
    def once(self, *args):
        key = (fn.__name__, *args)
        if key not in self._stored:
            self._stored[key] = pin(fn(self, *args))
        return self._stored[key]
    return once


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._stored: dict[tuple, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def numbered(self) -> DataFrame:
        """Events with a symbol and a gap-free trade id per symbol."""
        ev = self.table("events").select(
            F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("symbol"),
            "event_id", "ts", "event_type", "value", "props", block_no("event_id").alias("blk"))
        return ordinals(ev, ["symbol"], "blk", ["event_id"], "n").withColumn("trade_id", F.col("n") + 1)

    @stored
    def ticks(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("double")
        return self.numbered().select(
            "symbol", "trade_id", "ts", (F.col("value") + 1).alias("price"), (k + 1).alias("qty"),
            F.when(F.col("event_id") % 2 == 0, "b").otherwise("s").alias("side"),
            F.when(F.col("event_id") % 5 == 0, "m").otherwise("l").alias("ord_type"), "event_id")

    def ticks_gappy(self) -> DataFrame:
        return self.ticks().where(F.col("event_id") % 97 != 0)

    def verified(self) -> DataFrame:
        """Single missing ids that the exchange confirms, as ranges."""
        gone = self.ticks().where((F.col("event_id") % 97 == 0) & (F.col("trade_id") % 2 == 0))
        return gone.select("symbol", F.col("trade_id").alias("lo"), F.col("trade_id").alias("hi"))

    def quotes(self) -> DataFrame:
        mid = F.col("value") + 1
        wide = 0.0002 * (1 + F.col("event_id") % 4)
        ev = self.table("events").where(F.col("event_id") % 3 == 0)
        return ev.select(F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("symbol"), "ts",
                         (mid * (1 - wide)).alias("bid"), (mid * (1 + wide)).alias("ask"), "event_id")

    def status(self) -> DataFrame:
        """Feed heartbeat per symbol: one hour after the last trade; S2 is out of sync."""
        t = self.ticks_gappy()
        return t.groupBy("symbol").agg(
            (F.max(epoch_us("ts")) + 3_600_000_000).alias("live_through_us"),
            F.max("trade_id").alias("last_trade_id")).withColumn("in_sync", F.col("symbol") != "S2")

    def bars_1m(self) -> DataFrame:
        return ticks_to_1m(self.ticks(), self.quotes())

    @stored
    def bars(self, tf: int) -> DataFrame:
        ticks = self.ticks()
        return resample(ticks_to_1m(ticks, self.quotes()), coverage_runs(ticks), tf, NOW)

    @stored
    def indexed(self, tf: int) -> DataFrame:
        return index_bars(self.bars(tf))

    @stored
    def features(self, tf: int) -> DataFrame:
        return add_technicals(self.indexed(tf))

    @stored
    def daily(self) -> DataFrame:
        o = self.table("orders")
        return o.groupBy(F.concat(F.lit("S"), (F.col("o_custkey") % 3).cast("string")).alias("symbol"),
                         bar_open(epoch_us("o_orderdate"), 86400).alias("t")).agg(
            F.max_by("o_totalprice", "o_orderkey").alias("close"))

    def closed_trades(self) -> DataFrame:
        o = self.table("orders")
        net = ((F.col("o_orderkey") * 7919) % 601 - 290).cast("double")
        return o.select(
            F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("sleeve"),
            F.concat(F.lit("S"), (F.col("o_custkey") % 3).cast("string")).alias("symbol"),
            (epoch_us("o_orderdate") / 1_000_000).cast("long").alias("ts"), net.alias("net_bps"),
            (net * F.col("o_totalprice") / 1e6).alias("pnl"),
            F.when(F.col("o_orderstatus") == "F", "fill").otherwise("sync").alias("source"),
            F.element_at(F.array(F.lit("trend"), F.lit("chop"), F.lit("volatile_chop")),
                         (F.col("o_orderkey") % 3 + 1).cast("int")).alias("regime"),
            F.lit(0.03).alias("stop_frac"), F.col("o_totalprice").alias("notional"))

    @stored
    def fills(self) -> DataFrame:
        rows = self.table("lineitem")
        parts = more_partitions(rows)
        rows = rows.repartition(parts, "l_orderkey", "l_linenumber") if parts else rows
        li = rows.groupBy("l_orderkey", "l_linenumber").agg(
            F.min(F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                           "l_linestatus", "l_tax")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return li.select(
            F.concat(F.lit("S"), (F.col("l_partkey") % 3).cast("string")).alias("symbol"),
            (epoch_us("l_shipdate") / 1_000_000).cast("long").alias("ts"), "l_orderkey", "l_linenumber",
            F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
            F.col("l_quantity").alias("vol"), price.alias("price"), F.col("l_extendedprice").alias("cost"),
            (price * F.col("l_quantity") * F.col("l_tax") / 100).alias("fee"))

    def holdings(self) -> DataFrame:
        """Holding periods: entry at every 50th trade, exit 40 trades later."""
        t = self.ticks().select("symbol", "trade_id", "price", epoch_us("ts").alias("us"))
        entry = t.where(F.col("trade_id") % 50 == 1).select(
            "symbol", F.col("trade_id").alias("entry_id"), F.col("price").alias("entry_px"),
            F.col("us").alias("entry_us"), (F.col("trade_id") + 40).alias("exit_id"))
        leave = t.where(F.col("trade_id") % 50 == 41).select(
            "symbol", F.col("trade_id").alias("exit_id"), F.col("price").alias("exit_px"),
            F.col("us").alias("exit_us"))
        return entry.join(leave, ["symbol", "exit_id"])

    def decisions(self) -> DataFrame:
        ev = self.numbered()
        action = (F.when(F.col("event_type") == "purchase", "BUY")
                  .when(F.col("event_type") == "error", "SELL").otherwise("WAIT"))
        reason = (F.when(F.col("event_type") == "view", "Filters failed: regime, trend")
                  .when(F.col("event_type") == "click", "Filters failed: volume").otherwise("ok"))
        signal = F.struct(action.alias("action"),
                          F.get_json_object("props", "$.k").cast("bigint").alias("score"),
                          reason.alias("reason"), (F.col("value") + 1).alias("price"))
        risk = F.struct((F.col("event_type") == "purchase").alias("approved"))
        return ev.select("event_id", "symbol", epoch_us("ts").alias("ts_us"), signal.alias("signal"),
                         risk.alias("risk"))


# ---- the same inputs in SQL, for the checks -------------------------------------------------

TABLES: dict[str, tuple[str, str]] = {
    "ticks": ("", """SELECT 'S' || (user_id % 3) AS symbol,
        row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS trade_id, ts, epoch_us(ts) AS us,
        value + 1 AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS qty,
        CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 's' END AS side,
        CASE WHEN event_id % 5 = 0 THEN 'm' ELSE 'l' END AS ord_type, event_id, event_type, value, props FROM events"""),
    "ticks_gappy": ("ticks", "SELECT * FROM ticks WHERE event_id % 97 <> 0"),
    "verified": ("ticks", """SELECT symbol, trade_id AS lo, trade_id AS hi FROM ticks
        WHERE event_id % 97 = 0 AND trade_id % 2 = 0"""),
    "quotes": ("", """SELECT 'S' || (user_id % 3) AS symbol, ts, epoch_us(ts) AS us, event_id,
        (value + 1) * (1 - 0.0002 * (1 + event_id % 4)) AS bid,
        (value + 1) * (1 + 0.0002 * (1 + event_id % 4)) AS ask FROM events WHERE event_id % 3 = 0"""),
    "status": ("ticks_gappy", """SELECT symbol, max(us) + 3600000000 AS live_through_us, max(trade_id) AS last_trade_id,
        symbol <> 'S2' AS in_sync FROM ticks_gappy GROUP BY symbol"""),
    "gaps": ("ticks_gappy", """SELECT symbol, before_id + 1 AS lo, trade_id - 1 AS hi, before_us, us AS after_us FROM (
        SELECT *, lag(trade_id) OVER w AS before_id, lag(us) OVER w AS before_us FROM ticks_gappy
        WINDOW w AS (PARTITION BY symbol ORDER BY trade_id)) WHERE trade_id > before_id + 1"""),
    "open_gaps": ("gaps verified", """SELECT g.* FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM verified v
        WHERE v.symbol = g.symbol AND v.lo = g.lo AND v.hi = g.hi)"""),
    "runs": ("ticks_gappy open_gaps status", """SELECT r.symbol, start_us,
        CASE WHEN rn_last = 1 AND s.in_sync AND s.last_trade_id <= last_id AND s.live_through_us > end_us
             THEN s.live_through_us ELSE end_us END AS end_us FROM (
          SELECT symbol, run, min_by(us, trade_id) AS start_us, max_by(us, trade_id) AS end_us, max(trade_id) AS last_id,
            row_number() OVER (PARTITION BY symbol ORDER BY run DESC) AS rn_last FROM (
            SELECT t.*, sum(CASE WHEN g.symbol IS NULL THEN 0 ELSE 1 END)
                OVER (PARTITION BY t.symbol ORDER BY t.trade_id ROWS UNBOUNDED PRECEDING) AS run
            FROM ticks_gappy t LEFT JOIN open_gaps g ON g.symbol = t.symbol AND g.hi + 1 = t.trade_id)
          GROUP BY symbol, run) r JOIN status s ON s.symbol = r.symbol"""),
    "m1": ("ticks quotes", """SELECT a.*, q.spread_bps FROM (
        SELECT symbol, us // 60000000 * 60 AS t, min_by(price, trade_id) AS open, max(price) AS high, min(price) AS low,
          max_by(price, trade_id) AS close, sum(price * qty) / nullif(sum(qty), 0) AS vwap, sum(qty) AS volume,
          count(*) AS trades, sum(CASE WHEN side = 'b' THEN qty ELSE 0 END) AS buy_vol,
          sum(CASE WHEN side = 'b' THEN 0 ELSE qty END) AS sell_vol,
          count(*) FILTER (side = 'b') AS buy_count, count(*) FILTER (side <> 'b') AS sell_count,
          (sum(CASE WHEN side = 'b' THEN qty ELSE -qty END)) / nullif(sum(qty), 0) AS ofi
        FROM ticks GROUP BY 1, 2) a LEFT JOIN (
        SELECT symbol, us // 60000000 * 60 AS t, avg((ask - bid) / ((bid + ask) / 2) * 1e4) AS spread_bps
        FROM quotes GROUP BY 1, 2) q ON q.symbol = a.symbol AND q.t = a.t"""),
    "daily": ("", """SELECT 'S' || (o_custkey % 3) AS symbol, epoch_us(o_orderdate) // 86400000000 * 86400 AS t,
        max_by(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2"""),
    "closed_trades": ("", """SELECT o_orderkey AS id, o_orderpriority AS sleeve, 'S' || (o_custkey % 3) AS symbol,
        epoch_us(o_orderdate) // 1000000 AS ts, CAST((o_orderkey * 7919) % 601 - 290 AS DOUBLE) AS net_bps,
        CAST((o_orderkey * 7919) % 601 - 290 AS DOUBLE) * o_totalprice / 1e6 AS pnl,
        CASE WHEN o_orderstatus = 'F' THEN 'fill' ELSE 'sync' END AS source,
        CASE o_orderkey % 3 WHEN 0 THEN 'trend' WHEN 1 THEN 'chop' ELSE 'volatile_chop' END AS regime,
        CAST(0.03 AS DOUBLE) AS stop_frac, o_totalprice AS notional FROM orders"""),
    "fills": ("", """SELECT 'S' || (l_partkey % 3) AS symbol, epoch_us(l_shipdate) // 1000000 AS ts, l_orderkey, l_linenumber,
        CASE l_linestatus WHEN 'O' THEN 'buy' ELSE 'sell' END AS side, l_quantity AS vol,
        l_extendedprice / l_quantity AS price, l_extendedprice AS cost,
        l_extendedprice / l_quantity * l_quantity * l_tax / 100 AS fee FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey,
            l_extendedprice, l_quantity, l_linestatus, l_tax) AS rn FROM lineitem) WHERE rn = 1"""),
    "holdings": ("ticks", """SELECT a.symbol, b.trade_id AS exit_id, a.trade_id AS entry_id, a.price AS entry_px,
        a.us AS entry_us, b.price AS exit_px, b.us AS exit_us FROM ticks a JOIN ticks b
        ON b.symbol = a.symbol AND b.trade_id = a.trade_id + 40 WHERE a.trade_id % 50 = 1"""),
    "decisions": ("ticks", """SELECT event_id, symbol, us AS ts_us,
        CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'error' THEN 'SELL' ELSE 'WAIT' END AS action,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS score,
        CASE event_type WHEN 'view' THEN 'Filters failed: regime, trend' WHEN 'click' THEN 'Filters failed: volume'
          ELSE 'ok' END AS reason, price, event_type = 'purchase' AS approved FROM ticks"""),
}


def _bars_sql(tf: int) -> str:
    s = tf * 60
    return f"""SELECT symbol, {tf} AS tf, t, coalesce(open, pc) AS open, coalesce(high, pc) AS high, coalesce(low, pc) AS low,
        coalesce(close, pc) AS close, pq / nullif(volume, 0) AS vwap, coalesce(volume, 0) AS volume,
        CAST(coalesce(trades, 0) AS BIGINT) AS trades, coalesce(buy_vol, 0) AS buy_vol, coalesce(sell_vol, 0) AS sell_vol,
        CAST(coalesce(buy_count, 0) AS BIGINT) AS buy_count, CAST(coalesce(sell_count, 0) AS BIGINT) AS sell_count,
        (buy_vol - sell_vol) / nullif(volume, 0) AS ofi, spread_bps,
        row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i FROM (
      SELECT g.symbol, g.t, b.* EXCLUDE (symbol, t),
        last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.t ROWS UNBOUNDED PRECEDING) AS pc
      FROM (SELECT symbol, unnest(generate_series(a // {s}000000 * {s} + {s},
              least(b, {NOW}000000) // {s}000000 * {s} - {s}, {s})) AS t
            FROM (SELECT symbol, min_by(us, trade_id) AS a, max_by(us, trade_id) AS b FROM ticks GROUP BY symbol)) g
      LEFT JOIN (SELECT symbol, t // {s} * {s} AS t, min_by(open, t) AS open, max(high) AS high, min(low) AS low,
          max_by(close, t) AS close, sum(coalesce(vwap, close) * volume) AS pq, sum(volume) AS volume, sum(trades) AS trades,
          sum(buy_vol) AS buy_vol, sum(sell_vol) AS sell_vol, sum(buy_count) AS buy_count, sum(sell_count) AS sell_count,
          avg(spread_bps) AS spread_bps FROM m1 GROUP BY 1, 2) b ON b.symbol = g.symbol AND b.t = g.t) WHERE pc IS NOT NULL"""


for _tf in (15, 60, 240, 1440):
    TABLES[f"bars_{_tf}"] = ("ticks m1", _bars_sql(_tf))


def _feature_sql(tf: int) -> dict[str, tuple[str, str]]:
    """Features of one timeframe: recurrences as explicit weighted sums over all earlier bars."""
    def seeded(x: str, alpha: float, first: int = 0) -> str:
        return (f"sum(CASE WHEN b.i < {first} THEN 0 WHEN b.i = {first} THEN 1 ELSE {alpha!r} END "
                f"* pow({1 - alpha!r}, a.i - b.i) * {x})")

    def wilder(x: str) -> str:
        return f"sum(CASE WHEN b.i < 14 THEN pow({1 - 1 / 14!r}, a.i - 13) ELSE pow({1 - 1 / 14!r}, a.i - b.i) END * {x} / 14)"
    emas = ", ".join(f"{seeded('b.close', 2 / (n + 1))} AS ema{n}" for n in (20, 50, 80, 100, 200))
    w = "PARTITION BY symbol ORDER BY i ROWS BETWEEN"
    prior = ", ".join(
        f"CASE WHEN i >= {n} THEN max(high) OVER ({w} {n} PRECEDING AND 1 PRECEDING) END AS prior_high{n}, "
        f"CASE WHEN i >= {n} THEN avg(volume) OVER ({w} {n} PRECEDING AND 1 PRECEDING) END AS prior_vol{n}" for n in (20, 55))
    return {
        f"lag_{tf}": (f"bars_{tf}", f"""SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
            coalesce(greatest(close - pc, 0), 0) AS up, coalesce(greatest(pc - close, 0), 0) AS dn,
            CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
            CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm FROM (
            SELECT *, lag(close) OVER o AS pc, lag(high) OVER o AS ph, lag(low) OVER o AS pl FROM bars_{tf}
            WINDOW o AS (PARTITION BY symbol ORDER BY i))"""),
        f"smooth_{tf}": (f"lag_{tf}", f"""SELECT a.symbol, a.i, {emas}, {seeded('b.up', 1 / 14, 1)} AS up,
            {seeded('b.dn', 1 / 14, 1)} AS dn, {seeded('b.tr', 1 / 14)} AS atr, {wilder('b.tr')} AS wtr,
            {wilder('b.pdm')} AS wpd, {wilder('b.mdm')} AS wmd
            FROM lag_{tf} a JOIN lag_{tf} b ON b.symbol = a.symbol AND b.i <= a.i GROUP BY 1, 2"""),
        f"dx_{tf}": (f"smooth_{tf}", f"""SELECT *, CASE WHEN i < 13 THEN 0 ELSE coalesce(100 * abs(100 * wpd / nullif(wtr, 0)
            - 100 * wmd / nullif(wtr, 0)) / nullif(100 * wpd / nullif(wtr, 0) + 100 * wmd / nullif(wtr, 0), 0), 0) END AS dx,
            CASE WHEN i < 1 THEN 50 ELSE coalesce(100 - 100 / (1 + up / nullif(dn, 0)), 50) END AS rsi FROM smooth_{tf}"""),
        f"adx_{tf}": (f"dx_{tf}", f"""SELECT a.symbol, a.i, CASE WHEN a.i >= 13 THEN {wilder('b.dx')} END AS adx
            FROM dx_{tf} a JOIN dx_{tf} b ON b.symbol = a.symbol AND b.i <= a.i GROUP BY 1, 2"""),
        f"feat_{tf}": (f"lag_{tf} dx_{tf} adx_{tf}", f"""SELECT j.*,
            CASE WHEN n200 >= 50 THEN (list_count_less + (list_count_same + 1) / 2.0) / n200 END AS atr_rank,
            CASE WHEN j.i >= 9 THEN (volume - m20) / nullif(s20, 0) END AS vol_z,
            CASE WHEN n50 >= 25 THEN (ofi - m50) / nullif(s50, 0) END AS ofi_z FROM (
          SELECT *, len(list_filter(r200, lambda v: v < atr_pct)) AS list_count_less,
            len(list_filter(r200, lambda v: v = atr_pct)) AS list_count_same, len(r200) AS n200 FROM (
          SELECT *, list(atr_pct) OVER ({w} 199 PRECEDING AND CURRENT ROW) AS r200,
            avg(volume) OVER ({w} 19 PRECEDING AND CURRENT ROW) AS m20, stddev_pop(volume) OVER ({w} 19 PRECEDING AND CURRENT ROW) AS s20,
            avg(ofi) OVER ({w} 49 PRECEDING AND CURRENT ROW) AS m50, stddev_pop(ofi) OVER ({w} 49 PRECEDING AND CURRENT ROW) AS s50,
            count(ofi) OVER ({w} 49 PRECEDING AND CURRENT ROW) AS n50,
            CASE WHEN i >= 2 THEN sum(buy_vol - sell_vol) OVER ({w} 2 PRECEDING AND CURRENT ROW)
              / nullif(sum(buy_vol + sell_vol) OVER ({w} 2 PRECEDING AND CURRENT ROW), 0) END AS flow3,
            sum(buy_vol - sell_vol) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW) AS cvd,
            lag(ofi) OVER (PARTITION BY symbol ORDER BY i) AS prev_ofi,
            max(high) OVER ({w} 21 PRECEDING AND CURRENT ROW) AS hh22, {prior},
            coalesce(last_value(CASE WHEN adx > 25 THEN true WHEN adx < 20 THEN false END IGNORE NULLS)
              OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW), false) AS adx_on25,
            coalesce(last_value(CASE WHEN adx > 30 THEN true WHEN adx < 20 THEN false END IGNORE NULLS)
              OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW), false) AS adx_on30 FROM (
          SELECT l.symbol, l.tf, l.t, l.i, l.open, l.high, l.low, l.close, l.volume, l.buy_vol, l.sell_vol, l.trades,
            (l.buy_vol - l.sell_vol) / nullif(l.buy_vol + l.sell_vol, 0) AS ofi, l.spread_bps, l.tr,
            d.ema20, d.ema50, d.ema80, d.ema100, d.ema200, d.rsi, d.atr, d.atr / nullif(l.close, 0) AS atr_pct, x.adx
          FROM lag_{tf} l JOIN dx_{tf} d ON d.symbol = l.symbol AND d.i = l.i
          JOIN adx_{tf} x ON x.symbol = l.symbol AND x.i = l.i))) j"""),
    }


for _tf in (15, 60, 240):
    TABLES.update(_feature_sql(_tf))


def with_tables(names: list[str], body: str) -> str:
    """``WITH`` clause holding the named inputs and all they need, then ``body``."""
    seen: dict[str, str] = {}

    def need(name: str) -> None:
        if name in seen:
            return
        deps, text = TABLES[name]
        for d in deps.split():
            need(d)
        seen[name] = text
    for n in names:
        need(n)
    if not seen:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({t})" for n, t in seen.items())
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body.lstrip()[len('WITH RECURSIVE'):]}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes},\n{body.lstrip()[5:]}"
    return f"WITH {ctes}\n{body}"
