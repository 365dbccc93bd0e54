"""Queries on ticks, quotes, coverage and bars."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeworks import schemas
from tapeworks.functions.core import day_text, epoch_us, rounded
from tapeworks.operators import bars as B
from tapeworks.operators import coverage as C
from tapeworks.plans.inputs import NOW, Inputs
from tapeworks.plans.registry import query
from tapeworks.session import work_dir
from tapeworks.sources import store as S

TODAY = "2024-01-28"
TICK_OUT = """symbol, trade_id, us AS ts_us, round(price, 6) AS price, round(qty, 6) AS qty, side, ord_type"""
BAR_SQL = """symbol, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close,
    round(vwap, 8) AS vwap, round(volume, 6) AS volume, trades, round(buy_vol, 6) AS buy_vol,
    round(sell_vol, 6) AS sell_vol, buy_count, sell_count, round(ofi, 6) AS ofi, round(spread_bps, 6) AS spread_bps"""


def new_folder(x: Inputs, name: str) -> str:
    return f"{work_dir(x.spark)}/{name}-{uuid.uuid4().hex}"


def tick_out(df):
    return df.select("symbol", "trade_id", epoch_us("ts").alias("ts_us"),
                     *rounded(price=("price", 6), qty=("qty", 6)), "side", "ord_type")


def bar_out(df, *extra):
    counts = ("trades", "buy_count", "sell_count")
    return df.select("symbol", "t", *extra, *[F.col(c).cast("bigint").alias(c) if c in counts
                                              else F.round(c, 8 if c == "vwap" else 6).alias(c) for c in schemas.BAR])


# ---- sources and sinks -------------------------------------------------------------------

def text_store(x: Inputs) -> str:
    """Ticks as gzip text with headers, repeats and torn lines."""
    t = x.ticks().withColumn("day", day_text(epoch_us("ts")))
    sec = F.format_string("%d.%06d", F.floor(epoch_us("ts") / 1_000_000).cast("long"), F.pmod(epoch_us("ts"), F.lit(1_000_000)))
    line = F.concat_ws(",", "trade_id", sec, F.col("price").cast("string"), F.col("qty").cast("string"), "side", "ord_type")
    head = F.lit(",".join(S.TICK_FIELDS))
    torn = F.concat_ws(",", F.col("trade_id") + 10 ** 9, sec, F.col("price").cast("string"))
    extra = F.concat(line, F.lit(",x"))
    dup = F.expr("transform(sequence(1, 1 + cast(trade_id % 2 as int)), v -> 1)")
    lines = t.select("symbol", "day", "trade_id", line.alias("line"), torn.alias("torn"), extra.alias("extra"), dup.alias("dup"))
    value = F.explode(F.flatten(F.array(
        F.transform("dup", lambda v: F.col("line")),
        F.when(F.col("trade_id") % 50 == 0, F.array(head, F.col("torn"), F.col("extra")))
        .otherwise(F.array().cast("array<string>")))))
    root = new_folder(x, "ticks-text")
    S.write_text_store(lines.select("symbol", "day", value.alias("value")), root)
    return root


@query("a1_read_ticks", f"SELECT {TICK_OUT} FROM ticks", "ticks")
def a1(x: Inputs):
    """The text store read back."""
    return tick_out(S.read_ticks(x.spark, text_store(x)))


@query("a1_damage", """SELECT symbol, CAST(sum(1 + trade_id % 2 + CASE WHEN trade_id % 50 = 0 THEN 3 ELSE 0 END) AS BIGINT) AS lines, count(*) FILTER (trade_id % 50 = 0) AS headers,
    2 * count(*) FILTER (trade_id % 50 = 0) AS damaged, CAST(0 AS BIGINT) AS torn_files FROM ticks GROUP BY 1""", "ticks")
def a1_damage(x: Inputs):
    """Lines, headers and damaged lines of the text store; no file of it is torn."""
    d = S.damage(x.spark, text_store(x))
    return d.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in ("lines", "headers", "damaged")], F.count_if("torn").alias("torn_files"))


@query("a2_read_quotes", """SELECT symbol, us AS ts_us, round(bid, 6) AS bid, round(ask, 6) AS ask FROM quotes""", "quotes")
def a2(x: Inputs):
    q = x.quotes().withColumn("day", day_text(epoch_us("ts")))
    sec = F.format_string("%d.%06d", F.floor(epoch_us("ts") / 1_000_000).cast("long"), F.pmod(epoch_us("ts"), F.lit(1_000_000)))
    line = F.concat_ws(",", sec, F.col("bid").cast("string"), F.col("ask").cast("string"))
    root = new_folder(x, "quotes-text")
    S.write_text_store(q.select("symbol", "day", F.explode(F.array(line, line)).alias("value")), root, "none")
    return S.read_quotes(x.spark, root).select("symbol", epoch_us("ts").alias("ts_us"), *rounded(bid=("bid", 6), ask=("ask", 6)))


DAY_COUNTS = """SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, min(trade_id) AS first_id,
    max(trade_id) AS last_id, round(sum(price), 4) AS price_sum FROM ticks GROUP BY 1, 2"""


def day_counts(df):
    return df.groupBy("symbol", F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("trade_id").alias("first_id"), F.max("trade_id").alias("last_id"),
        F.round(F.sum("price"), 4).alias("price_sum"))


@query("a3_append_by_day", DAY_COUNTS, "ticks")
def a3(x: Inputs):
    root = new_folder(x, "store")
    S.append(x.ticks().drop("event_id"), root)
    return day_counts(S.read_store(x.spark, root, schemas.TICK))


@query("a4_compact", f"""SELECT symbol, day, CASE WHEN day < '{TODAY}' THEN rows ELSE rows + extra END AS rows, first_id, last_id
    FROM (SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, count(*) FILTER (event_id % 4 = 0) AS extra,
    min(trade_id) AS first_id, max(trade_id) AS last_id FROM ticks GROUP BY 1, 2)""", "ticks")
def a4(x: Inputs):
    """A store with repeats in every day; compaction cleans the closed days only."""
    root, t = new_folder(x, "store"), x.ticks()
    S.append(t.drop("event_id"), root)
    S.append(t.where("event_id % 4 = 0").drop("event_id"), root)
    S.compact(x.spark, root, schemas.TICK, TODAY)
    return day_counts(S.read_store(x.spark, root, schemas.TICK)).drop("price_sum")


@query("a4_compact_quotes", f"""SELECT symbol, day, CASE WHEN day < '{TODAY}' THEN rows ELSE rows + extra END AS rows, round(bids, 4) AS bids FROM (
    SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, count(*) FILTER (event_id % 7 = 0) AS extra, sum(CASE WHEN strftime(ts, '%Y-%m-%d') >= '{TODAY}' AND event_id % 7 = 0 THEN 2 * bid ELSE bid END) AS bids FROM quotes GROUP BY 1, 2)""", "quotes")
def a4q(x: Inputs):
    """Quotes by their time; only closed days that were written twice are rewritten."""
    root, q = new_folder(x, "quotes"), x.quotes()
    S.append(q.drop("event_id"), root, "ts")
    S.append(q.where("event_id % 7 = 0").drop("event_id"), root, "ts")
    S.compact(x.spark, root, schemas.QUOTE, TODAY, "ts")
    out = S.read_store(x.spark, root, schemas.QUOTE)
    return out.groupBy("symbol", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("bid"), 4).alias("bids"))


@query("a5_store_ends", """SELECT symbol, min(trade_id) AS first_id, min_by(us, trade_id) AS first_us, max(trade_id) AS last_id,
    max_by(us, trade_id) AS last_us FROM ticks GROUP BY symbol""", "ticks")
def a5(x: Inputs):
    return C.store_ends(x.ticks())


@query("a6_day_range", f"""SELECT {TICK_OUT} FROM ticks WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-10' AND '2024-01-12'""",
       "ticks")
def a6(x: Inputs):
    """Only the partitions of three days are read."""
    root = new_folder(x, "store")
    S.append(x.ticks().drop("event_id"), root)
    return tick_out(S.read_store(x.spark, root, schemas.TICK, ("2024-01-10", "2024-01-12")))


def other_store(x: Inputs):
    """A second machine's store: no late days, holes in some days."""
    return x.ticks().where("day(ts) <= 20 and not (day(ts) % 3 = 0 and trade_id % 7 = 0)")


OTHER = "SELECT * FROM ticks WHERE day(ts) <= 20 AND NOT (day(ts) % 3 = 0 AND trade_id % 7 = 0)"


@query("a7_import_days", f"""WITH other AS ({OTHER}), d AS (
    SELECT t.symbol, strftime(t.ts, '%Y-%m-%d') AS day, count(*) AS offered, count(o.trade_id) AS kept
    FROM ticks t LEFT JOIN other o ON o.symbol = t.symbol AND o.trade_id = t.trade_id GROUP BY 1, 2)
    SELECT symbol, day, offered, CASE WHEN day >= '{TODAY}' THEN 'skipped_open_day' WHEN kept = 0 THEN 'added'
      WHEN kept = offered THEN 'same' ELSE 'merged' END AS verdict,
      CASE WHEN day >= '{TODAY}' THEN 0 ELSE offered - kept END AS new_rows FROM d""", "ticks")
def a7(x: Inputs):
    return S.import_days(x.ticks(), other_store(x), TODAY)


MANIFEST = """SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, min(trade_id) AS first_id,
    max(trade_id) AS last_id, bit_xor(CAST('0x' || substr(md5(trade_id || '|' || us || '|' || side || '|' || ord_type || '|' ||
      CAST(round(price * 1e6) AS BIGINT) || '|' || CAST(round(qty * 1e6) AS BIGINT)), 1, 15) AS BIGINT)) AS digest"""


@query("a8_manifest", f"{MANIFEST} FROM ticks WHERE strftime(ts, '%Y-%m-%d') < '{TODAY}' GROUP BY 1, 2", "ticks")
def a8(x: Inputs):
    return S.manifest(x.ticks(), TODAY)


@query("a9_check_manifest", f"""WITH m AS ({MANIFEST} FROM ticks WHERE strftime(ts, '%Y-%m-%d') < '{TODAY}' GROUP BY 1, 2),
    other AS ({OTHER}), c AS ({MANIFEST} FROM other GROUP BY 1, 2),
    s AS (SELECT m.symbol, CASE WHEN c.rows IS NULL THEN 'missing' WHEN c.digest = m.digest THEN 'exact'
      WHEN c.rows >= m.rows AND c.first_id <= m.first_id AND c.last_id >= m.last_id THEN 'superset' ELSE 'short' END AS state
      FROM m LEFT JOIN c ON c.symbol = m.symbol AND c.day = m.day)
    SELECT symbol, count(*) AS listed, count(*) FILTER (state = 'exact') AS exact, count(*) FILTER (state = 'superset') AS superset,
      count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'short') AS short,
      count(*) FILTER (state IN ('missing', 'short')) = 0 AS ok FROM s GROUP BY symbol""", "ticks")
def a9(x: Inputs):
    return S.check_manifest(S.manifest(x.ticks(), TODAY), S.manifest(other_store(x), TODAY))


# ---- coverage ----------------------------------------------------------------------------

@query("e20_id_gaps", "SELECT symbol, lo, hi, before_us, after_us FROM gaps", "gaps")
def e20(x: Inputs):
    return C.id_gaps(x.ticks_gappy())


@query("e20_coverage_runs", "SELECT symbol, start_us, end_us FROM runs", "runs")
def e20_runs(x: Inputs):
    return C.coverage_runs(x.ticks_gappy(), x.verified(), x.status())


@query("c15_open_gaps", "SELECT symbol, lo, hi, before_us, after_us FROM open_gaps", "open_gaps")
def c15(x: Inputs):
    return C.open_gaps(C.id_gaps(x.ticks_gappy()), x.verified())


@query("g3_union_holes", """SELECT symbol, lo, hi FROM verified UNION SELECT symbol, lo, hi FROM gaps WHERE lo % 3 = 0""",
       "verified gaps")
def g3(x: Inputs):
    other = C.id_gaps(x.ticks_gappy()).where("lo % 3 = 0").select("symbol", "lo", "hi")
    return x.verified().union(other).distinct()


@query("d4_day_summary", """SELECT d.symbol, d.day, n, first_id, first_us, last_id, last_us, coalesce(h.holes, 0) AS holes,
    h.first_hole_us FROM (SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(trade_id) AS first_id,
      min_by(us, trade_id) AS first_us, max(trade_id) AS last_id, max_by(us, trade_id) AS last_us FROM ticks_gappy GROUP BY 1, 2) d
    LEFT JOIN (SELECT symbol, strftime(make_timestamp(before_us), '%Y-%m-%d') AS day, count(*) AS holes,
      min(before_us) AS first_hole_us FROM open_gaps WHERE before_us // 86400000000 = after_us // 86400000000 GROUP BY 1, 2) h
    ON h.symbol = d.symbol AND h.day = d.day""", "ticks_gappy open_gaps")
def d4(x: Inputs):
    return C.day_summary(x.ticks_gappy(), x.verified())


@query("d5_continuity", """SELECT t.symbol, first_day, last_day, rows, first_id, last_id, days, coalesce(open_gaps, 0) AS open_gaps,
    coalesce(verified_holes, 0) AS verified_holes, coalesce(open_gaps, 0) = 0 AS contiguous FROM (
      SELECT symbol, min(strftime(ts, '%Y-%m-%d')) AS first_day, max(strftime(ts, '%Y-%m-%d')) AS last_day, count(*) AS rows,
        min(trade_id) AS first_id, max(trade_id) AS last_id, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days
      FROM ticks_gappy GROUP BY symbol) t LEFT JOIN (
      SELECT g.symbol, count(*) FILTER (v.lo IS NULL) AS open_gaps, count(*) FILTER (v.lo IS NOT NULL) AS verified_holes
      FROM gaps g LEFT JOIN verified v ON v.symbol = g.symbol AND v.lo = g.lo AND v.hi = g.hi GROUP BY 1) g
    ON g.symbol = t.symbol""", "ticks_gappy gaps verified")
def d5(x: Inputs):
    return C.continuity(x.ticks_gappy(), x.verified())


# ---- bars --------------------------------------------------------------------------------

@query("d1_bars_1m", f"SELECT {BAR_SQL} FROM m1", "m1")
def d1(x: Inputs):
    return bar_out(x.bars_1m())


@query("c4_minute_spread", """SELECT symbol, us // 60000000 * 60 AS t,
    round(avg((ask - bid) / ((bid + ask) / 2) * 1e4), 6) AS spread_bps FROM quotes GROUP BY 1, 2""", "quotes")
def c4(x: Inputs):
    return B.minute_spread(x.quotes()).withColumn("spread_bps", F.round("spread_bps", 6))


def covered_sql(tf: int) -> str:
    s = tf * 60
    return f"""WITH g AS (SELECT DISTINCT symbol, unnest(generate_series(start_us // {s}000000 * {s} + {s},
          least(end_us, {NOW}000000) // {s}000000 * {s} - {s}, {s})) AS t FROM runs),
        mg AS (SELECT symbol, us // 60000000 * 60 AS t, min_by(price, trade_id) AS open, max(price) AS high, min(price) AS low,
          max_by(price, trade_id) AS close, sum(price * qty) / sum(qty) AS vwap, sum(qty) AS volume, count(*) AS trades,
          sum(CASE WHEN side = 'b' THEN qty ELSE 0 END) AS buy_vol, sum(CASE WHEN side = 'b' THEN 0 ELSE qty END) AS sell_vol,
          count(*) FILTER (side = 'b') AS buy_count, count(*) FILTER (side <> 'b') AS sell_count FROM ticks_gappy GROUP BY 1, 2),
        mq AS (SELECT symbol, us // 60000000 * 60 AS t, avg((ask - bid) / ((bid + ask) / 2) * 1e4) AS spread_bps FROM quotes GROUP BY 1, 2),
        b AS (SELECT mg.symbol, mg.t // {s} * {s} AS t, min_by(open, mg.t) AS open, max(high) AS high, min(low) AS low,
          max_by(close, mg.t) AS close, sum(vwap * volume) AS pq, sum(volume) AS volume, sum(trades) AS trades,
          sum(buy_vol) AS buy_vol, sum(sell_vol) AS sell_vol, sum(buy_count) AS buy_count, sum(sell_count) AS sell_count,
          avg(spread_bps) AS spread_bps FROM mg LEFT JOIN mq ON mq.symbol = mg.symbol AND mq.t = mg.t GROUP BY 1, 2),
        f AS (SELECT g.symbol, g.t, b.* EXCLUDE (symbol, t), last_value(close IGNORE NULLS) OVER (
          PARTITION BY g.symbol ORDER BY g.t ROWS UNBOUNDED PRECEDING) AS pc FROM g LEFT JOIN b ON b.symbol = g.symbol AND b.t = g.t)
        SELECT symbol, t, round(coalesce(open, pc), 6) AS open, round(coalesce(high, pc), 6) AS high,
          round(coalesce(low, pc), 6) AS low, round(coalesce(close, pc), 6) AS close, round(pq / nullif(volume, 0), 8) AS vwap,
          round(coalesce(volume, 0), 6) AS volume, CAST(coalesce(trades, 0) AS BIGINT) AS trades,
          round(coalesce(buy_vol, 0), 6) AS buy_vol, round(coalesce(sell_vol, 0), 6) AS sell_vol,
          CAST(coalesce(buy_count, 0) AS BIGINT) AS buy_count, CAST(coalesce(sell_count, 0) AS BIGINT) AS sell_count,
          round((buy_vol - sell_vol) / nullif(volume, 0), 6) AS ofi, round(spread_bps, 6) AS spread_bps FROM f WHERE pc IS NOT NULL"""


@query("d2_bars_covered", covered_sql(15), "runs quotes ticks_gappy")
def d2(x: Inputs):
    """15-minute bars over a stream with holes: only what is proved complete is emitted."""
    ticks = x.ticks_gappy()
    runs = C.coverage_runs(ticks, x.verified(), x.status())
    return bar_out(B.resample(B.ticks_to_1m(ticks, x.quotes()), runs, 15, NOW))


@query("d2_bars_1h", f"SELECT {BAR_SQL} FROM bars_60", "bars_60")
def d2_1h(x: Inputs):
    return bar_out(x.bars(60))


@query("d2_bars_4h", f"SELECT {BAR_SQL} FROM bars_240", "bars_240")
def d2_4h(x: Inputs):
    return bar_out(x.bars(240))


@query("d3_trade_bars", f"""WITH b AS (SELECT symbol, us // 900000000 * 900 AS t, min_by(price, trade_id) AS open, max(price) AS high,
      min(price) AS low, max_by(price, trade_id) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2)
    SELECT symbol, t // 14400 * 14400 AS t, round(min_by(open, t), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low,
      round(max_by(close, t), 6) AS close, round(sum(volume), 6) AS volume FROM b
    GROUP BY 1, 2 HAVING t // 14400 * 14400 < {NOW} // 14400 * 14400""".replace("HAVING t // 14400 * 14400", "HAVING min(b.t) // 14400 * 14400"),
       "ticks")
def d3(x: Inputs):
    out = B.plain_resample(B.trade_bars(x.ticks(), 15), 240, NOW)
    return out.select("symbol", "t", *rounded(**{c: (c, 6) for c in ("open", "high", "low", "close", "volume")}))


OHLC = "SELECT symbol, t, open, high, low, close * 1.001 AS close, volume FROM bars_60 WHERE t // 3600 % 2 = 0"


def ohlc_ref(x: Inputs):
    """A second source of hourly bars: even hours only, closes 0.1 % higher."""
    b = x.bars(60).where("t div 3600 % 2 = 0")
    return b.select("symbol", "t", "open", "high", "low", (F.col("close") * 1.001).alias("close"), "volume")


@query("c2_overlay", f"""WITH o AS (SELECT * FROM ({OHLC}) WHERE t >= 1704240000),
    l AS (SELECT * FROM bars_60 WHERE t // 3600 % 3 <> 0), f AS (SELECT symbol, min(t) AS f FROM o GROUP BY 1),
    k AS (SELECT l.* FROM l JOIN f ON f.symbol = l.symbol WHERE l.t >= f.f)
    SELECT coalesce(o.symbol, k.symbol) AS symbol, coalesce(o.t, k.t) AS t,
      round(CASE WHEN k.t IS NULL THEN o.open ELSE k.open END, 6) AS open,
      round(CASE WHEN k.t IS NULL THEN o.close ELSE k.close END, 6) AS close,
      round(CASE WHEN k.t IS NULL THEN o.volume ELSE k.volume END, 6) AS volume, round(k.ofi, 6) AS ofi,
      CASE WHEN k.t IS NULL THEN 'ohlc' ELSE 'ticks' END AS src FROM o FULL JOIN k ON k.symbol = o.symbol AND k.t = o.t""", "bars_60")
def c2(x: Inputs):
    out = B.overlay(ohlc_ref(x).where("t >= 1704240000"), x.bars(60).drop("tf").where("t div 3600 % 3 <> 0"))
    return out.select("symbol", "t", *rounded(open=("open", 6), close=("close", 6), volume=("volume", 6), ofi=("ofi", 6)), "src")


@query("c3_merge_daily", """WITH p AS (SELECT symbol, t, close FROM daily WHERE t // 86400 % 4 <> 0),
    k AS (SELECT symbol, t, close FROM daily WHERE t // 86400 % 2 = 0)
    SELECT symbol, t, round(close, 6) AS close FROM p UNION ALL
    SELECT symbol, t, round(close * 2, 6) AS close FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.symbol = k.symbol AND p.t = k.t)""",
       "daily")
def c3(x: Inputs):
    d = x.daily()
    out = B.merge_daily(d.where("t div 86400 % 4 <> 0"),
                        d.where("t div 86400 % 2 = 0").withColumn("close", F.col("close") * 2))
    return out.select("symbol", "t", F.round("close", 6).alias("close"))


@query("a11_merge_ohlc", """WITH n AS (SELECT symbol, t, close * 2 AS close FROM bars_60 WHERE t // 3600 % 5 = 0 AND t // 86400 % 9 <> 0),
    o AS (SELECT symbol, t, close FROM bars_60 WHERE t // 86400 % 9 <> 0),
    m AS (SELECT o.symbol, o.t, coalesce(n.close, o.close) AS close FROM o LEFT JOIN n ON n.symbol = o.symbol AND n.t = o.t),
    s AS (SELECT symbol, t, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS step FROM m),
    c AS (SELECT symbol, max(t) AS f, count(*) AS holes FROM s WHERE step > 3600 * 6 GROUP BY 1)
    SELECT m.symbol, m.t, round(m.close, 6) AS close, coalesce(c.holes, 0) AS holes FROM m LEFT JOIN c ON c.symbol = m.symbol
    WHERE c.f IS NULL OR m.t >= c.f""", "bars_60")
def a11(x: Inputs):
    """Two caches merged, the newer wins, cut to the run after the last gap of more than six bars."""
    old = x.bars(60).where("t div 86400 % 9 <> 0").select("symbol", "t", "close")
    new = old.where("t div 3600 % 5 = 0").withColumn("close", F.col("close") * 2)
    out = B.contiguous_tail(B.newest_wins([old, new], ["symbol", "t"]), 60, max_step=6)
    return out.withColumn("close", F.round("close", 6))


@query("e19_contiguous_tail", """WITH b AS (SELECT symbol, t, close FROM bars_60 WHERE t // 3600 % 50 <> 7),
    s AS (SELECT symbol, t, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS step FROM b),
    c AS (SELECT symbol, max(t) AS f, count(*) AS holes FROM s WHERE step > 3600 GROUP BY 1)
    SELECT b.symbol, b.t, round(b.close, 6) AS close, coalesce(c.holes, 0) AS holes FROM b LEFT JOIN c ON c.symbol = b.symbol
    WHERE c.f IS NULL OR b.t >= c.f""", "bars_60")
def e19(x: Inputs):
    b = x.bars(60).where("t div 3600 % 50 <> 7").select("symbol", "t", "close")
    return B.contiguous_tail(b, 60).withColumn("close", F.round("close", 6))


@query("e32_quiet_bars", """SELECT symbol, t, round(close, 6) AS close FROM bars_15 WHERE trades = 0""", "bars_15")
def e32(x: Inputs):
    """Covered bars without a trade carry the previous close."""
    return x.bars(15).where("trades = 0").select("symbol", "t", F.round("close", 6).alias("close"))


@query("g1_union_dedup", """SELECT symbol, count(*) AS rows, sum(trade_id) AS id_sum FROM ticks
    WHERE event_id % 3 <> 0 OR event_id % 2 = 0 GROUP BY 1""", "ticks")
def g1(x: Inputs):
    t = x.ticks()
    parts = [t.where("event_id % 3 <> 0"), t.where("event_id % 2 = 0")]
    return (B.newest_wins(parts, ["symbol", "trade_id"]).groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("trade_id").alias("id_sum")))
