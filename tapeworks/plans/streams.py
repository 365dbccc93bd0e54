"""Streaming jobs run over files written from the tables, until nothing is left to read."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks import schemas
from tapeworks.functions.core import epoch_us, rounded
from tapeworks.plans.feeds import PLAIN, feed_lines
from tapeworks.plans.inputs import NOW, Inputs
from tapeworks.plans.market_data import new_folder
from tapeworks.plans.registry import query
from tapeworks.plans.stats import GATE_SQL, entry_requests
from tapeworks.session import pin
from tapeworks.sources.snapshots import SnapshotStore
from tapeworks.streaming import held as H
from tapeworks.streaming import ingest as I
from tapeworks.streaming import stateful as Z


def write_files(spark, df, path: str, files: int, done: int, kind: str = "parquet") -> None:
    """One step of arrivals as exactly ``files`` files, written side by side; ``done`` steps are in the folder already.

    A task without rows writes no file, so empty ones make up the number: a stream that
    takes ``files`` files a batch then reads one step per batch.
    """
    df.write.mode("append").format(kind).save(path)
    empty = spark.createDataFrame([], df.schema).coalesce(1)
    have = len(spark.read.format(kind).schema(df.schema).load(path).inputFiles())
    for _ in range(files * (done + 1) - have):
        empty.write.mode("append").format(kind).save(path)


def write_parts(df, path: str, order: str, parts: int = 3) -> int:
    """Parts in event order, one after the other, each as so many files: a file stream reads the oldest files first."""
    spark, files = df.sparkSession, df.sparkSession.sparkContext.defaultParallelism
    at = F.unix_micros(order) if dict(df.dtypes)[order] == "timestamp" else F.col(order)
    edges = df.select(F.percentile_approx(at, [k / parts for k in range(1, parts)], 10_000).alias("e")).first()["e"]
    for k, (lo, hi) in enumerate(zip([None, *edges], [*edges, None])):
        part = df if lo is None else df.where(at >= lo)
        part = part if hi is None else part.where(at < hi)
        write_files(spark, part.repartition(files).sortWithinPartitions(order), path, files, k)
    return files


def stream_of(x: Inputs, df, order: str, name: str, parts: int = 3):
    path = new_folder(x, name)
    files = write_parts(df, path, order, parts)
    return x.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def message_files(x: Inputs) -> tuple[str, int]:
    """Feed messages as text files in arrival order: every seventh trade is sent twice, and every eleventh comes after all others, weeks late."""
    path = new_folder(x, "messages")
    lines = feed_lines(x).withColumn("no", F.coalesce(F.get_json_object("value", "$.data[0].trade_id").cast("bigint"), F.lit(0)))
    lines = lines.withColumn("o", F.concat(F.when(F.col("no") % 11 == 5, "late ").otherwise("in time "), F.get_json_object("value", "$.data[0].timestamp")))
    twice = lines.unionByName(lines.where("no % 7 = 3").withColumn("o", F.concat(F.lit("replay "), "o")))
    return path, write_lines(twice, path)


def write_lines(lines, path: str) -> int:
    """So many files per kind of arrival, the oldest first: in time, then late, then the replays."""
    spark, files = lines.sparkSession, lines.sparkSession.sparkContext.defaultParallelism
    for k, kind in enumerate(("in time", "late", "replay")):
        rows = lines.where(F.col("o").startswith(kind)).repartition(files).sortWithinPartitions("o").select("value")
        write_files(spark, rows, path, files, k, "text")
    return files


def tick_store(x: Inputs, name: str, schema: str = schemas.TICK) -> SnapshotStore:
    return SnapshotStore(x.spark, new_folder(x, name), schema, ["trade_id"])


@query("t1_ingest", "SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, sum(trade_id) AS ids, round(sum(price), 4) AS price_sum FROM ticks GROUP BY 1, 2", "ticks")
def t1(x: Inputs):
    """Messages to trades, merged into the store by symbol and day; late trades reach their day, replays do not."""
    store = tick_store(x, "ingested")
    I.ingest(I.trade_stream(I.message_stream(x.spark, *message_files(x)), PLAIN), store, new_folder(x, "cp"))
    return store.read().groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("rows"), F.sum("trade_id").alias("ids"), F.round(F.sum("price"), 4).alias("price_sum"))


def tick_rows(x: Inputs):
    return x.ticks().select("symbol", "trade_id", epoch_us("ts").alias("us"), "price", "qty", "side", "ord_type", "event_id", F.timestamp_micros(epoch_us("ts")).alias("at"))


@query("t2_drop_replays", "SELECT symbol, trade_id, us FROM ticks", "ticks")
def t2(x: Inputs):
    """Every third trade arrives a second time, up to weeks later; every arrival counts once."""
    t = tick_rows(x).select("symbol", "trade_id", "us")
    twice = t.withColumn("seq", F.col("us")).unionByName(t.where("trade_id % 3 = 0").withColumn("seq", F.col("us") + F.col("trade_id") % 20 * 86_400_000_000))
    store = tick_store(x, "once", "symbol string, trade_id bigint, ts timestamp_ntz")
    I.ingest(stream_of(x, twice, "seq", "replays").drop("seq"), store, new_folder(x, "cp"))
    return store.arrivals().select("symbol", "trade_id", epoch_us("ts").alias("us"))


@query("t3_gaps", """SELECT symbol, lo, hi, 'open' AS status FROM gaps UNION ALL SELECT g.symbol, g.lo, g.hi, 'filled' FROM gaps g WHERE lo % 2 = 0 AND hi = lo""", "gaps")
def t3(x: Inputs):
    """Ranges of missing ids while they are open, and again once late trades filled them (all with an even id do)."""
    cols = ["symbol", "trade_id", "us"]
    live = tick_rows(x).where("event_id % 97 <> 0").select(*cols, F.col("us").alias("seq"))
    late = tick_rows(x).where("event_id % 97 = 0 and trade_id % 2 = 0").select(*cols, (F.col("us") + 400 * 86_400_000_000).alias("seq"))
    tables, out, step = H.gap_ranges("seq")
    gaps = H.TableStream(x.spark, new_folder(x, "missing"), tables, out).run(stream_of(x, live.unionByName(late), "seq", "gappy", 2), new_folder(x, "cp"), step)
    return gaps.select("symbol", "lo", "hi", "status")


@query("t4_candles", """SELECT symbol, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, trades FROM m1 WHERE t + 60 + 600 <= (SELECT max(us) FROM ticks) / 1e6""", "m1 ticks")
def t4(x: Inputs):
    """Minute candles that the watermark has closed."""
    s = I.minute_candles(stream_of(x, tick_rows(x), "us", "ticks"))
    out = I.run_to_table(s, new_folder(x, "out"), new_folder(x, "cp"))
    return out.select("symbol", "t", *rounded(open=("open", 6), high=("high", 6), low=("low", 6), close=("close", 6)), "trades")


def positions(x: Inputs):
    """A position at every 200th trade, with levels from its entry price."""
    t = tick_rows(x).where("trade_id % 200 = 1")
    px = F.col("price")
    return t.select(F.concat_ws("|", "symbol", "trade_id").alias("position_id"), "symbol", F.col("us").alias("opened_us"), px.alias("entry"), (px * 0.6).alias("stop"), (px * 2.5).alias("target"),
                    (px * 0.2).alias("atr"), F.lit(1.5).alias("activate_atr"), F.lit(1.0).alias("trail_atr"))


def feed(x: Inputs, name: str, **kinds):
    """Rows of several kinds as one stream in time order; columns that a kind lacks are NULL."""
    rows = None
    for kind, df in kinds.items():
        df = df.withColumn("kind", F.lit(kind))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    return stream_of(x, rows, "us", name)


@query("t5_exit_alerts", """WITH p AS (SELECT symbol || '|' || trade_id AS position_id, symbol, us AS opened, price AS entry FROM ticks WHERE trade_id % 200 = 1),
    j AS (SELECT p.position_id, p.entry, t.us, t.trade_id, t.price, greatest(p.entry, max(t.price) OVER (PARTITION BY p.position_id ORDER BY t.us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS peak
      FROM p JOIN ticks t ON t.symbol = p.symbol AND t.us > p.opened),
    r AS (SELECT *, CASE WHEN price <= entry * 0.6 THEN 'stop' WHEN price >= entry * 2.5 THEN 'target' WHEN peak - entry + 1e-12 >= 1.5 * (entry * 0.2) AND price <= peak - entry * 0.2 THEN 'trail' END AS reason FROM j)
    SELECT position_id, reason, us, price FROM (SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY us) AS rk FROM r WHERE reason IS NOT NULL) WHERE rk = 1""", "ticks")
def t5(x: Inputs):
    """Opens and prints as one feed; every position is followed to its exit."""
    opens = positions(x).withColumnRenamed("opened_us", "us")
    prints = tick_rows(x).select("symbol", "trade_id", "us", "price")
    tables, out, step = H.exit_alerts()
    return H.TableStream(x.spark, new_folder(x, "held"), tables, out).run(feed(x, "opens-prints", open=opens, print=prints), new_folder(x, "cp"), step)


@query("t6_bench_stream")
def t6s(x: Inputs):
    """The bench state machine as a keyed processor; the tests compare it with the batch job."""
    Z.use_rocksdb(x.spark)
    t = x.closed_trades().select(F.concat_ws("|", "sleeve", "symbol").alias("key"), "id", "ts", "net_bps")
    s = Z.apply(stream_of(x, t, "ts", "closed"), ["key"], Z.BenchGate())
    return I.run_to_table(s, new_folder(x, "out"), new_folder(x, "cp"))


@query("t6_gate_stream", GATE_SQL, "closed_trades")
def t6gs(x: Inputs):
    """The same verdicts from one keyed state machine over closes and requests in time order."""
    Z.use_rocksdb(x.spark)
    closes = x.closed_trades().select("sleeve", "symbol", "regime", F.col("ts").alias("us"), "id", "net_bps")
    asks = entry_requests(x).withColumnRenamed("now", "us")
    s = Z.apply(feed(x, "closes-requests", close=closes, request=asks), ["sleeve", "symbol"], Z.EntryGate())
    return I.run_to_table(s, new_folder(x, "out"), new_folder(x, "cp"))


@query("t7_quote_throttle", """WITH RECURSIVE q AS MATERIALIZED (SELECT * FROM quotes), c AS (SELECT symbol, CAST(-1 AS BIGINT) AS us, CAST(-9000000000000 AS BIGINT) AS ready FROM q GROUP BY 1
    UNION ALL SELECT c.symbol, n.us, n.us + 3600000000 FROM c, LATERAL (SELECT q.us FROM q WHERE q.symbol = c.symbol AND q.us >= c.ready ORDER BY q.us LIMIT 1) n)
    SELECT q.symbol, q.us, q.bid, q.ask FROM q JOIN c ON c.symbol = q.symbol AND c.us = q.us""", "quotes")
def t7(x: Inputs):
    """At most one quote an hour per symbol, counted from the last one passed."""
    q = x.quotes().select("symbol", epoch_us("ts").alias("us"), "bid", "ask")
    tables, out, step = H.quote_throttle(H.HOUR_US)
    return H.TableStream(x.spark, new_folder(x, "passed"), tables, out).run(stream_of(x, q, "us", "quotes"), new_folder(x, "cp"), step)


@query("t8_feed_watch", "SELECT symbol, max(us) AS last_us FROM ticks GROUP BY 1", "ticks")
def t8(x: Inputs):
    """Heartbeat state per feed; stale reports depend on the batches and are left out of the result."""
    Z.use_rocksdb(x.spark)
    ticks = stream_of(x, tick_rows(x).select("symbol", "us", "at"), "us", "beats").withWatermark("at", "10 seconds")
    s = Z.apply(ticks.select("symbol", "us", "at"), ["symbol"], Z.FeedWatch(), time_mode="EventTime")
    out = I.run_to_table(s, new_folder(x, "out"), new_folder(x, "cp"))
    return out.where("status = 'live'").groupBy("symbol").agg(F.max("last_us").alias("last_us"))


@query("t9_funding_accrual", """WITH p AS (SELECT symbol || '|' || trade_id AS position_id, symbol, us AS opened, CASE WHEN trade_id % 400 = 1 THEN us + 432000000000 END AS closed FROM ticks WHERE trade_id % 200 = 1),
    j AS (SELECT p.position_id, p.opened, q.us, (q.event_id % 21 - 10) * 1e-5 AS rate, (q.us - p.opened) // 3600000000 AS h FROM p JOIN quotes q ON q.symbol = p.symbol AND q.us > p.opened AND (closed IS NULL OR q.us <= closed))
    SELECT position_id, us, h - prev AS hours, round(rate * 100 * (h - prev), 8) AS cash FROM (SELECT *, coalesce(lag(h) OVER (PARTITION BY position_id ORDER BY us), 0) AS prev FROM j) WHERE h > prev""", "ticks quotes")
def t9(x: Inputs):
    """Short positions of 100 dollars, funding in whole hours; every other one is closed after five days, the rest stay open."""
    rates = x.quotes().select("symbol", epoch_us("ts").alias("us"), ((F.col("event_id") % 21 - 10) * 1e-5).alias("rate"))
    opens = positions(x).select("position_id", "symbol", F.col("opened_us").alias("us"), F.lit("short").alias("side"), F.lit(100.0).alias("notional"))
    closes = opens.where("cast(split(position_id, '[|]')[1] as bigint) % 400 = 1").select("position_id", "symbol", (F.col("us") + 5 * 24 * H.HOUR_US).alias("us"))
    tables, out, step = H.funding_accrual()
    paid = H.TableStream(x.spark, new_folder(x, "funded"), tables, out).run(feed(x, "opens-rates", open=opens, close=closes, rate=rates), new_folder(x, "cp"), step)
    return paid.select("position_id", "us", "hours", F.round("cash", 8).alias("cash"))


@query("t10_limit_orders", """WITH o AS (SELECT symbol || '|' || trade_id AS order_id, symbol, us AS placed, price * 0.9 AS lim FROM ticks WHERE trade_id % 25 = 1),
    m AS (SELECT o.order_id, o.placed, min(t.us) AS filled_us FROM o LEFT JOIN ticks t ON t.symbol = o.symbol AND t.us >= o.placed AND t.us < o.placed + 14400000000 AND t.price <= o.lim GROUP BY 1, 2)
    SELECT order_id, CASE WHEN filled_us IS NOT NULL THEN 'filled' WHEN placed + 14400000000 <= (SELECT max(us) FROM ticks) THEN 'expired' ELSE 'open' END AS status, filled_us FROM m""", "ticks")
def t10(x: Inputs):
    """Resting buys ten percent under a print, good for four hours; what is undecided in the end is open."""
    t = tick_rows(x)
    orders = t.where("trade_id % 25 = 1").select(F.concat_ws("|", "symbol", "trade_id").alias("order_id"), "symbol", (F.col("price") * 0.9).alias("limit_px"), "us", (F.col("us") + 4 * H.HOUR_US).alias("expires_us"))
    tables, out, step = H.limit_orders(late_us=2 * H.HOUR_US)
    stream = H.TableStream(x.spark, new_folder(x, "resting"), tables, out)
    done = stream.run(feed(x, "orders-prints", order=orders, print=t.select("symbol", "us", "price")), new_folder(x, "cp"), step)
    return done.unionByName(H.still_open(stream)).select("order_id", "status", "filled_us")


@query("t11_late_bars", "SELECT symbol, t, round(open, 6) AS open, round(close, 6) AS close, round(volume, 6) AS volume FROM bars_60", "bars_60")
def t11(x: Inputs):
    """Hourly bars while half the trades of every seventh day arrive last: in the end every covered bar is there."""
    t = tick_rows(x).select("symbol", "trade_id", "us", "price", "qty", "side", "ord_type", "at")
    late = F.expr("day(timestamp_micros(us)) % 7 = 3 and trade_id % 2 = 0")
    seq = t.withColumn("seq", F.col("us") + F.when(late, 400 * 86_400_000_000).otherwise(0))
    store, out = new_folder(x, "late-store"), new_folder(x, "late-bars")
    I.rebuild_covered_bars(stream_of(x, seq, "seq", "late", 2).drop("seq"), store, out, new_folder(x, "cp"), 60, NOW)
    return x.spark.read.parquet(out).select("symbol", "t", *rounded(open=("open", 6), close=("close", 6), volume=("volume", 6)))
