"""Trade and quote ingest, replay dropping, candles and bars of touched days."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks import schemas
from tapeworks.operators import bars as B
from tapeworks.operators import coverage as C
from tapeworks.session import pin
from tapeworks.sources import payloads as P
from tapeworks.sources.snapshots import SnapshotStore


def to_timestamp(us: str) -> Column:
    return F.timestamp_micros(F.col(us))


def message_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Lines of feed messages from a folder; on a cluster the same frame may come from Kafka's ``value``."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", per_trigger).text(path)


def trade_stream(messages: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    t = P.feed_trades(P.parse_feed(messages, aliases=aliases))
    return t.withColumn("at", to_timestamp("us"))


def quote_stream(messages: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    q = P.feed_quotes(P.parse_feed(messages, aliases=aliases))
    return q.withColumn("us", F.round(F.col("ts") * 1e6).cast("bigint")).withColumn("at", to_timestamp("us"))


def run(query) -> None:
    query.awaitTermination()


def stored(trades: DataFrame) -> DataFrame:
    """Trades as the tick store holds them, with their UTC day."""
    rows = trades.withColumn("ts", F.timestamp_add("MICROSECOND", F.col("us"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))).drop("us", "at")
    return rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def ingest(trades: DataFrame, store: SnapshotStore, checkpoint: str) -> None:
    """Merges each batch into the tick store: a stored id is a replay however late it comes, and a late trade still gets in.

    A batch is one snapshot: when it fails half-way the one before stays in place, and the
    retry writes the same folders.
    """
    run(trades.writeStream.foreachBatch(lambda batch, n: store.merge(stored(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_ingested(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{schemas.TICK}, day string, batch int").parquet(root)


def minute_candles(trades: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One-minute OHLC per symbol in event time; a minute appears once the watermark has passed it."""
    w = F.window("at", "1 minute")
    return (trades.withWatermark("at", late).groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", "trade_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "trade_id").alias("close"), F.count(F.lit(1)).alias("trades"))
        .select("symbol", F.unix_seconds("w.start").alias("t"), "open", "high", "low", "close", "trades"))


def run_to_table(stream: DataFrame, root: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into parquet and return the rows."""
    run(stream.writeStream.outputMode(mode).format("parquet").option("path", root).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return stream.sparkSession.read.schema(stream.schema).parquet(root)


def rebuild_covered_bars(trades: DataFrame, store: str, out: str, checkpoint: str, tf_minutes: int, now_s: int) -> None:
    """Bars of the days a batch touches, rebuilt from the store; uncovered time yields no bar until it is covered.

    Late trades close a gap of an old day: that day and its neighbours, whose
    first or last bar may now be covered, are rebuilt and their partitions
    replaced.  One more day on each side is read for the run edges.
    """
    def rebuild(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = pin(batch.withColumn("ts", F.timestamp_add("MICROSECOND", F.col("us"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))).drop("us", "at"))
        rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.mode("overwrite").partitionBy("symbol", "day").parquet(f"{store}/batch={batch_id}")
        touched = rows.select("symbol", F.to_date("ts").alias("d")).distinct()
        around = lambda n: touched.select("symbol", F.explode(F.sequence(F.date_sub("d", n), F.date_add("d", n))).alias("d")).distinct()
        have = read_ingested(spark, store).where(F.col("batch") <= batch_id).withColumn("d", F.to_date("day")).join(around(2), ["symbol", "d"], "left_semi")
        once = pin(have.groupBy("symbol", "trade_id").agg(F.min(F.struct("ts", "price", "qty", "side", "ord_type")).alias("r")).select("symbol", "trade_id", "r.*"))
        bars = B.resample(B.ticks_to_1m(once), C.coverage_runs(once), tf_minutes, now_s)
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t") / 86_400).cast("int"))
        fresh = bars.withColumn("d", day).join(around(1), ["symbol", "d"], "left_semi").withColumn("day", F.col("d").cast("string")).drop("d")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "day").parquet(out)
    run(trades.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
