"""Parsers for exchange payloads, logs and nested stores.  All schemas are explicit."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks import schemas
from tapeworks.functions.core import col, epoch_us, finite, ratio
from tapeworks.functions.gates import canonical_symbol


def number(c: str | Column) -> Column:
    """Text to double; junk, NaN and infinities become NULL."""
    return finite(col(c).try_cast("double"))


def parse_ohlc(payloads: DataFrame, tf_minutes: int, now_s: int, value: str = "value") -> DataFrame:
    """Rows ``[time, open, high, low, close, vwap, volume, ...]``: positive close, one row per time, closed bars only."""
    rows = payloads.select("symbol", F.explode(F.from_json(value, "array<array<string>>")).alias("r"))
    at = lambda n: number(F.get("r", F.lit(n)))
    b = rows.select("symbol", at(0).cast("bigint").alias("t"), *[at(n).alias(c) for c, n in (("open", 1), ("high", 2), ("low", 3), ("close", 4), ("volume", 6))])
    b = b.where((F.col("close") > 0) & (F.col("t") + tf_minutes * 60 <= now_s))
    cols = ("open", "high", "low", "close", "volume")
    return b.groupBy("symbol", "t").agg(F.min(F.struct(*cols)).alias("r")).select("symbol", "t", "r.*")


def iso_to_us(text: str | Column) -> Column:
    """ISO text in UTC to microseconds."""
    ts = F.to_timestamp_ntz(F.regexp_replace(col(text), "(Z|[+]00:00)$", ""))
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def parse_feed(messages: DataFrame, value: str = "value", aliases: dict[str, str] | None = None) -> DataFrame:
    """One row per item of a feed message, with its channel; prices stay text until cast."""
    m = messages.select(F.from_json(value, schemas.FEED_MESSAGE).alias("m")).select("m.channel", F.inline_outer("m.data"))
    return m.withColumn("symbol", canonical_symbol("symbol", aliases)).where("symbol is not null")


def feed_trades(items: DataFrame) -> DataFrame:
    us = F.coalesce(F.round(number("timestamp") * 1_000_000).cast("bigint"), iso_to_us("timestamp"))
    t = items.where("channel = 'trade'").select(
        "symbol", F.col("trade_id").try_cast("bigint").alias("trade_id"), us.alias("us"), number("price").alias("price"), number("qty").alias("qty"),
        F.when(F.lower("side").startswith("b"), "b").otherwise("s").alias("side"), F.when(F.lower("ord_type").startswith("l"), "l").otherwise("m").alias("ord_type"))
    return t.where("trade_id is not null and us is not null and price is not null and qty is not null")


def feed_quotes(items: DataFrame) -> DataFrame:
    q = items.where("channel = 'ticker'").select("symbol", number("timestamp").alias("ts"), number("bid").alias("bid"), number("ask").alias("ask"))
    return q.where("bid > 0 and ask > 0")


def parse_trade_pages(pages: DataFrame, value: str = "value") -> DataFrame:
    """Rows ``[price, volume, time, side, type, misc, id]``; shorter rows are skipped."""
    r = pages.select("symbol", F.explode(F.from_json(value, "array<array<string>>")).alias("r")).where(F.size("r") >= 7)
    get = lambda n: F.get("r", F.lit(n))
    return r.select("symbol", get(6).try_cast("bigint").alias("trade_id"), F.round(number(get(2)) * 1e6).cast("bigint").alias("us"), number(get(0)).alias("price"),
                    number(get(1)).alias("qty"), F.substring(get(3), 1, 1).alias("side"), F.substring(get(4), 1, 1).alias("ord_type"))


def read_json_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows of a JSON-lines log, and the lines that did not parse."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    ok = F.col("r").isNotNull() & F.col("r._bad").isNull()
    return parsed.where(ok).select("r.*").drop("_bad"), parsed.where(~ok).select("value")


def append_json_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def latest_executions(versions: DataFrame, key: str, version: Column) -> DataFrame:
    """Upsert by key: the newest version of every row."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def learner_trades(stores: DataFrame, value: str = "value") -> DataFrame:
    """Closed trades out of nested learner stores; rows without a finite pnl are dropped."""
    s = stores.select(F.from_json(value, schemas.LEARNER_STORE).alias("s"))
    c = s.select(F.col("s.strategy_key").alias("strategy_key"), F.explode("s.coins").alias("symbol", "c"))
    h = c.select("strategy_key", "symbol", F.explode("c.history").alias("h"))
    out = h.select("symbol", F.coalesce("h.ts", F.lit(0.0)).alias("ts"), number("h.pnl").alias("pnl"), "h.net_bps",
                   F.coalesce("h.strategy", "strategy_key", F.lit("unknown")).alias("sleeve"), F.coalesce("h.regime", F.lit("unknown")).alias("regime"))
    return out.where("pnl is not null")


def funding_rates(rows: DataFrame) -> DataFrame:
    """Relative hourly rates with times in seconds, from rows timed in ms, s or ISO text."""
    raw = F.coalesce("timestamp", "time")
    n = number(raw)
    sec = F.when(n > 1e12, n / 1000).when(n.isNotNull(), n).otherwise(F.floor(iso_to_us(raw) / 1_000_000))
    rel = F.coalesce(number("relative_rate"), ratio(number("absolute_rate"), F.when(number("mark") > 0, number("mark"))))
    return rows.withColumn("t", F.floor(sec).cast("bigint")).withColumn("rate", rel).where("t is not null and rate is not null")


def priors(results: DataFrame, strategy_key: str | None = None, value: str = "value") -> DataFrame:
    """Out-of-sample priors per strategy (``family@tfm``), symbol, and symbol and regime; of one strategy if asked for."""
    r = results.select(F.from_json(value, schemas.STUDY_RESULT).alias("r")).select("r.*")
    r = r.withColumns({"strategy": F.concat(F.col("family"), F.lit("@"), F.col("tf").cast("string"), F.lit("m")), "symbol": F.upper("symbol")})
    r = r if strategy_key is None else r.where(F.col("strategy") == strategy_key)
    a = r.select("strategy", F.col("symbol").alias("key"), "oos.*")
    b = r.select("strategy", "symbol", F.explode("oos_by_regime").alias("regime", "m")).select("strategy", F.concat_ws("|", "symbol", "regime").alias("key"), "m.*")
    return a.unionByName(b).where("trades > 0").select("strategy", "key", F.col("trades").alias("n"), F.col("avg_net_bps").alias("bps"))


def log_state(lines: DataFrame, value: str = "value") -> DataFrame:
    """Newest cycle and start times of a process log and the lock flags of the newest start."""
    pattern = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\S*\s+(CYCLE|START)"
    at = F.regexp_extract(value, pattern, 1).try_cast("timestamp_ntz")
    l = lines.select(value, F.floor(epoch_us(at) / 1_000_000).cast("long").alias("ts"), F.regexp_extract(value, pattern, 2).alias("kind")).where("ts is not null")
    s = l.agg(F.max(F.when(F.col("kind") == "CYCLE", F.col("ts"))).alias("last_cycle"), F.max(F.when(F.col("kind") == "START", F.col("ts"))).alias("last_start"),
              F.max_by(F.when(F.col("kind") == "START", F.col(value)), F.when(F.col("kind") == "START", F.struct("ts", value))).alias("line"))
    flag = lambda k: F.nullif(F.regexp_extract("line", rf"\b{k}=(\w+)", 1), F.lit(""))
    return s.select("last_cycle", "last_start", *[flag(k).alias(k) for k in ("locked", "paper", "dry_run", "allow_live")])


def feed_health(status: DataFrame, now_s: float, stale_s: float = 120.0) -> DataFrame:
    """Age and freshness of every feed, from its newest status row."""
    cols = [c for c in status.columns if c not in ("symbol", "updated_at")]
    s = status.groupBy("symbol").agg(F.max_by(F.struct(*cols), "updated_at").alias("r"), F.max("updated_at").alias("heartbeat")).select("symbol", "heartbeat", "r.*")
    age = F.lit(now_s) - F.col("live_through")
    return s.withColumns({"age_s": age, "fresh": F.coalesce((age <= stale_s) & F.col("in_sync"), F.lit(False))})


def futures_quotes(rows: DataFrame) -> DataFrame:
    """Futures ticker rows: mark falls back to last, funding as a fraction of the mark."""
    mark = F.coalesce(number("markPrice"), number("last"))
    return rows.select(F.upper("symbol").alias("symbol"), number("last").alias("last"), mark.alias("mark"), number("bid").alias("bid"), number("ask").alias("ask"),
                       number("fundingRate").alias("funding_rate"), ratio(number("fundingRate"), F.when(mark > 0, mark)).alias("funding_relative"), number("openInterest").alias("open_interest"))


def maintenance_margin(instruments: DataFrame, default: float = 0.01) -> DataFrame:
    """Smallest maintenance margin listed for every instrument."""
    return instruments.select(F.upper("symbol").alias("symbol"), F.coalesce(F.array_min(F.transform("levels", lambda v: number(v))), F.lit(default)).alias("margin"))


def new_closed_trades(rows: DataFrame, seen: DataFrame, since_s: int) -> DataFrame:
    """Closed trades at or after the cursor with a known pnl, not ingested before."""
    return rows.where((F.col("ts") >= since_s) & F.col("pnl").isNotNull()).join(seen.select("id"), "id", "left_anti")


def next_cursor(rows: DataFrame, since_s: int) -> DataFrame:
    return rows.where(F.col("ts") >= since_s).agg(F.greatest(F.coalesce(F.max(F.when(F.col("pnl").isNotNull(), F.col("ts"))), F.lit(since_s)), F.lit(since_s)).alias("cursor"))
