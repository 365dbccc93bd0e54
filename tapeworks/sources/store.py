"""The tick and quote store: text day files in, partitioned parquet out."""
from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.core import day_text, epoch_us
from tapeworks.session import pin

TICK_FIELDS = ("trade_id", "ts", "price", "qty", "side", "ord_type")
QUOTE_FIELDS = ("ts", "bid", "ask")


LINES = "symbol string, value string, file string, part bigint, line bigint, torn boolean, unread bigint"


def _unzipped(chunks: bytes, piece: int = 1 << 20) -> Iterator[tuple[bytes, int]]:
    """What the gzip members of a file hold, piece by piece; in the end, how many compressed bytes belong to a member without an end."""
    at, began, member = 0, 0, zlib.decompressobj(31)
    while at < len(chunks):
        try:
            out = member.decompress(chunks[at:at + piece])
        except zlib.error:
            break
        at = min(at + piece, len(chunks))
        if out:
            yield out, 0
        if member.eof:
            at = began = at - len(member.unused_data)
            member = zlib.decompressobj(31)
    if began < len(chunks):  # the last member has no end
        yield b"", len(chunks) - began


def _gzip_lines(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Numbered lines of gzip files up to where each can be read, and one row per file without a value that says how it ended."""
    def batch(symbol, file, values, first, torn=None, unread=None):
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array([symbol] * n, pa.string()), pa.array(values, pa.string()), pa.array([file] * n, pa.string()), pa.array([0] * n, pa.int64()),
                                           pa.array(range(first, first + n), pa.int64()), pa.array([torn] * n, pa.bool_()), pa.array([unread] * n, pa.int64())],
                                          names=["symbol", "value", "file", "part", "line", "torn", "unread"])
    for b in batches:
        for symbol, path, content in zip(*(b.column(k) for k in range(3))):
            symbol, file, done, tail, unread = symbol.as_py(), path.as_py().rsplit("/", 1)[-1], 0, b"", 0
            for out, lost in _unzipped(content.as_py()):
                unread += lost
                *lines, tail = (tail + out).split(b"\n")
                for k in range(0, len(lines), rows):
                    part = [x.decode("utf-8", "replace").rstrip("\r") for x in lines[k:k + rows]]
                    yield batch(symbol, file, part, done)
                    done += len(part)
            if tail:
                yield batch(symbol, file, [tail.decode("utf-8", "replace")], done)
                done += 1
            yield batch(symbol, file, [None], done, unread > 0, unread)


def day_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all day files with their place, and per gzip file a row that tells whether it is torn.

    A gzip file cannot be split, so one task reads one: it yields what the members hold up
    to the tear, and nothing is skipped in silence. Plain files are read in splits; one
    that cannot be read is an error.
    """
    files = spark.read.format("binaryFile").load(root)
    zipped = F.col("path").endswith(".gz")
    out = files.where(zipped).select(F.col("symbol").cast("string"), "path", "content").mapInArrow(_gzip_lines, LINES)
    if files.where(~zipped).select("path").limit(1).count():
        plain = spark.read.option("basePath", root).option("pathGlobFilter", "*[!z]").text(root)
        out = out.unionByName(plain.select(F.col("symbol").cast("string"), "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("part"),
                                           F.monotonically_increasing_id().alias("line"), F.lit(False).alias("torn"), F.lit(0).cast("long").alias("unread")))
    return out


def _read_lines(spark: SparkSession, root: str, fields: Sequence[str]) -> DataFrame:
    """Split day files (plain or gzip) into text fields, with the line's place in the store.

    Lines with too many fields are skipped and short ones padded with NULL.
    A cut gzip member yields the lines before the cut; ``damage`` reports it.
    """
    lines = day_lines(spark, root).where("value is not null").select("symbol", "value", F.struct("file", "part", "line").alias("place"))
    parts = F.split("value", ",")
    return (lines.where(F.size(parts) <= len(fields))
            .select("symbol", "place", *[F.when(F.size(parts) > n, parts.getItem(n)).alias(f)
                                         for n, f in enumerate(fields)]))


def damage(spark: SparkSession, root: str, fields: Sequence[str] = TICK_FIELDS, texts: Sequence[str] = ("side", "ord_type")) -> DataFrame:
    """Per file of the store: lines, how many of them are headers or damaged, whether it is torn, and the compressed bytes of its member without an end.

    A damaged line has the wrong number of fields, or a number that is none.
    """
    parts = F.split("value", ",")
    number = [F.coalesce(F.get(parts, k).try_cast("double").isNotNull(), F.lit(False)) for k, f in enumerate(fields) if f not in texts]
    head = F.col("value") == ",".join(fields)
    good = reduce(lambda a, b: a & b, number, F.size(parts) == len(fields))
    lines = day_lines(spark, root)
    return lines.groupBy("symbol", "file").agg(
        F.count("value").alias("lines"), F.count_if(head).alias("headers"), F.count_if(F.col("value").isNotNull() & ~head & ~good).alias("damaged"),
        F.coalesce(F.max("torn"), F.lit(False)).alias("torn"), F.coalesce(F.max("unread"), F.lit(0)).alias("unread_bytes"))


def _seconds_to_ts(seconds):
    us = F.round(seconds * 1_000_000).cast("long")
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def clean_ticks(raw: DataFrame) -> DataFrame:
    """Typed ticks with a known side; header lines and torn lines fall out of the casts."""
    num = {c: F.expr(f"try_cast({c} AS double)") for c in ("ts", "price", "qty")}
    typed = raw.select(
        "symbol", "place", F.expr("try_cast(try_cast(trade_id AS double) AS bigint)").alias("trade_id"),
        num["ts"].alias("sec"), num["price"].alias("price"), num["qty"].alias("qty"), "side", "ord_type")
    ok = F.col("side").isin("b", "s")
    for c in ("trade_id", "sec", "price", "qty"):
        ok = ok & F.col(c).isNotNull()
    for c in ("sec", "price", "qty"):
        ok = ok & ~F.isnan(c)
    return typed.where(ok).withColumn("ts", _seconds_to_ts(F.col("sec"))).drop("sec")


def first_per_key(df: DataFrame, keys: Sequence[str], place: str = "place") -> DataFrame:
    """The row that comes first in the store for every key; duplicates merge before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != place]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}") for c in rest]))


def read_ticks(spark: SparkSession, root: str) -> DataFrame:
    """Deduplicated typed ticks of a folder of ``symbol=.../day=...`` text files."""
    return first_per_key(clean_ticks(_read_lines(spark, root, TICK_FIELDS)), ["symbol", "trade_id"])


def read_quotes(spark: SparkSession, root: str) -> DataFrame:
    raw = _read_lines(spark, root, QUOTE_FIELDS)
    typed = raw.select("symbol", "place", *[F.expr(f"try_cast({c} AS double)").alias(c) for c in QUOTE_FIELDS])
    ok = F.lit(True)
    for c in QUOTE_FIELDS:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    typed = typed.where(ok).withColumn("ts", _seconds_to_ts(F.col("ts")))
    return first_per_key(typed, ["symbol", "ts"])


def write_text_store(lines: DataFrame, root: str, compression: str = "gzip") -> None:
    """Text lines (``symbol, day, value``) as day files."""
    lines.select("symbol", "day", "value").write.mode("append").partitionBy("symbol", "day").option(
        "compression", compression).text(root)


def append(rows: DataFrame, root: str, order: str = "trade_id") -> None:
    """Append to the parquet store, split by symbol and UTC day.

    Range partitions on (symbol, day, order) keep files few and sorted, and
    spread a heavy symbol-day over several writers.
    """
    daily = rows.withColumn("day", day_text(epoch_us("ts")))
    (daily.repartitionByRange("symbol", "day", order).sortWithinPartitions("symbol", "day", order)
     .write.mode("append").partitionBy("symbol", "day").parquet(root))


def read_store(spark: SparkSession, root: str, schema: str, days: tuple[str, str] | None = None) -> DataFrame:
    """The parquet store; ``days`` prunes partitions, both ends included."""
    df = spark.read.schema(f"{schema}, day string").parquet(root)
    return df if days is None else df.where((F.col("day") >= days[0]) & (F.col("day") <= days[1]))


def compact(spark: SparkSession, root: str, schema: str, today: str, key: str = "trade_id") -> None:
    """Rewrite closed days that more than one file was written to: one row per key, sorted, in few files.

    A day of one file was compacted before, or written once, and keeps its file. The new
    days are staged first, then replace exactly their own partitions.
    """
    stored = read_store(spark, root, schema).where(F.col("day") < today)
    files = stored.select("symbol", "day", F.col("_metadata.file_path").alias("f")).distinct()
    many = pin(files.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol", "day"))
    closed = stored.join(many, ["symbol", "day"], "left_semi").select(stored.columns)
    rest = [c for c in closed.columns if c not in ("symbol", "day", key)]
    staged = pin(closed.groupBy("symbol", "day", key).agg(F.min(F.struct(*rest)).alias("_r"))
                 .select("symbol", "day", key, *[F.col(f"_r.{c}") for c in rest]))
    (staged.repartitionByRange("symbol", "day", key).sortWithinPartitions("symbol", "day", key)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("symbol", "day").parquet(root))


def unique_ids(ticks: DataFrame) -> DataFrame:
    """One row per stored trade id and day."""
    return ticks.groupBy("symbol", day_text(epoch_us("ts")).alias("day"), "trade_id").agg(F.lit(1).alias("one")).drop("one")


def import_days(source: DataFrame, target: DataFrame, today: str) -> DataFrame:
    """What an import of closed days does, per symbol and day: added, merged, same, skipped_open_day."""
    src, dst = unique_ids(source), unique_ids(target)
    have = dst.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("have"))
    new = (src.join(dst, ["symbol", "day", "trade_id"], "left_anti")
           .groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("new_rows")))
    days = src.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("offered"))
    out = days.join(have, ["symbol", "day"], "left").join(new, ["symbol", "day"], "left")
    verdict = (F.when(F.col("day") >= today, "skipped_open_day").when(F.col("have").isNull(), "added")
               .when(F.coalesce("new_rows", F.lit(0)) == 0, "same").otherwise("merged"))
    return out.select("symbol", "day", "offered", verdict.alias("verdict"),
                      F.when(verdict.isin("added", "merged"), F.coalesce("new_rows", F.lit(0))).otherwise(0)
                      .cast("bigint").alias("new_rows"))


def rows_to_import(source: DataFrame, target: DataFrame, today: str) -> DataFrame:
    """The closed-day ticks that the target does not hold yet."""
    closed = source.where(day_text(epoch_us("ts")) < today)
    return closed.join(target.select("symbol", "trade_id"), ["symbol", "trade_id"], "left_anti")


def manifest(ticks: DataFrame, today: str) -> DataFrame:
    """Per closed day: unique rows, id range and a content hash that ignores row order."""
    us = epoch_us("ts")
    line = F.concat_ws("|", "trade_id", us, "side", "ord_type", F.round(F.col("price") * 1e6).cast("bigint"),
                       F.round(F.col("qty") * 1e6).cast("bigint"))
    rows = ticks.select("symbol", day_text(us).alias("day"), "trade_id", line.alias("line")).where(F.col("day") < today)
    once = rows.groupBy("symbol", "day", "trade_id").agg(F.min("line").alias("line"))
    digest = F.conv(F.substring(F.md5("line"), 1, 15), 16, 10).cast("bigint")
    return once.groupBy("symbol", "day").agg(
        F.count(F.lit(1)).alias("rows"), F.min("trade_id").alias("first_id"), F.max("trade_id").alias("last_id"),
        F.bit_xor(digest).alias("digest"))


def check_manifest(listed: DataFrame, current: DataFrame) -> DataFrame:
    """Per symbol: how many listed days are exact, grown, missing or short in ``current``."""
    cur = current.select("symbol", "day", *[F.col(c).alias(f"c_{c}") for c in ("rows", "first_id", "last_id", "digest")])
    both = listed.join(cur, ["symbol", "day"], "left")
    grown = ((F.col("c_rows") >= F.col("rows")) & (F.col("c_first_id") <= F.col("first_id"))
             & (F.col("c_last_id") >= F.col("last_id")) & (F.col("rows") > 0))
    state = (F.when(F.col("c_rows").isNull(), "missing").when(F.col("c_digest") == F.col("digest"), "exact")
             .when(grown, "superset").otherwise("short"))
    out = both.withColumn("state", state).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("listed"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("exact", "superset", "missing", "short")])
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("short") == 0))
