"""Intent keys and the hash chain of the audit log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.operators.scan import BLOCK_ROWS, block_no, previous

USERREF_MODULUS = 2_147_483_647  # fixed value: largest signed 32-bit integer


def intent_key(strategy: Column, symbol: Column, side: Column, notional: Column, bar: Column) -> Column:
    """Deterministic key of one trading intent, by bar rather than by clock."""
    text = F.concat_ws("|", strategy, symbol, side, F.format_string("%.2f", notional), bar)
    return F.substring(F.sha2(text, 256), 1, 32)


def reference_number(key: Column) -> Column:
    """The key as a positive 31-bit number."""
    head = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    return head % (USERREF_MODULUS - 1) + 1


def chain_faults(entries: DataFrame, seq: str = "seq", genesis: str = "0" * 64, rows: int = BLOCK_ROWS) -> DataFrame:
    """Entries whose previous hash or content hash is wrong.

    ``entries`` has ``seq`` (unique), ``previous_hash``, ``material`` (canonical text) and ``entry_hash``.
    """
    b = previous(entries.withColumn("_b", block_no(seq, rows)), [], "_b", [seq], {"entry_hash": "want_prev"})
    broken = F.col("previous_hash") != F.coalesce("want_prev", F.lit(genesis))
    tampered = F.col("entry_hash") != F.sha2("material", 256)
    return b.withColumn("fault", F.when(broken, "chain_break").when(tampered, "tampered")).where("fault is not null").select(seq, "fault")


def verify_chain(entries: DataFrame, seq: str = "seq", genesis: str = "0" * 64) -> DataFrame:
    """One row: intact or not, the first bad entry and what is wrong with it."""
    bad = chain_faults(entries, seq, genesis)
    return bad.agg((F.count(F.lit(1)) == 0).alias("intact"), F.count(F.lit(1)).alias("faults"), F.min(seq).alias("first_bad"), F.min_by("fault", seq).alias("first_fault"))
