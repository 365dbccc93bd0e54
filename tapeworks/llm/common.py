"""Small helpers shared by the corpus operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tapeworks.session import work_dir

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"
ROWS = 4096  # rows that are worth a task of their own
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's checkpoint folder.

    Later steps read those files, so a lost executor costs no recomputation and row
    ids given before stay what they are. The files go when nothing refers to them any
    more, if the cluster has ``spark.cleaner.referenceTracking.cleanCheckpoints`` on.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


def packed(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """``settle(df)``, read back in no more partitions than its rows fill, and what was counted on the way: ``rows`` and ``sums``.

    Chains of joins over small tables otherwise cost a task per partition and step, and
    the driver keeps a record of each.
    """
    seen = Observation()
    done = settle(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in sums.items())))
    return done.coalesce(max(1, -(-seen.get["rows"] // ROWS))), seen.get


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; clashing extra columns stay behind."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """64-bit hash of each word. Nothing is remembered: a worker's memory does not grow with the words it has met."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """One 64-bit hash from two, position by position; the order of the two counts."""
    with np.errstate(over="ignore"):
        x = (a * _MIX) ^ (b + (a >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order; the whole sequence as one if it is shorter."""
    if not len(words):
        return words
    n = min(width, len(words))
    out = words[:len(words) - n + 1]
    for k in range(1, n):
        out = mix(out, words[k:len(words) - n + 1 + k])
    return mix(out, np.uint64(n))


def per_row(fn: Callable[[dict], tuple], schema: pa.Schema, rows: int = 512):
    """A ``mapInArrow`` function that calls ``fn`` for each row and gives its tuples back in small batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = [fn(row) for row in part.to_pylist()]
                columns = zip(*made) if made else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        pa.default_memory_pool().release_unused()  # workers live on: what this task freed goes back
    return run


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def without(docs: DataFrame, bad: DataFrame, id: str, tag: Column, max_broadcast: int = 500_000) -> DataFrame:
    """``docs`` less the rows that ``bad`` (doc_id, tag) names. ``bad`` is broadcast up to so many rows, else both sides are shuffled."""
    bad = settle(bad.select("doc_id", "tag").distinct())
    bad = F.broadcast(bad) if bad.count() <= max_broadcast else bad
    return docs.alias("d").join(bad.alias("m"), (tag == F.col("m.tag")) & F.col(f"d.`{id}`").eqNullSafe(F.col("m.doc_id")), "left_anti")
