"""Trie of conversation prefixes, with a count-min screen in front of the exact grouping.

A node is a distinct sequence of first turns; its members are the conversations that
start with it. A prefix is known by two 64-bit digests: the exclusive or, over its
turns, of a hash of place and content. That composes, so digests are a running
aggregate in blocks of turns, and a conversation of any length is never one group.

* **Screen.** Prefixes of chosen depths are counted in a count-min sketch of two lines.
  An estimate of one proves that a prefix occurs once, and then so do all longer ones of
  that conversation: its tail is written out in place, without a shuffle. The sketch is
  two bitmaps of the cells with count one, of a size bounded by ``MAX_CELLS``. Beyond
  that bound more prefixes stay unproven; they cost a shuffle, never a result.
* **Grouping.** Prefixes above the tails are grouped exactly by depth and both digests.
* **Subtrees without descent.** Every node is entered by its smallest member, and the
  nodes that a conversation enters are its last ones. A subtree's sum therefore is the
  sum, over the node's members, of what each enters from this depth on: a suffix sum
  along conversations and one more aggregate. The same suffix counts leaves, and the
  next row's flag counts children, so no round per level is needed.
* **Ends.** The ids that end at a node are joined in order by chunks of the id range,
  each in a group of its own, and the chunks of a node are fed to one running SHA-256.
  The hash takes its input in order, so a node's chunks pass one task, as a stream.

Defined cases: a null role or text is empty, a null turn comes first; turns with the
same number are ordered by the digest of role and text, equal ones are all kept; rows
without a conversation id belong to no conversation and are left out; an empty table
gives an empty result, without a root; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import WORD, only, settle
from tapeworks.operators.scan import ordinals, range_blocks

NODE = ("pos", "k1", "k2")
BLOCK_TURNS = 4096
MAX_CELLS = 1 << 27
CHUNK_IDS = 1024
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, i, content, words): turns numbered from 0 in their conversation; ``content`` is a digest of role and text."""
    own = only(conversations, conv_id=conv_id, turn=turn, role=role, text=text).where(F.col("conv_id").isNotNull())
    own = own.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    slim = own.select("conv_id", "turn", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("content"),
                      F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    cut = range_blocks(slim, ["conv_id"], ["turn", "content"])
    return ordinals(cut, ["conv_id"], "blk", ["turn", "content"]).select("conv_id", "i", "content", "words")


def whole(turns: DataFrame) -> DataFrame:
    """Every conversation as it is: (conv_id, pos from 0 for the bare root, content, words, len)."""
    size = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"))
    return _rooted(turns.join(size, "conv_id").select("conv_id", (F.col("i") + 1).alias("pos"), "content", "words", "len"), size)


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations whose first ``crc32(id) % (most + 1)`` turns are those of the next lower id divisible by ``every``."""
    c = F.col("conv_id")
    size = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    size = size.withColumns({"h": F.crc32(c.cast("string")) % (most + 1), "base": c - c % every})
    lent = size.where(c % every == 0).select(c.alias("base"), F.col("n").alias("lent"))
    size = size.join(lent, "base", "left").withColumn("head", F.least("h", F.coalesce("lent", F.lit(0))))
    size = size.withColumn("len", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "head", "len")
    heads = turns.where((F.col("i") < most) & (c % every == 0)).withColumnRenamed("conv_id", "base").join(size, "base").where("i < h")
    own = turns.join(size, "conv_id").where("i >= h")
    place = lambda df, pos: df.select("conv_id", pos.alias("pos"), "content", "words", "len")
    both = place(heads, F.col("i") + 1).unionByName(place(own, F.col("head") + F.col("i") - F.col("h") + 1))
    return _rooted(both, size)


def _rooted(rows: DataFrame, size: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    roots = size.select("conv_id", zero.alias("pos"), F.lit(None).cast("binary").alias("content"), zero.alias("words"), "len")
    return settle(rows.unionByName(roots))


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds the digests ``k1, k2`` of the conversation up to this place. Only conversations longer than a block need a carry."""
    own = {k: F.when(F.col("pos") > 0, F.xxhash64(F.lit(n), "pos", "content")).otherwise(F.lit(0).cast("long")) for k, n in (("x1", 1), ("x2", 2))}
    rows = rows.select("conv_id", "pos", "words", "len", F.floor(F.col("pos") / BLOCK_TURNS).alias("blk"), *(v.alias(k) for k, v in own.items()))
    here = Window.partitionBy("conv_id", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.where(F.col("len") >= BLOCK_TURNS).groupBy("conv_id", "blk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    carry = carry.select("conv_id", "blk", F.bit_xor("x1").over(before).alias("c1"), F.bit_xor("x2").over(before).alias("c2")).where("blk > 0")
    local = rows.withColumns({"l1": F.bit_xor("x1").over(here), "l2": F.bit_xor("x2").over(here)}).join(carry, ["conv_id", "blk"], "left")
    joined = lambda n: F.col(f"l{n}").bitwiseXOR(F.coalesce(f"c{n}", F.lit(0).cast("long"))).alias(f"k{n}")
    return settle(local.select("conv_id", "pos", joined(1), joined(2), "words", "len"))


def screened(pos: Column) -> Column:
    """Depths whose prefixes the sketch counts: the first eight, then powers of two. The root is shared anyway."""
    return (pos > 0) & ((pos <= 8) | (pos.bitwiseAND(pos - 1) == 0))


def singleton_depths(rows: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """(conv_id, tail): the least depth whose prefix the sketch estimates, and so proves, to occur once."""
    probes = rows.where(screened(F.col("pos")))
    cells = 1 << 15
    while cells < min(4 * probes.count(), max_cells):
        cells *= 2
    at = [F.pmod(F.col(k), F.lit(cells)) for k in ("k1", "k2")]
    counts = probes.select(F.posexplode(F.array(*at)).alias("line", "cell")).groupBy("line", "cell").agg(F.count(F.lit(1)).alias("n"))
    ones = counts.where("n = 1").withColumn("cell", F.col("cell") + 1)
    packed = ones.groupBy("line", F.bitmap_bucket_number("cell").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    table = np.zeros((2, cells // 8), np.uint8)  # at most MAX_CELLS bits a line
    for r in packed.toLocalIterator():
        table[r["line"], (r["part"] - 1) << 12:r["part"] << 12] = np.frombuffer(r["bits"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            once = np.zeros(b.num_rows, bool)
            for line in (0, 1):
                cell = b.column(2 + line).to_numpy() & (cells - 1)  # pmod of a power of two
                once |= (bits[line][cell >> 3] >> (cell & 7) & 1).astype(bool)
            yield b.select([0, 1]).filter(pa.array(once))

    alone = probes.select("conv_id", "pos", "k1", "k2").mapInArrow(run, probes.select("conv_id", "pos").schema)
    return settle(alone.groupBy("conv_id").agg(F.min("pos").alias("tail")))  # as with nodes, for a conversation of very many turns


def digest_of_ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conversation ids that end at each node, ascending and joined by commas."""
    chunk = F.floor(F.col("conv_id") / CHUNK_IDS)
    parts = ends.groupBy(*NODE, chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    lanes = parts.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, made = None, None
        for b in batches:
            out = []
            for *mine, ids in zip(*(c.to_pylist() for c in b.columns)):
                if mine == node:
                    made.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, made.hexdigest()))
                node, made = mine, hashlib.sha256(ids.encode())
            yield _batch(out)
        if node is not None:
            yield _batch([(*node, made.hexdigest())])

    return lanes.mapInArrow(run, "pos long, k1 long, k2 long, ends_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.string() if n == "ends_sha256" else pa.int64()) for n, c in zip((*NODE, "ends_sha256"), columns)})


def along_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation and shared depth: what it enters from here on (``saved``, ``leaves``), whether the next node is its own, the parent's entry."""
    by = Window.partitionBy("conv_id", "blk").orderBy("pos")
    rest = Window.partitionBy("conv_id", "blk").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    conv = Window.partitionBy("conv_id").orderBy("blk")
    later = Window.partitionBy("conv_id").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.where(F.col("len") >= BLOCK_TURNS).groupBy("conv_id", "blk").agg(
        F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.min_by("enters", "pos").alias("enters"), F.max_by("entry", "pos").alias("entry"))
    edges = edges.select("conv_id", "blk", F.sum("saved").over(later).alias("e_saved"), F.sum("leaf").over(later).alias("e_leaf"),
                         F.lead("enters").over(conv).alias("e_next"), F.lag("entry").over(conv).alias("e_entry"))
    out = rows.withColumns({"l_saved": F.sum("saved").over(rest), "l_leaf": F.sum("leaf").over(rest), "l_next": F.lead("enters").over(by), "l_entry": F.lag("entry").over(by)})
    out = out.join(edges, ["conv_id", "blk"], "left")
    both = lambda n: F.col(f"l_{n}") + F.coalesce(f"e_{n}", F.lit(0))
    next_own = F.when(F.col("pos") + 1 == F.col("tail"), 1).otherwise(F.coalesce("l_next", "e_next", F.lit(0)))
    return out.select("conv_id", *NODE, "enters", both("saved").alias("saved"), both("leaf").alias("leaves"), next_own.alias("child"),
                      F.coalesce("l_entry", "e_entry").alias("above"))


def prefix_trie(paths: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """Nodes of the trie of ``paths`` (rows of ``whole`` or ``with_shared_heads``): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = prefixes(paths)
    marked = settle(rows.join(singleton_depths(rows, max_cells), "conv_id", "left"))
    lone, c = F.coalesce(F.col("pos") >= F.col("tail"), F.lit(False)), F.col("conv_id")
    shared, tails = marked.where(~lone), marked.where(lone)

    nodes = shared.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("entry"), F.count_if(F.col("pos") == F.col("len")).alias("n_ends"))
    nodes = settle(nodes)  # dealt out on its own for the join, which lets adaptive execution split a prefix that very many share
    own, end = c == F.col("entry"), F.col("pos") == F.col("len")
    seen = settle(shared.join(nodes, list(NODE)).select(
        "conv_id", *NODE, "len", "tail", "entry", own.cast("int").alias("enters"), F.when(own, (F.col("n") - 1) * F.col("words")).otherwise(0).alias("saved"),
        ((own & end & (F.col("n_ends") == F.col("n"))) | F.coalesce(F.col("pos") + 1 == F.col("tail"), F.lit(False))).cast("long").alias("leaf"),
        F.floor(F.col("pos") / BLOCK_TURNS).alias("blk")))
    per_node = along_conversations(seen).groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.max(F.when(F.col("enters") == 1, F.col("above"))).alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum("child").cast("long").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = digest_of_ends(shared.where(end).select("conv_id", *NODE))
    upper = per_node.join(ends, list(NODE), "left").withColumnRenamed("pos", "depth").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))

    tops = tails.where("pos = tail").join(seen.where("pos + 1 = tail").select("conv_id", F.col("entry").alias("parent_conv_id")), "conv_id")
    lower = tops.select(*tails.columns, "parent_conv_id").unionByName(tails.where("pos > tail").withColumn("parent_conv_id", c))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    lower = lower.select(c, F.col("pos").alias("depth"), "parent_conv_id", one.alias("n_convs"), F.when(end, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
                         zero.alias("saved_tokens"), F.when(end, F.sha2(c.cast("string").cast("binary"), 256)).otherwise(EMPTY_SHA).alias("ends_sha256"))
    return upper.select(lower.columns).unionByName(lower)
