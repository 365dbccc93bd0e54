"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its 5-word shingles. Its sketch holds the ``SKETCH`` smallest
hashes. Inverted lists are kept for what the sketches retain: pairs of neighbouring
values, so a passage that many documents share makes no long list, since their other
shingles fall between its values. Documents in a list are candidates. The smallest
values of two sketches together are a sample of the union, and the part of it that both
hold estimates the similarity; only pairs well below the threshold are dropped there.
The rest is decided on the full sets.

At the threshold a shared list is missed with probability below 1e-7: neighbours in the
union both shared have probability 0.72, and 20 neighbourhoods are kept. Sets of up to
21 shingles are kept whole, so nothing can be missed there.

Exact copies have one set and are one node. Every list is first linked to its most
central member, the one whose other lists are longest, so all lists of a group of near
copies agree on a member near the text they come from. What can be linked at all mostly
is linked to that one, in as many pairs as the group has members. Members of lists with
one pivot make a block. A block with more than one component is linked to a second
pivot, the member with the fewest shingles that no other open document has, now counted
on full sets. What is still apart is compared between components, and only pairs that
counts do not rule out: with D the symmetric difference of x and y, a link at p percent
needs (100 - p)(|x| + |y|) >= (100 + p) D, and D is at least the shingles that no other
open document has, counted in x and y, plus the difference of what x and y share with
the pivot (or with the pivot of the largest block of both). All counts are exact, so no
link is lost. Members are dealt by size class (similar sets differ by one class at most)
and into cells of bounded size that hold these numbers only. The number of these
comparisons still grows with the square of what a block leaves apart.

Defined cases: a text of fewer than five words is one shingle of all its words; null,
empty and blank texts have the empty set, which is linked with nothing; rows with equal
ids share the id; equal texts are linked; a null id is the smallest id; an empty table
gives an empty result. Extra columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import only, packed, per_row, settle, shingle_hashes, text_bytes, without, word_hashes
from tapeworks.llm.components import components

SKETCH, RUNS, CELL, BROADCAST = 64, 20, 1024, 16 << 20
_READ = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("set_hash", pa.binary()), ("sketch", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("set_hash", pa.binary()), ("shingles", pa.list_(pa.int64()))])


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles."""
    words = text_bytes(text).lower().split()
    return np.unique(shingle_hashes(word_hashes(words), width) >> np.uint64(1)) if words else np.empty(0, np.uint64)


def _digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def read_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    def read(row: dict) -> tuple:
        s = shingle_set(row["text"], width)
        few = s[:RUNS + 1]
        keys = np.unique((few[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ few[1:]).view(np.int64) if len(few) > 1 else few[:0].view(np.int64)
        return row["doc_id"], row["tag"], len(s), _digest(s), s[:SKETCH].view(np.int64), keys

    made = docs.withColumn("tag", F.xxhash64("text")).mapInArrow(per_row(read, _READ), "doc_id long, tag long, n long, set_hash binary, sketch array<long>, keys array<long>")
    return settle(made.withColumn("rid", F.monotonically_increasing_id()))


def estimated(percent: int) -> float:
    """Lowest estimate that is looked at: five standard deviations below the threshold."""
    p = percent / 100
    return p - 5 * math.sqrt(p * (1 - p) / SKETCH)


def _sides(pairs: DataFrame, values: DataFrame, long: str) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``values`` (node, ...) of both, named by column and side.

    Only nodes of these pairs are taken; they are broadcast if their arrays ``long`` hold up to BROADCAST bytes, else all is shuffled.
    """
    used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    own, seen = packed(values.join(used, "node"), longs=F.sum(F.size(long) + 8))
    few = 8 * (seen["longs"] or 0) <= BROADCAST
    for x in "ba":
        side = own.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}{x}") for c in own.columns if c != "node"))
        pairs = pairs.join(F.broadcast(side) if few else side, x)
    return pairs


def _may_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and union sketch allow a link."""
    both = _sides(packed(pairs)[0], nodes.select("node", "n", "sketch"), "sketch").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    union = F.slice(F.array_sort(F.array_union("sketcha", "sketchb")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("sketcha", "sketchb"), F.col("u")))
    return both.withColumn("u", union).where(shared >= estimated(percent) * F.size("u")).select("a", "b")


def _full_sets(used: DataFrame, rows: int, docs: DataFrame, width: int, max_broadcast: int) -> DataFrame:
    """(node, shingles) of the nodes in ``used`` (node, doc_id, set_hash), so many ``rows``; only their documents are read again."""
    wanted = used.select("doc_id").distinct()
    wanted = F.broadcast(wanted) if rows <= max_broadcast else wanted

    def sets(row: dict) -> tuple:
        s = shingle_set(row["text"], width)
        return row["doc_id"], _digest(s), s.view(np.int64)

    again = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    full = again.mapInArrow(per_row(sets, _SETS, 128), "doc_id long, set_hash binary, shingles array<long>")
    return (used.alias("u").join(full.alias("f"), (F.col("u.set_hash") == F.col("f.set_hash")) & F.col("u.doc_id").eqNullSafe(F.col("f.doc_id")))
            .select("node", "shingles"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, width: int, max_broadcast: int) -> DataFrame:
    """(a, b, shared, linked) of pairs (a, b), from their full sets."""
    pairs, _ = packed(pairs)
    ids = nodes.select("node", "doc_id", "set_hash")
    used, seen = packed(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(ids, "node"))
    full = _full_sets(used, seen["rows"], docs, width, max_broadcast).dropDuplicates(["node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, linked = [], []
            for x, y in zip(batch.column("shinglesa"), batch.column("shinglesb")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both)
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())],
                                             names=["a", "b", "shared", "linked"])

    both = _sides(pairs, full, "shingles").select("a", "b", "shinglesa", "shinglesb")
    return packed(both.mapInArrow(compare, "a long, b long, shared long, linked boolean"))[0]


def _open_blocks(members: DataFrame) -> DataFrame:
    """Rows of ``members`` (p, node, c) whose block has more than one component."""
    several = members.groupBy("p").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("p")
    return members.join(several, "p")


def _across(members: DataFrame, nodes: DataFrame, known: DataFrame, docs: DataFrame, percent: int, width: int, max_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of a block from different components that their counts allow to be linked, found cell by cell; and ``known`` with what was compared here.

    ``members``: p, node, c of all blocks; ``known``: a, b, shared of pairs compared before.
    """
    members, _ = packed(_open_blocks(members))
    used, seen = packed(members.select("node").distinct().join(nodes.select("node", "n", "doc_id", "set_hash"), "node"))
    # Equal sets are one node and rows may repeat an id, so a shingle counts once per node.
    each = _full_sets(used, seen["rows"], docs, width, max_broadcast).select("node", F.explode("shingles").alias("s"))
    lone = each.groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("most")).where("node = most").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    alive = used.select("node", "n").join(lone, "node", "left").withColumn("u", F.coalesce("u", F.lit(0))).where((100 - percent) * F.col("n") >= percent * F.col("u"))
    own, _ = packed(_open_blocks(members.join(alive, "node")))
    centre = own.groupBy("p").agg(F.min_by("node", F.struct("u", "node")).alias("q"))
    own, _ = packed(own.join(centre, "p").select(F.col("q").alias("p"), "node", "n", "u").where("p <> node").distinct()
                    .withColumns({"a": F.least("p", "node"), "b": F.greatest("p", "node")}))
    rest = _verified(own.select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), nodes, docs, percent, width, max_broadcast)
    known = known.unionByName(rest)
    seen = components(known.where("linked"))
    own = own.join(known.select("a", "b", F.col("shared").alias("near")), ["a", "b"]).drop("a", "b").join(seen, "node", "left")
    own, _ = packed(_open_blocks(own.withColumn("c", F.coalesce("component", "node")).drop("component")))

    # A node is also measured against the pivot of its largest block, which small blocks beside that one would miss.
    large = own.groupBy("p").agg(F.count(F.lit(1)).alias("m"))
    most = F.max_by(F.struct(F.col("p").alias("home"), F.col("near").alias("from_home")), F.struct("m", "p")).alias("h")
    own, _ = packed(own.join(own.join(large, "p").groupBy("node").agg(most).select("node", "h.home", "h.from_home"), "node"))

    step = math.log(100 / percent)
    own = own.withColumn("cls", F.floor(F.log("n") / step + 1e-9))
    homes = own.select("*", F.explode(F.array(F.struct(F.lit(0).alias("guest"), F.col("cls").alias("at")),
                                              F.struct(F.lit(1).alias("guest"), (F.col("cls") - 1).alias("at")))).alias("h"))
    numbers = ["node", "n", "c", "u", "near", "home", "from_home", "guest", "mine"]
    homes = homes.select("p", *numbers[:-2], "h.guest", "h.at")
    sizes = homes.groupBy("p", "at").agg(F.count(F.lit(1)).alias("m"), F.min("guest").alias("host"), F.min("c").alias("x"), F.max("c").alias("y"))
    sizes = sizes.where("host = 0 AND x <> y").select("p", "at", F.ceil(F.col("m") / CELL).cast("int").alias("cells"))
    dealt = homes.join(sizes, ["p", "at"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    spread = dealt.select("p", "at", *numbers, F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("o"))
    cell = spread.groupBy("p", "at", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j")).agg(*(F.collect_list(x).alias(x) for x in numbers))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, seconds = [], []
            for at in range(batch.num_rows):
                node, n, c, u, near, home, from_home, guest, mine = (batch.column(x)[at].values.to_numpy() for x in numbers)
                if (c == c[0]).all():
                    continue
                apart = np.abs(np.subtract.outer(near, near))
                apart = np.maximum(apart, np.abs(np.subtract.outer(from_home, from_home)) * (home[:, None] == home[None, :])) + np.add.outer(u, u)
                may = (100 - percent) * np.add.outer(n, n) >= (100 + percent) * apart
                may &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
                may &= (c[:, None] != c[None, :]) & (node[:, None] < node[None, :]) & ~((guest[:, None] == 1) & (guest[None, :] == 1))
                if batch.column("i")[at].as_py() != batch.column("j")[at].as_py():
                    may &= mine[:, None] != mine[None, :]
                x, y = np.nonzero(may)
                firsts.append(node[x])
                seconds.append(node[y])
            if firsts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts), pa.int64()), pa.array(np.concatenate(seconds), pa.int64())], names=["a", "b"])

    return cell.mapInArrow(compare, "a long, b long").distinct().join(known, ["a", "b"], "left_anti"), known


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 85, width: int = 5,
                    max_broadcast: int = 500_000) -> DataFrame:
    """(doc_id, tag, n_shingles, component_id, kept) per row; ``tag`` hashes the text; links have 100 * intersection >= ``percent`` * union."""
    own = only(docs, doc_id=id, text=text)
    read = read_documents(own, width)
    sets = read.where("n > 0").groupBy("set_hash").agg(F.min("rid").alias("node"))
    of, _ = packed(read.select("rid", "doc_id", "tag", "set_hash", "n").join(sets, "set_hash", "left").select("rid", "doc_id", "tag", "n", "node"))
    nodes, _ = packed(read.join(of.where("rid = node").select("rid"), "rid", "left_semi").withColumnRenamed("rid", "node"))

    lists = nodes.select("node", F.explode("keys").alias("key"))
    long = lists.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared, _ = packed(lists.join(long, "key"))
    ranked = shared.join(shared.groupBy("node").agg(F.sum("m").alias("rank")), "node")
    pivots = ranked.groupBy("key").agg(F.max_by("node", F.struct("rank", -F.col("node"))).alias("p"))
    members, _ = packed(shared.select("key", "node").join(pivots, "key").select("p", "node").distinct())
    stars = members.where("p <> node").select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct()
    known = _verified(_may_link(stars, nodes, percent), nodes, own, percent, width, max_broadcast)

    seen = components(known.where("linked"))
    labelled = members.join(seen, "node", "left").select("p", "node", F.coalesce("component", "node").alias("c"))
    pairs, known = _across(labelled, nodes, known, own, percent, width, max_broadcast)
    more = _verified(_may_link(pairs, nodes, percent), nodes, own, percent, width, max_broadcast)

    seen = components(known.unionByName(more).where("linked"))
    of = of.join(seen, "node", "left").withColumn("component", F.coalesce("component", "node", "rid"))
    whole = of.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    out = of.join(whole, "component").withColumn("component_id", F.when(~F.col("unnamed"), F.col("component_id")))
    return out.select("doc_id", "tag", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component; all columns stay. Of rows that repeat id and text one stays."""
    found = near_duplicates(docs, id, text, **options).groupBy("doc_id", "tag").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    found, seen = packed(found, twice=F.count_if(F.expr("kept AND rows > 1")))
    tag = F.xxhash64(F.col(f"d.`{text}`"))
    twice = found.where("kept AND rows > 1")
    left = without(docs, found.where("NOT kept OR rows > 1"), id, tag)
    if not seen["twice"]:
        return left
    same = (tag == F.col("m.tag")) & F.col(f"d.`{id}`").eqNullSafe(F.col("m.doc_id"))
    return left.unionByName(docs.alias("d").join(twice.alias("m"), same, "left_semi").dropDuplicates([id, text]))
