"""Packing documents into as few fixed-length sequences as possible: dominance reduction, then best fit.

A document is its token ids and one end id. Longer ones are cut into pieces of the
capacity; the last piece keeps what is left. Which document a piece comes from does not
matter for packing, only its length, so the instance is a histogram with at most
``capacity`` entries, whatever the corpus holds. It is the only thing that reaches the
driver.

* **Reduction** (Martello and Toth). For a length ``a`` a set that contains it is fixed
  for good if it dominates every other set that contains it: alone, where nothing else
  fits beside it; with the longest partner, where at most one more piece fits, the two
  fill a sequence exactly or the partner is as long as the best two others; with the
  best two others, where at most two fit and no two lengths strictly between them could
  go instead. A dominating set stays one while pieces are taken away, so it is fixed as
  often as its lengths last in one step. Passes repeat until none applies.
* **Best fit** for the rest, longest first, also on the histogram: all open sequences of
  one content are one row, and the ones with the least sufficient room are filled
  together. A length opens or splits at most a few rows, so the plan has a few times
  ``capacity`` rows.

The plan says how many sequences have which content. Pieces are numbered within their
length: each task numbers its own, and a window over one row per (length, task) gives
where the task's numbers begin. A piece's number then points into the plan. The numbers
are in the settled table, so a task that runs again finds the same ones.

Defined cases: a null or empty text is the end id alone; repeated rows are documents of
their own; a null id is kept; an empty table gives an empty result; other columns are
ignored. A text is read in stretches, so a very long one costs its own size.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import settle

CAPACITY, END_ID = 2048, 0
_SPACE, _STRETCH = b" \t\n\r\x0b\x0c", 1 << 20


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit) of a run without ASCII white space, remembered up to a bound.

    The vocabulary drops white space before it merges, so a text's ids are those of its
    runs, one after the other. Inside an ASCII run letter case does not count, and a
    comma or full stop after letters is a token of its own. Two generations of bounded
    size: what the older one answers moves to the younger.
    """

    KEEP, LONGEST = 300_000, 48

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        self.model, self.older = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json")), {}

    def encode(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "replace")
        if run.isalpha() and run.islower():  # one pre-token that no normalisation changes: its merges alone
            ids = [t.id for t in self.model.model.tokenize(text)]
        else:
            ids = self.model.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def __missing__(self, run: bytes) -> bytes:
        if len(run) > self.LONGEST:
            return self.encode(run)
        if run[-1:] in (b".", b",") and run[:-1].isalpha():
            return self[run[:-1]] + self[run[-1:]]
        if run.isalpha() and not run.islower():
            return self[run.lower()]
        ids = self.older.get(run)
        if ids is None:
            ids = self.encode(run)
        if len(self) >= self.KEEP:
            self.older = dict(self)
            self.clear()
        self[run] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = at + _STRETCH
            while end < len(text) and text[end] not in _SPACE:
                end += 1
            part = text[at:end] if at or end < len(text) else text
            if part.isascii() and b"<|" not in part:
                part = part.lower()
            out.append(b"".join(map(self.__getitem__, part.split())))
            at = end
        return b"".join(out)


_words: dict[str | None, WordIds] = {}


def words_of(path: str | None) -> WordIds:
    """One cache per worker process and vocabulary."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def cut(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, the task's number and the piece's rank within (task, length)."""
    own = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    ddl = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task long, rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen, end = words_of(path), TaskContext.get().partitionId(), Counter(), np.asarray([END_ID], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, piece, start, length, crc, rank, kept = [], [], [], [], [], [], []
                for k, value in enumerate(part.column(1)):
                    ids = words.of(value.as_py() or b"") + end
                    for p, at in enumerate(range(0, len(ids), step)):
                        own_ids = ids[at:at + step]
                        n = len(own_ids) // 4
                        row.append(k), piece.append(p), start.append(at // 4), length.append(n), crc.append(zlib.crc32(own_ids)), rank.append(seen[n])
                        seen[n] += 1
                        if with_ids:
                            kept.append(own_ids)
                long = lambda x: pa.array(x, pa.int64())
                columns = {"doc_id": part.column(0).take(long(row)), "piece": pa.array(piece, pa.int32()), "start": long(start), "length": long(length),
                           "ids_crc32": long(crc), "task": long([task] * len(row)), "rank": long(rank)}
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(kept, pa.binary())} if with_ids else {}))

    return own.mapInArrow(run, ddl + (", ids binary" if with_ids else ""))


# ---- the plan, on the histogram of lengths -------------------------------------------------


def dominating(a: int, sizes: list[int], left: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """Lengths of a set with ``a`` that dominates every other set with ``a``, or None where these rules show none."""
    room = capacity - a
    have = lambda x: left[x] - (x == a)
    fits, load = 0, 0  # how many of the shortest others fit beside a, up to 3
    for x in sizes:
        n = min(have(x), 3 - fits, (room - load) // x)
        fits, load = fits + n, load + n * x
        if fits == 3 or load + x > room:
            break
    if fits == 0:
        return (a,)
    at = bisect_right(sizes, room) - 1
    b = sizes[at] if have(sizes[at]) else sizes[at - 1]
    if fits == 1 or a + b == capacity:
        return a, b
    if fits > 2:
        return None
    best, lo, hi = (0, 0, 0), 0, at
    while lo <= hi:  # the two others with the largest sum that fits
        q, p = sizes[lo], sizes[hi]
        if p + q > room or have(p) < 1 + (p == q):
            hi -= 1
            continue
        if have(q) and p + q > best[0]:
            best = p + q, p, q
        lo += 1
    both, p, q = best
    if not both or b >= both:
        return a, b
    between, load = 0, 0
    for x in sizes[bisect_right(sizes, q):bisect_left(sizes, p)]:
        n = min(have(x), 2 - between)
        between, load = between + n, load + n * x
        if between == 2:
            break
    return (a, p, q) if p == b and (between < 2 or load > room) else None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """([(lengths, how often)] fixed for good, what is left)."""
    left = {x: n for x, n in counts.items() if n > 0}
    sizes, fixed, again = sorted(left), [], True
    while again:
        again = False
        for a in sorted(left, reverse=True):
            while left.get(a) and (found := dominating(a, sizes, left, capacity)):
                need = Counter(found)
                times = min(left[x] // n for x, n in need.items())
                fixed.append((found, times))
                again = True
                for x, n in need.items():
                    left[x] -= n * times
                    if not left[x]:
                        del left[x]
                        sizes.remove(x)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first; sequences of equal content are handled as one."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(content: tuple[int, ...], room: int, times: int) -> None:
        if times:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((content, times))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                content, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, content, times = capacity, (), n
            each = room // x
            full, rest = min(times, n // each), 0
            if full < times and n - full * each:
                rest = n - full * each
            put(content + (x,) * each, room - each * x, full)
            put(content + (x,) * rest, room - rest * x, int(rest > 0))
            if content:
                put(content, room, times - full - (rest > 0))
            n -= full * each + rest
    return [row for rows in open_.values() for row in rows]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound (Martello and Toth's L2): long pieces apart, what the middle ones leave free taken by the shorter."""
    sizes = sorted(counts)
    n = np.array([counts[x] for x in sizes], object)
    w = np.array(sizes, object)
    best = 0
    for k in {0, *(x for x in sizes if 2 * x <= capacity)}:
        big, middle, small = w > capacity - k, (w <= capacity - k) & (2 * w > capacity), (2 * w <= capacity) & (w >= k)
        free = capacity * n[middle].sum() - (n * w)[middle].sum()
        best = max(best, n[big].sum() + n[middle].sum() + max(0, -(((n * w)[small].sum() - free) // -capacity)))
    return int(best)


@dataclass(frozen=True)
class Plan:
    """Contents of sequences with how many there are, and for each length where its pieces go, in the order of their numbers."""

    rows: list[tuple[tuple[int, ...], int]]
    key: np.ndarray  # length << 44 | first number
    first: np.ndarray
    each: np.ndarray  # pieces of that length in one sequence
    sequence: np.ndarray  # number of the first sequence
    offset: np.ndarray

    @property
    def n_sequences(self) -> int:
        return sum(times for _, times in self.rows)

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) | number, side="right") - 1
        k = number - self.first[at]
        return self.sequence[at] + k // self.each[at], self.offset[at] + k % self.each[at] * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    fixed, rest = reduce_by_dominance(counts, capacity)
    rows = fixed + best_fit(rest, capacity)
    begin, sequence, slots = Counter(), 0, []
    for content, times in rows:
        offset = 0
        for x, each in sorted(Counter(content).items(), reverse=True):
            slots.append((x << 44 | begin[x], begin[x], each, sequence, offset))
            begin[x] += each * times
            offset += x * each
        sequence += times
    return Plan(rows, *np.array(sorted(slots), np.int64).reshape(-1, 5).T.copy())


# ---- on the cluster ------------------------------------------------------------------------


def histogram(pieces: DataFrame) -> dict[int, int]:
    """At most ``capacity`` rows."""
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}


def pack_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``ids`` (little-endian, 32 bits each) if asked for."""
    pieces = settle(cut(docs, id, text, path, capacity, with_ids))
    chosen = plan(histogram(pieces), capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")).select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    numbered = pieces.join(begins, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), (F.col("begin") + F.col("rank")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, offset = chosen.place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            kept = {n: batch.column(n) for n in batch.schema.names if n != "number"}
            yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(to, pa.int64()), "offset": pa.array(offset, pa.int64())})

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number")
    return numbered.mapInArrow(run, f"{ddl}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token ids: sequence_id, n_tokens, ids (binary). ``packed`` must hold ``ids``; a group holds at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
