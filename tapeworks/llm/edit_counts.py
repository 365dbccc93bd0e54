"""Token counts that follow edits.

A document is cut into pre-tokens once; runs of ``LEAF`` pre-tokens are the leaves of a
segment tree that holds the characters and tokens below each node. An edit replaces the
characters from ``start`` to ``end`` by another text. Pre-tokens depend on few
characters after them, so only these are cut anew: from the last pre-token boundary at
least ``BACK`` characters before the edit, to the first boundary behind the edit where
old and new cuts agree. The new pre-tokens are counted, leaves that changed are
rewritten and the sums on the paths above them updated; everything else stays.

The counts equal those of a full encoding, because the vocabulary's merges never cross
pre-tokens and the cut of a text goes on the same way from a common boundary.

Defined cases: a null text counts as empty; edits beyond the text are cut to its end,
reversed ones are empty; edits of a document apply one after the other, each to the
text before it; an empty document has one empty leaf; a row that occurs twice comes out
twice; an empty table gives an empty result. Extra columns are not read.
"""
from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import only, per_row
from tapeworks.llm.secret_scan import encoding

LEAF = 32   # pre-tokens of a full leaf
BACK = 4    # characters after its end that can decide where a pre-token ends
EDITS = "array<struct<start:int,end:int,text:string>>"
_TREE = "doc_id long, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"


class Counter:
    """Tokens of pre-tokens, remembered up to a bound."""

    LIMIT = 300_000

    def __init__(self, path: str | None = None):
        import public_tokenizers

        self.encoding, self.cut, self.known = encoding(path), regex.compile(public_tokenizers.PATTERN), {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def leaves(self, pieces: list[str], like: int = 0) -> list[list[int]]:
        """[characters, tokens] of each leaf; ``like`` many leaves if they come out neither bare nor twice as full."""
        step = -(-len(pieces) // like) if like and like <= len(pieces) <= 2 * LEAF * like else LEAF
        if like and -(-len(pieces) // step) != like:
            step = LEAF
        out = []
        for i in range(0, len(pieces), step):
            part = pieces[i:i + step]
            out.append([sum(map(len, part)), sum(map(self.count, part))])
        return out or [[0, 0]]


def _counter(path: str | None, made: dict = {}) -> Counter:  # noqa: B006  one per worker and vocabulary
    if path not in made:
        made[path] = Counter(path)
    return made[path]


class Tree:
    """Sums over leaves in levels of pairs; ``levels[0]`` are the leaves."""

    def __init__(self, leaves: list[list[int]]):
        self.levels = [leaves]
        self.updated = 0
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([self._sum(below, i) for i in range(0, len(below), 2)])

    @staticmethod
    def _sum(below: list[list[int]], i: int) -> list[int]:
        pair = below[i:i + 2]
        return [sum(x[0] for x in pair), sum(x[1] for x in pair)]

    @property
    def total(self) -> list[int]:
        return self.levels[-1][0]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) that holds a character, by the sums from the root down; the last leaf beyond the end."""
        i, first = 0, 0
        for level in reversed(self.levels[:-1]):
            i *= 2
            if i + 1 < len(level) and char >= first + level[i][0]:
                first, i = first + level[i][0], i + 1
        return i, first

    def replace(self, a: int, b: int, leaves: list[list[int]]) -> None:
        """Leaves ``a`` to ``b`` (exclusive) become ``leaves``. Sums above change on the paths; only where the number of
        leaves changes are the nodes to the right paired anew."""
        same = len(leaves) == b - a
        self.levels[0][a:b] = leaves
        lo, hi = a, a + len(leaves) if same else len(self.levels[0])
        for k in range(1, len(self.levels)):
            below, lo, hi = self.levels[k - 1], lo // 2, (hi + 1) // 2
            del self.levels[k][(len(below) + 1) // 2:]
            for i in range(lo, hi):
                node = self._sum(below, 2 * i)
                self.updated += 1
                if i < len(self.levels[k]):
                    self.levels[k][i] = node
                else:
                    self.levels[k].append(node)
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([self._sum(below, i) for i in range(0, len(below), 2)])
        while len(self.levels) > 1 and len(self.levels[-2]) == 1:
            self.levels.pop()


def edit(tree: Tree, counter: Counter, old: str, start: int, end: int, put: str) -> tuple[str, int]:
    """Applies one edit to the tree; the new text and the characters that were cut and counted anew."""
    start = min(max(start, 0), len(old))
    end = min(max(end, start), len(old))
    new, shift = old[:start] + put + old[end:], len(put) - (end - start)
    a, first = tree.leaf_at(max(start - BACK, 0))
    # The leaf before may end in a pre-token that reached into the edit's surroundings.
    while a > 0 and first > start - BACK:
        a -= 1
        first -= tree.levels[0][a][0]
    # The last boundary inside this leaf that lies far enough before the edit.
    keep = [m.group() for m in counter.cut.finditer(old[first:min(len(old), start + BACK)])]
    at, kept = first, []
    for piece in keep:
        if at + len(piece) > start - BACK:
            break
        kept.append(piece)
        at += len(piece)
    # New cuts go on until they meet an old leaf boundary behind the edit.
    b, boundary = tree.leaf_at(end)
    boundary += tree.levels[0][b][0]
    b += 1
    pieces, pos, seen = list(kept), at, 0
    while pos < len(new):
        m = counter.cut.match(new, pos)
        pieces.append(m.group())
        pos, seen = m.end(), seen + len(m.group())
        while boundary + shift < pos and b < len(tree.levels[0]):
            boundary += tree.levels[0][b][0]
            b += 1
        if pos == boundary + shift and boundary >= end:
            break
    else:
        b = len(tree.levels[0])
    tree.replace(a, b, counter.leaves(pieces, b - a) if pieces or (a == 0 and b == len(tree.levels[0])) else [])
    return new, seen


def build_trees(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """State table: (doc_id, text, n_tokens, leaf_chars, leaf_tokens). Inner sums follow from the leaves."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()),
                        ("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32()))])

    def build(row: dict) -> tuple:
        counter, text = _counter(vocabulary), row["text"] or ""
        leaves = counter.leaves(counter.cut.findall(text))
        return row["doc_id"], row["text"], sum(x[1] for x in leaves), [x[0] for x in leaves], [x[1] for x in leaves]

    return only(docs, doc_id=id, text=text).mapInArrow(per_row(build, schema), _TREE)


def apply_edits(state: DataFrame, edits: str = "edits", vocabulary: str | None = None) -> DataFrame:
    """State table after the edits in column ``edits`` (``EDITS``), with what they cost.

    Adds n_before, n_edits, recounted_chars (cut and encoded anew) and updated_nodes.
    A table of edits is brought to the state by a join on the document's id.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("leaf_chars", pa.list_(pa.int32())),
                        ("leaf_tokens", pa.list_(pa.int32())), ("n_before", pa.int64()), ("n_edits", pa.int64()),
                        ("recounted_chars", pa.int64()), ("updated_nodes", pa.int64())])

    def update(row: dict) -> tuple:
        counter, text = _counter(vocabulary), row["text"] or ""
        tree, seen, todo = Tree([list(x) for x in zip(row["leaf_chars"], row["leaf_tokens"])]), 0, row["edits"] or []
        for e in todo:
            text, n = edit(tree, counter, text, e["start"], e["end"], e["text"] or "")
            seen += n
        leaves = tree.levels[0]
        return (row["doc_id"], text if todo else row["text"], tree.total[1], [x[0] for x in leaves], [x[1] for x in leaves],
                row["n_tokens"], len(todo), seen, tree.updated)

    own = state.select("doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens", F.col(f"`{edits}`").alias("edits"))
    return own.mapInArrow(per_row(update, schema), _TREE + ", n_before long, n_edits long, recounted_chars long, updated_nodes long")


def spread_edits(id: str = "doc_id", text: str = "text") -> Column:
    """Three edits of every document, from its id and length: a correction, a deletion and an insertion."""
    n, k = F.coalesce(F.length(text), F.lit(0)), F.abs(F.coalesce(F.col(id), F.lit(0)) % 1_000_003)
    at = lambda m: (k * m % (n + 1)).cast("int")
    one = lambda s, e, t: F.struct(s.alias("start"), e.cast("int").alias("end"), F.lit(t).alias("text"))
    return F.array(one(at(7919), at(7919) + 6, "corrected"), one(at(104729), at(104729) + k % 40, ""),
                   one(at(1299709), at(1299709), " and a new clause,")).cast(EDITS)
