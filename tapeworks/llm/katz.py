"""Katz backoff scores of documents, from a bigram model of the training documents.

p(w | v) is the Good-Turing discounted count of (v, w) over the count of v where the
pair was seen, else a(v) p(w). p(w) is the discounted share of w; what the discounts
leave there belongs to all unknown words together. a(v) is the mass that the discounts
leave to v over the mass of the words not seen after it, so every distribution sums to
one over the known words and the unknown one. Counts up to ``K`` are discounted by
Katz's formula, or by ``TAIL`` where the counts of counts do not allow it; larger ones
by ``TAIL``, which leaves every context some mass.

How it is computed. Words are 56-bit hashes. Every batch of documents reduces itself to
distinct (word, context) pairs with the documents that hold them, packed into binary
columns by the hash of the *word*: the table of pairs, partitioned by word. A partition
thus knows the counts of its words and pairs and gives back
* per document the sums of all log terms that need nothing else; the number of seen
  pairs per count up to ``K`` stands for the discounts, which are not known yet;
* per context the number of its followers by count and their mass: the table of
  contexts, partitioned by context, from which a(v) follows;
* the unseen pairs, by context, which meet the contexts' table in a second exchange.
What is left is a sum per document. Text is read twice: for the unigram counts and for
the pairs; it is never shuffled. Partitions hold about ``PART`` bytes of text.

Words that are a large part of all tokens (at most 2 * ``HOT`` of them, which is all
that the driver sees of the vocabulary) would make heavy partitions. Their pairs are
dealt by pair instead, with the word's count sent along, and as contexts they get
``SALT`` partitions each.

``docs`` must give the same rows in the same order when a lost task runs again, as a
table does; settle anything else first.

Defined cases: a null or empty text is the end token alone; a row that occurs twice is
trained on twice and comes out twice; a null id counts as the empty text in the choice
of training documents; without training documents all scores are 0; an empty table
gives an empty result. Extra columns are not read.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import mix, settle, text_bytes, word_hashes

K, TAIL = 5, 0.5
END, START = np.uint64(0), np.uint64(1)
MASK = np.uint64((1 << 56) - 1)
PART, BATCH, HOT, SALT = 24 << 20, 2_500_000, 2500, 16
SHORT = np.uint64((1 << 48) - 1)  # contexts are told apart by so many bits
UNIT, LIFT = 1e9, 10  # sums of logarithms travel as whole billionths, lifted above 0
_B = pa.binary()


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs."""
    top = int(x.max()) if len(x) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(b: bytes, n: int) -> np.ndarray:
    width = len(b) // n if n else 1
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(n, width)
    return out.reshape(-1).view("<u8")


def discounted(n: list[float]) -> np.ndarray:
    """r* for r = 0..K from n[r], the number of types that were counted r times, r = 1..K+1."""
    flat = np.array([0.0] + [r - TAIL for r in range(1, K + 1)])
    if any(n[r] <= 0 for r in range(1, K + 2)):
        return flat
    a = (K + 1) * n[K + 1] / n[1]
    if a >= 1:
        return flat
    d = np.array([((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, K + 1)])
    return np.concatenate([[0.0], d * np.arange(1, K + 1)]) if ((d > 0) & (d < 1)).all() else flat


class Unigrams:
    """Totals of the training tokens and the counts of the few frequent words."""

    def __init__(self, tokens: int, types: int, of_counts: list[float], words: list[tuple[int, int]]):
        self.tokens, self.types, self.r = tokens, types, discounted(of_counts)
        rare = sum(of_counts[r] for r in range(1, K + 1))
        left = sum(of_counts[r] * (r - self.r[r]) for r in range(1, K + 1)) + (types - rare) * TAIL
        self.unknown = left / tokens if tokens else 1.0
        words = sorted(words)
        self.hot = np.array([w for w, _ in words], np.uint64)
        self.hot_counts = np.array([c for _, c in words], np.int64)
        self.hot_contexts = np.sort(np.append(self.hot & SHORT, START))

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, words), max(len(self.hot) - 1, 0))
        return self.hot[at] == words if len(self.hot) else np.zeros(len(words), bool)

    def is_hot_context(self, contexts: np.ndarray) -> np.ndarray:
        return self.hot_contexts[np.minimum(np.searchsorted(self.hot_contexts, contexts), len(self.hot_contexts) - 1)] == contexts

    def p(self, counts: np.ndarray) -> np.ndarray:
        kept = np.where(counts > K, counts - TAIL, self.r[np.minimum(counts, K)])
        return np.where(counts > 0, kept / max(self.tokens, 1), self.unknown)


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bool, np.ndarray]]]:
    """Lists of (doc_id, train, word hashes), about ``BATCH`` words each."""
    out, n = [], 0
    for batch in rows:
        for at in range(0, batch.num_rows, 512):
            for r in batch.slice(at, 512).to_pylist():
                words = word_hashes(text_bytes(r["text"]).lower().split()) & MASK
                out.append((r["doc_id"], r["train"], words))
                n += len(words) + 8
                if n >= BATCH or len(out) >= 60_000:
                    yield out
                    out, n = [], 0
    if out:
        yield out


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def unigrams(docs: DataFrame, n_bytes: int) -> Unigrams:
    """``docs``: doc_id, text, train."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(rows):
            words, n = np.unique(np.concatenate([np.append(w, END) for _, _, w in batch]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n)], schema=schema)

    table = docs.where("train").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    least = max(1, n_bytes // HOT)  # a word of one letter and a blank are two bytes: at most 2 * HOT words reach it, the end token aside
    row = table.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"),
                    *(F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, K + 2)),
                    F.collect_list(F.when((F.col("n") >= least) | (F.col("word") == int(END)), F.struct("word", "n"))).alias("hot")).first()
    return Unigrams(row["tokens"] or 0, row["types"], [0] + [row[f"n{r}"] for r in range(1, K + 2)], [(x["word"], x["n"]) for x in row["hot"]])


_PAIRS = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("docs", pa.int32()), ("train", pa.int32()), ("ids", _B), ("n_words", pa.int32()),
                    ("n_pairs", pa.int32()), ("n_at", pa.int32()), ("words", _B), ("per_word", _B), ("contexts", _B), ("per_pair", _B), ("at", _B), ("times", _B)])
_PAIRS_DDL = ("part int, batch long, docs int, train int, ids binary, n_words int, n_pairs int, n_at int, words binary, per_word binary, "
              "contexts binary, per_pair binary, at binary, times binary")


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _packed(batch: list[tuple[int | None, bool, np.ndarray]], number: int, model: Unigrams, parts: int) -> pa.RecordBatch:
    """The rows of one batch, which is emptied on the way; its arrays go before the next one is read."""
    batch.sort(key=lambda d: not d[1])  # training documents first
    sizes, n_docs, n_train = np.array([len(w) + 1 for _, _, w in batch]), len(batch), sum(t for _, t, _ in batch)
    ids = np.array([-1 if d is None else d for d, _, _ in batch], np.int64).tobytes() + np.array([d is None for d, _, _ in batch], np.uint8).tobytes()
    end = np.array([END])
    word = np.concatenate([x for _, _, w in batch for x in (w, end)])
    batch.clear()
    context = np.empty_like(word)
    context[1:] = word[:-1] & SHORT
    context[np.cumsum(sizes) - sizes] = START
    part = (word % np.uint64(parts)).astype(np.uint32)
    hot = np.flatnonzero(model.is_hot(word))
    part[hot] = mix(word[hot], context[hot]) % np.uint64(parts)
    order = np.lexsort((context, word, part))  # stable: equal pairs stay in the order of their documents
    part, word = part[order], word[order]
    context = context[order]
    at = np.repeat(np.arange(n_docs, dtype=np.uint32), sizes)[order]
    del order, hot
    s = _runs(part, word, context, at)
    times = _sizes(s, len(at)).astype(np.uint32)
    part, word = part[s], word[s]
    context, at = context[s], at[s]
    del s
    edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint32))
    del part
    out = []
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        if a == b and p:
            continue
        w, c = word[a:b], context[a:b]
        pair, first = _runs(w, c), _runs(w)
        out.append((p, number, n_docs, n_train, ids if p == 0 else None, len(first), len(pair), b - a,
                    pack(w[first]), pack(_sizes(np.searchsorted(pair, first), len(pair))), pack(c[pair]), pack(_sizes(pair, b - a)), pack(at[a:b]), pack(times[a:b])))
    return _rows(_PAIRS, out)


def pair_table(docs: DataFrame, model: Unigrams, parts: int) -> DataFrame:
    """The packed pairs of every batch of documents, by partition of the word."""
    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(_batches(rows)):
            yield _packed(batch, (TaskContext.get().partitionId() << 32) + k, model, parts)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(read, _PAIRS_DDL)


_FOUND = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("batch", pa.int64()), ("docs", pa.int32()), ("train", pa.int32()), ("ids", _B), ("n", pa.int32()),
                    ("keys", _B), ("ints", _B), ("floats", _B)])
_FOUND_DDL = "kind string, part int, batch long, docs int, train int, ids binary, n int, keys binary, ints binary, floats binary"
_INTS = 2 + K       # tokens, known tokens, seen pairs by count
_FOLLOW = K + 2     # followers of a context by count 1..K, K+1 and beyond, and of count K+1 alone


def _context_part(context: np.ndarray, hot: np.ndarray, salt: int, parts: int) -> np.ndarray:
    return np.where(hot, mix(context, np.uint64(salt)), context) % np.uint64(parts)


def _by_part(part: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    for p in range(parts):
        if edges[p] < edges[p + 1]:
            yield p, order[edges[p]:edges[p + 1]]


class _Row:
    """A row of an Arrow table whose binary values stay where they are."""

    def __init__(self, table: pa.Table, i: int):
        self.table, self.i = table, i

    def __getitem__(self, name: str):
        x = self.table.column(name)[self.i]
        return (x.as_buffer() if x.is_valid else None) if pa.types.is_binary(x.type) else x.as_py()


def held(r: _Row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, document, times) of a packed row."""
    pair = np.repeat(np.arange(r["n_pairs"], dtype=np.int32), unpack(r["per_pair"], r["n_pairs"]).astype(np.int64))
    return pair, unpack(r["at"], r["n_at"]).astype(np.int32), unpack(r["times"], r["n_at"]).astype(np.int32)


def count_pairs(pairs: DataFrame, model: Unigrams, parts: int) -> DataFrame:
    """What each partition of the pair table knows: rows of kind documents, contexts and unseen."""
    def count(table: pa.Table) -> pa.Table:
        rows = [_Row(table, i) for i in range(table.num_rows)]
        edges = np.cumsum([0] + [r["n_pairs"] for r in rows])
        word, context, n = (np.empty(edges[-1], t) for t in (np.uint64, np.uint64, np.int32))
        for r, a, b in zip(rows, edges, edges[1:]):
            word[a:b] = np.repeat(unpack(r["words"], r["n_words"]), unpack(r["per_word"], r["n_words"]).astype(np.int64))
            context[a:b] = unpack(r["contexts"], r["n_pairs"])
            pair, at, times = held(r)
            n[a:b] = np.bincount(pair, times * (at < r["train"]), r["n_pairs"])
        order = np.lexsort((context, word)).astype(np.int32)
        word = word[order]
        context = context[order]
        s = _runs(word, context)
        of = np.empty(len(order), np.int32)
        of[order] = np.repeat(np.arange(len(s), dtype=np.int32), _sizes(s, len(order)))
        counts = np.add.reduceat(n[order], s, dtype=np.int64) if len(s) else n.astype(np.int64)
        del order, n
        word, context = word[s], context[s]                        # distinct pairs from here on
        first = _runs(word)
        word_counts = np.add.reduceat(counts, first) if len(first) else counts
        hot = model.is_hot(word[first])
        word_counts[hot] = model.hot_counts[np.searchsorted(model.hot, word[first][hot])]
        # All terms of a pair but the discounts and, for unseen ones, what hangs on the context.
        kinds, per_kind = word[first], _sizes(first, len(word))    # a word's numbers are found once, then repeated for its pairs
        del word
        p, known, base = (np.repeat(x, per_kind) for x in (model.p(word_counts), word_counts > 0, np.log10(word_counts + 0.5)))
        term = np.repeat(-np.where((word_counts > 0) & (kinds != END), np.log10(np.maximum(word_counts, 1)), 0.0), per_kind)
        many, none = np.flatnonzero(counts > K), np.flatnonzero(counts == 0)
        term[many] += np.log10(counts[many] - TAIL)
        term[none] += np.log10(p[none])
        del many, none
        out = []
        for i, r in enumerate(rows):
            pair, at, times = held(r)
            g, d = of[edges[i]:edges[i + 1]][pair], r["docs"]
            ints = [np.bincount(at, times, d), np.bincount(at, times * known[g], d)]
            ints += [np.bincount(at, times * (counts[g] == k), d) for k in range(1, K + 1)]
            sums = (np.bincount(at, times * (x[g] + LIFT), d) for x in (base, term))
            sums = np.stack([np.rint(x * UNIT).astype(np.int64) for x in sums])
            out.append(("documents", 0, r["batch"], d, r["train"], None if r["ids"] is None else r["ids"].to_pybytes(), d, None, zlib.compress(pack(np.concatenate(ints)), 1), pack(sums.ravel())))
            new = counts[g] == 0
            v, at, times = context[g[new]], at[new], times[new]
            for q, x in _by_part(_context_part(v, model.is_hot_context(v), r["batch"] % SALT, parts), parts):
                out.append(("unseen", q, r["batch"], d, 0, None, len(x), pack(v[x]), pack(at[x]), pack(times[x])))
        seen = counts > 0
        v, c, p = context[seen], counts[seen], p[seen]
        order = np.argsort(v, kind="stable")
        v, c, p = v[order], c[order], p[order]
        s = _runs(v)
        if len(s):
            follow = [np.add.reduceat((c == k).astype(np.int64), s) for k in range(1, K + 1)]
            follow += [np.add.reduceat((c > K).astype(np.int64), s), np.add.reduceat((c == K + 1).astype(np.int64), s)]
            follow, mass, v = np.stack(follow, 1), np.add.reduceat(p, s), v[s]
            hot = model.is_hot_context(v)
            sent, cold, warm = [], np.flatnonzero(~hot), np.flatnonzero(hot)
            salted = np.stack([_context_part(v[warm], hot[warm], salt, parts) for salt in range(SALT)])
            for salt in range(SALT):  # once to each partition that any salt leads to
                some = np.flatnonzero(~(salted[:salt] == salted[salt]).any(0))
                sent.append((warm[some], salted[salt][some]))
            for some, q in ((cold, v[cold] % np.uint64(parts)), *sent):
                for q, x in _by_part(q, parts):
                    x = some[x]
                    out.append(("contexts", q, 0, 0, 0, None, len(x), pack(v[x]), pack(follow[x].ravel()), mass[x].tobytes()))
            sums = follow.sum(0)
            out.append(("sums", 0, 0, 0, 0, None, len(sums), None, pack(sums), None))
        return pa.Table.from_batches([_rows(_FOUND, out)])

    return pairs.groupBy("part").applyInArrow(count, _FOUND_DDL)


_LEFT = pa.schema([("batch", pa.int64()), ("docs", pa.int32()), ("train", pa.int32()), ("ids", _B), ("kind", pa.string()), ("n", pa.int32()), ("ints", _B), ("floats", _B)])
_LEFT_DDL = "batch long, docs int, train int, ids binary, kind string, n int, ints binary, floats binary"


def back_off(found: DataFrame, r: np.ndarray) -> DataFrame:
    """For unseen pairs the sum of log10 a(v) c(v) per document; the c(v) undoes what the documents' rows took off for all contexts."""
    def weigh(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        known = [x for x in rows if x["kind"] != "unseen"]
        v = np.concatenate([unpack(x["keys"], x["n"]) for x in known] + [np.empty(0, np.uint64)])
        follow = (unpack(x["ints"], x["n"] * _FOLLOW).reshape(-1, _FOLLOW).astype(np.float64) for x in known)
        freed = np.concatenate([f[:, :K] @ (np.arange(1, K + 1) - r[1:]) + f[:, K] * TAIL for f in follow] + [np.empty(0)])
        mass = np.concatenate([np.frombuffer(x["floats"], np.float64) for x in known] + [np.empty(0)])
        v, of = np.unique(v, return_inverse=True)
        weight = np.log10(np.bincount(of, freed, len(v))) - np.log10(1 - np.bincount(of, mass, len(v))) if len(v) else np.empty(0)
        out = []
        for x in rows:
            if x["kind"] == "unseen":
                c = unpack(x["keys"], x["n"])
                at = np.minimum(np.searchsorted(v, c), max(len(v) - 1, 0))
                w = np.where(v[at] == c, weight[at], 0.0) if len(v) else np.zeros(len(c))  # a context that was never seen has a(v) = 1
                add = np.bincount(unpack(x["ints"], x["n"]).astype(np.int64), unpack(x["floats"], x["n"]).astype(np.int64) * w, x["docs"])
                some = np.flatnonzero(add)
                out.append((x["batch"], x["docs"], 0, None, "more", len(some), pack(some), add[some].tobytes()))
        return pa.Table.from_batches([_rows(_LEFT, out)])

    rows = found.where("kind IN ('contexts', 'unseen')").select("kind", "part", "batch", "docs", "n", "keys", "ints", "floats")
    return rows.groupBy("part").applyInArrow(weigh, _LEFT_DDL)


def score_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", train=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    ``train``: boolean column that chooses the training documents; by default those whose crc32 of the id leaves no 1 modulo 5.
    ``base_score``: additive unigram score with 0.5 per word; ``score``: the model's log10 probability of words and end.
    """
    if train is None:
        train = F.crc32(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    own = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), train.alias("train"))
    n_bytes = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, -(-n_bytes // PART))
    model = unigrams(own, n_bytes)
    found = settle(count_pairs(pair_table(own, model, parts), model, parts))
    of_counts = np.zeros(_FOLLOW)
    totals = found.where("kind = 'sums'").select(*(F.expr(f"aggregate(sequence(0, length(ints) div n - 1), 0L, (t, b) -> t + shiftleft(cast(conv(hex(substr(ints, "
                                                   f"cast({k} * (length(ints) div n) + b + 1 as int), 1)), 16, 10) as long), cast(8 * b as int)))").alias(f"f{k}") for k in range(_FOLLOW)))
    totals = totals.agg(*(F.sum(f"f{k}") for k in range(_FOLLOW))).first()
    of_counts = [float(x or 0) for x in totals]
    r = discounted([0.0, *of_counts[:K], of_counts[K + 1]])
    starts = sum(of_counts)  # no pairs at all: nothing was trained
    n_train = own.where("train").count()
    tokens, types, log_start = model.tokens, model.types, math.log10(n_train) if n_train and starts else 0.0
    out_schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                            ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        d = rows[0]["docs"]
        ints, floats, score, ids, trained = np.zeros((_INTS, d), np.int64), np.zeros((2, d)), np.zeros(d), None, 0
        for x in rows:
            if x["kind"] == "more":
                score[unpack(x["ints"], x["n"]).astype(np.int64)] += np.frombuffer(x["floats"], np.float64)
                continue
            n = unpack(zlib.decompress(x["ints"]), d * _INTS).astype(np.int64).reshape(_INTS, d)
            ints += n
            floats += unpack(x["floats"], 2 * d).astype(np.float64).reshape(2, d) / UNIT - LIFT * n[0]
            ids, trained = x["ids"] or ids, x["train"]
        names = np.frombuffer(ids[:8 * d], np.int64)
        unnamed = np.frombuffer(ids[8 * d:], np.uint8).astype(bool)
        score += floats[1] - log_start + np.log10(np.maximum(r[1:], 1e-300)) @ ints[2:]
        base = floats[0] - ints[0] * math.log10(tokens + 0.5 * (types + 1))
        return pa.table([pa.array(names, mask=unnamed), pa.array(np.arange(d) >= trained), pa.array(ints[0]), pa.array(ints[1]),
                         pa.array(np.full(d, tokens, np.int64)), pa.array(base), pa.array(score)], schema=out_schema)

    rows = found.where("kind = 'documents'").select("batch", "docs", "train", "ids", "kind", "n", "ints", "floats").unionByName(back_off(found, r))
    return rows.groupBy("batch").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
