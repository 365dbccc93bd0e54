"""Dominance packing: exact optimum on small instances, ids against the library, rows against brute force."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeworks.llm import dominance_packing as D
from tapeworks.llm import queries

PIECES = ["a", "B", "'s", "'S", "ẖ", "H̱", "É", "é", "İ", "ß", "Σ", "7", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", ".", ",", "..", " ", "\n", "\x1c",
          " ", " ", "\t ", "the", "Don't", "x,", "\U0001f600", "中文", "_", "-", "\x00", "\x85"]


def model():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def least(items, capacity):
    """Exact optimum over all orders: fewest sequences and the least filled last one, by subsets."""
    best = [(0, capacity)] + [None] * ((1 << len(items)) - 1)
    for m in range(1, len(best)):
        ways = []
        for i, x in enumerate(items):
            if m >> i & 1:
                n, used = best[m ^ 1 << i]
                ways.append((n, used + x) if used + x <= capacity else (n + 1, x))
        best[m] = min(ways)
    return best[-1][0]


def test_reduction_keeps_the_optimum_and_places_without_gaps():
    rng, removed = random.Random(5), 0
    for t in range(1500):
        capacity = rng.randint(5, 40)
        items = [rng.randint(max(1, capacity // 4) if t % 3 == 0 else 1, capacity) for _ in range(rng.randint(1, 8))]
        fixed, rest = D.reduce_by_dominance(Counter(items), capacity)
        rest = [x for x, n in rest.items() for _ in range(n)]
        removed += len(items) - len(rest)
        want = least(items, capacity)
        assert want == sum(n for _, n in fixed) + (least(rest, capacity) if rest else 0)
        made, number, filled = D.plan(Counter(items), capacity), Counter(), defaultdict(list)
        assert D.least_sequences(Counter(items), capacity) <= want <= made.n_sequences <= want + 1
        for x in items:
            to, offset = made.place(np.array([x]), np.array([number[x]]))
            number[x] += 1
            filled[to[0]].append((offset[0], x))
        assert len(filled) == made.n_sequences
        for parts in filled.values():
            assert all(o == sum(x for _, x in sorted(parts)[:k]) for k, (o, _) in enumerate(sorted(parts))) and sum(x for _, x in parts) <= capacity
    assert removed > 3000


def test_many_equal_pieces_take_a_plan_of_a_few_rows():
    counts = {x: 10 ** 9 + x for x in range(3, 2048, 5)}
    made = D.plan(counts, 2048)
    assert len(made.rows) < 8192 and made.n_sequences < 1.001 * D.least_sequences(counts, 2048)
    placed = Counter()
    for content, times in made.rows:
        placed.update({x: n * times for x, n in Counter(content).items()})
    assert placed == counts


def test_ids_equal_the_library():
    rng, whole, words = random.Random(2), model(), D.WordIds()
    words.KEEP = 40
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    long = " ".join("Word%d, and" % k for k in range(200_000))
    assert np.frombuffer(words.of(long.encode()), "<u4").tolist() == whole.encode(long, add_special_tokens=False).ids


def check(rows, docs, capacity):
    whole, want = model(), Counter()
    for d, text in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), capacity):
            part = ids[p:p + capacity]
            want[d, p // capacity, p, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= capacity
    return len(placed)


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.QUERIES["op11_dominance_packing"](spark, sf).collect()
    used = check(rows, docs, 2048)
    assert used <= 1 + D.least_sequences(Counter(r.length for r in rows), 2048)


def test_hard_rows_small_capacity_and_sequences(spark):
    docs = [(1, None), (1, None), (None, "no id"), (2, ""), (3, "word " * 70), (4, "one two. Three, four"), (5, "<|endoftext|> é 7 " * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("task", "rank", "length", "piece", "offset", "n")})
    packed = D.pack_documents(df, capacity=16, with_ids=True)
    rows = packed.collect()
    check(rows, docs, 16)
    made = {r.sequence_id: r for r in D.sequences(packed).collect()}
    assert sum(r.n_tokens for r in made.values()) == sum(r.length for r in rows)
    for r in rows:
        assert bytes(made[r.sequence_id].ids)[4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    assert D.pack_documents(df.where("doc_id < 0")).collect() == []
