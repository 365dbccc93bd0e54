"""Prefix trie against a trie built turn by turn."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tapeworks.llm import prefix_trie as P
from tapeworks.llm import queries

DDL = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((t is not None, t or 0), tie, (role, text)))
    own = {c: [x for *_, x in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[:heads[c]] + v[heads[c]:] for c, v in own.items()}, own


def brute(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, set()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode().split()) if k else 0)
    for k, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], digest))
    return out


def got(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op12_prefix_trie"](spark, sf)) == brute(rebuilt(rows)[0])


@pytest.mark.parametrize("cells, block, chunk", [(P.MAX_CELLS, 4096, 1024), (1 << 15, 3, 2)])
def test_shared_and_hard_rows(spark, monkeypatch, cells, block, chunk):
    monkeypatch.setattr(P, "BLOCK_TURNS", block)
    monkeypatch.setattr(P, "CHUNK_IDS", chunk)
    rng, rows = random.Random(4), [(None, 0, "user", "lost"), (None, 0, "user", "lost"), (7, None, None, None), (7, 3, "user", ""), (7, 3, "user", ""), (901, 0, "a", "b")]
    for c in range(400):
        c = c if c % 40 else c + 1000  # some heads are absent
        for t in range(rng.choice([1, 2, 3, 5, 12])):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["hi there", "hi", None]) if rng.random() < 0.9 else f"own {rng.random()} word"))
    rows += [(c, t, "u", f"same {t}") for c in (2000, 2001, 2002, 2043) for t in range(40)]
    df = spark.createDataFrame(rows, DDL).withColumns({c: F.lit(1) for c in ("pos", "blk", "k1", "len", "words", "tail", "i", "n")})
    turns = P.ordered_turns(df)
    paths, own = rebuilt(rows)
    assert got(P.prefix_trie(P.with_shared_heads(turns), cells)) == brute(paths)
    assert got(P.prefix_trie(P.whole(turns), cells)) == brute(own)


def test_empty_and_one_conversation(spark):
    df = spark.createDataFrame([(5, 0, "user", "one two")], DDL)
    assert P.prefix_trie(P.whole(P.ordered_turns(df.where("turn > 9")))).collect() == []
    assert got(P.prefix_trie(P.with_shared_heads(P.ordered_turns(df)))) == brute(rebuilt([(5, 0, "user", "one two")])[0])


def test_screen_proves_only_singletons(spark):
    rows = [(c, t, "u", f"{c % 50 if t < 3 else c} {t}") for c in range(300) for t in range(6)]
    paths = P.prefixes(P.whole(P.ordered_turns(spark.createDataFrame(rows, DDL))))
    tails = {r.conv_id: r.tail for r in P.singleton_depths(paths).collect()}
    assert all(t >= 4 for t in tails.values()) and len(tails) > 290
    assert all(t >= 4 for t in {r.conv_id: r.tail for r in P.singleton_depths(paths, 1 << 15).collect()}.values())
