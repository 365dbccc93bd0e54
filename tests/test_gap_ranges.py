"""Missing ids as a table between batches against a walk that keeps sets."""
import random

from tapeworks.streaming import held as H


def walk(batches):
    """Status rows of a plain walk in order of arrival."""
    out, top, ranges = [], {}, {}
    for batch in batches:
        for s, at, i, us in sorted(batch, key=lambda r: (r[1], r[2])):
            if s not in top:
                top[s] = i
            elif i > top[s]:
                if i > top[s] + 1:
                    ranges[s, top[s] + 1, i - 1] = set(range(top[s] + 1, i))
                    out.append((s, top[s] + 1, i - 1, "open", us))
                top[s] = i
            else:
                for (sym, lo, hi), left in ranges.items():
                    if sym == s and i in left:
                        left.discard(i)
                        if not left:
                            out.append((s, lo, hi, "filled", us))
    return sorted(out)


def test_gaps_open_split_and_fill_over_batches(spark, tmp_path):
    rng, batches, at = random.Random(5), [], 0
    ids = {s: rng.sample(range(10, 130), 110) for s in ("hot", "cold")}
    for s in ids:  # mostly in order, with jumps, replays and ids that come weeks late
        ids[s] = sorted(ids[s][:70]) + ids[s][70:] + ids[s][60:90]
    for k in range(3):
        batch = []
        for s in ids:
            for i in ids[s][k * 50:(k + 1) * 50]:
                at += 1
                batch.append((s, at // 2, i, 1000 + at))
        batches.append(batch)
    tables, out, step = H.gap_ranges("seq")
    was = {n: spark.createDataFrame([], ddl) for n, ddl in tables.items()}
    got = []
    for k, batch in enumerate(batches):
        rng.shuffle(batch)
        after, rows = step(spark.createDataFrame(batch, "symbol string, seq long, trade_id long, us long"), was)
        for n, df in after.items():
            df.write.parquet(f"{tmp_path}/{n}-{k}")
        was = {n: spark.read.parquet(f"{tmp_path}/{n}-{k}") for n in after}
        got += [tuple(r) for r in rows.collect()]
    want = walk(batches)
    assert sorted(got) == want and {r[3] for r in want} == {"open", "filled"}
