"""Lots, gates, text, hashes, and batch against stream."""
import html
import re

import pytest
from pyspark.sql import functions as F

from tapeworks.functions import gates as T
from tapeworks.functions import hashing as H
from tapeworks.functions import text as X
from tapeworks.operators import book as B
from tapeworks.operators import stats as S


def test_reconcile_meets_each_side_once(spark):
    """Odd books: absent ids, copies that differ, listings without fills; totals need no join of their own."""
    cols = "order_id string, symbol string, side string, vol double, cost double, fee double"
    orders = spark.createDataFrame([("a", "X", "buy", 3.0, 30.0, 0.3), ("b", "X", "buy", 1.0, 5.0, 0.1), ("b", "Y", "sell", 1.0, 5.0, 0.1),
                                    ("c", "X", "buy", 2.0, 8.0, 0.0), (None, "X", "buy", 1.0, 1.0, 0.0), ("z", "X", "buy", 0.0, 0.0, 0.0)], cols)
    fills = spark.createDataFrame([("f1", "a", "X", "buy", 1.0, 10.0, 0.1), ("f2", "a", "X", "buy", 2.0, 20.0, 0.2), ("f2", "a", "X", "buy", 2.0, 20.0, 0.2),
                                   ("f3", "b", "X", "buy", 1.0, 5.0, 0.1), ("f4", None, "X", "buy", 1.0, 1.0, 0.0), ("f5", "nowhere", "X", "sell", 1.0, 1.0, 0.0)], f"fill_id string, {cols}")
    legs = [(f, leg, x, fee) for f, v, c, fee in (("f1", 1.0, -10.0, 0.1), ("f2", 2.0, -20.0, 0.2), ("f3", 1.5, -5.0, 0.1), ("f4", 1.0, -1.0, 0.5), ("g", 1.0, 1.0, 0.0)) for leg, x, fee in (("base", v, 0.0), ("quote", c, fee))]
    out = B.reconcile_orders(orders, fills, spark.createDataFrame(legs, "refid string, leg string, amount double, fee double"))
    got = sorted((r.key or "", r.rule, r.expected, r.actual) for r in out.collect())
    b = [("f3", "base_amount", "1.0000000", "1.50000000")] * 2  # once for each listing of its order
    assert got == sorted([
        ("", "order_without_fills", "1.00000000", "none"), ("a", "total_cost", "30.00000000", "50.00000000"), ("a", "total_fee", "0.30000000", "0.50000000"),
        ("a", "total_vol", "3.00000000", "5.00000000"), ("b", "duplicate_order", "1", "2"), ("c", "order_without_fills", "2.00000000", "none"),
        ("f2", "duplicate_fill", "1", "2"), *b, ("f3", "fill_attribution", "Y/sell", "X/buy"), ("f4", "fill_without_order", "none", "none"),
        ("f4", "ledger_fee", "0.00000000", "0.50000000"), ("f5", "fill_without_order", "nowhere", "none"), ("f5", "ledger_legs", "2", "0"), ("g", "ledger_without_fill", "none", "g")])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # fills with legs, then with orders; there were three


def test_lots_over_many_blocks(spark, monkeypatch):
    import random
    rng, rows = random.Random(4), []
    for i in range(400):
        rows.append(("hot" if i % 5 else "cold", i, rng.choice(["buy", "sell"]), float(rng.randint(1, 9)), float(rng.randint(90, 110))))
    df = spark.createDataFrame(rows, "symbol string, n int, side string, vol double, price double").withColumns({"cost": F.col("vol") * F.col("price"), "fee": F.lit(0.5)})
    from tapeworks.operators import scan
    monkeypatch.setattr(B, "range_blocks", lambda d, k, o, name="blk": scan.range_blocks(d, k, o, name, blocks=6))
    fifo = {(r.symbol, r.n): r.pnl for r in B.fifo_pnl(df, ["symbol"], ["n"]).collect()}
    avg = {(r.symbol, r.n): r for r in B.average_cost(df, ["symbol"], ["n"]).collect()}
    lots, books = {}, {}
    for sym, n, side, vol, px in rows:
        q, basis, entry = books.get(sym, (0.0, 0.0, 0.0))
        queue = lots.setdefault(sym, [])
        if side == "buy":
            queue.append([vol, px])
            books[sym] = (q + vol, basis + vol * px + 0.5, (entry * q + vol * px) / (q + vol))
        else:
            left, pnl = min(vol, q), 0.0
            done = left
            while left > 0:
                take = min(left, queue[0][0])
                pnl += take * (px - queue[0][1])
                queue[0][0] -= take
                left -= take
                if queue[0][0] == 0:
                    queue.pop(0)
            if done:
                assert fifo[(sym, n)] == pytest.approx(pnl)
                assert avg[(sym, n)].pnl == pytest.approx(done * px - 0.5 - basis * done / q)
            assert avg[(sym, n)].exceeds == (vol > q)
            books[sym] = (q - done, basis * (q - done) / q if q else 0.0, entry)
        r = avg[(sym, n)]
        assert (r.held, r.basis, r.entry_price) == pytest.approx(books[sym])


def test_lots_and_scales_over_three_levels_of_blocks(spark, monkeypatch):
    import random
    rng = random.Random(8)
    rows = [(i, rng.choice(["buy", "sell"]), float(rng.randint(1, 9)), float(rng.randint(90, 110)), float(rng.randint(-1, 1))) for i in range(90)]
    df = spark.createDataFrame(rows, "n int, side string, vol double, price double, pnl double").withColumns({"symbol": F.lit("hot"), "cost": F.col("vol") * F.col("price"), "fee": F.lit(0.5)})
    monkeypatch.setattr(B, "MAP_ROWS", 4)
    avg = {r.n: (r.held, r.basis, r.entry_price) for r in B.average_cost(df.drop("pnl"), ["symbol"], ["n"]).collect()}
    scale = {r.n: r.risk_scale for r in B.risk_scale(df.select("symbol", "n", "pnl"), ["symbol"], ["n"]).collect()}
    q, basis, entry, at = 0.0, 0.0, 0.0, 1.0
    for n, side, vol, px, pnl in rows:
        if side == "buy":
            q, basis, entry = q + vol, basis + vol * px + 0.5, (entry * q + vol * px) / (q + vol)
        else:
            left = max(0.0, q - vol)
            q, basis = left, basis * left / q if q else 0.0
        at = min(2.0, at + 0.15) if pnl > 0 else max(0.5, at - 0.15) if pnl < 0 else at
        assert avg[n] == pytest.approx((q, basis, entry)) and scale[n] == pytest.approx(at)


def test_risk_gate_order(spark):
    one = spark.range(1)
    def gate(action="BUY", price=100.0, stop=95.0, equity=500.0, peak=500.0, today=0.0, last=None, exposure=0.0):
        c = T.entry_risk(F.lit(action), F.lit(price), F.lit(stop).cast("double"), F.lit(equity), F.lit(peak), F.lit(today), F.lit(0), F.lit(last).cast("double"), F.lit(exposure), 1000.0)
        return one.select(c.alias("r")).first().r
    ok = gate()
    assert ok.approved and ok.notional == 100.0 and ok.planned_loss == 5.0
    assert gate("SELL", today=-99.0).approved and not gate("WAIT").approved
    assert gate(today=-15.0).reason.startswith("Daily loss")
    assert gate(equity=440.0).reason.startswith("Maximum drawdown")
    assert gate(last=900.0).reason == "Trade cooldown is active"
    assert gate(stop=None).reason == "Invalid stop distance" and gate(stop=101.0).reason == "Invalid stop distance"
    assert gate(exposure=250.0).reason == "Exposure cap reached"
    assert gate(exposure=200.0).notional == 50.0


def test_order_size_rounds_down(spark):
    df = spark.createDataFrame([(10.0, 3.0, 4, 2), (0.4, 3.0, 4, 2), (10.0, 0.004, 4, 2)], "n double, p double, ld int, pd int")
    z = T.size_order(F.col("n"), F.col("p"), F.col("ld"), F.col("pd"), F.lit(0.01).cast("decimal(20,8)"), F.lit(0.5).cast("decimal(20,8)"))
    out = [r.z for r in df.select(z.alias("z")).collect()]
    assert (out[0].volume, out[0].price, out[0].ok) == (3.3333, 3.0, True)
    assert out[1].reason == "below minimum cost" and out[2].reason == "price rounds to zero"


def test_sentiment_words(spark):
    texts = ["Bitcoin bullish, huge rally!", "solana is not bullish", "XRP scam, rug and crash", "quiet day", "Never sell"]
    want = [3.5, -2.0, -6.5, 0.0, 0.8]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in df.select("i", X.lexicon_score("t").alias("s")).orderBy("i").collect()]
    assert got == pytest.approx(want)
    who = [r.m for r in df.select("i", X.mentions("t").alias("m")).orderBy("i").collect()]
    assert who == [["BTC"], ["SOL"], ["XRP"], ["BTC"], ["BTC"]]


def test_clean_text_on_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in pages.select("html", X.clean("html").alias("c")).collect():
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", r.html))).strip()
        assert r.c == want


def test_audit_chain(spark):
    import hashlib
    rows, prev = [], "0" * 64
    for i in range(50):
        m = f"{prev}|{i}"
        h = hashlib.sha256(m.encode()).hexdigest()
        rows.append((i, prev, m, h))
        prev = h
    ddl = "seq long, previous_hash string, material string, entry_hash string"
    ok = H.verify_chain(spark.createDataFrame(rows, ddl)).first()
    assert ok.intact and ok.faults == 0
    rows[20] = (20, rows[20][1], rows[20][2] + "x", rows[20][3])
    rows[30] = (30, "f" * 64, rows[30][2], rows[30][3])
    bad = H.verify_chain(spark.createDataFrame(rows, ddl)).first()
    assert (bad.intact, bad.faults, bad.first_bad, bad.first_fault) == (False, 2, 20, "tampered")


def test_suggestions_need_evidence(spark):
    def reason(i):
        return "Filters failed: volume, regime" if i % 10 < 7 else "ok"
    rows = [(i, ("WAIT", 10, reason(i), 1.0)) for i in range(60)]
    d = spark.createDataFrame(rows, "event_id int, signal struct<action:string,score:bigint,reason:string,price:double>")
    bars = spark.createDataFrame([("S", i, 100.0 * 1.01 ** i) for i in range(80)], "symbol string, t long, close double")
    out = {r.parameter: r for r in S.suggestions(S.filter_analysis(d), S.signal_quality(d), S.market_regime(bars),
                                                 {"regime_ema": 200, "min_volume_ratio": 1.1, "breakout_lookback": 20, "risk_per_trade": 0.01, "cooldown_minutes": 60}).collect()}
    assert {k for k, r in out.items() if r.fires} == {"regime_ema", "min_volume_ratio", "risk_per_trade", "cooldown_minutes"}
    assert out["regime_ema"].suggested_value == 180 and out["risk_per_trade"].suggested_value == 0.015


def test_bench_stream_equals_batch(spark, sf):
    from tapeworks.plans.catalog import QUERIES
    batch = {r.id: (r.state, r.until) for r in QUERIES["t6_bench_states"](spark, sf).collect()}
    live = {r.id: (r.state, r.until) for r in QUERIES["t6_bench_stream"](spark, sf).collect()}
    assert batch == live and "benched" in {s for s, _ in batch.values()}
