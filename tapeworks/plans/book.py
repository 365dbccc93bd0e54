"""Queries on lots, orders, reconciliation, gates, sizing and hashes."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.functions import costs as K
from tapeworks.functions import gates as T
from tapeworks.functions import hashing as H
from tapeworks.functions.core import bar_open, day_text, epoch_us, iso_text, rounded
from tapeworks.operators import book as B
from tapeworks.operators.scan import block_no, greedy_chain
from tapeworks.plans.inputs import TABLES, Inputs
from tapeworks.plans.registry import query
from tapeworks.session import pin

ORDER = ["ts", "l_orderkey", "l_linenumber"]


@query("c8_excursions", """SELECT h.symbol, h.entry_id, round((min(b.low) / h.entry_px - 1) * 1e4, 4) AS mae_bps, round((max(b.high) / h.entry_px - 1) * 1e4, 4) AS mfe_bps
    FROM holdings h LEFT JOIN m1 b ON b.symbol = h.symbol AND (b.t + 60) * 1000000 > h.entry_us AND b.t * 1000000 <= h.exit_us GROUP BY h.symbol, h.entry_id, h.entry_px""", "holdings m1")
def c8(x: Inputs):
    e = B.excursions(x.holdings(), x.bars_1m(), 1)
    return e.select("symbol", "entry_id", *rounded(mae_bps=("mae_bps", 4), mfe_bps=("mfe_bps", 4)))


LOTS = """w AS (SELECT *, sum(CASE WHEN side = 'buy' THEN vol ELSE -vol END) OVER o AS s FROM fills WINDOW o AS (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber)),
    v AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber)) AS held FROM w),
    u AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber), 0) AS was FROM v),
    lots AS (SELECT *, CASE WHEN side = 'sell' THEN was - held ELSE 0 END AS closed FROM u)"""
BUYS = """b AS (SELECT symbol, price, sum(vol) OVER o - vol AS lo, sum(vol) OVER o AS hi FROM lots WHERE side = 'buy' WINDOW o AS (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber)),
    c AS (SELECT symbol, ts, l_orderkey, l_linenumber, price, closed, sum(closed) OVER o - closed AS lo, sum(closed) OVER o AS hi FROM lots WHERE side = 'sell' AND closed > 0
      WINDOW o AS (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber))"""


@query("c11_fifo_pnl", f"""WITH {LOTS}, {BUYS} SELECT symbol, ts // 2592000 AS month, count(*) AS sells, sum(closed) AS closed, round(sum(pnl), 1) AS pnl FROM (
    SELECT c.symbol, c.ts, c.l_orderkey, c.l_linenumber, c.closed, sum((least(b.hi, c.hi) - greatest(b.lo, c.lo)) * (c.price - b.price)) AS pnl
    FROM c JOIN b ON b.symbol = c.symbol AND b.lo < c.hi AND b.hi > c.lo GROUP BY ALL) GROUP BY 1, 2""", "fills")
def c11(x: Inputs):
    """Profit of each sell against first-in lots, per symbol and 30 days."""
    f = B.fifo_pnl(x.fills(), ["symbol"], ORDER)
    return f.groupBy("symbol", F.floor(F.col("ts") / 2_592_000).alias("month")).agg(F.count(F.lit(1)).alias("sells"), F.sum("closed").alias("closed"), F.round(F.sum("pnl"), 1).alias("pnl"))


@query("c11_fifo_total", f"""WITH {LOTS}, {BUYS} SELECT c.symbol, round(sum((least(b.hi, c.hi) - greatest(b.lo, c.lo)) * (c.price - b.price)), 0) AS realized,
    round(min(f.fees), 2) AS fees FROM c JOIN b ON b.symbol = c.symbol AND b.lo < c.hi AND b.hi > c.lo JOIN (SELECT symbol, sum(fee) AS fees FROM fills GROUP BY 1) f ON f.symbol = c.symbol GROUP BY 1""", "fills")
def c11_total(x: Inputs):
    f = x.fills()
    pnl = B.fifo_pnl(f, ["symbol"], ORDER).groupBy("symbol").agg(F.round(F.sum("pnl"), 0).alias("realized"))
    return pnl.join(f.groupBy("symbol").agg(F.round(F.sum("fee"), 2).alias("fees")), "symbol")


@query("e36_average_cost", f"""WITH {LOTS}, l AS (SELECT symbol, list({{'b': side = 'buy', 'c': cost + fee, 'p': cost, 'x': price, 'f': fee, 'was': was, 'held': held, 'closed': closed}} ORDER BY ts, l_orderkey, l_linenumber) AS xs,
      count(*) FILTER (side = 'sell' AND vol > was) AS exceeds, max_by(held, ROW(ts, l_orderkey, l_linenumber)) AS qty FROM lots GROUP BY 1),
    r AS (SELECT symbol, exceeds, qty, list_reduce(list_transform(xs, lambda v: {{'b': v.b, 'c': v.c, 'p': v.p, 'x': v.x, 'f': v.f, 'was': v.was, 'held': v.held, 'closed': v.closed, 'basis': 0.0::DOUBLE, 'entry': 0.0::DOUBLE, 'pnl': 0.0::DOUBLE}}),
      lambda a, v: CASE WHEN v.b THEN {{'b': v.b, 'c': v.c, 'p': v.p, 'x': v.x, 'f': v.f, 'was': v.was, 'held': v.held, 'closed': v.closed, 'basis': a.basis + v.c, 'entry': (a.entry * v.was + v.p) / v.held, 'pnl': a.pnl}}
        ELSE {{'b': v.b, 'c': v.c, 'p': v.p, 'x': v.x, 'f': v.f, 'was': v.was, 'held': v.held, 'closed': v.closed, 'basis': CASE WHEN v.was > 0 THEN a.basis * v.held / v.was ELSE 0 END, 'entry': a.entry,
          'pnl': a.pnl + CASE WHEN v.closed > 0 THEN v.closed * v.x - v.f - a.basis * (1 - v.held / v.was) ELSE 0 END}} END,
      {{'b': true, 'c': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'x': 0.0::DOUBLE, 'f': 0.0::DOUBLE, 'was': 0.0::DOUBLE, 'held': 0.0::DOUBLE, 'closed': 0.0::DOUBLE, 'basis': 0.0::DOUBLE, 'entry': 0.0::DOUBLE, 'pnl': 0.0::DOUBLE}}) AS z FROM l)
    SELECT symbol, exceeds, qty, round(z.basis, 2) AS basis, round(z.entry, 4) AS entry_price, round(z.pnl, 0) AS realized FROM r""", "fills")
def e36(x: Inputs):
    """Final lot per symbol and the profit realised on the way."""
    a = B.average_cost(x.fills(), ["symbol"], ORDER)
    last = F.struct(*ORDER)
    return a.groupBy("symbol").agg(F.count_if("exceeds").alias("exceeds"), F.max_by("held", last).alias("qty"), F.round(F.max_by("basis", last), 2).alias("basis"),
                                   F.round(F.max_by("entry_price", last), 4).alias("entry_price"), F.round(F.sum("pnl"), 0).alias("realized"))


SCALE = """SELECT sleeve, list_reduce(list_prepend(1.0::DOUBLE, list(sign(pnl)::DOUBLE ORDER BY ts, id)), lambda a, v: CASE WHEN v > 0 THEN least(2.0, a + 0.15) WHEN v < 0 THEN greatest(0.5, a - 0.15) ELSE a END) AS s,
    list(sign(pnl)::INT ORDER BY ts, id) AS xs FROM closed_trades WHERE ts < {cut} GROUP BY 1"""


@query("e29_risk_scale", f"""WITH t AS (SELECT sleeve, id, pnl, ts, row_number() OVER (PARTITION BY sleeve ORDER BY ts, id) AS n FROM closed_trades),
    z AS ({SCALE.format(cut=9_999_999_999)}) SELECT z.sleeve, round(z.s, 6) AS risk_scale, (SELECT count(*) FROM t a WHERE a.sleeve = z.sleeve AND a.pnl > 0 AND a.n > (SELECT coalesce(max(n), 0) FROM t b WHERE b.sleeve = z.sleeve AND b.pnl < 0)) AS win_streak,
    (SELECT count(*) FROM t a WHERE a.sleeve = z.sleeve AND a.pnl < 0 AND a.n > (SELECT coalesce(max(n), 0) FROM t b WHERE b.sleeve = z.sleeve AND b.pnl > 0)) AS loss_streak FROM z""", "closed_trades")
def e29(x: Inputs):
    """Adaptive risk scale and streaks after the last trade of every sleeve."""
    r = B.risk_scale(x.closed_trades(), ["sleeve"], ["ts", "id"])
    last = F.max_by(F.struct("risk_scale", "win_streak", "loss_streak"), F.struct("ts", "id"))
    return r.groupBy("sleeve").agg(last.alias("r")).select("sleeve", F.round("r.risk_scale", 6).alias("risk_scale"), F.col("r.win_streak").cast("bigint").alias("win_streak"), F.col("r.loss_streak").cast("bigint").alias("loss_streak"))


@query("e31_cooldown", """WITH RECURSIVE d AS MATERIALIZED (SELECT * FROM decisions WHERE action = 'BUY'),
    c AS (SELECT symbol, CAST(-1 AS BIGINT) AS event_id, CAST(-9000000000000 AS BIGINT) AS ready FROM d GROUP BY 1 UNION ALL SELECT c.symbol, n.event_id, n.ts_us + 7200000000 FROM c,
      LATERAL (SELECT d.event_id, d.ts_us FROM d WHERE d.symbol = c.symbol AND d.ts_us >= c.ready ORDER BY d.ts_us LIMIT 1) n)
    SELECT d.event_id, d.symbol, c.event_id IS NOT NULL AS accepted FROM d LEFT JOIN c ON c.symbol = d.symbol AND c.event_id = d.event_id""", "decisions")
def e31(x: Inputs):
    """Buys at least two hours after the last accepted buy of the symbol."""
    d = x.decisions().where("signal.action = 'BUY'").select("event_id", "symbol", "ts_us", block_no("event_id").alias("blk"), (F.col("ts_us") + 7_200_000_000).alias("ready"))
    return greedy_chain(d, ["symbol"], "blk", "ts_us", "ready", ["event_id"]).select("event_id", "symbol", "accepted")


# ---- positions ---------------------------------------------------------------------------

PRICES = "(SELECT symbol, max_by(price, trade_id) AS price FROM ticks WHERE symbol <> 'S2' GROUP BY 1)"


@query("c13_mark_to_market", f"""WITH {LOTS}, g AS (SELECT symbol, list({{'b': side = 'buy', 'c': cost + fee, 'p': cost, 'was': was, 'held': held}} ORDER BY ts, l_orderkey, l_linenumber) AS xs, max_by(held, ROW(ts, l_orderkey, l_linenumber)) AS quantity FROM lots GROUP BY 1),
    p AS (SELECT symbol, quantity, z.entry AS entry_price, z.basis - quantity * z.entry AS fees_paid FROM (SELECT symbol, quantity, list_reduce(
      list_transform(xs, lambda v: {{'b': v.b, 'c': v.c, 'p': v.p, 'was': v.was, 'held': v.held, 'basis': 0.0::DOUBLE, 'entry': 0.0::DOUBLE}}),
      lambda a, v: {{'b': v.b, 'c': v.c, 'p': v.p, 'was': v.was, 'held': v.held, 'basis': CASE WHEN v.b THEN a.basis + v.c WHEN v.was > 0 THEN a.basis * v.held / v.was ELSE 0 END,
        'entry': CASE WHEN v.b THEN (a.entry * v.was + v.p) / v.held ELSE a.entry END}},
      {{'b': true, 'c': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'was': 0.0::DOUBLE, 'held': 0.0::DOUBLE, 'basis': 0.0::DOUBLE, 'entry': 0.0::DOUBLE}}) AS z FROM g))
    SELECT p.symbol, quantity, round(quantity * coalesce(t.price, entry_price), 2) AS market_value, round(quantity * coalesce(t.price, entry_price) - quantity * entry_price - fees_paid, 2) AS unrealized
    FROM p LEFT JOIN {PRICES} t ON t.symbol = p.symbol WHERE quantity > 1e-12""", "fills ticks")
def c13(x: Inputs):
    """Open lots at the last price, entered at the average cost of what is held; the basis beyond it are fees."""
    last = F.max_by(F.struct("held", "basis", "entry_price"), F.struct(*ORDER)).alias("l")
    lots = B.average_cost(x.fills(), ["symbol"], ORDER).groupBy("symbol").agg(last)
    pos = lots.select("symbol", F.col("l.held").alias("quantity"), F.col("l.entry_price").alias("entry_price"), (F.col("l.basis") - F.col("l.held") * F.col("l.entry_price")).alias("fees_paid"))
    prices = x.ticks().where("symbol <> 'S2'").groupBy("symbol").agg(F.max_by("price", "trade_id").alias("price"))
    return B.mark_positions(pos, prices, 500.0).select("symbol", "quantity", *rounded(market_value=("market_value", 2), unrealized=("unrealized", 2)))


@query("h13_book_exposure", """SELECT sleeve, count(*) AS open_positions, round(sum(notional), 2) AS exposure, round(sum(notional * 0.5 + pnl), 2) AS equity_addon FROM closed_trades WHERE source = 'sync' GROUP BY 1""", "closed_trades")
def h13(x: Inputs):
    """Margin still locked plus unrealised profit, and exposure, of a futures book."""
    t = x.closed_trades().where("source = 'sync'")
    return t.groupBy("sleeve").agg(F.count(F.lit(1)).alias("open_positions"), F.round(F.sum(F.abs("notional")), 2).alias("exposure"),
                                   F.round(F.sum(F.col("notional") * 0.5 + F.col("pnl")), 2).alias("equity_addon"))


# ---- orders, fills, ledger ---------------------------------------------------------------

def order_book(x: Inputs):
    """Orders, fills and ledger with planted faults in each."""
    f = x.fills().select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fill_id"), F.concat_ws("-", "l_orderkey", "symbol", "side").alias("order_id"), "l_orderkey", "symbol", "side", "vol", "cost", "fee")
    f = f.withColumns({"cost": F.round("cost", 2), "fee": F.round("fee", 4)})
    o = f.groupBy("order_id", "symbol", "side", "l_orderkey").agg(*[F.sum(F.col(c).cast(B.EXACT)).alias(c) for c in ("vol", "cost", "fee")])
    o = o.withColumn("vol", F.when(F.col("l_orderkey") % 103 == 0, F.col("vol") + 1).otherwise(F.col("vol")))
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    legs = F.array(F.struct(F.lit("base").alias("leg"), (sign * F.col("vol")).cast(B.EXACT).alias("amount"), F.lit(0).cast(B.EXACT).alias("fee")),
                   F.when(F.col("l_orderkey") % 107 != 0, F.struct(F.lit("quote").alias("leg"), (-sign * F.col("cost")).cast(B.EXACT).alias("amount"), F.col("fee").cast(B.EXACT).alias("fee"))))
    led = f.select(F.col("fill_id").alias("refid"), "symbol", "l_orderkey", F.explode(legs).alias("l")).where("l IS NOT NULL").select("refid", "symbol", "l_orderkey", "l.*")
    led = led.withColumn("amount", F.when((F.col("leg") == "quote") & (F.col("l_orderkey") % 101 == 0), F.col("amount") + 1).otherwise(F.col("amount")))
    return pin(o), f, led


TABLES["rf"] = ("fills", """SELECT l_orderkey || '-' || l_linenumber AS fill_id, l_orderkey || '-' || symbol || '-' || side AS order_id, l_orderkey, symbol, side, CAST(vol AS DECIMAL(28,8)) AS vol,
    CAST(round(cost, 2) AS DECIMAL(28,8)) AS cost, CAST(round(fee, 4) AS DECIMAL(28,8)) AS fee FROM fills""")


@query("c19_reconcile", """SELECT fill_id AS key, 'ledger_legs' AS rule FROM rf WHERE l_orderkey % 107 = 0 UNION ALL SELECT fill_id, 'quote_amount' FROM rf WHERE l_orderkey % 101 = 0 AND l_orderkey % 107 <> 0
    UNION ALL SELECT DISTINCT order_id, 'total_vol' FROM rf WHERE l_orderkey % 103 = 0""", "rf")
def c19(x: Inputs):
    """All disagreements between orders, fills and ledger."""
    return B.reconcile_orders(*order_book(x)).select("key", "rule")


def faulty_book(x: Inputs):
    """An exact book, then one kind of fault for every thirteen residues of the order number."""
    f = x.fills().select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fill_id"), F.concat_ws("-", "l_orderkey", "symbol", "side").alias("order_id"),
                         (F.col("l_orderkey") % 128).alias("r"), "symbol", "side", "vol", F.round("cost", 2).alias("cost"), F.round("fee", 4).alias("fee"))
    r, copies = F.col("r"), lambda k: F.explode(F.when(F.col("r") == k, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    o = f.groupBy("order_id", "symbol", "side", "r").agg(*[F.sum(F.col(c).cast(B.EXACT)).alias(c) for c in ("vol", "cost", "fee")])
    for k, c in ((11, "vol"), (12, "cost"), (13, "fee")):
        o = o.withColumn(c, F.when(r == k, F.col(c) + 1).otherwise(F.col(c)))
    listed = (F.when(r == 2, F.array().cast("array<string>")).when(r == 9, F.array("order_id", "order_id"))
              .when(r == 10, F.array("order_id", F.concat("order_id", F.lit("-ghost")))).otherwise(F.array("order_id")))
    orders = pin(o.withColumns({"symbol": F.when(r == 3, "other").otherwise(F.col("symbol")), "order_id": F.explode(listed)}))
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    base = F.struct(F.lit("base").alias("leg"), (sign * F.col("vol") + F.when(r == 6, 1).otherwise(0)).cast(B.EXACT).alias("amount"), F.lit(0).cast(B.EXACT).alias("fee"))
    quote = F.struct(F.lit("quote").alias("leg"), (-sign * F.col("cost") + F.when(r == 7, 1).otherwise(0)).cast(B.EXACT).alias("amount"), (F.col("fee") + F.when(r == 8, 1).otherwise(0)).cast(B.EXACT).alias("fee"))
    rows = f.select("fill_id", "r", F.explode(F.array(base, F.when(r != 5, quote))).alias("l")).where("l IS NOT NULL")
    ref = F.explode(F.when(r == 4, F.array(F.col("fill_id"), F.concat("fill_id", F.lit("-ghost")))).otherwise(F.array("fill_id")))
    ledger = rows.select(ref.alias("refid"), "l.*")
    return orders, f.withColumn("n", copies(1)).drop("n"), ledger


FAULTS = {2: "fill_without_order", 3: "fill_attribution", 5: "ledger_legs", 6: "base_amount", 7: "quote_amount", 8: "ledger_fee"}
ORDER_FAULTS = {9: "duplicate_order", 11: "total_vol", 12: "total_cost", 13: "total_fee"}


@query("c19_all_faults", f"""WITH g AS (SELECT *, l_orderkey % 128 AS r FROM rf), o AS (SELECT order_id, r, sum(fee) AS fee FROM g GROUP BY 1, 2)
    SELECT fill_id AS key, CASE r {' '.join(f"WHEN {k} THEN '{v}'" for k, v in FAULTS.items())} END AS rule FROM g WHERE r IN ({', '.join(map(str, FAULTS))})
    UNION ALL SELECT fill_id, 'duplicate_fill' FROM g WHERE r = 1 UNION ALL SELECT fill_id || '-ghost', 'ledger_without_fill' FROM g WHERE r = 4
    UNION ALL SELECT order_id, CASE r {' '.join(f"WHEN {k} THEN '{v}'" for k, v in ORDER_FAULTS.items())} END FROM o WHERE r IN ({', '.join(map(str, ORDER_FAULTS))})
    UNION ALL SELECT order_id || '-ghost', 'order_without_fills' FROM o WHERE r = 10
    UNION ALL SELECT order_id, unnest(['total_vol', 'total_cost']) FROM o WHERE r = 1 UNION ALL SELECT order_id, 'total_fee' FROM o WHERE r = 1 AND fee <> 0""", "rf")
def c19f(x: Inputs):
    """All thirteen kinds of disagreement, each planted on its own orders."""
    return B.reconcile_orders(*faulty_book(x)).select("key", "rule")


@query("c20_balances", """WITH l AS (SELECT symbol AS asset, sum(CASE side WHEN 'buy' THEN vol ELSE -vol END) AS s FROM rf GROUP BY 1 UNION ALL
      SELECT 'USD', sum(CASE WHEN l_orderkey % 107 = 0 THEN 0 ELSE CASE side WHEN 'buy' THEN -cost ELSE cost END + CASE WHEN l_orderkey % 101 = 0 THEN 1 ELSE 0 END - fee END) FROM rf)
    SELECT asset, CAST(round(s, 4) AS DOUBLE) AS ledger_sum, CAST(round(s + 1, 4) AS DOUBLE) AS balance FROM l WHERE asset = 'S1'""", "rf")
def c20(x: Inputs):
    """Ledger sums against balances; one balance is off by one."""
    _, _, led = order_book(x)
    led = led.withColumn("asset", F.when(F.col("leg") == "base", F.col("symbol")).otherwise("USD"))
    bal = led.groupBy("asset").agg(F.sum(F.col("amount") - F.col("fee")).alias("balance")).withColumn("balance", F.when(F.col("asset") == "S1", F.col("balance") + 1).otherwise(F.col("balance")))
    out = B.reconcile_balances(led, bal)
    return out.select("asset", *[F.round(F.col(c), 4).cast("double").alias(c) for c in ("ledger_sum", "balance")])


@query("c20_unprotected", f"""WITH {LOTS}, p AS (SELECT symbol, max_by(held, ROW(ts, l_orderkey, l_linenumber)) AS qty FROM lots GROUP BY 1), s AS (SELECT symbol, sum(vol) - sum(CASE WHEN l_orderkey % 2 = 0 THEN vol ELSE 0 END) AS covered FROM fills WHERE side = 'sell' GROUP BY 1)
    SELECT p.symbol, CAST(qty AS DOUBLE) AS qty, CAST(coalesce(covered, 0) AS DOUBLE) AS covered FROM p LEFT JOIN s ON s.symbol = p.symbol WHERE qty > 0 AND coalesce(covered, 0) <> qty""", "fills")
def c20b(x: Inputs):
    """Open lots against resting stop orders."""
    lots = B.inventory(x.fills(), ["symbol"], ORDER).groupBy("symbol").agg(F.max_by("held", F.struct(*ORDER)).alias("qty"))
    stops = x.fills().where("side = 'sell'").select("symbol", "vol", F.when(F.col("l_orderkey") % 2 == 0, F.col("vol")).otherwise(0.0).alias("vol_exec"))
    return B.unprotected_lots(lots, stops).select("symbol", F.col("qty").cast("double").alias("qty"), F.col("covered").cast("double").alias("covered"))


@query("c20_unattributed_fills", "SELECT fill_id FROM rf WHERE l_orderkey % 2 = 1", "rf")
def c20c(x: Inputs):
    o, f, _ = order_book(x)
    return f.join(o.where("l_orderkey % 2 = 0").select("order_id"), "order_id", "left_anti").select("fill_id")


@query("c19_order_faults", """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 11 = 0 THEN 'inconsistent_quantity' WHEN o_orderkey % 13 = 0 THEN 'unfilled_with_costs' ELSE 'unknown_status' END AS fault FROM orders
    WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0""")
def c19b(x: Inputs):
    k = F.col("o_orderkey")
    o = x.table("orders").select(k.alias("order_id"), F.lit(10.0).alias("vol"), F.when(k % 11 == 0, 11.0).when(k % 13 == 0, 0.0).otherwise(5.0).alias("vol_exec"),
                                 F.col("o_totalprice").alias("cost"), F.lit(0.1).alias("fee"), F.when(k % 17 == 0, "lost").otherwise("closed").alias("status"))
    return B.order_faults(o).select("order_id", "fault")


@query("c10_unmanaged", "SELECT DISTINCT 'S' || (o_custkey % 7) AS symbol FROM orders WHERE o_custkey % 7 >= 3")
def c10(x: Inputs):
    active = x.table("orders").select(F.concat(F.lit("S/"), (F.col("o_custkey") % 7).cast("string")).alias("symbol"))
    managed = x.fills().select("symbol").distinct()
    return B.unmanaged(active, managed)


@query("g2_local_not_exchange", "SELECT l_orderkey AS order_id FROM lineitem WHERE l_orderkey % 5 = 0 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def g2(x: Inputs):
    local = x.table("lineitem").where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("order_id")).distinct()
    return local.join(x.table("orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("order_id")), "order_id", "left_anti")


@query("g4_allowlist", "SELECT o_orderkey AS id FROM orders WHERE 'S' || (o_custkey % 7) IN ('S1', 'S4')")
def g4(x: Inputs):
    allow = x.spark.createDataFrame([("S1",), ("S4",)], "symbol string")
    o = x.table("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("S"), (F.col("o_custkey") % 7).cast("string")).alias("symbol"))
    return o.join(allow, "symbol", "left_semi").select("id")


@query("c17_foreign_symbols", """WITH t AS (SELECT DISTINCT sleeve, 'S' || (id // 10) AS symbol, source FROM closed_trades) SELECT DISTINCT sleeve, symbol FROM t a WHERE source = 'fill' AND NOT EXISTS (
    SELECT 1 FROM t b WHERE b.symbol = a.symbol AND b.sleeve <> a.sleeve AND b.source = 'sync')""", "closed_trades")
def c17(x: Inputs):
    """Candidates that no other sleeve holds: the owners of a symbol are counted first."""
    t = x.closed_trades().select("sleeve", F.concat(F.lit("S"), F.floor(F.col("id") / 10).cast("string")).alias("symbol"), "source")
    owners = t.where("source = 'sync'").groupBy("symbol").agg(F.min("sleeve").alias("lo"), F.max("sleeve").alias("hi"))
    mine = t.where("source = 'fill'").select("sleeve", "symbol").distinct().join(owners, "symbol", "left")
    free = F.col("lo").isNull() | ((F.col("lo") == F.col("sleeve")) & (F.col("hi") == F.col("sleeve")))
    return mine.where(free).select("sleeve", "symbol")


EXEC = """SELECT e.*, cost / volume AS fill_price, o.o_totalprice / 1000 AS signal_price FROM (SELECT order_id, l_orderkey, symbol, side, sum(vol) AS volume, sum(cost) AS cost, sum(fee) AS fee FROM rf GROUP BY ALL) e
    LEFT JOIN orders o ON o.o_orderkey = e.l_orderkey AND o.o_orderstatus <> 'P'"""


def executions(x: Inputs):
    _, f, _ = order_book(x)
    signals = f.select("order_id", "l_orderkey").distinct().join(x.table("orders").where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).select("order_id", (F.col("o_totalprice") / 1000).alias("signal_price"))
    return B.order_executions(f, signals)


@query("d32_order_executions", f"""SELECT order_id, volume, fill_price, CASE side WHEN 'buy' THEN fill_price - coalesce(signal_price, 0) ELSE coalesce(signal_price, 0) - fill_price END AS slippage_usd,
    CASE WHEN signal_price > 0 THEN CASE side WHEN 'buy' THEN fill_price - signal_price ELSE signal_price - fill_price END / signal_price * 1e4 ELSE 0 END AS slippage_bps
    FROM (SELECT * REPLACE (CAST(volume AS DOUBLE) AS volume, CAST(cost AS DOUBLE) / CAST(volume AS DOUBLE) AS fill_price) FROM ({EXEC}))""", "rf")
def d32(x: Inputs):
    return executions(x).select("order_id", "volume", "fill_price", "slippage_usd", "slippage_bps")


@query("d18_slippage", f"""SELECT count(*) AS executions, count(*) FILTER (signal_price > 0) AS measured, round(avg(CASE side WHEN 'buy' THEN p - signal_price ELSE signal_price - p END) FILTER (signal_price > 0), 4) AS avg_usd,
    round(avg(CASE side WHEN 'buy' THEN p - signal_price ELSE signal_price - p END / signal_price * 1e4) FILTER (signal_price > 0), 2) AS avg_bps FROM (SELECT *, CAST(cost AS DOUBLE) / CAST(volume AS DOUBLE) AS p FROM ({EXEC}))""", "rf")
def d18(x: Inputs):
    return B.slippage_summary(executions(x)).select("executions", "measured", *rounded(avg_usd=("avg_usd", 4), avg_bps=("avg_bps", 2)))


# ---- selection ---------------------------------------------------------------------------

SELECT_SQL = """WITH l AS (SELECT sleeve, symbol, count(*) AS n, avg(pnl) AS e, sum(pnl) FILTER (regime = 'chop') AS rp FROM closed_trades GROUP BY 1, 2),
    c AS (SELECT l.sleeve, d.event_id, d.ts_us, d.ts_us // 3600000000 AS hour, d.symbol, d.score * CASE WHEN coalesce(l.n, 0) < 3 THEN 1.0 ELSE round(1 + greatest(-0.5, least(0.5, l.e)), 3) END * CASE WHEN l.n >= 3 AND l.rp < 0 THEN 0.6 ELSE 1 END AS eff
      FROM decisions d JOIN l ON l.symbol = d.symbol WHERE action = 'BUY')"""


def scored_candidates(x: Inputs):
    t = x.closed_trades().groupBy("sleeve", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("e"), F.sum(F.when(F.col("regime") == "chop", F.col("pnl"))).alias("rp"))
    d = x.decisions().where("signal.action = 'BUY'").join(t, "symbol")
    eff = F.col("signal.score") * B.selection_bias(F.col("e"), F.col("n")) * B.regime_penalty(F.col("rp"), F.col("n"))
    return d.select("sleeve", "ts_us", F.expr("ts_us div 3600000000").alias("hour"), "symbol", F.col("event_id").alias("place"), eff.alias("effective"))


@query("f3_best_candidate", SELECT_SQL + " SELECT sleeve, hour, symbol, round(eff, 6) AS effective FROM (SELECT *, row_number() OVER (PARTITION BY sleeve, hour ORDER BY eff DESC, event_id) AS rk FROM c) WHERE rk = 1 AND eff >= 25", "decisions closed_trades")
def f3(x: Inputs):
    """Best buy of every sleeve and hour by score, learned bias and regime penalty."""
    return B.best_candidate(scored_candidates(x), ["sleeve", "hour"]).select("sleeve", "hour", "symbol", F.round("effective", 6).alias("effective"))


@query("f4_best_free_candidate", SELECT_SQL + """, s AS (SELECT symbol, ts_us FROM decisions WHERE action = 'SELL'), g AS (SELECT c.*, s.ts_us AS sold FROM c ASOF LEFT JOIN s ON s.symbol = c.symbol AND c.ts_us >= s.ts_us)
    SELECT sleeve, hour, symbol, round(eff, 6) AS effective FROM (SELECT *, row_number() OVER (PARTITION BY sleeve, hour ORDER BY eff DESC, event_id) AS rk FROM g WHERE symbol <> 'S1' AND (sold IS NULL OR ts_us - sold >= 2700000000)) WHERE rk = 1""", "decisions closed_trades")
def f4(x: Inputs):
    """The same, without symbols that are held or were sold less than 45 minutes ago."""
    held = x.spark.createDataFrame([("S1",)], "symbol string")
    free = scored_candidates(x).join(held, "symbol", "left_anti")
    exits = x.decisions().where("signal.action = 'SELL'").select("symbol", F.col("ts_us").alias("sold_us"))
    free = B.off_cooldown(free, exits, 45)
    return B.best_candidate(free, ["sleeve", "hour"], float("-inf")).select("sleeve", "hour", "symbol", F.round("effective", 6).alias("effective"))


@query("f8_scan_limit", """SELECT sleeve, symbol, bias FROM (SELECT *, row_number() OVER (PARTITION BY sleeve ORDER BY bias DESC, symbol) AS rk FROM (SELECT sleeve, symbol, round(1 + greatest(-0.5, least(0.5, avg(pnl))), 3) AS bias FROM closed_trades GROUP BY 1, 2)) WHERE rk <= 2""", "closed_trades")
def f8(x: Inputs):
    from pyspark.sql import Window
    g = x.closed_trades().groupBy("sleeve", "symbol").agg(F.avg("pnl").alias("e"), F.count(F.lit(1)).alias("n")).withColumn("bias", B.selection_bias(F.col("e"), F.col("n")))
    w = Window.partitionBy("sleeve").orderBy(F.desc("bias"), "symbol")
    return g.withColumn("rk", F.row_number().over(w)).where("rk <= 2").select("sleeve", "symbol", "bias")


PAIRS = [("S0", "ZUSD", "online", 8, 1, 0.0001, 0.5), ("S1", "USD", "online", 4, 2, 0.01, 0.5), ("S2", "USD", "cancel_only", 2, 2, 1.0, 5.0)]
PAIR_SQL = "(VALUES " + ", ".join(f"('{s}', '{q}', '{st}', {ld}, {pd}, {om}, {cm})" for s, q, st, ld, pd, om, cm in PAIRS) + ") p(symbol, quote, status, lot_decimals, pair_decimals, ordermin, costmin)"


def pair_meta(x: Inputs):
    m = x.spark.createDataFrame(PAIRS, "symbol string, quote string, status string, lot_decimals int, pair_decimals int, ordermin double, costmin double")
    return m.withColumns({c: F.col(c).cast("decimal(20,8)") for c in ("ordermin", "costmin")})


@query("h5_size_order", f"""SELECT trade_id, symbol, reason, CASE WHEN reason = 'ok' THEN CAST(v AS DOUBLE) END AS volume, CASE WHEN reason = 'ok' THEN CAST(q AS DOUBLE) END AS price FROM (SELECT *, CASE WHEN q <= 0 THEN 'price rounds to zero' WHEN v <= 0 THEN 'volume rounds to zero'
      WHEN v < ordermin THEN 'below minimum volume' WHEN v * px < costmin THEN 'below minimum cost' ELSE 'ok' END AS reason FROM (SELECT t.trade_id, t.symbol, p.ordermin, p.costmin, CAST(t.price AS DECIMAL(20,8)) AS px,
      floor(t.price * pow(10, pair_decimals) + 1e-7) / pow(10, pair_decimals) AS q, floor((t.qty * 0.05) / t.price * pow(10, lot_decimals) + 1e-9) / pow(10, lot_decimals) AS v FROM ticks t JOIN {PAIR_SQL} ON p.symbol = t.symbol))""", "ticks")
def h5(x: Inputs):
    """Order sizes of 5 cents per unit of quantity, cut to each pair's decimals."""
    t = x.ticks().join(F.broadcast(pair_meta(x)), "symbol")
    s = T.size_order(F.round(F.col("qty") * 0.05, 8), F.col("price"), F.col("lot_decimals"), F.col("pair_decimals"), F.col("ordermin"), F.col("costmin"))
    return t.select("trade_id", "symbol", s.alias("z")).select("trade_id", "symbol", "z.reason", "z.volume", "z.price")


@query("b15_universe", f"""SELECT DISTINCT t.symbol FROM ticks t JOIN {PAIR_SQL} ON p.symbol = t.symbol WHERE ltrim(quote, 'Z') = 'USD' AND status = 'online' AND t.symbol IN ('S0', 'S1', 'S2')""", "ticks")
def b15(x: Inputs):
    """Active dollar pairs that are allowed and can be sized at the position cap."""
    last = x.ticks().groupBy("symbol").agg(F.max_by("price", "trade_id").alias("price"))
    m = pair_meta(x).where((F.regexp_replace(F.upper("quote"), "^Z+", "") == "USD") & (F.lower("status") == "online"))
    s = T.size_order(F.lit(200.0), F.col("price"), F.col("lot_decimals"), F.col("pair_decimals"), F.col("ordermin"), F.col("costmin"))
    return last.join(F.broadcast(m), "symbol").where(s["ok"]).select("symbol")


# ---- gates -------------------------------------------------------------------------------

SPELL = "CASE event_id % 6 WHEN 0 THEN 'xbtusd' WHEN 1 THEN 'XXBTZUSD' WHEN 2 THEN 'eth-usd' WHEN 3 THEN 'SOL/USD' WHEN 4 THEN 'sol_usd' ELSE 'DOGEUSD' END"


@query("b1_canonical", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'BTC/USD' WHEN 1 THEN 'BTC/USD' WHEN 2 THEN 'ETH/USD' WHEN 3 THEN 'SOL/USD' WHEN 4 THEN 'SOL/USD' END AS symbol FROM events")
def b1(x: Inputs):
    return x.table("events").select("event_id", T.canonical_symbol(F.expr(SPELL)).alias("symbol"))


@query("h17_symbol_parts", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' ELSE 'SOL' END AS base, 'USD' AS quote FROM events")
def h17(x: Inputs):
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN 'xbt/usd' WHEN 1 THEN 'eth/usd' ELSE 'Sol/USD' END")
    base = F.upper(F.split_part(raw, F.lit("/"), F.lit(1)))
    return x.table("events").select("event_id", F.when(base.isin("XBT", "XXBT"), "BTC").otherwise(base).alias("base"), F.upper(F.split_part(raw, F.lit("/"), F.lit(2))).alias("quote"))


@query("b2_valid_ticks", "SELECT event_id, value FROM events WHERE event_id % 9 <> 0 AND event_id % 10 <> 0 AND event_id % 4 <> 3")
def b2(x: Inputs):
    """Text fields, some broken: price not a number, unknown side, or quantity NaN."""
    from tapeworks.sources.store import clean_ticks
    e = F.col("event_id")
    raw = x.table("events").select("event_id", "value", F.lit("S0").alias("symbol"), e.alias("place"), e.cast("string").alias("trade_id"), F.lit("1704067200.5").alias("ts"),
                                   F.when(e % 9 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("price"), F.when(e % 10 == 0, "nan").otherwise("1.5").alias("qty"),
                                   F.when(e % 4 == 3, "x").otherwise("b").alias("side"), F.lit("l").alias("ord_type"))
    ok = clean_ticks(raw.drop("event_id", "value"))
    return ok.select(F.col("trade_id").alias("event_id"), F.col("price").alias("value"))


@query("b6_fee_edge", "SELECT event_id, value / 10000 + 1e-15 >= 0.01 AND value > 0 AS ok FROM events")
def b6(x: Inputs):
    from tapeworks.operators.signals import fee_edge
    return x.table("events").select("event_id", fee_edge(F.col("value") / 10_000, 100.0)["ok"].alias("ok"))


@query("b7_market_quality", """SELECT event_id, CASE WHEN bid <= 0 OR ask <= bid THEN 'Invalid or crossed market quote' WHEN (ask - bid) / ((bid + ask) / 2) * 1e4 > 10 THEN 'Spread too wide' WHEN (bid + ask) * 500 < 30000 THEN 'Recent dollar volume is below minimum'
    ELSE 'Liquidity and spread checks passed' END AS reason FROM quotes""", "quotes")
def b7(x: Inputs):
    q = x.quotes().withColumn("dollars", (F.col("bid") + F.col("ask")) * 500)
    g = T.market_quality("bid", "ask", "dollars", 10.0, 30_000.0)
    return q.select("event_id", F.regexp_replace(g["reason"], ":.*", "").alias("reason"))


@query("b8_freshness", """SELECT symbol, max(us) // 60000000 * 60 AS last_bar, CASE WHEN 1706486400 - max(us) // 60000000 * 60 < -900 THEN 'future_bar' WHEN 1706486400 - max(us) // 60000000 * 60 > 2700 THEN 'stale' ELSE 'fresh' END AS verdict
    FROM ticks WHERE symbol = 'S0' OR (symbol = 'S1' AND us < 1706484600000000) OR us < 1706480000000000 GROUP BY 1""", "ticks")
def b8(x: Inputs):
    """Feed verdicts at a fixed time; the three feeds end at different times."""
    t = x.ticks().withColumn("us", epoch_us("ts")).where("symbol = 'S0' or (symbol = 'S1' and us < 1706484600000000) or us < 1706480000000000")
    b = t.groupBy("symbol").agg(F.max(bar_open("us", 60)).alias("last_bar"))
    return b.select("symbol", "last_bar", T.freshness(F.col("last_bar"), 1_706_486_400, 15).alias("verdict"))


@query("b9_bar_faults", """WITH b AS (SELECT symbol, trade_id AS arrived, CASE WHEN trade_id % 500 = 0 THEN us // 60000000 * 60 - 7200 ELSE us // 60000000 * 60 END AS t FROM ticks)
    SELECT symbol, count(*) AS rows, count(*) FILTER (t < p) AS out_of_order, count(*) - count(DISTINCT t) AS duplicates, count(*) FILTER (t < p) = 0 AND count(*) = count(DISTINCT t) AS ok FROM (SELECT *, lag(t) OVER (PARTITION BY symbol ORDER BY arrived) AS p FROM b) GROUP BY 1""", "ticks")
def b9(x: Inputs):
    """Minute stamps in arrival order, every 500th two hours late."""
    t = bar_open(epoch_us("ts"), 60)
    b = x.ticks().select("symbol", F.col("trade_id").alias("arrived"), F.when(F.col("trade_id") % 500 == 0, t - 7200).otherwise(t).alias("t"))
    return T.bar_faults(b)


@query("b10_entry_risk", """SELECT event_id, approved, reason, round(CASE WHEN reason = 'Risk checks passed' THEN size END, 2) AS notional FROM (SELECT *, CASE WHEN action = 'SELL' THEN 'Exit signal approved' WHEN action <> 'BUY' THEN 'No entry order requested' WHEN today <= -(eq * 0.03) THEN 'Daily loss circuit breaker is active'
      WHEN 1 - eq / greatest(least(520, 500), 0.01) >= 0.1 THEN 'Maximum drawdown circuit breaker is active' WHEN gap < 600 THEN 'Trade cooldown is active' WHEN stop IS NULL OR price <= stop THEN 'Invalid stop distance' WHEN expo >= eq * 0.5 THEN 'Exposure cap reached'
      WHEN size < 1 THEN 'Calculated order is below minimum notional' ELSE 'Risk checks passed' END AS reason, action = 'SELL' OR reason = 'Risk checks passed' AS approved FROM (
      SELECT *, CASE WHEN expo + s0 > eq * 0.5 THEN greatest(eq * 0.5 - expo, 0) ELSE s0 END AS size FROM (SELECT *, least(eq * 0.01 / ((price - stop) / price), eq * 0.4, eq) AS s0 FROM (
        SELECT event_id, action, price, CASE WHEN score % 10 = 0 THEN NULL ELSE price * (0.9 + (score % 12) / 100.0) END AS stop, least(greatest(440.0 + score, 0), 500) AS eq, CASE WHEN score % 17 = 0 THEN -20.0 ELSE 0 END AS today, score * 7 AS gap, score * 2.6 AS expo FROM decisions))))""", "decisions")
def b10(x: Inputs):
    """The entry gate over all decisions, with session state made from the score."""
    d, s = x.decisions(), F.col("signal.score")
    price = F.col("signal.price")
    stop = F.when(s % 10 != 0, price * (0.9 + (s % 12) / 100.0))
    r = T.entry_risk(F.col("signal.action"), price, stop, 440.0 + s, F.lit(520.0), F.when(s % 17 == 0, -20.0).otherwise(0.0), F.lit(0), F.lit(1_000_000) - s * 7, s * 2.6, 1_000_000)
    return d.select("event_id", r.alias("r")).select("event_id", "r.approved", "r.reason", "r.notional")


@query("b12_gate_name", """SELECT event_id, CASE event_type WHEN 'view' THEN 'learner' WHEN 'click' THEN 'market_quality' WHEN 'purchase' THEN 'fee_edge' WHEN 'error' THEN 'risk' ELSE 'other' END AS gate FROM events""")
def b12(x: Inputs):
    why = F.expr("""CASE event_type WHEN 'view' THEN 'Learner benched after fee drag' WHEN 'click' THEN 'Market quality: exposure unknown? no, spread' WHEN 'purchase' THEN 'Fee gate and risk' WHEN 'error' THEN 'RISK refused' ELSE 'n/a' END""")
    why = F.regexp_replace(why, "exposure unknown\\? no, ", "")
    return x.table("events").select("event_id", T.gate_name(why).alias("gate"))


@query("b11_redact", "SELECT event_id, '[REDACTED]' AS secret, event_type AS kept, '[REDACTED]' AS inner_secret, '[REDACTED]' AS listed_secret, event_type AS listed_kept FROM events")
def b11(x: Inputs):
    """Secrets at the top, inside a record and inside records of a list."""
    m = F.create_map(F.lit("API_Key"), F.col("value").cast("string"), F.lit("kind"), F.col("event_type"))
    legs = F.array(F.create_map(F.lit("nonce"), F.col("event_id").cast("string"), F.lit("kind"), F.col("event_type")))
    payload = x.table("events").select("event_id", F.struct(m.alias("head"), F.struct(F.col("value").alias("Password"), legs.alias("legs")).alias("request")).alias("p"))
    r = payload.select("event_id", T.redact("p", payload.schema["p"].dataType).alias("r"))
    leg = F.col("r.request.legs")[0]
    return r.select("event_id", F.col("r.head")["API_Key"].alias("secret"), F.col("r.head")["kind"].alias("kept"), F.col("r.request.Password").alias("inner_secret"),
                    leg["nonce"].alias("listed_secret"), leg["kind"].alias("listed_kept"))


# ---- scalar jobs -------------------------------------------------------------------------

@query("h1_net_return", """SELECT entry_id, symbol, round(exit_px * (1 - 0.0005) * (1 - 0.004) / (entry_px * (1 + 0.0005) * (1 + 0.004)) - 1, 8) AS taker,
    round(exit_px * (1 - 0.0025) / (entry_px * (1 + 0.0025)) - 1, 8) AS maker FROM holdings""", "holdings")
def h1(x: Inputs):
    c, yes = K.Costs(), F.lit(True)
    return x.holdings().select("entry_id", "symbol", F.round(c.net_return("entry_px", "exit_px"), 8).alias("taker"), F.round(c.net_return("entry_px", "exit_px", yes, yes), 8).alias("maker"))


@query("h2_fill_model", """SELECT event_id, round(fill, 6) AS fill_price, round(mid * 3 * CASE WHEN maker THEN 25 ELSE 40 END / 1e4, 6) AS fee, round(spread, 4) AS spread_bps FROM (SELECT *, greatest(mid + sgn * (mid * spread / 2 / 1e4 + CASE WHEN maker THEN 0 ELSE mid * 10 / 1e4 END), 1e-12) AS fill FROM (
    SELECT event_id, (bid + ask) / 2 AS mid, (ask - bid) / ((bid + ask) / 2) * 1e4 AS spread, event_id % 2 = 0 AS maker, CASE WHEN event_id % 4 < 2 THEN 1 ELSE -1 END * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END AS sgn FROM quotes))""", "quotes")
def h2(x: Inputs):
    e = F.col("event_id")
    f = K.simulated_fill(F.when(e % 4 < 2, "buy").otherwise("sell"), F.col("bid"), F.lit(3.0), "bid", "ask", e % 2 == 0)
    return x.quotes().select("event_id", f.alias("f")).select("event_id", *rounded(fill_price=("f.fill_price", 6), fee=("f.fee", 6), spread_bps=("f.spread_bps", 4)))


@query("h3_one_way_cost", "SELECT event_id, round(value * 0.0025, 8) AS cost FROM events")
def h3(x: Inputs):
    return x.table("events").select("event_id", F.round(F.col("value") * K.one_way_fraction(), 8).alias("cost"))


@query("h4_levels", """SELECT symbol, t, round(close * 0.999, 6) AS limit_price, round(close * 0.97, 6) AS stop, round(close * 1.25, 6) AS target, round(close - least(greatest(atr * 1.5, close * 0.02), close * 0.12), 6) AS atr_stop,
    CASE WHEN atr > 0 THEN 'atr' ELSE 'pct' END AS source FROM (SELECT symbol, t, close, atr FROM feat_60) WHERE atr > 0""", "feat_60")
def h4(x: Inputs):
    from tapeworks.operators.features import add_smooth
    f = add_smooth(x.indexed(60)).where("atr > 0")
    stop, target = K.bracket(F.lit("buy"), "close", 0.03, 0.25)
    a, src = K.atr_stop(F.lit("buy"), "close", "atr")
    return f.select("symbol", "t", *rounded(limit_price=(K.limit_entry(F.lit("buy"), "close"), 6), stop=(stop, 6), target=(target, 6), atr_stop=(a, 6)), src.alias("source"))


@query("h6_risk_quantity", "SELECT id, CASE WHEN pnl = 0 THEN 0.0 ELSE floor(notional * 0.01 / abs(pnl) * 1e6) / 1e6 END AS qty FROM closed_trades", "closed_trades")
def h6(x: Inputs):
    """Quantity that loses one percent of the notional between a stop and an entry one pnl apart."""
    stop = F.lit(0.0)
    return x.closed_trades().select("id", K.risk_quantity("notional", 0.01, F.abs("pnl"), stop).alias("qty"))


@query("h7_kelly", """SELECT sleeve, symbol, round(CASE WHEN l <= 0 OR p <= 0 OR p >= 1 THEN 0 ELSE least(0.25, greatest(0, (w / l * p - (1 - p)) / (w / l)) * 0.25) END, 8) AS kelly FROM (
    SELECT sleeve, symbol, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS p, avg(pnl) FILTER (pnl > 0) AS w, -avg(pnl) FILTER (pnl < 0) AS l FROM closed_trades GROUP BY 1, 2)""", "closed_trades")
def h7(x: Inputs):
    """Kelly share of every sleeve and symbol from its own record."""
    g = x.closed_trades().groupBy("sleeve", "symbol").agg(F.avg((F.col("pnl") > 0).cast("double")).alias("p"), F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("w"),
                                                          (-F.avg(F.when(F.col("pnl") < 0, F.col("pnl")))).alias("l"))
    return g.select("sleeve", "symbol", F.round(K.kelly("p", "w", "l"), 8).alias("kelly"))


@query("h8_futures", """SELECT id, round(notional * CASE WHEN id % 2 = 0 THEN 0.0002 ELSE 0.0005 END, 8) AS fee, lev, round(100 * (1 + 1 / lev - least(0.01, 1 / lev - 1e-9)), 6) AS liq_short, round(100 * (1 - 1 / lev + least(0.01, 1 / lev - 1e-9)), 6) AS liq_long, round(net_bps * 1e-6 * notional * 3, 8) AS funding_short
    FROM (SELECT *, least(2.0, greatest(1.0, id % 40 / 10.0)) AS lev FROM closed_trades)""", "closed_trades")
def h8(x: Inputs):
    lev, e = K.clamp_leverage((F.col("id") % 40) / 10.0), F.lit(100.0)
    return x.closed_trades().select("id", F.round(K.futures_fee(F.col("notional"), F.col("id") % 2 == 0), 8).alias("fee"), lev.alias("lev"), F.round(K.liquidation_price(e, F.lit("short"), lev), 6).alias("liq_short"),
                                    F.round(K.liquidation_price(e, F.lit("long"), lev), 6).alias("liq_long"), F.round(K.funding_cash(F.lit("short"), F.col("notional"), F.col("net_bps") * 1e-6, F.lit(3)), 8).alias("funding_short"))


@query("h9_margin_cost", """SELECT id, floor((id % 100) / 4.0) AS blocks, round(notional * r, 8) AS opening, round(notional * r * floor((id % 100) / 4.0), 8) AS rollover FROM (SELECT *, CASE symbol WHEN 'S0' THEN 0.0002 ELSE 0.0004 END AS r FROM closed_trades)""", "closed_trades")
def h9(x: Inputs):
    """Borrow cost of margin positions: opening fee once, then one fee per whole four hours."""
    name = {"S0": "BTC", "S1": "ETH", "S2": "SOL"}
    rates = [(s, *K.MARGIN_RATES.get(a, K.MARGIN_DEFAULT)) for s, a in name.items()]
    r = x.spark.createDataFrame(rates, "symbol string, open_rate double, roll_rate double")
    blocks = F.floor((F.col("id") % 100) / K.ROLLOVER_HOURS)
    return x.closed_trades().join(F.broadcast(r), "symbol").select("id", blocks.alias("blocks"), F.round(F.col("notional") * F.col("open_rate"), 8).alias("opening"), F.round(F.col("notional") * F.col("roll_rate") * blocks, 8).alias("rollover"))


@query("h10_spread_bps", "SELECT event_id, round((ask - bid) / ((bid + ask) / 2) * 1e4, 6) AS spread_bps FROM quotes", "quotes")
def h10(x: Inputs):
    return x.quotes().select("event_id", F.round(K.spread_bps("bid", "ask"), 6).alias("spread_bps"))


@query("h11_slippage", "SELECT entry_id, symbol, round((exit_px / entry_px - 1) * 1e4, 4) AS entry_slip, round((1 - exit_px / entry_px) * 1e4, 4) AS exit_slip, round(entry_px * 0.004 + exit_px * 0.004, 6) AS fees FROM holdings", "holdings")
def h11(x: Inputs):
    return x.holdings().select("entry_id", "symbol", F.round(K.slippage_bps(F.lit("buy"), "entry_px", "exit_px"), 4).alias("entry_slip"), F.round(K.slippage_bps(F.lit("sell"), "entry_px", "exit_px"), 4).alias("exit_slip"),
                               F.round(F.col("entry_px") * 0.004 + F.col("exit_px") * 0.004, 6).alias("fees"))


@query("h12_position_value", "SELECT entry_id, symbol, round(exit_px * 2, 6) AS value, round(entry_px * 2 + 0.1, 6) AS cost_basis, round(exit_px * 2 - entry_px * 2 - 0.1, 6) AS unrealized FROM holdings", "holdings")
def h12(x: Inputs):
    q, fee = 2.0, 0.1
    value, cost = F.col("exit_px") * q, F.col("entry_px") * q + fee
    return x.holdings().select("entry_id", "symbol", F.round(value, 6).alias("value"), F.round(cost, 6).alias("cost_basis"), F.round(value - cost, 6).alias("unrealized"))


@query("h14_time_texts", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch_us(ts) // 900000000 * 900 AS bar15, epoch_us(ts) // 86400000000 * 86400 AS day_start FROM events""")
def h14(x: Inputs):
    us = epoch_us("ts")
    return x.table("events").select("event_id", day_text(us).alias("day"), iso_text(us / 1_000_000).alias("iso"), bar_open(us, 900).alias("bar15"), bar_open(us, 86_400).alias("day_start"))


@query("h18_intent_key", """SELECT event_id, k AS key, CAST('0x' || substr(sha256(k), 1, 8) AS BIGINT) % 2147483646 + 1 AS userref FROM (SELECT event_id, substr(sha256('regime|' || symbol || '|buy|' || printf('%.2f', price) || '|' || (us // 3600000000 * 3600)), 1, 32) AS k FROM ticks)""", "ticks")
def h18(x: Inputs):
    k = H.intent_key(F.lit("regime"), F.col("symbol"), F.lit("buy"), F.col("price"), bar_open(epoch_us("ts"), 3600).cast("string"))
    return x.ticks().select("event_id", k.alias("key"), H.reference_number(k).alias("userref"))


def audit_log(x: Inputs, tamper: bool):
    """A hash chain whose previous text is the previous event's text; some rows changed afterwards."""
    e = x.table("events")
    own = F.concat_ws("|", "event_id", "event_type")
    p = e.select((F.col("event_id") + 1).alias("event_id"), own.alias("prev_text"))
    log = e.select("event_id", own.alias("own")).join(p, "event_id", "left")
    log = log.withColumn("material", F.concat_ws("|", F.coalesce("prev_text", F.lit("")), "own"))
    hashed = log.withColumn("entry_hash", F.sha2("material", 256))
    before = hashed.select((F.col("event_id") + 1).alias("event_id"), F.col("entry_hash").alias("previous_hash"))
    out = hashed.join(before, "event_id", "left").withColumn("previous_hash", F.coalesce("previous_hash", F.lit("0" * 64)))
    if tamper:
        out = out.withColumn("material", F.when((F.col("event_id") % 211 == 0) & (F.col("event_id") > 0), F.concat("material", F.lit("!"))).otherwise(F.col("material")))
        out = out.withColumn("previous_hash", F.when(F.col("event_id") % 499 == 498, F.lit("f" * 64)).otherwise(F.col("previous_hash")))
    return out.select(F.col("event_id").alias("seq"), "previous_hash", "material", "entry_hash")


@query("h19_audit_chain", "SELECT event_id AS seq, CASE WHEN event_id % 499 = 498 THEN 'chain_break' ELSE 'tampered' END AS fault FROM events WHERE event_id % 499 = 498 OR (event_id % 211 = 0 AND event_id > 0)")
def h19(x: Inputs):
    return H.chain_faults(audit_log(x, True))


@query("h19_verify_chain", "SELECT true AS intact, 0 AS faults, CAST(NULL AS BIGINT) AS first_bad, CAST(NULL AS VARCHAR) AS first_fault")
def h19b(x: Inputs):
    return H.verify_chain(audit_log(x, False))
