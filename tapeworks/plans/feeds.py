"""Queries on payloads, logs, nested stores and text."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks import schemas
from tapeworks.functions import text as X
from tapeworks.functions.core import epoch_us, iso_text, rounded
from tapeworks.plans.inputs import NOW, Inputs
from tapeworks.plans.market_data import new_folder
from tapeworks.plans.registry import query
from tapeworks.sources import payloads as P

PLAIN = {f"S{n}": f"S{n}" for n in range(3)}


@query("a10_parse_ohlc", f"""SELECT symbol, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars_60 WHERE t + 3600 <= {NOW} - 1800 AND i % 40 <> 0""", "bars_60")
def a10(x: Inputs):
    """Array payloads with repeated rows, zero closes and bars that still form."""
    b = x.indexed(60)
    row = F.array(*[c.cast("string") for c in (F.col("t"), F.col("open"), F.col("high"), F.col("low"), F.when(F.col("i") % 40 == 0, 0.0).otherwise(F.col("close")), F.col("vwap"), F.col("volume"), F.col("trades"))])
    payload = b.groupBy("symbol", F.expr("t div 86400").alias("day")).agg(F.collect_list(row).alias("rows"))
    text = payload.select("symbol", F.to_json(F.concat("rows", F.slice("rows", 1, 2))).alias("value"))
    out = P.parse_ohlc(text, 60, NOW - 1_800)
    return out.select("symbol", "t", *rounded(**{c: (c, 6) for c in ("open", "high", "low", "close", "volume")}))


@query("a12_json_log", """SELECT 'good' AS kind, count(*) AS n, sum(score) AS score FROM decisions UNION ALL SELECT 'bad', count(*) FILTER (event_id % 100 = 0), 0 FROM decisions""", "decisions")
def a12(x: Inputs):
    """Decisions appended as JSON lines with torn lines between, then read back."""
    path = new_folder(x, "decisions-log")
    d = x.decisions()
    P.append_json_log(d.select("symbol", "signal", "risk"), path)
    d.where("event_id % 100 = 0").select(F.lit('{"symbol": "S0", "signal": {"act').alias("value")).write.mode("append").text(path)
    good, bad = P.read_json_log(x.spark, path, schemas.DECISION)
    a = good.agg(F.lit("good").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("signal.score").alias("score"))
    return a.unionByName(bad.agg(F.lit("bad").alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("score")))


def feed_lines(x: Inputs):
    """Exchange messages: one trade message per tick and one ticker message per quote."""
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    item = F.struct("symbol", F.when(F.col("side") == "b", "buy").otherwise("sell").alias("side"), F.col("price").cast("string").alias("price"), F.col("qty").cast("string").alias("qty"),
                    F.when(F.col("ord_type") == "m", "market").otherwise("limit").alias("ord_type"), F.col("trade_id").cast("string").alias("trade_id"), iso.alias("timestamp"))
    trades = x.ticks().select(F.to_json(F.struct(F.lit("trade").alias("channel"), F.array(item).alias("data"))).alias("value"))
    q = F.struct("symbol", (epoch_us("ts") / 1e6).cast("string").alias("timestamp"), F.col("bid").cast("string").alias("bid"), F.col("ask").cast("string").alias("ask"))
    tickers = x.quotes().select(F.to_json(F.struct(F.lit("ticker").alias("channel"), F.array(q).alias("data"))).alias("value"))
    return trades.unionByName(tickers)


@query("a13_parse_feed", "SELECT symbol, trade_id, us, price, qty, side, ord_type FROM ticks", "ticks")
def a13(x: Inputs):
    return P.feed_trades(P.parse_feed(feed_lines(x), aliases=PLAIN))


@query("a13_parse_quotes", "SELECT symbol, bid, ask FROM quotes", "quotes")
def a13q(x: Inputs):
    return P.feed_quotes(P.parse_feed(feed_lines(x), aliases=PLAIN)).select("symbol", "bid", "ask")


@query("a14_trade_pages", "SELECT symbol, trade_id, us, price, qty, side, ord_type FROM ticks", "ticks")
def a14(x: Inputs):
    """Pages of up to a thousand trade rows, each with one short row."""
    sec = F.format_string("%d.%06d", F.floor(epoch_us("ts") / 1_000_000).cast("long"), F.pmod(epoch_us("ts"), F.lit(1_000_000)))
    row = F.array(F.col("price").cast("string"), F.col("qty").cast("string"), sec, F.when(F.col("side") == "b", "buy").otherwise("sell"), F.when(F.col("ord_type") == "m", "market").otherwise("limit"), F.lit(""), F.col("trade_id").cast("string"))
    pages = x.ticks().groupBy("symbol", F.floor(F.col("trade_id") / 1000).alias("page")).agg(F.collect_list(row).alias("rows"))
    return P.parse_trade_pages(pages.select("symbol", F.to_json(F.array_append("rows", F.array(F.lit("1"), F.lit("2")))).alias("value")))


VERSION = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query("a15_latest_executions", f"""SELECT l_orderkey, l_quantity, l_extendedprice, l_linestatus FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rk FROM lineitem) WHERE rk = 1""")
def a15(x: Inputs):
    li = x.table("lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    out = P.latest_executions(li, "l_orderkey", F.struct(*[c.strip() for c in VERSION.split(",")]))
    return out.select("l_orderkey", "l_quantity", "l_extendedprice", "l_linestatus")


@query("a15_recent", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC LIMIT 100")
def a15b(x: Inputs):
    li = x.table("lineitem").where("l_quantity > 0 and l_extendedprice > 0")
    return li.orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_quantity")).limit(100).select("l_orderkey", "l_linenumber", "l_quantity")


@query("a16_learner_store", "SELECT symbol, ts, round(pnl, 8) AS pnl, CASE WHEN id % 3 = 0 THEN 'stored' ELSE sleeve END AS sleeve, regime FROM closed_trades WHERE id % 10 <> 0", "closed_trades")
def a16(x: Inputs):
    """Nested stores of at most 200 trades, some with a pnl that is not a number, some without a strategy."""
    pnl = F.when(F.col("id") % 10 == 0, "NaN").otherwise(F.col("pnl").cast("string"))
    h = F.struct(pnl.alias("pnl"), "net_bps", "regime", F.col("ts").cast("double").alias("ts"), F.when(F.col("id") % 3 != 0, F.col("sleeve")).alias("strategy"))
    per = x.closed_trades().groupBy("symbol", F.floor(F.col("id") / 200).alias("chunk")).agg(F.collect_list(h).alias("history"))
    store = F.struct(F.lit("stored").alias("strategy_key"), F.create_map(F.col("symbol"), F.struct("history")).alias("coins"))
    return P.learner_trades(per.select(F.to_json(store).alias("value"))).select("symbol", F.col("ts").cast("bigint").alias("ts"), F.round("pnl", 8).alias("pnl"), "sleeve", "regime")


@query("a17_funding_rates", "SELECT event_id, epoch_us(ts) // 1000000 AS t, round(CASE WHEN event_id % 2 = 0 THEN value * 1e-4 ELSE 0.001 END, 9) AS rate FROM events WHERE event_id % 2 = 0 OR event_id % 5 <> 0")
def a17(x: Inputs):
    """Times in milliseconds, seconds and ISO text; a missing relative rate is the absolute one over the mark."""
    e, sec = F.col("event_id"), F.floor(epoch_us("ts") / 1_000_000).cast("long")
    raw = x.table("events").select("event_id", F.when(e % 3 == 0, (sec * 1000).cast("string")).when(e % 3 == 1, sec.cast("string")).alias("timestamp"), F.when(e % 3 == 2, iso_text(sec)).alias("time"),
                                   F.when(e % 2 == 0, (F.col("value") * 1e-4).cast("string")).alias("relative_rate"), ((F.col("value") + 1) * 0.001).cast("string").alias("absolute_rate"),
                                   F.when(e % 5 != 0, (F.col("value") + 1).cast("string")).otherwise("0").alias("mark"))
    return P.funding_rates(raw).select("event_id", "t", F.round("rate", 9).alias("rate"))


@query("a18_priors", """SELECT sleeve || '@60m' AS strategy, symbol AS key, CAST(count(*) AS INT) AS n, round(avg(net_bps), 6) AS bps FROM closed_trades GROUP BY 1, 2
    UNION ALL SELECT sleeve || '@60m', symbol || '|' || regime, CAST(count(*) AS INT), round(avg(net_bps), 6) FROM closed_trades WHERE regime <> 'chop' GROUP BY sleeve, symbol, regime""", "closed_trades")
def a18(x: Inputs):
    """Study results as JSON per sleeve and symbol, read as the priors of every strategy; empty regimes do not count."""
    t = x.closed_trades()
    n = F.when(F.col("regime") == "chop", 0).otherwise(F.count(F.lit(1))).cast("int")
    reg = t.groupBy("sleeve", "symbol", "regime").agg(n.alias("trades"), F.avg("net_bps").alias("avg_net_bps"))
    reg = reg.groupBy("sleeve", "symbol").agg(F.map_from_entries(F.collect_list(F.struct("regime", F.struct("trades", "avg_net_bps")))).alias("oos_by_regime"))
    tot = t.groupBy("sleeve", "symbol").agg(F.count(F.lit(1)).cast("int").alias("trades"), F.avg("net_bps").alias("avg_net_bps"))
    doc = tot.join(reg, ["sleeve", "symbol"]).select(F.to_json(F.struct(F.col("sleeve").alias("family"), F.lit(60).alias("tf"), F.lower("symbol").alias("symbol"), F.struct("trades", "avg_net_bps").alias("oos"), "oos_by_regime")).alias("value"))
    return P.priors(doc).select("strategy", "key", "n", F.round("bps", 6).alias("bps"))


@query("a19_log_state", """SELECT max(epoch_us(ts) // 1000000) FILTER (event_type = 'view') AS last_cycle, max(epoch_us(ts) // 1000000) FILTER (event_type = 'error') AS last_start, 'True' AS locked,
    max_by(CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END, event_id) FILTER (event_type = 'error') AS paper, 'True' AS dry_run, 'False' AS allow_live FROM events""")
def a19(x: Inputs):
    kind = F.when(F.col("event_type") == "view", "CYCLE ok").when(F.col("event_type") == "error", F.concat(F.lit("START locked=True paper="), F.when(F.col("event_id") % 2 == 0, "True").otherwise("False"), F.lit(" dry_run=True allow_live=False"))).otherwise("note")
    lines = x.table("events").select(F.concat(iso_text(epoch_us("ts") / 1_000_000), F.lit(" "), kind).alias("value"))
    return P.log_state(lines)


@query("a20_feed_health", f"""SELECT symbol, max(us) / 1e6 AS live_through, {NOW} - max(us) / 1e6 AS age_s, {NOW} - max(us) / 1e6 <= 600 AND max_by(trade_id % 2 = 0, us) AS fresh, CAST(max_by(trade_id % 4, us) AS BIGINT) AS gaps_open FROM ticks GROUP BY 1""", "ticks")
def a20(x: Inputs):
    """Status files written after every tick; health from the newest of each symbol."""
    us = epoch_us("ts")
    st = x.ticks().select(F.to_json(F.struct("symbol", (us / 1e6).alias("live_through"), (F.col("trade_id") % 2 == 0).alias("in_sync"), F.col("trade_id").alias("last_trade_id"), (F.col("trade_id") % 4).alias("gaps_open"))).alias("value"), (us / 1e6).alias("updated_at"))
    rows = st.select(F.from_json("value", schemas.FEED_STATUS).alias("r"), "updated_at").select("r.*", "updated_at")
    return P.feed_health(rows, NOW, 600).select("symbol", "live_through", "age_s", "fresh", "gaps_open")


@query("a21_futures_quotes", """SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN value + 2 ELSE value + 1 END, 6) AS mark, round(0.01 / CASE WHEN event_id % 4 = 0 THEN value + 2 ELSE value + 1 END, 9) AS funding_relative, event_id % 3 * 0.01 + 0.01 AS margin FROM events""")
def a21(x: Inputs):
    e = F.col("event_id")
    r = x.table("events").select(e.cast("string").alias("symbol"), (F.col("value") + 2).cast("string").alias("last"), F.when(e % 4 != 0, (F.col("value") + 1).cast("string")).alias("markPrice"), F.lit("1").alias("bid"), F.lit(None).cast("string").alias("ask"),
                                 F.lit("0.01").alias("fundingRate"), F.lit("x").alias("openInterest"))
    m = x.table("events").select(e.cast("string").alias("symbol"), F.array(F.lit("0.5"), (e % 3 * 0.01 + 0.01).cast("string"), F.lit("bad")).alias("levels"))
    both = P.futures_quotes(r).join(P.maintenance_margin(m), "symbol")
    return both.select(F.col("symbol").cast("bigint").alias("event_id"), F.round("mark", 6).alias("mark"), F.round("funding_relative", 9).alias("funding_relative"), "margin")


@query("a23_new_closed_trades", "SELECT id, symbol, ts FROM closed_trades WHERE ts >= 946684800 AND source = 'fill' AND id % 4 <> 0", "closed_trades")
def a23(x: Inputs):
    """Trades after the cursor with a known pnl that an earlier read did not deliver."""
    t = x.closed_trades().withColumn("pnl", F.when(F.col("source") == "fill", F.col("pnl")))
    return P.new_closed_trades(t, t.where("id % 4 = 0"), 946_684_800).select("id", "symbol", "ts")


@query("a23_cursor", "SELECT max(ts) AS cursor FROM closed_trades WHERE source = 'fill'", "closed_trades")
def a23c(x: Inputs):
    t = x.closed_trades().withColumn("pnl", F.when(F.col("source") == "fill", F.col("pnl")))
    return P.next_cursor(t, 946_684_800)


@query("h21_nested_defaults", "SELECT symbol, sum(CASE WHEN event_id % 2 = 0 THEN score ELSE 0 END) AS score, count(*) FILTER (action = 'BUY' AND event_id % 2 = 0) AS buys FROM decisions GROUP BY 1", "decisions")
def h21(x: Inputs):
    """Every second row has no signal at all; reads fall back to their defaults."""
    d = x.decisions().withColumn("signal", F.when(F.col("event_id") % 2 == 0, F.col("signal")))
    return d.groupBy("symbol").agg(F.sum(F.coalesce("signal.score", F.lit(0))).alias("score"), F.count_if(F.coalesce("signal.action", F.lit("WAIT")) == "BUY").alias("buys"))


@query("h22_reason_map", """SELECT sleeve, list_sort(list(reason || '=' || n)) AS reasons FROM (SELECT sleeve, regime AS reason, count(*) AS n FROM closed_trades GROUP BY 1, 2) GROUP BY 1""".replace("list_sort(list(reason || '=' || n))", "array_to_string(list_sort(list(reason || '=' || n)), ',')"), "closed_trades")
def h22(x: Inputs):
    n = x.closed_trades().groupBy("sleeve", "regime").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("sleeve").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("regime", "n")))).alias("m"))
    return m.select("sleeve", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("reasons"))


# ---- text --------------------------------------------------------------------------------

WORDS = {"the": 1.5, "and": -2.0, "that": 0.8, "is": -0.6, "of": 1.2, "le": -1.0, "de": 2.0, "un": 0.7, "la": -1.3, "be": 0.5}
NOTS = ("not", "in", "to", "et")
NAMES = {"A": ("erou", "tion"), "B": ("whou", "leux"), "C": ("zzqx", "ithand"), "D": ("ment",)}
SCORE_SQL = "list_sum(list_transform(list_filter(list_zip(w, list_prepend('', w)), lambda z: list_contains(" + repr(list(WORDS)) + ", z[1])), lambda z: " + repr(list(WORDS.values())) + "[list_position(" + repr(list(WORDS)) + ", z[1])] * CASE WHEN list_contains(" + repr(list(NOTS)) + ", z[2]) THEN -1 ELSE 1 END))"
DOCS_SQL = f"SELECT doc_id, source, text, coalesce({SCORE_SQL}, 0) AS score FROM (SELECT *, regexp_extract_all(lower(text), '[a-z\\.]+') AS w FROM documents)"
HIT_SQL = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{a}')" for a in al) + f" THEN '{n}' END" for n, al in NAMES.items()) + "], lambda v: v IS NOT NULL)"


@query("h20_lexicon_score", f"SELECT doc_id, round(score, 6) AS score FROM ({DOCS_SQL})")
def h20(x: Inputs):
    return x.table("documents").select("doc_id", F.round(X.lexicon_score("text", WORDS, NOTS), 6).alias("score"))


@query("h20_real_lexicon", "SELECT doc_id, round(coalesce(" + SCORE_SQL.replace(repr(list(WORDS)), repr(list(X.LEXICON))).replace(repr(list(WORDS.values())), repr(list(X.LEXICON.values()))).replace(repr(list(NOTS)), "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in X.NEGATIONS) + "]") + ", 0), 6) AS score FROM (SELECT *, regexp_extract_all(lower(text), '[a-z\\.]+') AS w FROM documents)")
def h20r(x: Inputs):
    """The market lexicon over all documents."""
    return x.table("documents").select("doc_id", F.round(X.lexicon_score("text"), 6).alias("score"))


@query("c16_mentions", f"SELECT doc_id, unnest(CASE WHEN len(m) = 0 THEN ['A'] ELSE m END) AS entity FROM (SELECT doc_id, {HIT_SQL} AS m FROM documents)")
def c16(x: Inputs):
    return x.table("documents").select("doc_id", F.explode(X.mentions("text", NAMES, "A")).alias("entity"))


@query("d28_sentiment", f"""SELECT entity, n, sources, round(avg_score, 6) AS avg_score, score, score <= -0.15 AS blocks_buy, score <= -0.55 AS triggers_exit FROM (SELECT *, round(avg_score / (abs(avg_score) + 2), 3) AS score FROM (
    SELECT entity, count(*) AS n, count(DISTINCT source) AS sources, avg(score) AS avg_score FROM (SELECT source, score, unnest(CASE WHEN len(m) = 0 THEN ['A'] ELSE m END) AS entity FROM (SELECT *, {HIT_SQL} AS m FROM ({DOCS_SQL}))) GROUP BY 1))""")
def d28(x: Inputs):
    s = X.sentiment(x.table("documents"), WORDS, NOTS, NAMES, "A")
    return s.select("entity", "n", "sources", F.round("avg_score", 6).alias("avg_score"), "score", "blocks_buy", "triggers_exit")


PLAIN_HTML = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _name, _sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
    PLAIN_HTML = f"replace({PLAIN_HTML}, '{_name}', '{_sign}')"


@query("h15_clean_text", f"SELECT page_id, trim(regexp_replace(regexp_replace({PLAIN_HTML}, '&amp;?', '&', 'g'), '[\\s\\x1c-\\x1f]+', ' ', 'g'), ' ') AS text FROM pages")
def h15(x: Inputs):
    """Pages without tags and entities; the SQL knows the entities that these pages use, the tests all of them."""
    return x.table("pages").select("page_id", X.clean("html").alias("text"))


@query("h16_item_text", "SELECT conv_id, turn, trim(regexp_replace(role || ' ' || regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations")
def h16(x: Inputs):
    """Feed items with a title and a description, built from the conversations."""
    body = F.regexp_replace("text", "[^A-Za-z0-9]+", " ")
    xml = F.concat(F.lit("<item><title>"), F.col("role"), F.lit("</title><description>"), body, F.lit("</description></item>"))
    return x.table("conversations").select("conv_id", "turn", X.item_text(xml).alias("text"))
