"""Explicit schemas of every input; nothing is inferred."""

TICK = "symbol string, trade_id bigint, ts timestamp_ntz, price double, qty double, side string, ord_type string"
QUOTE = "symbol string, ts timestamp_ntz, bid double, ask double"
BAR_FLOW = ("volume", "trades", "buy_vol", "sell_vol", "buy_count", "sell_count")
BAR = ("open", "high", "low", "close", "vwap", *BAR_FLOW, "ofi", "spread_bps")

FEED_MESSAGE = (
    "channel string, method string, data array<struct<symbol:string, side:string, price:string, qty:string, "
    "ord_type:string, trade_id:string, timestamp:string, bid:string, ask:string>>"
)
FEED_STATUS = (
    "symbol string, live_through double, in_sync boolean, last_trade_id bigint, "
    "last_trade_ts double, gaps_filled bigint, gaps_open bigint"
)
LEARNER_STORE = (
    "strategy_key string, coins map<string, struct<trades:bigint, wins:bigint, pnl:double, "
    "history:array<struct<pnl:string, net_bps:double, regime:string, ts:double, strategy:string>>>>"
)
DECISION = (
    "symbol string, timestamp string, dry_run boolean, order_id string, "
    "risk struct<approved:boolean, reason:string, notional_usd:double, planned_loss_usd:double>, "
    "signal struct<action:string, score:bigint, reason:string, price:double, atr:double, stop_price:double>"
)
STUDY_RESULT = (
    "family string, tf int, symbol string, oos struct<trades:int, avg_net_bps:double>, "
    "oos_by_regime map<string, struct<trades:int, avg_net_bps:double>>"
)
