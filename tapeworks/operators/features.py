"""Technical and order-flow features on bars.  No value looks past its own bar.

Input frames carry ``symbol, tf, t, i`` (dense bar number per series) and OHLCV.
Recurrences run as blocked linear scans, trailing frames as windows over blocks
with a halo, running state as blocked running aggregates, so a long series is
spread over many tasks.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.core import known, ratio
from tapeworks.operators.scan import linear_scan, ordinals, running, with_halo
from tapeworks.session import pin

SERIES = ("symbol", "tf")
SCAN_ROWS = 1024
FRAME_ROWS = 2048
SPANS = (20, 50, 80, 100, 200)
RANK_BARS, RANK_MIN = 200, 50
VOL_BARS, OFI_BARS = 20, 50
LOOKBACKS = (20, 55)
CHANDELIER_BARS = 22


def index_bars(bars: DataFrame, keys: Sequence[str] = SERIES, rows: int = 4096) -> DataFrame:
    """Add the dense bar number ``i``; blocks are stretches of the time grid."""
    b = bars.withColumn("_blk", F.floor(F.col("t") / (F.col("tf") * 60 * rows)).cast("long"))
    return ordinals(b, list(keys), "_blk", ["t"]).drop("_blk")


def previous_bar(bars: DataFrame, keys: Sequence[str] = SERIES, rows: int = SCAN_ROWS) -> DataFrame:
    """``prev_close, prev_high, prev_low`` and the scan block ``sblk = i div rows``."""
    h = with_halo(bars, "i", 1, rows, block="sblk")
    w = Window.partitionBy(*keys, "sblk").orderBy("i")
    lags = {f"prev_{c}": F.lag(c).over(w) for c in ("close", "high", "low")}
    return h.withColumns(lags).where("home").drop("home")


def true_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")),
                      F.abs(F.col("low") - F.col("prev_close")))


def seeded(x: Column, alpha: float, first: int = 0) -> tuple[Column, float]:
    """Exponential average whose seed is the value in row ``first``."""
    i = F.col("i")
    c = F.when(i < first, 0.0).when(i == first, x).otherwise(x * alpha)
    return F.coalesce(c, F.lit(0.0)), 1 - alpha


def wilder(x: Column, n: int) -> tuple[Column, float]:
    """Wilder average seeded with the mean of the first ``n`` rows (valid from row n-1)."""
    d, i = 1 - 1 / n, F.col("i")
    c = F.when(i < n, x / n * F.pow(F.lit(d), i - (n - 1))).otherwise(x / n)
    return F.coalesce(c, F.lit(0.0)), d


def add_smooth(bars: DataFrame, keys: Sequence[str] = SERIES, spans: Sequence[int] = SPANS, rsi_n: int = 14,
               atr_n: int = 14, adx_n: int = 14, rows: int = SCAN_ROWS) -> DataFrame:
    """EMAs, RSI, ATR and the smoothed ranges that ADX needs, in one scan."""
    b = previous_bar(bars, keys, rows)
    step = F.col("close") - F.col("prev_close")
    up_move, down_move = F.col("high") - F.col("prev_high"), F.col("prev_low") - F.col("low")
    plus = F.when((up_move > down_move) & (up_move > 0), up_move).otherwise(0.0)
    minus = F.when((down_move > up_move) & (down_move > 0), down_move).otherwise(0.0)
    terms = {f"ema{n}": seeded(F.col("close"), 2 / (n + 1)) for n in spans}
    terms |= {"_up": seeded(F.greatest(step, F.lit(0.0)), 1 / rsi_n, 1),
              "_dn": seeded(F.greatest(-step, F.lit(0.0)), 1 / rsi_n, 1),
              "atr": seeded(true_range(), 1 / atr_n), "_wtr": wilder(true_range(), adx_n),
              "_wpd": wilder(plus, adx_n), "_wmd": wilder(minus, adx_n)}
    out = linear_scan(b, list(keys), "i", "sblk", terms, rows)
    rs = ratio("_up", F.when(F.col("_dn") != 0, F.col("_dn")))
    rsi = F.when(F.col("i") < 1, 50.0).otherwise(F.coalesce(100 - 100 / (1 + rs), F.lit(50.0)))
    return out.withColumns({"rsi": rsi, "atr_pct": ratio("atr", "close")}).drop("_up", "_dn")


def add_adx(frame: DataFrame, keys: Sequence[str] = SERIES, n: int = 14, rows: int = SCAN_ROWS) -> DataFrame:
    """ADX.  Rows before the ranges exist count as DX 0 and enter the seed."""
    pdi, mdi = 100 * ratio("_wpd", "_wtr"), 100 * ratio("_wmd", "_wtr")
    dx = F.when(F.col("i") < n - 1, 0.0).otherwise(F.coalesce(100 * ratio(F.abs(pdi - mdi), pdi + mdi), F.lit(0.0)))
    out = linear_scan(frame, list(keys), "i", "sblk", {"_adx": wilder(dx, n)}, rows)
    return out.withColumn("adx", F.when(F.col("i") >= n - 1, F.col("_adx"))).drop("_adx", "_wtr", "_wpd", "_wmd")


def hysteresis_mark(value: str | Column, enter: float, leave: float) -> Column:
    """True above ``enter``, false below ``leave``, NULL (keep the state) between."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v > enter, True).when(v < leave, False)


def add_state(frame: DataFrame, keys: Sequence[str] = SERIES, enters: Sequence[float] = (25.0, 30.0),
              leave: float = 20.0) -> DataFrame:
    """ADX on/off state per entry level and the cumulative volume delta."""
    net = F.col("buy_vol") - F.col("sell_vol")
    specs = {f"adx_on{int(e)}": ("last", hysteresis_mark("adx", e, leave)) for e in enters}
    specs["cvd"] = ("sum", F.coalesce(net, F.lit(0.0)))
    out = running(frame, list(keys), "sblk", ["i"], specs)
    known_on = {f"adx_on{int(e)}": F.coalesce(f"adx_on{int(e)}", F.lit(False)) for e in enters}
    return out.withColumns({**known_on, "cvd": F.when(net.isNotNull(), F.col("cvd"))})


def frame_window(keys: Sequence[str] = SERIES) -> Callable[[int, int], Window]:
    base = Window.partitionBy(*keys, "hblk").orderBy("i")
    return lambda back, stop=0: base.rowsBetween(-back, stop)


def full(w, n: int, value: Column, counted: Column) -> Column:
    """``value`` only where the frame holds ``n`` known inputs."""
    return F.when(F.count(counted).over(w) >= n, value)


def zscore(c: str, w, min_rows: int) -> Column:
    x = F.col(c)
    return full(w, min_rows, ratio(x - F.avg(x).over(w), F.when(F.stddev_pop(x).over(w) != 0, F.stddev_pop(x).over(w))), x)


def pct_rank(c: str, w, min_rows: int) -> Column:
    """Rank of the value in its frame, ties averaged, as a fraction of the frame."""
    seen = F.collect_list(c).over(w)
    less = F.size(F.filter(seen, lambda v: v < F.col(c)))
    same = F.size(F.filter(seen, lambda v: v == F.col(c)))
    return F.when((F.size(seen) >= min_rows) & F.col(c).isNotNull(), (less + (same + 1) / 2) / F.size(seen))


def add_trailing(frame: DataFrame, keys: Sequence[str] = SERIES, lookbacks: Sequence[int] = LOOKBACKS,
                 rows: int = FRAME_ROWS) -> DataFrame:
    """Trailing-frame features: volatility rank, z-scores, 3-bar flow, prior highs and volumes."""
    h = with_halo(frame, "i", RANK_BARS, rows)
    w = frame_window(keys)
    buy, sell = F.col("buy_vol"), F.col("sell_vol")
    h = h.withColumn("ofi", ratio(buy - sell, buy + sell))
    cols = {"atr_rank": pct_rank("atr_pct", w(RANK_BARS - 1), RANK_MIN),
            "vol_z": zscore("volume", w(VOL_BARS - 1), VOL_BARS // 2),
            "ofi_z": zscore("ofi", w(OFI_BARS - 1), OFI_BARS // 2),
            "flow3": full(w(2), 3, ratio(F.sum(buy - sell).over(w(2)), F.sum(buy + sell).over(w(2))), buy - sell),
            "prev_ofi": F.lag("ofi").over(Window.partitionBy(*keys, "hblk").orderBy("i")),
            "hh22": F.max("high").over(w(CHANDELIER_BARS - 1))}
    for n in lookbacks:
        cols[f"prior_high{n}"] = full(w(n, -1), n, F.max("high").over(w(n, -1)), F.col("high"))
        cols[f"prior_vol{n}"] = full(w(n, -1), n, F.avg("volume").over(w(n, -1)), F.col("volume"))
    return h.withColumns(cols).where("home").drop("home", "hblk")


def add_technicals(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """The whole feature frame.  The scan result is kept as files: ADX and state read it twice."""
    smooth = pin(add_smooth(bars, keys))
    return add_trailing(add_state(add_adx(smooth, keys), keys), keys).drop("sblk")


# ---- order-flow entry filters ------------------------------------------------------------

FLOW_FILTERS: dict[str, Callable[[], Column]] = {
    "ofi_pos": lambda: F.col("ofi") > 0,
    "ofi_z_pos": lambda: F.col("ofi_z") > 0,
    "flow3_pos": lambda: F.col("flow3") > 0,
    "ofi_rising": lambda: F.col("ofi") > F.col("prev_ofi"),
}


def register_filter(name: str, build: Callable[[], Column]) -> None:
    FLOW_FILTERS[name] = build


def flow_filter(name: str | None) -> Column:
    """Mask of a named filter; unknown data never passes, an unknown name is an error."""
    if not name:
        return F.lit(True)
    if name not in FLOW_FILTERS:
        raise ValueError(f"unknown flow filter {name!r}; known: {sorted(FLOW_FILTERS)}")
    return known(FLOW_FILTERS[name]())


# ---- daily risk-on filter ----------------------------------------------------------------

SMA_DAYS, RISE_DAYS, DAY = 50, 5, 86_400


def riskon_table(daily: DataFrame, now_s: int) -> DataFrame:
    """Closed days with SMA50, its value five days earlier and the risk-on flag.

    One row per symbol and day, so a window over a symbol holds one row per
    calendar day and stays small however many trades the day had.
    """
    w = Window.partitionBy("symbol").orderBy("t")
    frame = w.rowsBetween(-(SMA_DAYS - 1), 0)
    d = (daily.where((F.col("t") + DAY <= now_s) & F.col("close").isNotNull()).select("symbol", "t", "close")
         .dropDuplicates(["symbol", "t"]))
    d = d.withColumn("sma50", F.when(F.count("close").over(frame) == SMA_DAYS, F.avg("close").over(frame)))
    d = d.withColumn("sma50_prev", F.lag("sma50", RISE_DAYS).over(w))
    on = (F.col("close") > F.col("sma50")) & (F.col("sma50") > F.col("sma50_prev"))
    return d.select("symbol", (F.col("t") + DAY).alias("close_time"), "close", "sma50", "sma50_prev",
                    F.when(F.col("sma50").isNotNull() & F.col("sma50_prev").isNotNull(), on).alias("riskon"))


def attach_daily(bars: DataFrame, table: DataFrame) -> DataFrame:
    """The latest daily row that had closed by each bar's close."""
    from tapeworks.operators.asof import asof_join
    out = asof_join(bars.withColumn("_close_t", F.col("t") + F.col("tf") * 60), table, ["symbol"],
                    "_close_t", "close_time", ["riskon", "sma50"], span=DAY * 64)
    return out.withColumnsRenamed({"riskon": "d1_riskon", "sma50": "d1_sma50"}).drop("_close_t")


# ---- blended realised volatility ---------------------------------------------------------

VOL_WINDOWS, VOL_WEIGHTS, VOL_FLOOR, YEAR = (10, 30), (0.4, 0.6), 0.05, 365


def realized_vol(frame: DataFrame, ret: str = "ret", keys: Sequence[str] = SERIES, rows: int = FRAME_ROWS) -> DataFrame:
    """Annualised volatility over two windows, blended; a window counts once it is full."""
    h = with_halo(frame, "i", max(VOL_WINDOWS), rows)
    w = frame_window(keys)
    num, den = F.lit(0.0), F.lit(0.0)
    for n, weight in zip(VOL_WINDOWS, VOL_WEIGHTS):
        vol = F.when(F.count(ret).over(w(n - 1)) >= n, F.stddev_samp(ret).over(w(n - 1)) * YEAR ** 0.5)
        num, den = num + F.coalesce(vol * weight, F.lit(0.0)), den + F.when(vol.isNotNull(), weight).otherwise(0.0)
    vol = F.greatest(F.coalesce(ratio(num, F.when(den > 0, den)), F.lit(VOL_FLOOR)), F.lit(VOL_FLOOR))
    return h.withColumn("vol", vol).where("home").drop("home", "hblk")


def latest_rows(frame: DataFrame, keys: Sequence[str] = SERIES, at: str = "t") -> DataFrame:
    """The newest row of every series."""
    return frame.groupBy(*keys).agg(F.max_by(F.struct(*frame.columns), at).alias("r")).select("r.*")


def regime_label(on: str = "adx_on25", min_bars: int = 0) -> Column:
    """trend, or chop split by the volatility rank; unknown while the series is short."""
    label = F.when(F.col(on), "trend").when(F.col("atr_rank") >= 0.7, "volatile_chop").otherwise("chop")
    return F.when(F.col("i") < min_bars - 1, "unknown").otherwise(label) if min_bars else label


def simple_rsi(frame: DataFrame, n: int = 14, keys: Sequence[str] = SERIES, rows: int = FRAME_ROWS) -> DataFrame:
    """RSI from plain rolling means; a zero loss counts as 1."""
    h = with_halo(frame, "i", n, rows)
    w = frame_window(keys)(n - 1)
    step = F.col("close") - F.col("prev_close")
    gain = F.avg(F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0))).over(w)
    loss = F.avg(F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0))).over(w)
    rsi = 100 - 100 / (1 + gain / F.when(loss == 0, 1.0).otherwise(loss))
    return h.withColumn("rsi_simple", F.when(F.col("i") >= n, rsi)).where("home").drop("home", "hblk")


def momentum(frame: DataFrame, lookback: int, keys: Sequence[str] = SERIES, rows: int = FRAME_ROWS) -> DataFrame:
    """Change over the last ``lookback`` closes and volume against its mean, this bar included."""
    h = with_halo(frame, "i", lookback, rows)
    w = frame_window(keys)(lookback - 1)
    mean = F.avg("volume").over(w)
    return h.withColumns({
        "change": F.when(F.col("i") >= 4, ratio("close", F.first("close").over(w)) - 1),
        "volume_ratio": F.when(F.col("i") >= 4, F.when(mean > 0, F.col("volume") / mean).otherwise(1.0)),
    }).where("home").drop("home", "hblk")
