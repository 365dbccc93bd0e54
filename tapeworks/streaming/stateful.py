"""Keyed state machines on trade and position streams.

Each processor keeps a few numbers per key.  ``transformWithStateInPandas``
needs the RocksDB state store; ``use_rocksdb`` sets it for a session.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import fsum
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _rows(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    frames = list(parts)
    return pd.concat(frames).sort_values(order, kind="stable") if frames else pd.DataFrame()


class BenchGate(StatefulProcessor):
    """Verdict after each closed trade of a key: benched for a time when the rolling upper bound is below zero.

    Holds the last ``window`` results and the end of the current bench.
    """
    output = "key string, id bigint, state string, until bigint"

    def __init__(self, window: int = 50, min_sample: int = 30, bench_s: int = 72 * 3600, conf: float = 0.90) -> None:
        self.window, self.min_sample, self.bench_s, self.conf = window, min_sample, bench_s, conf
        self.quantile: dict[int, float] = {}  # by sample size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "bps double")
        self.bench = handle.getValueState("bench", "until bigint")

    def upper(self, xs: list[float]) -> float | None:
        n = len(xs)
        if n < 2:
            return None
        if n not in self.quantile:
            z, df = NormalDist().inv_cdf(self.conf), n - 1
            self.quantile[n] = z + (z ** 3 + z) / 4 / df + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96 / df ** 2 + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384 / df ** 3
        mean = fsum(xs) / n
        return mean + self.quantile[n] * (fsum([(x - mean) ** 2 for x in xs]) / (n - 1) / n) ** 0.5

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        xs = [v[0] for v in self.recent.get()] if self.recent.exists() else []
        until = self.bench.get()[0] if self.bench.exists() else None
        out = []
        for r in _rows(rows, ["ts", "id"]).itertuples():
            xs = (xs + [float(r.net_bps)])[-self.window:]
            ucb = self.upper(xs)
            if (until is None or r.ts >= until) and len(xs) >= self.min_sample and ucb is not None and ucb < 0:
                until = int(r.ts) + self.bench_s
            mean = sum(xs) / len(xs)
            state = "benched" if until is not None and r.ts < until else "negative" if mean < 0 else "weak" if mean < 25 else "ok"
            out.append((key[0], int(r.id), state, until))
        self.recent.put([(v,) for v in xs])
        if until is not None:
            self.bench.update((until,))
        yield pd.DataFrame(out, columns=["key", "id", "state", "until"]).astype({"until": "Int64"})

    def close(self) -> None:
        pass


class EntryGate(BenchGate):
    """Verdict on each entry request from two levels of state: the symbol's closed trades and those of the request's regime.

    Rows are closed trades (``kind`` 'close') and requests ('request') in time order, closes
    first. Per level: the last ``window`` results, the number of closes, and the current bench.
    """
    output = "id bigint, now bigint, allow boolean, size_mult double, state string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "scope string", "bps array<double>, closed bigint, until bigint, at bigint")

    def judge(self, level: list, now: int) -> tuple[bool, float, str]:
        """May start or lift the level's bench."""
        xs, closed, until, at = level
        if until is not None:
            if now < until:
                return False, 0.0, "benched"
            if closed <= at:
                return True, 0.5, "probation"
        upper = self.upper(xs)
        if len(xs) >= self.min_sample and upper is not None and upper < 0:
            level[2:] = now + self.bench_s, closed
            return False, 0.0, "benched"
        level[2:] = None, None
        mean = sum(xs) / len(xs) if xs else None
        return (True, 1.0, "neutral") if mean is None else (True, 0.5, "negative") if mean < 0 else (True, 0.75, "weak") if mean < 25 else (True, 1.0, "ok")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, levels = [], {}

        def of(scope: str) -> list:
            if scope not in levels:
                held = self.levels.getValue((scope,)) if self.levels.containsKey((scope,)) else ([], 0, None, None)
                levels[scope] = [list(held[0]), *held[1:]]
            return levels[scope]

        for r in _rows(rows, ["us", "kind", "id"]).itertuples():
            if r.kind == "close":
                for scope in ("", r.regime)[:1 + (r.regime is not None)]:
                    level = of(scope)
                    level[0], level[1] = (level[0] + [float(r.net_bps)])[-self.window:], level[1] + 1
                continue
            s = g = self.judge(of(""), int(r.us))
            if r.regime is not None:
                g = self.judge(of(r.regime), int(r.us))
            if not g[0] or s[0] and g[1] < s[1]:
                s = s[0] and g[0], min(s[1], g[1]) if s[0] and g[0] else 0.0, g[2]
            out.append((int(r.id), int(r.us), *s))
        for scope, level in levels.items():
            self.levels.updateValue((scope,), tuple(level))
        yield pd.DataFrame(out, columns=["id", "now", "allow", "size_mult", "state"])


class FeedWatch(StatefulProcessor):
    """Heartbeats per feed; a timer reports a feed that has gone quiet."""
    output = "symbol string, status string, last_us bigint"

    def __init__(self, idle_ms: int = 30_000) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(p["us"].max()) for p in rows)
        newest = max(newest, self.last.get()[0]) if self.last.exists() else newest
        self.last.update((newest,))
        self.handle.registerTimer(newest // 1000 + self.idle)
        yield pd.DataFrame([(key[0], "live", newest)], columns=["symbol", "status", "last_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        if expiredTimerInfo.getExpiryTimeInMs() >= last // 1000 + self.idle:
            yield pd.DataFrame([(key[0], "stale", last)], columns=["symbol", "status", "last_us"])

    def close(self) -> None:
        pass


def apply(stream: DataFrame, keys: list[str], processor: StatefulProcessor, mode: str = "append", time_mode: str = "none") -> DataFrame:
    """Run a processor per key."""
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.output, outputMode=mode, timeMode=time_mode)
