"""The text store with torn files, and the snapshot store with late rows and a merge that dies."""
import datetime as dt
import gzip
import os

import pytest
from pyspark.sql import functions as F

from tapeworks.sources import snapshots, store

LINES = [f"{k},170000000{k % 10}.5,{100 + k}.25,1.5,b,m" for k in range(400)]


def test_torn_gzip_members(spark, tmp_path):
    whole, cut, two = (tmp_path / f"symbol=S{k}" / "day=2024-01-01" for k in range(3))
    for d in (whole, cut, two):
        os.makedirs(d)
    text = ("\n".join(LINES) + "\n").encode()
    (whole / "a.csv.gz").write_bytes(gzip.compress(text))
    (cut / "a.csv.gz").write_bytes(gzip.compress(text)[:-700])
    (two / "a.csv.gz").write_bytes(gzip.compress(b"trade_id,ts,price,qty,side,ord_type\n" + text[:2000]) + gzip.compress(text[2000:]) + b"garbage")
    (two / "b.csv").write_bytes(text.replace(b",b,m", b",s,l") + b"9,x,1,1,b,m\n12,17")
    got = {(r.symbol, r.trade_id): r for r in store.read_ticks(spark, str(tmp_path)).collect()}
    assert {k for s, k in got if s == "S0"} == set(range(400)) == {k for s, k in got if s == "S2"}
    before = {k for s, k in got if s == "S1"}
    assert 100 < len(before) < 400 and before == set(range(len(before)))
    d = {(r.symbol, r.file): r for r in store.damage(spark, str(tmp_path)).collect()}
    assert not d["S0", "a.csv.gz"].torn and d["S0", "a.csv.gz"].lines == 400 and d["S0", "a.csv.gz"].damaged == 0
    assert d["S1", "a.csv.gz"].torn and d["S1", "a.csv.gz"].unread_bytes > 0 and d["S1", "a.csv.gz"].lines >= len(before)
    assert d["S2", "a.csv.gz"].torn and d["S2", "a.csv.gz"].headers == 1 and d["S2", "a.csv.gz"].lines == 401 and d["S2", "a.csv.gz"].unread_bytes == 7
    assert (d["S2", "b.csv"].lines, d["S2", "b.csv"].damaged, d["S2", "b.csv"].torn) == (402, 2, False)


def rows(spark, *ids, day="2024-01-01"):
    t = dt.datetime.fromisoformat(f"{day}T10:00:00")
    return spark.createDataFrame([("S0", k, t, float(k), day) for k in ids], "symbol string, trade_id long, ts timestamp_ntz, price double, day string")


def test_snapshots(spark, tmp_path, monkeypatch):
    s = snapshots.SnapshotStore(spark, str(tmp_path / "s"), "symbol string, trade_id long, ts timestamp_ntz, price double", ["trade_id"])
    ids = lambda df: sorted(r.trade_id for r in df.collect())
    assert s.version() == -1 and ids(s.read()) == []
    s.merge(rows(spark, 1, 2, 2), 0)
    s.merge(rows(spark, 5, day="2024-01-09"), 1)
    s.merge(rows(spark, 2, 3), 2)  # days late, with a replay
    assert ids(s.read()) == [1, 2, 3, 5] and ids(s.arrivals()) == [1, 2, 3, 5] and ids(s.read(1)) == [1, 2, 5]
    assert {(r.day, r.of) for r in s.manifest().collect()} == {("2024-01-01", 2), ("2024-01-09", 1)}  # the other day was not rewritten
    with monkeypatch.context() as m:
        m.setattr(snapshots.SnapshotStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            s.merge(rows(spark, 7), 3)
    assert s.version() == 2 and ids(s.read()) == [1, 2, 3, 5] and ids(s.arrivals()) == [1, 2, 3, 5]  # what the dead merge left is not seen
    s.merge(rows(spark, 7), 3)
    s.merge(rows(spark, 99), 3)  # a snapshot that is committed is not written again
    assert ids(s.read()) == [1, 2, 3, 5, 7] and ids(s.arrivals()) == [1, 2, 3, 5, 7]
    again = snapshots.SnapshotStore(spark, str(tmp_path / "s"), "symbol string, trade_id long, ts timestamp_ntz, price double", ["trade_id"])
    assert again.version() == 3
    s.compact("2024-01-05", 4, max_files=0)
    assert ids(s.read()) == [1, 2, 3, 5, 7] and {(r.day, r.of) for r in s.manifest().collect()} == {("2024-01-01", 4), ("2024-01-09", 1)}


def test_orders_may_be_late_and_live_long(spark, tmp_path):
    """Prints before their order's file, a touch hours after placement, an expiry, and one that stays open."""
    from tapeworks.streaming import held as H
    h = H.HOUR_US
    ddl = "kind string, order_id string, symbol string, limit_px double, us long, expires_us long, price double"
    tables, out, step = H.limit_orders(late_us=h)
    batches = [[("print", None, "A", None, 10, None, 9.0), ("order", "o1", "A", 8.0, 20, 50 * h, None), ("order", "o2", "A", 5.0, 20, 2 * h, None)],
               [("order", "late", "A", 9.0, 5, 3 * h, None), ("print", None, "A", None, 30 * h, None, 7.5)],
               [("order", "o4", "A", 1.0, 30 * h, 90 * h, None), ("print", None, "A", None, 60 * h, None, 6.0)]]
    src = str(tmp_path / "src")
    for rows_ in batches:
        spark.createDataFrame(rows_, ddl).coalesce(1).write.mode("append").parquet(src)
    stream = H.TableStream(spark, str(tmp_path / "t"), tables, out)
    done = stream.run(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src), str(tmp_path / "cp"), step)
    got = {r.order_id: (r.status, r.filled_us) for r in done.unionByName(H.still_open(stream)).collect()}
    assert got == {"o1": ("filled", 30 * h), "o2": ("expired", None), "late": ("filled", 10), "o4": ("open", None)}
