"""A store that merges rows by touched (symbol, day) and commits each merge as a snapshot.

``data/version=N/symbol=.../day=...`` holds the partitions that merge N wrote,
``manifests/version=N`` says which version each partition has in snapshot N,
``added/version=N`` has the rows that were new, and ``commits/version=N`` is written last: a snapshot counts once its commit is there.
Readers take the newest commit, so a merge that dies half-way changes nothing that
they see, and the same merge run again overwrites what it left. Only touched
partitions are read and rewritten; rows may arrive any time after their day.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.session import pin

PART = ["symbol", "day"]


class SnapshotStore:
    """``schema``: DDL of the rows with ``symbol`` and without ``day``; ``key`` names one row of a symbol and day."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: Sequence[str]):
        self.spark, self.root, self.key = spark, root.rstrip("/"), list(key)
        self.schema = spark.createDataFrame([], schema).schema
        self.values = [f.name for f in self.schema if f.name != "symbol"]
        rows = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema if f.name != "symbol")
        self._ddl = {"data": f"{rows}, version long, symbol string, day string", "added": f"symbol string, day string, {rows}, version long", "manifests": "symbol string, day string, of long, version long", "commits": "at timestamp, version long"}
        for name, ddl in self._ddl.items():  # "ignore" leaves a store that exists as it is
            empty = spark.createDataFrame([], ddl).drop("version").write.mode("ignore")
            (empty.partitionBy(*PART) if name == "data" else empty).parquet(f"{self.root}/{name}/version=-1")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._ddl[name]).parquet(f"{self.root}/{name}")

    def version(self) -> int:
        """The newest committed snapshot, -1 before the first."""
        newest = self._table("commits").where("at is not null").agg(F.max("version")).first()[0]
        return -1 if newest is None else newest

    def manifest(self, version: int | None = None) -> DataFrame:
        """(symbol, day, of): the version that wrote each partition of a snapshot."""
        n = self.version() if version is None else version
        return self._table("manifests").where((F.col("version") == n) & F.col("symbol").isNotNull()).select(*PART, "of")

    def _partitions(self, which: DataFrame) -> DataFrame:
        """Rows of the partitions that ``which`` (symbol, day, of) names; files of others are pruned."""
        names = which.withColumnRenamed("of", "version")
        return self._table("data").join(names, [*PART, "version"], "left_semi").select(*PART, *self.values)

    def read(self, version: int | None = None) -> DataFrame:
        return self._partitions(self.manifest(version))

    def arrivals(self) -> DataFrame:
        """Every row once, as the merges took them in."""
        return self._table("added").where(F.col("symbol").isNotNull() & (F.col("version") <= self.version()))

    def merge(self, rows: DataFrame, version: int) -> None:
        """Adds rows whose key is not in the store yet and commits snapshot ``version``; nothing if that is committed already.

        ``rows`` has the schema's columns and ``day``. Of rows with one key the smallest is kept.
        """
        base = self.version()
        if base >= version:
            return
        on = [*PART, *self.key]
        rest = [c for c in self.values if c not in self.key]
        arrived = rows.groupBy(*on).agg(F.min(F.struct(*rest)).alias("_r")).select(*on, *[F.col(f"_r.{c}") for c in rest])
        arrived = pin(arrived)
        manifest = self.manifest(base)
        touched = arrived.select(*PART).distinct()
        old = self._partitions(manifest.join(touched, PART, "left_semi"))
        new = pin(arrived.join(old.select(*on), on, "left_anti"))
        changed = pin(new.select(*PART).distinct())
        self._write(old.join(changed, PART, "left_semi").unionByName(new.select(old.columns)), version)
        new.select(*PART, *self.values).write.mode("overwrite").parquet(f"{self.root}/added/version={version}")
        self._commit(manifest.join(changed, PART, "left_anti").unionByName(changed.withColumn("of", F.lit(version).cast("long"))), version)

    def compact(self, before: str, version: int, max_files: int = 1) -> None:
        """Rewrites the partitions of days before ``before`` that hold more than ``max_files`` files; the others keep theirs."""
        base = self.version()
        if base >= version:
            return
        manifest = self.manifest(base)
        closed = manifest.where(F.col("day") < before).withColumnRenamed("of", "version")
        paths = self._table("data").select(*PART, "version", F.col("_metadata.file_path").alias("f"))
        files = paths.join(closed, [*PART, "version"], "left_semi").distinct()
        many = pin(files.groupBy(*PART).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_files).select(*PART))
        self._write(self._partitions(manifest.join(many, PART, "left_semi")), version)
        self._commit(manifest.join(many, PART, "left_anti").unionByName(many.withColumn("of", F.lit(version).cast("long"))), version)

    def _write(self, rows: DataFrame, version: int) -> None:
        """Range partitions keep a partition's files few and sorted, and spread a heavy day over several writers."""
        order = [*PART, *self.key]
        (rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(*PART)
         .parquet(f"{self.root}/data/version={version}"))

    def _commit(self, manifest: DataFrame, version: int) -> None:
        manifest.select(*PART, "of").write.mode("overwrite").parquet(f"{self.root}/manifests/version={version}")
        done = self.spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1)
        done.write.mode("overwrite").parquet(f"{self.root}/commits/version={version}")
