"""Snapshots of state from run to run, kept as tables bucketed by their key: a run's rows are brought to the buckets, what is kept from earlier runs is never shuffled.

A run is named by a text that sorts with time, as a date does. Each run writes a table of its own and reads the latest before it, so a run that is repeated, after a failure
or for a correction, starts from what it started from before and replaces only what it wrote itself."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 200


class Snapshots:
    """The runs of one state table. key: what its rows are merged by; location: a folder for the tables, the warehouse if none is given.

    Take as many buckets as tasks that should share a merge: each is read, merged and written by one task, in one file. A snapshot with no more rows than fit a few
    tasks needs few. Snapshots of other bucket numbers are read all the same, but shuffled."""

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int = BUCKETS, location: str | None = None):
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise ValueError(f"{name!r} can't name a table: take lower-case letters, digits and _")
        self.spark, self.name, self.key, self.buckets, self.location = spark, name, key, buckets, location

    def _table(self, run: str) -> str:
        if not re.fullmatch(r"[0-9A-Za-z-]+", run):
            raise ValueError(f"{run!r} can't name a run: take letters, digits and -")
        return f"{self.name}__{run.replace('-', '_').lower()}"

    def runs(self) -> list[str]:
        """The tables of all runs, earliest first."""
        return sorted(t.name for t in self.spark.catalog.listTables(pattern=f"{self.name}__*") if t.name.startswith(f"{self.name}__"))

    def before(self, run: str) -> DataFrame | None:
        """What the latest run before this one left; None if there is none."""
        own = self._table(run)
        earlier = [t for t in self.runs() if t < own]
        return self.spark.table(earlier[-1]) if earlier else None

    def write(self, run: str, rows: DataFrame) -> DataFrame:
        """rows as the snapshot of a run, read back. Rows of a merge with an earlier snapshot lie by bucket already and are written as they are."""
        table = self._table(run)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        writer = rows.write.mode("overwrite").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
        if self.location:
            writer = writer.option("path", f"{self.location}/{table}")
        writer.saveAsTable(table)
        return self.spark.table(table)

    def start(self, run: str, rows: DataFrame) -> DataFrame:
        """rows from elsewhere, such as a first load, as the snapshot of a run: shuffled once, so that each bucket is one file."""
        return self.write(run, rows.repartition(self.buckets, F.col(self.key)))

    def forget(self, keep: int = 2) -> None:
        """Drops all but the latest runs, files included."""
        if keep < 1:
            raise ValueError("at least one run must stay")
        for table in self.runs()[:-keep]:
            if self.location:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{table}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
