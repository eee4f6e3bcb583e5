"""Result tables whose new versions take effect together.

A run writes new files below ``<table>/run=…``, split by a key column, and touches no older file. A
snapshot is a small table that names the live parts (table, key value, run); it is written last, and its
success marker is the commit. Readers resolve the newest snapshot with a marker, so a run that stops at
any earlier point leaves the old state readable. One run at a time may write to a root.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIVE = "table string, part string, run string"


def _folders(spark: SparkSession, root: str) -> dict[int, bool]:
    """Numbers of the snapshots below ``root``, and whether each was committed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshots")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return {}
    paths = [status.getPath() for status in files.listStatus(folder)]
    return {int(p.getName()): files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) for p in paths if p.getName().isdigit()}


def newest(spark: SparkSession, root: str) -> int | None:
    """Number of the newest committed snapshot; None before the first."""
    return max((n for n, whole in _folders(spark, root).items() if whole), default=None)


def live_parts(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """``table, part, run`` of a snapshot (the newest unless given); empty before the first."""
    number = newest(spark, root) if number is None else number
    if number is None:
        return spark.createDataFrame([], LIVE)
    return spark.read.schema(LIVE).parquet(f"{root}/snapshots/{number:012d}")


def read(spark: SparkSession, root: str, table: str, schema: str, key: str, number: int | None = None) -> DataFrame:
    """Rows of the live parts of a table. A table without any is empty; an empty key is read as null."""
    empty = spark.createDataFrame([], schema)
    try:
        rows = spark.read.schema(f"{schema}, run string").parquet(f"{root}/{table}")
    except AnalysisException:
        return empty
    live = live_parts(spark, root, number).filter(F.col("table") == table).select("part", F.col("run").alias("live_run"))
    return rows.join(live, (F.col("run") == F.col("live_run")) & F.col(key).eqNullSafe(F.col("part")), "left_semi").select(empty.columns)


class Run:
    """New versions of some tables, readable after :meth:`commit` and not before."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.name = spark, root, uuid.uuid4().hex
        numbers = _folders(spark, root)
        self.before = live_parts(spark, root)
        self.number = max(numbers, default=0) + 1
        self.added = self.replaced = spark.createDataFrame([], "table string, part string")

    def write(self, table: str, df: DataFrame, key: str, replaced: DataFrame | None = None) -> DataFrame:
        """Write ``df`` once as the new parts of its keys and return what was written.

        Stored parts of keys that have new rows, and of the keys in ``replaced``, are no longer live after the commit.
        """
        df.hint("rebalance", key).write.partitionBy(key).parquet(f"{self.root}/{table}/run={self.name}")
        written = self.spark.read.schema(df.schema).parquet(f"{self.root}/{table}/run={self.name}").select(df.columns)
        parts = written.select(F.lit(table).alias("table"), F.col(key).alias("part")).distinct()
        self.added = self.added.unionByName(parts)
        self.replaced = self.replaced.unionByName(parts)
        if replaced is not None:
            self.replaced = self.replaced.unionByName(replaced.select(F.lit(table).alias("table"), F.col(key).alias("part")))
        return written

    def commit(self) -> int:
        """Write the snapshot that takes over all tables at once; its number."""
        old, gone = self.before.alias("old"), self.replaced.alias("gone")
        same = (F.col("old.table") == F.col("gone.table")) & F.col("old.part").eqNullSafe(F.col("gone.part"))
        live = old.join(gone, same, "left_anti").unionByName(self.added.withColumn("run", F.lit(self.name)))
        live.write.parquet(f"{self.root}/snapshots/{self.number:012d}")
        return self.number
