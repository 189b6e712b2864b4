"""Contact matrices that are updated in runs: a log of deltas beside a base, merged when read, folded together when asked.

A run's events are summed up by pixel before they are written: what was added since the last time the pixel was set, or since
the run began. Runs follow one another, so a pixel's value is that of its last run that set it and all additions after.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL = ["chrom", "bin1", "bin2"]
_DELTA = "chrom string, bin1 bigint, bin2 bigint, is_set boolean, amount double, run bigint"
_BASE = "chrom string, bin1 bigint, bin2 bigint, count double, version bigint"
_STATE = "run bigint, version bigint"


@dataclass(frozen=True)
class MatrixLog:
    """A folder with deltas (by run), bases (by version) and the list of versions: which runs a base holds. One writer at a time;
    a reader sees whole runs and whole versions, since each counts only once its row is in the list."""

    spark: SparkSession
    path: str
    nrows: int | None = None

    @staticmethod
    def created(spark: SparkSession, path: str, nrows: int | None = None) -> MatrixLog:
        log = MatrixLog(spark, path, nrows)
        spark.createDataFrame([(0, 0)], _STATE).coalesce(1).write.parquet(f"{path}/state")
        spark.createDataFrame([], _DELTA).write.parquet(f"{path}/deltas/run=0")
        spark.createDataFrame([], _BASE).write.parquet(f"{path}/bases/version=0")
        return log

    def _state(self) -> tuple[int, int, int]:
        """The last run, the last version, and the last run that this holds."""
        rows = [(r["run"], r["version"]) for r in self.spark.read.schema(_STATE).parquet(f"{self.path}/state").collect()]  # a row a run or version
        run, version = max(r for r, _ in rows), max(v for _, v in rows)
        return run, version, max(r for r, v in rows if v == version and (v or r == 0))

    def _noted(self, run: int, version: int) -> None:
        self.spark.createDataFrame([(run, version)], _STATE).coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def append(self, events: DataFrame) -> None:
        """One run of events (chrom, bin1, bin2, op, n, seq): ``add``, ``subtract``, ``set`` and ``erase`` in order of ``seq``. Pixels
        outside the band are left out. A run that failed before it was noted is written anew."""
        run = self._state()[0] + 1
        kept = events if self.nrows is None else events.where(F.abs(F.col("bin2") - F.col("bin1")) < self.nrows)
        canon = kept.select("chrom", F.least("bin1", "bin2").alias("bin1"), F.greatest("bin1", "bin2").alias("bin2"), F.col("op").isin("set", "erase").alias("sets"), F.when(F.col("op") == "erase", 0).when(F.col("op") == "subtract", -F.col("n")).otherwise(F.col("n")).cast("double").alias("amount"), "seq")
        sets = canon.where("sets").groupBy(*PIXEL).agg(F.max("seq").alias("last"))
        after = canon.join(sets, PIXEL, "left").where(F.col("last").isNull() | (F.col("seq") > F.col("last")) | ((F.col("seq") == F.col("last")) & F.col("sets")))
        delta = after.groupBy(*PIXEL).agg(F.max(F.col("last").isNotNull()).alias("is_set"), F.sum("amount").alias("amount"))
        delta.write.mode("overwrite").parquet(f"{self.path}/deltas/run={run}")
        self._noted(run, -1)

    def pixels(self) -> DataFrame:
        """(chrom, bin1, bin2, count) after all runs, without those that are 0. A pixel's deltas are as many as there are runs since
        the last compaction."""
        run, version, held = self._state()
        base = self.spark.read.schema(_BASE).parquet(f"{self.path}/bases").where(F.col("version") == version)
        deltas = self.spark.read.schema(_DELTA).parquet(f"{self.path}/deltas").where(F.col("run").between(held + 1, run))
        steps = base.select(*PIXEL, F.lit(-1).cast("bigint").alias("run"), F.lit(True).alias("is_set"), F.col("count").alias("amount")).unionByName(deltas.select(*PIXEL, "run", "is_set", "amount"))
        listed = steps.groupBy(*PIXEL).agg(F.array_sort(F.collect_list(F.struct("run", "is_set", "amount"))).alias("steps"))
        value = F.aggregate("steps", F.lit(0.0), lambda a, x: F.when(x["is_set"], x["amount"]).otherwise(a + x["amount"]))
        return listed.select(*PIXEL, value.alias("count")).where("count <> 0")

    def compact(self) -> None:
        """A new base of all runs so far; older bases and deltas stay for readers that have begun."""
        run, version, _ = self._state()
        self.pixels().write.mode("overwrite").parquet(f"{self.path}/bases/version={version + 1}")
        self._noted(run, version + 1)
