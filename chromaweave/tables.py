"""Tables that are written to the folder the whole cluster shares, and ordered scans of groups over many tasks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for this session, from ``spark.checkpoint.dir``. Where that is unset: a temporary one on one machine, an
    error on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that the whole cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written now as a Parquet table in the shared folder, and read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sorted(df: DataFrame, groups: list[str], order: list[str | Column]) -> DataFrame:
    """``df`` sorted over many tasks and written, with ``_row``, ascending, and ``_part``, the task that wrote a row."""
    keys = [*groups, *order]
    kept = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    return shared_table(kept).withColumn("_part", F.shiftright("_row", 33))


def _with_parts(kept: DataFrame, carried: DataFrame, groups: list[str]) -> DataFrame:
    """Each row with what is carried to its task's part of its group."""
    own = carried.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.col("_part").alias("_p"), *[c for c in carried.columns if c not in (*groups, "_part")])
    meets = F.col("_part") == F.col("_p")
    for k, g in enumerate(groups):
        meets = meets & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return kept.join(own, meets)


def numbered(df: DataFrame, groups: list[str], order: list[str | Column], name: str = "pos", total: str | None = None) -> DataFrame:
    """``df`` with each row's place by ``order`` in its group from 0 on (all rows, if there are no groups), and with ``total``
    the group's size. Null groups count as one.

    A range sort, written with numbers by task; where each task's part of a group begins follows from the counts by task, so
    no group is in one task. Rows equal in ``order`` are numbered in any order.
    """
    kept = _sorted(df, groups, order)
    parts = kept.groupBy(*groups, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_here"))
    own = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_here").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(*groups, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_here").over(own).alias("_total"))
    out = _with_parts(kept, starts, groups).withColumn(name, F.col("_row") + F.col("_shift"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, name, *([total] if total else []))


def running(df: DataFrame, groups: list[str], order: list[str | Column], columns: dict[str, tuple[str, Column]], own: bool = True) -> DataFrame:
    """``df`` with running values by ``order`` in each group, the row's own included unless ``own`` is off: name to (kind, column),
    kinds being ``sum``, ``min``, ``max`` and ``last`` (the last that is not null). Null where there is nothing before.

    A range sort, written; every task's part of a group is summed up, what comes before a part is carried into it, and a
    window runs over the part alone. So a window holds what one task sorted, however large a group is; the windows over
    parts have a row for each task.
    """
    names = list(columns)
    kept = _sorted(df.withColumns({f"_v{k}": columns[n][1] for k, n in enumerate(names)}), groups, order)
    whole = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_row")))}
    over = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    kinds = [columns[n][0] for n in names]
    parts = kept.groupBy(*groups, "_part").agg(*[whole[kind](f"_v{k}").alias(f"_t{k}") for k, kind in enumerate(kinds)])
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*groups, "_part", *[over[kind](f"_t{k}").over(before).alias(f"_c{k}") for k, kind in enumerate(kinds)])
    here = Window.partitionBy(*groups, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    scanned = kept.withColumns({f"_w{k}": over[kind](f"_v{k}").over(here) for k, kind in enumerate(kinds)})

    def joined(kind: str, carry: Column, value: Column) -> Column:
        if kind == "last":
            return F.coalesce(value, carry)
        both = {"sum": carry + value, "min": F.least(carry, value), "max": F.greatest(carry, value)}[kind]
        return F.coalesce(both, carry, value)

    out = _with_parts(scanned, carried, groups)
    return out.select(*df.columns, *[joined(kind, F.col(f"_c{k}"), F.col(f"_w{k}")).alias(n) for k, (n, kind) in enumerate(zip(names, kinds))])
