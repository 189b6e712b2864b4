"""Summaries of genomes, units and tracks, and a reproducible sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def genome_statistics(chroms: DataFrame, intervals: DataFrame, barriers: DataFrame, bin_size: int, nrows: int, density: float) -> DataFrame:
    """One row: size of the genome and of its simulated part, longest chromosome, interval and name, most barriers of an
    interval, and the largest number of contacts an interval is simulated for. ``barriers`` has interval_id."""
    size = F.col("end") - F.col("start")
    ncols = F.ceil(size / bin_size)
    one = chroms.agg(F.sum("size").alias("genome_size"), F.max_by("chrom", F.struct("size", "chrom")).alias("longest_chrom"), F.max(F.length("chrom")).alias("longest_name"))
    two = intervals.agg(F.sum(size).alias("simulated_size"), F.max(size).alias("longest_interval"), F.max(F.round(ncols * F.least(ncols, F.lit(nrows)) * density)).cast("bigint").alias("most_contacts"))
    three = barriers.groupBy("interval_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most_barriers"))
    return _beside(one, two, three)


def _beside(*rows: DataFrame) -> DataFrame:
    """Tables of one row, side by side."""
    out = rows[0].withColumn("_k", F.lit(0))
    for row in rows[1:]:
        out = out.join(F.broadcast(row.withColumn("_k", F.lit(0))), "_k")  # one row, as an aggregate without groups has
    return out.drop("_k")


def loop_statistics(lefs: DataFrame, groups: list[str]) -> DataFrame:
    """Mean loop size and its coefficient of variation (population); the latter is null if all loops are empty."""
    size = F.col("fwd") - F.col("rev")
    return lefs.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(size).alias("mean"), (F.stddev_pop(size) / F.nullif(F.avg(size), F.lit(0.0))).alias("cv"))


def window_statistics(track: DataFrame, intervals: DataFrame, window: int) -> DataFrame:
    """(interval_id, window, mean, least, largest, bases) of a track over equal windows of each interval that it touches;
    means weigh values by the bases they cover."""
    from chromaweave.operators.intervals import overlap_join

    cut = intervals.select("interval_id", "chrom", "start", "end", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("end") - F.col("start") - 1) / window))).alias("window"))
    windows = cut.select("interval_id", "window", "chrom", (F.col("start") + F.col("window") * window).alias("start"), F.least(F.col("start") + (F.col("window") + 1) * window, F.col("end")).alias("end"))
    hits = overlap_join(windows, track)
    bases = F.least("end", "r_end") - F.greatest("start", "r_start")
    return hits.groupBy("interval_id", "window").agg((F.sum(F.col("r_value") * bases) / F.sum(bases)).alias("mean"), F.min("r_value").alias("least"), F.max("r_value").alias("largest"), F.sum(bases).alias("bases"))


def release_chance(base: float, soft: float, hard: float, rev_stalled: Column, fwd_stalled: Column) -> Column:
    """Chance that a unit lets go: ``base``, less by ``soft`` or ``hard`` where one or both sides are held by a barrier."""
    sides = rev_stalled.cast("int") + fwd_stalled.cast("int")
    return base / F.when(sides == 0, 1.0).when(sides == 1, soft).otherwise(hard)


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same for a seed however the rows are dealt out: those with the smallest MD5 of
    seed and key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def occupied_states(barriers: DataFrame, groups: list[str]) -> DataFrame:
    """How many barriers are active and inactive."""
    return barriers.groupBy(*groups).agg(F.count_if(F.col("active")).alias("active"), F.count_if(~F.col("active")).alias("inactive"))
