"""The four verbs: simulate, transform, evaluate and annotate barriers, from files to files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaweave.operators import barriers as bars
from chromaweave.operators import evaluation, matrix
from chromaweave.operators.intervals import overlap_join
from chromaweave.operators.simulation import SimulationConfig, interval_report, outputs, simulate_intervals_raw
from chromaweave.sources import genomic
from chromaweave.sources.config import config_to_json


def select_intervals(chroms: DataFrame, regions: DataFrame | None) -> DataFrame:
    """(interval_id, chrom, start, end): whole chromosomes, or the regions that overlap one, cut to its size."""
    whole = chroms.select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"))
    if regions is not None:
        whole = overlap_join(regions.select("chrom", "start", "end"), whole).select("chrom", "start", F.least("end", "r_end").alias("end"))
    return whole.withColumn("interval_id", F.xxhash64("chrom", "start", "end"))


def run_simulation(spark: SparkSession, chrom_sizes: str, barriers: str, out: str, config: SimulationConfig, regions: str | None = None) -> None:
    """Writes ``out/matrix`` (pixels and metadata), ``out/occupancy`` (bedGraph, scaled by interval), ``out/epochs`` (tab
    separated) and ``out/intervals``, with those that have no barriers; all from ``out/raw``, for which the kernel runs once."""
    config = config.resolved()
    chroms = genomic.read_chrom_sizes(spark, chrom_sizes)
    intervals = select_intervals(chroms, genomic.read_bed(spark, regions, 3) if regions else None)
    own = bars.barriers_from_records(genomic.read_bed(spark, barriers, 6, unique=True), config.stp_active, config.stp_inactive)
    if config.occupancy is not None:
        own = bars.with_occupancy(own, config.occupancy, config.stp_inactive)
    mapped = bars.map_to_intervals(own, intervals)
    simulate_intervals_raw(intervals, own, config, with_epochs=True).write.partitionBy("kind").parquet(f"{out}/raw")
    found = outputs(spark.read.parquet(f"{out}/raw"))
    interval_report(intervals, mapped, config).coalesce(1).write.csv(f"{out}/intervals", sep="\t", header=True)
    placed = found["pixels"].join(intervals.select("interval_id", F.floor(F.col("start") / config.bin_size).alias("_offset")), "interval_id")
    pixels = placed.groupBy("chrom", (F.col("bin1") + F.col("_offset")).alias("bin1"), (F.col("bin2") + F.col("_offset")).alias("bin2")).agg(F.sum("count").alias("count"))
    genomic.write_matrix(pixels, chroms, f"{out}/matrix", config.bin_size, config.nrows, {"config": config_to_json(config)})
    spots = found["occupancy"].join(intervals.select("interval_id", "start", "end"), "interval_id")
    largest = spots.groupBy("interval_id").agg(F.max("n").alias("_most"))
    start = F.col("start") + F.col("bin") * config.bin_size
    genomic.write_bedgraph(spots.join(largest, "interval_id").select("chrom", start.alias("start"), F.least(start + config.bin_size, F.col("end")).alias("end"), (F.col("n") / F.col("_most")).cast("float").alias("value")), f"{out}/occupancy")
    epochs = found["epochs"].join(intervals.select("interval_id", "start", "end"), "interval_id").withColumnRenamed("interval_id", "task_id").withColumnRenamed("cell", "cell_id")
    epochs = epochs.withColumns({"burnin": F.when(F.col("burnin") > 0, "True").otherwise("False"), **{c: F.col(c).cast("bigint") for c in epochs.columns if c.startswith("num_")}})
    epochs.select(*EPOCH_LOG).write.csv(f"{out}/epochs", sep="\t", header=True)


#: Columns of the epoch log.
EPOCH_LOG = ("task_id", "epoch", "cell_id", "chrom", "start", "end", "burnin", "barrier_occupancy", "num_active_lefs", "num_stalls_rev", "num_stalls_fwd", "num_stalls_both", "num_lef_bar_collisions", "num_primary_lef_lef_collisions", "num_secondary_lef_lef_collisions", "avg_loop_size")


def run_transform(spark: SparkSession, path: str, out: str, method: str, sigma: float = 1.0, sigma2: float | None = None, bounds: tuple[float, float] = (0.0, 1.0), saturation: tuple[float, float] | None = None, ranges: list[tuple[float, float, float]] | None = None, whole_numbers: bool = False) -> None:
    """``normalize``, ``gaussian_blur``, ``difference_of_gaussians`` or ``discretize``, then discretisation if ``ranges`` are given."""
    pixels, chroms, about = genomic.read_matrix(spark, path)
    shape = (chroms, about["bin_size"], about["nrows"])
    if method == "normalize":
        pixels = matrix.normalised(pixels, *shape, *bounds, saturation)
    elif method == "gaussian_blur":
        pixels = matrix.blurred(pixels, *shape, sigma)
    elif method == "difference_of_gaussians":
        pixels = matrix.difference_of_gaussians(pixels, *shape, sigma, sigma2, lower=(saturation or (-math.inf, math.inf))[0], upper=(saturation or (-math.inf, math.inf))[1])
    elif method != "discretize" or not ranges:
        raise ValueError(f"unknown method, or no ranges: {method!r}")
    if ranges:
        pixels = matrix.discretised(pixels, ranges, shape)
    genomic.write_matrix(matrix.rounded(pixels) if whole_numbers else pixels, chroms, out, about["bin_size"], about["nrows"], {"method": method})


def run_evaluation(spark: SparkSession, reference: str, target: str, out: str, metric: str, diagonal_width: int = 3_000_000, weights: str | None = None, weight_column: str = "balanced.sum", reciprocal: bool = True, without_zeros: bool = False, normalise: bool = False, regions: str | None = None) -> None:
    """Scores of every stripe of the chromosomes both matrices have, or of ``regions`` (BED) of them, as one tab-separated
    table for each direction; correlations come with their significance."""
    one, chroms, about = genomic.read_matrix(spark, reference, diagonal_width=diagonal_width)
    two, others, _ = genomic.read_matrix(spark, target, diagonal_width=diagonal_width)
    common = evaluation.common_chroms(chroms, others)
    nrows = min(about["nrows"], -(-diagonal_width // about["bin_size"]))
    filled = one.select("chrom").union(two.select("chrom")).distinct()  # chromosomes empty in both are left out
    common = common.join(filled, "chrom", "left_semi")
    if normalise:
        one, two = (matrix.normalised(m, common, about["bin_size"], nrows) for m in (one, two))
    own = evaluation.reciprocal_weights(genomic.read_weights(spark, weights, weight_column), reciprocal) if weights else None
    if own is not None and (lacking := [r["chrom"] for r in evaluation.chroms_without_weights(common, own).limit(10).collect()]):
        raise ValueError(f"no weights for {lacking}")
    wanted = common.select(F.col("chrom").alias("region"), "chrom", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"))
    if regions:
        asked = genomic.read_bed(spark, regions, 3).distinct()
        if bad := [tuple(r) for r in evaluation.invalid_regions(asked, chroms).limit(10).collect()]:
            raise ValueError(f"regions that are no part of a chromosome: {bad}")
        wanted = asked.join(common.select("chrom"), "chrom", "left_semi").select(F.format_string("%s:%d-%d", "chrom", "start", "end").alias("region"), "chrom", "start", "end")
        one, two = (evaluation.cut_to_regions(m, wanted, about["bin_size"]) for m in (one, two))
        own = own.join(wanted.select("chrom", "region"), "chrom").select(F.col("region").alias("chrom"), "diag", "weight") if own is not None else None
    shapes = wanted.select(F.col("region").alias("chrom"), (F.col("end") - F.col("start")).alias("size"))
    scores = evaluation.compare(one, two, shapes, about["bin_size"], nrows, metric, own, without_zeros, significance=True)
    names = {"pearson": {"score": "correlation"}, "spearman": {"score": "correlation"}, "custom": {"correct": "correctly_classified_pixels", "incorrect": "incorrectly_classified_pixels"}}.get(metric, {})
    placed = scores.withColumnRenamed("chrom", "region").join(wanted.select("region", "chrom", F.col("start").alias("_from")), "region")
    kept = [F.col(c).alias(names.get(c, c)) for c in scores.columns if c not in ("chrom", "start", "end", "direction")]
    scores = placed.select("chrom", (F.col("start") + F.col("_from")).alias("chrom_start"), (F.col("end") + F.col("_from")).alias("chrom_end"), "direction", *kept)
    scores.write.partitionBy("direction").csv(out, sep="\t", header=True)


def run_annotation(spark: SparkSession, barriers: str, track: str, out: str, scale: float, lower: float = 0.0, upper: float = 1.0, clamp: bool = False) -> None:
    """Barrier records with occupancies from a bedGraph or bigWig track, as BED6 text."""
    records = bars.annotate(genomic.read_bed(spark, barriers, 6), genomic.read_track(spark, track), scale, lower, upper, clamp)
    bars.format_bed(records.sort("chrom", "start", "end")).write.text(out)
