"""Command line: ``python -m chromaweave simulate|transform|evaluate|annotate-barriers``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from chromaweave.functions.formulas import genomic_distance
from chromaweave.operators.simulation import SimulationConfig
from chromaweave.plans import workflows
from chromaweave.sources.config import config_from_toml
from chromaweave.sources.genomic import read_ranges


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chromaweave")
    verbs = top.add_subparsers(dest="verb", required=True)
    p = verbs.add_parser("simulate")
    p.add_argument("--chrom-sizes", required=True)
    p.add_argument("--barriers", required=True)
    p.add_argument("--regions")
    p.add_argument("--config", help="TOML file; see SimulationConfig")
    p.add_argument("--output", required=True)
    p = verbs.add_parser("transform")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--method", required=True, choices=["normalize", "gaussian_blur", "difference_of_gaussians", "discretize"])
    p.add_argument("--sigma", type=float, default=1.0)
    p.add_argument("--sigma2", type=float)
    p.add_argument("--saturation", type=float, nargs=2)
    p.add_argument("--ranges")
    p.add_argument("--normalization-range", type=float, nargs=2, default=[0.0, 1.0])
    p.add_argument("--whole-numbers", action="store_true")
    p = verbs.add_parser("evaluate")
    p.add_argument("--reference", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--metric", default="custom", choices=["pearson", "spearman", "eucl_dist", "rmse", "custom"])
    p.add_argument("--diagonal-width", type=genomic_distance, default=3_000_000)
    p.add_argument("--regions-of-interest")
    p.add_argument("--weights")
    p.add_argument("--weight-column-name", default="balanced.sum")
    p.add_argument("--reciprocal-weights", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--normalize", action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--exclude-zero-pixels", action="store_true")
    p = verbs.add_parser("annotate-barriers")
    p.add_argument("--barriers", required=True)
    p.add_argument("--track", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--scale", type=float, default=20.0)
    p.add_argument("--lower", type=float, default=0.0)
    p.add_argument("--upper", type=float, default=1.0)
    p.add_argument("--clamp", action="store_true")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("chromaweave").getOrCreate()
    if a.verb == "simulate":
        config = config_from_toml(Path(a.config).read_text()) if a.config else SimulationConfig()
        workflows.run_simulation(spark, a.chrom_sizes, a.barriers, a.output, config, a.regions)
    elif a.verb == "transform":
        workflows.run_transform(spark, a.input, a.output, a.method, a.sigma, a.sigma2, tuple(a.normalization_range), tuple(a.saturation) if a.saturation else None, read_ranges(spark, a.ranges) if a.ranges else None, a.whole_numbers)
    elif a.verb == "evaluate":
        workflows.run_evaluation(spark, a.reference, a.target, a.output, a.metric, a.diagonal_width, a.weights, a.weight_column_name, a.reciprocal_weights, a.exclude_zero_pixels, a.normalize, a.regions_of_interest)
    else:
        workflows.run_annotation(spark, a.barriers, a.track, a.output, a.scale, a.lower, a.upper, a.clamp)


if __name__ == "__main__":
    main()
