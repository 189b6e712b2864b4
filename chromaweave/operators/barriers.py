"""Extrusion barriers: from BED records to positions and self-transition chances, mapped to simulated intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.functions.formulas import barrier_position, blocking_direction, logistic, stp_active_from_occupancy
from chromaweave.operators.intervals import overlap_join
from chromaweave.sources.genomic import BED_FIELDS


def barriers_from_records(records: DataFrame, stp_active: float, stp_inactive: float, score_is_occupancy: bool = True) -> DataFrame:
    """(chrom, pos, stp_active, stp_inactive, blocks) of stranded records (chrom, start, end, name, score, strand).

    A score other than 0 is taken as occupancy and sets the chance to stay active; scores outside [0, 1] and strands
    other than + - . raise an error; records without strand are left out.
    """
    checked = F.when(~F.col("strand").isin("+", "-", "."), F.raise_error(F.concat(F.lit("bad strand: "), "strand"))).when(~F.col("score").between(0, 1), F.raise_error(F.concat(F.lit("bad score: "), F.col("score").cast("string")))).otherwise(F.col("score"))
    kept = records.withColumn("score", checked).where("strand <> '.'")
    active = F.when(F.col("score") != 0, stp_active_from_occupancy(F.lit(stp_inactive), F.col("score"))).otherwise(F.lit(stp_active)) if score_is_occupancy else F.lit(stp_active)
    return kept.select("chrom", "start", "end", barrier_position(F.col("start"), F.col("end")).alias("pos"), active.alias("stp_active"), F.lit(float(stp_inactive)).alias("stp_inactive"), blocking_direction(F.col("strand")).alias("blocks"))


def duplicates(records: DataFrame) -> DataFrame:
    """Places (chrom, start, end) that several records have."""
    return records.groupBy("chrom", "start", "end").agg(F.count("*").alias("n")).where("n > 1")


def map_to_intervals(barriers: DataFrame, intervals: DataFrame) -> DataFrame:
    """(interval_id, pos, stp_active, stp_inactive, blocks) of each barrier record that overlaps an interval."""
    joined = overlap_join(intervals.select("interval_id", "chrom", "start", "end"), barriers)
    return joined.select("interval_id", "chrom", F.col("r_pos").alias("pos"), F.col("r_stp_active").alias("stp_active"), F.col("r_stp_inactive").alias("stp_inactive"), F.col("r_blocks").alias("blocks"))


def annotate(records: DataFrame, track: DataFrame, scale: float, lower: float = 0.0, upper: float = 1.0, clamp: bool = False) -> DataFrame:
    """BED6 records with the score replaced by the logistic of the track's largest value over them.

    Scores outside [lower, upper] are brought to the bounds with ``clamp``, else the record is dropped; records
    without any value are dropped, too. Repeated records stay as many.
    """
    key = ["chrom", "start", "end", "name", "strand"]
    counted = records.groupBy(*key).agg(F.count("*").alias("_times"))  # equal records have one score
    best = overlap_join(counted, track.where(~F.isnan("value"))).groupBy(*key, "_times").agg(F.max("r_value").alias("_max"))
    score = logistic(F.col("_max"), scale)
    scored = best.withColumn("score", F.greatest(F.lit(lower), F.least(F.lit(upper), score)) if clamp else score)
    kept = scored.where(F.col("score").between(lower, upper))
    return kept.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("chrom", "start", "end", "name", "score", "strand")


def with_occupancy(barriers: DataFrame, occupancy: float, stp_inactive: float) -> DataFrame:
    """``barriers`` with the chances that one occupancy gives all of them."""
    return barriers.withColumns({"stp_active": stp_active_from_occupancy(F.lit(float(stp_inactive)), F.lit(float(occupancy))), "stp_inactive": F.lit(float(stp_inactive))})


def format_bed(records: DataFrame, fields: int = 6) -> DataFrame:
    """One tab-separated line for each record, with its first ``fields`` fields (3 to 12). A missing colour is 0,0,0 and
    lists are joined by commas."""
    shown = []
    for name in BED_FIELDS[:fields]:
        kind = records.schema[name].dataType.typeName()
        text = F.array_join(F.transform(F.col(name), lambda x: x.cast("string")), ",") if kind == "array" else F.col(name).cast("string")
        shown.append(F.coalesce(text, F.lit("0,0,0")) if name == "rgb" else F.coalesce(text, F.lit(".")))
    return records.select(F.concat_ws("\t", *shown).alias("line"))
