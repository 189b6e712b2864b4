"""Banded matrices whose cells that are not kept have a value of their chromosome: the background.

Operators that move zero away change the background, one number a chromosome, and not the band's cells. These are written
out only at the end, and only for chromosomes whose background is not 0.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ["chrom", "bin1", "bin2"]


@dataclass(frozen=True)
class Matrix:
    """``pixels`` (chrom, bin1, bin2, count) with distinct places in the band, and ``chroms`` (chrom, n, background): columns, and
    the value of all other cells."""

    pixels: DataFrame
    chroms: DataFrame
    nrows: int

    @staticmethod
    def of(pixels: DataFrame, chroms: DataFrame, bin_size: int, nrows: int) -> Matrix:
        shaped = chroms.select("chrom", F.ceil(F.col("size") / bin_size).cast("bigint").alias("n"), F.lit(0.0).alias("background"))
        return Matrix(pixels.select(*PIXEL, F.col("count").cast("double").alias("count")), shaped, nrows)

    def _cells(self) -> Column:
        """Cells of a chromosome's band."""
        narrow = F.least("n", F.lit(self.nrows).cast("bigint"))
        return narrow * F.col("n") - narrow * (narrow - 1) / 2

    def _mapped(self, change) -> Matrix:
        return replace(self, pixels=self.pixels.withColumn("count", change(F.col("count"))), chroms=self.chroms.withColumn("background", change(F.col("background"))))

    def clamped(self, lower: float, upper: float) -> Matrix:
        """Every cell brought into [lower, upper]."""
        return self._mapped(lambda v: F.greatest(F.lit(float(lower)), F.least(F.lit(float(upper)), v)))

    def bounds(self, with_background: bool = False) -> DataFrame:
        """(chrom, n, background, low, high): the least and the largest value of any cell. The background counts where there are
        more cells than pixels, or ``with_background``, in full bands too."""
        found = self.pixels.groupBy("chrom").agg(F.min("count").alias("_min"), F.max("count").alias("_max"), F.count(F.lit(1)).alias("_kept"))
        more = F.coalesce("_kept", F.lit(0)) < self._cells()
        empty = F.when(more | F.lit(with_background), F.col("background"))
        return self.chroms.join(found, "chrom", "left").select("chrom", "n", "background", F.least("_min", empty).alias("low"), F.greatest("_max", empty).alias("high"))

    def normalised(self, lower: float, upper: float, with_background: bool = False) -> Matrix:
        """By chrom, values stretched to [lower, upper] from the least to the largest (``bounds``). Where all are equal they become
        null; a chrom that is all 0 stays so."""
        bounds = self.bounds(with_background)
        span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
        stretched = lambda v: (v - F.col("low")) / span * (upper - lower) + lower
        pixels = self.pixels.join(bounds.select("chrom", "low", "high"), "chrom").select(*PIXEL, stretched(F.col("count")).alias("count"))
        nothing = (F.col("low") == 0) & (F.col("high") == 0)
        chroms = bounds.select("chrom", "n", F.when(nothing, 0.0).otherwise(stretched(F.col("background"))).alias("background"))
        return replace(self, pixels=pixels, chroms=chroms)

    def discretised(self, ranges: list[tuple[float, float, float]]) -> Matrix:
        """Values in an open range replaced by its own; the first range counts."""

        def change(v: Column) -> Column:
            out = v
            for start, end, to in reversed(ranges):
                out = F.when((v > start) & (v < end), F.lit(float(to))).otherwise(out)
            return out

        return self._mapped(change)

    def cells(self) -> DataFrame:
        """(chrom, bin1, bin2, count) of all cells that are not 0. The band is written out where its background is not."""
        kept = self.pixels.where("count IS NULL OR count <> 0")
        raised = self.chroms.where("background IS NULL OR background <> 0")
        rows = raised.withColumn("bin1", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        grid = rows.withColumn("bin2", F.explode(F.sequence(F.col("bin1"), F.least(F.col("bin1") + self.nrows, F.col("n")) - 1)))
        rest = grid.join(self.pixels.select(*PIXEL), PIXEL, "left_anti")
        return kept.unionByName(rest.select(*PIXEL, F.col("background").alias("count")))
