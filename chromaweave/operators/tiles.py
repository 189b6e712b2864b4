"""Stencils over banded symmetric matrices by square tiles with borders of their neighbours.

A cell goes to its own tile and to those whose border it lies in: four at most, and few more than one for a tile much larger
than the stencil, whatever the stencil's size. A tile is filled in numpy, beyond the matrix with its edge, and worked one axis
at a time; it is the unit of work, of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along a tile's side, or as many as a stencil reaches, if that is more.
_SIDE = 256

_KEY = ["chrom", "_n", "_i", "_j"]


def _side(reach: int) -> int:
    return max(_SIDE, reach)


def _tiles_near(at: Column, reach: int) -> Column:
    """The one or two tiles along an axis that a cell lies in or close to."""
    side = _side(reach)
    return F.sequence(F.greatest(F.lit(0).cast("bigint"), F.floor((at - reach) / side)), F.least(F.floor((F.col("_n") - 1) / side), F.floor((at + reach) / side)))


def _dealt(pixels: DataFrame, reach: int) -> DataFrame:
    """Pixels (chrom, _n, bin1, bin2, count) of the upper triangle, and what of the lower is close to it, by tile of the upper."""
    side = _side(reach)
    values = ["chrom", "_n", "count"]
    upper = pixels.select(*values, F.col("bin1").alias("r"), F.col("bin2").alias("c"))
    lower = pixels.where((F.col("bin1") < F.col("bin2")) & (F.col("bin2") - F.col("bin1") < 2 * reach + side)).select(*values, F.col("bin2").alias("r"), F.col("bin1").alias("c"))
    both = upper.unionByName(lower).withColumn("_i", F.explode(_tiles_near(F.col("r"), reach)))
    return both.withColumn("_j", F.explode(_tiles_near(F.col("c"), reach))).where("_i <= _j")


def _filled(key: tuple, cells: pa.Table, reach: int) -> np.ndarray:
    """A tile with ``reach`` more cells on each side; beyond the matrix its edge is repeated."""
    side, n = _side(reach), key[1].as_py()
    grid = np.zeros((side + 2 * reach,) * 2)
    row0, col0 = key[2].as_py() * side - reach, key[3].as_py() * side - reach
    np.add.at(grid, (cells["r"].to_numpy() - row0, cells["c"].to_numpy() - col0), cells["count"].to_numpy().astype(float))
    for axis, at in ((0, row0), (1, col0)):
        take = np.clip(np.arange(at, at + len(grid)), 0, n - 1) - at
        grid = grid.take(take, axis)
    return grid


def _shaped(pixels: DataFrame, chroms: DataFrame, bin_size: int) -> DataFrame:
    return pixels.select("chrom", "bin1", "bin2", "count").join(chroms.select("chrom", F.ceil(F.col("size") / bin_size).cast("bigint").alias("_n")), "chrom")


def _along(grid: np.ndarray, kernel: np.ndarray, side: int) -> np.ndarray:
    """The kernel along the first axis."""
    out = kernel[0] * grid[:side]
    for k in range(1, len(kernel)):
        out += kernel[k] * grid[k : k + side]
    return out


def convolved(pixels: DataFrame, chroms: DataFrame, bin_size: int, nrows: int, kernels: list[list[float]]) -> DataFrame:
    """(chrom, bin1, bin2, v0, v1, ...): the band's cells where a convolution is not 0, with each one's value. A kernel is the one
    dimension of a separable one."""
    reach = max(len(k) for k in kernels) // 2
    side = _side(reach)
    padded = [np.pad(np.array(k, float), reach - len(k) // 2) for k in kernels]

    def run(key: tuple, cells: pa.Table) -> pa.Table:
        grid = _filled(key, cells, reach)
        made = [_along(_along(grid, k, side).T, k, side).T for k in padded]
        row, col = np.arange(side)[:, None] + key[2].as_py() * side, np.arange(side)[None] + key[3].as_py() * side
        n = key[1].as_py()
        keep = (row < n) & (col < n) & (col >= row) & (col - row < nrows) & np.any([m != 0 for m in made], axis=0)
        i, j = np.nonzero(keep)
        columns = {"bin1": pa.array(i + key[2].as_py() * side), "bin2": pa.array(j + key[3].as_py() * side), **{f"v{k}": pa.array(m[i, j]) for k, m in enumerate(made)}}
        return pa.table({"chrom": pa.array([key[0].as_py()] * len(i), pa.string()), **columns})

    schema = "chrom string, bin1 bigint, bin2 bigint, " + ", ".join(f"v{k} double" for k in range(len(kernels)))
    near = _dealt(_shaped(pixels, chroms, bin_size), reach).where((F.col("_j") - F.col("_i") - 1) * side < nrows)
    return near.groupBy(*_KEY).applyInArrow(run, schema)


def summed(pixels: DataFrame, chroms: DataFrame, centres: DataFrame, bin_size: int, width: int) -> DataFrame:
    """``centres`` (chrom, bin1, bin2, ...) with the sum over the ``width`` x ``width`` block around each, on either side of the
    diagonal. Centres outside the matrix are left out."""
    reach = width // 2
    side = _side(reach)
    shape = chroms.select("chrom", F.ceil(F.col("size") / bin_size).cast("bigint").alias("_n"))
    low, high = F.least("bin1", "bin2"), F.greatest("bin1", "bin2")
    asked = centres.select("chrom", "bin1", "bin2").join(shape, "chrom").where((low >= 0) & (high < F.col("_n"))).withColumns({"_i": F.floor(low / side), "_j": F.floor(high / side)})
    # repeated centres meet once
    asked = asked.groupBy(*_KEY, "bin1", "bin2").agg(F.count(F.lit(1)).alias("_times"))

    def run(key: tuple, cells: pa.Table, wanted: pa.Table) -> pa.Table:
        one, two, times = (wanted[c].to_numpy() for c in ("one", "two", "times"))
        if len(one):
            sums = np.pad(_filled(key, cells, reach).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            r, c = np.minimum(one, two) - key[2].as_py() * side, np.maximum(one, two) - key[3].as_py() * side
            w = 2 * reach + 1
            got = sums[r + w, c + w] - sums[r, c + w] - sums[r + w, c] + sums[r, c]
        else:
            got = np.zeros(0)
        every: Callable[[np.ndarray], pa.Array] = lambda v: pa.array(np.repeat(v, times))
        return pa.table({"chrom": pa.array([key[0].as_py()] * int(times.sum()), pa.string()), "bin1": every(one), "bin2": every(two), "sum": every(got)})

    cells = _dealt(_shaped(pixels, chroms, bin_size), reach)
    renamed = asked.select(*[F.col(c).alias(f"a{c}") for c in _KEY], F.col("bin1").alias("one"), F.col("bin2").alias("two"), F.col("_times").alias("times"))
    out = cells.groupBy(*_KEY).cogroup(renamed.groupBy(*[f"a{c}" for c in _KEY])).applyInArrow(run, "chrom string, bin1 bigint, bin2 bigint, sum double")
    whole = dict(pixels.dtypes)["count"] in ("tinyint", "smallint", "int", "bigint")
    return out.withColumn("sum", F.round("sum").cast("bigint")) if whole else out
