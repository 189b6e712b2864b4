"""Weighted moments, correlations and their significance, as columns over grouped or windowed rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaweave.tables import numbered, running


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.nullif(F.sum(w), F.lit(0.0))


def weighted_covariance(x: Column, y: Column, w: Column) -> Column:
    """Population covariance of weighted pairs, about their weighted means."""
    return weighted_mean(x * y, w) - weighted_mean(x, w) * weighted_mean(y, w)


def squared_deviations(x: Column) -> Column:
    """Sum of squared deviations from the mean."""
    return F.var_pop(x) * F.count(x)


def euclidean(a: Column, b: Column, w: Column | float = 1.0) -> Column:
    return F.sqrt(F.sum(F.lit(w) * (a - b) * (a - b)) if isinstance(w, float) else F.sum(w * (a - b) * (a - b)))


def rmse(a: Column, b: Column, w: Column) -> Column:
    return F.sqrt(F.sum(w * (a - b) * (a - b)) / F.nullif(F.sum(w), F.lit(0.0)))


def correlation_of_moments(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r from (weighted) sums, within [-1, 1]; null where a side is constant up to rounding."""

    def spread(s: Column, ss: Column) -> Column:
        v = n * ss - s * s
        return F.when(v > 1e-12 * n * ss, v)

    r = (n * sxy - sx * sy) / F.sqrt(spread(sx, sxx) * spread(sy, syy))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pearson(x: Column, y: Column, w: Column | None = None) -> Column:
    """(Weighted) Pearson's r as an aggregate."""
    w = F.lit(1.0) if w is None else w
    return correlation_of_moments(F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * y * y), F.sum(w * x * y))


def _histogram(rows: DataFrame, groups: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """Of each value of a group: how many rows have it, with further sums, and how many have it or a smaller one."""
    counted = rows.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in sums.items()])
    return running(counted, groups, [value], {"_to": ("sum", F.col(next(iter(sums), "_n")))})


def _looked_up(rows: DataFrame, histogram: DataFrame, keys: list[str], out: str, rank: Column) -> DataFrame:
    found = histogram.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)], rank.alias(out))
    return rows.join(found, [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(keys)]).select(*rows.columns, out)


def with_ranks(rows: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Ranks from 0 within groups; ties share their mean. Equal values are counted first, ranks follow from running sums over the
    distinct values, and rows look theirs up."""
    held = _histogram(rows, groups, value, {})
    return _looked_up(rows, held, [*groups, value], out, F.col("_to") - F.col("_n") + (F.col("_n") - 1) / 2)


def with_weighted_ranks(rows: DataFrame, groups: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Weight of all smaller values, plus half of (ties + 1) times the mean weight of the ties; found as in ``with_ranks``."""
    held = _histogram(rows, groups, value, {"_tied": F.sum(weight), "_mean": F.avg(weight)})
    return _looked_up(rows, held, [*groups, value], out, F.col("_to") - F.col("_tied") + (F.col("_n") + 1) / 2 * F.col("_mean"))


#: Rows of a group that one window holds, besides those that it borrows from the next.
_BLOCK = 4096


def moving_average(rows: DataFrame, groups: list[str], order: str, value: str, width: int, out: str) -> DataFrame:
    """Means of ``width`` neighbours: n - width of them (the last window is left out); one mean if width >= n. Groups are cut
    into blocks, each with the first rows of the next."""
    size = max(_BLOCK, width)
    placed = numbered(rows, groups, [order], "_place", "_n")
    block = F.floor(F.col("_place") / size)
    home = placed.withColumn("_block", block)
    lent = placed.where((F.col("_place") % size < width - 1) & (block > 0)).withColumn("_block", block - 1)
    here = Window.partitionBy(*groups, "_block").orderBy("_place")
    some = home.unionByName(lent).select("*", F.avg(value).over(here.rowsBetween(0, width - 1)).alias("_some")).where(F.col("_block") == block)
    kept = some.where((F.col("_place") < F.col("_n") - width) | ((F.col("_n") <= width) & (F.col("_place") == 0)))
    return kept.withColumn(out, F.col("_some")).select(*rows.columns, out)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction, for arrays of one length."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    inner = (x > 0) & (x < 1)
    p, q, z = a[inner], b[inner], x[inner]
    gamma = {v: math.lgamma(v) for v in np.unique(np.concatenate([p, q, p + q])).tolist()}
    log_gamma = [np.array([gamma[v] for v in part.tolist()]) for part in (p + q, p, q)]
    front = np.exp(p * np.log(z) + q * np.log1p(-z) + log_gamma[0] - log_gamma[1] - log_gamma[2]) / p
    tiny = 1e-300
    f, c, d = np.ones(len(z)), np.ones(len(z)), np.zeros(len(z))
    open_ = np.ones(len(z), bool)
    for step in range(400):
        m = step // 2
        if step == 0:
            factor = np.ones(len(z))
        elif step % 2 == 0:
            factor = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        else:
            factor = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1 + factor * d
        d = 1 / np.where(d == 0, tiny, d)
        c = 1 + factor / c
        c = np.where(c == 0, tiny, c)
        f = np.where(open_, f * c * d, f)
        open_ &= np.abs(1 - c * d) >= 1e-15
        if not open_.any():
            break
    out = np.where(x >= 1, 1.0, 0.0)
    out[inner] = front * (f - 1)
    return np.where(turned, 1 - out, out)


def pearson_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Pearson's r over n pairs; NaN for fewer than three."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    half = np.where(n > 2, n / 2 - 1, 1.0)
    return np.where((n > 2) & ~np.isnan(r), 2 * incomplete_beta(half, half, (1 - np.abs(np.nan_to_num(r))) / 2), np.nan)


def spearman_p(rho: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Spearman's rho over n pairs, by Student's t with n - 2 degrees of freedom."""
    rho, n = np.asarray(rho, float), np.asarray(n, float)
    free, own = np.where(n > 2, n - 2, 1.0), np.nan_to_num(rho)
    whole = np.abs(own) >= 1
    t2 = np.where(whole, 0, own * own * free / np.where(whole, 1, 1 - own * own))
    p = np.where(whole, 0.0, incomplete_beta(free / 2, np.full(own.shape, 0.5), free / (free + t2)))
    return np.where((n > 2) & ~np.isnan(rho), p, np.nan)


def _vectorised(function):
    @F.pandas_udf("double")
    def p_value(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for r, n in parts:
            p = pd.Series(function(r.to_numpy(float), n.to_numpy(float)))
            yield p.where(p.notna(), None)

    return p_value


def pearson_significance(r: Column, n: Column) -> Column:
    return _vectorised(pearson_p)(r, n)


def spearman_significance(rho: Column, n: Column) -> Column:
    return _vectorised(spearman_p)(rho, n)
