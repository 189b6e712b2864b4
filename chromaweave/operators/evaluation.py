"""Comparison of two contact matrices stripe by stripe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaweave.functions.statistics import correlation_of_moments, pearson_significance, spearman_significance
from chromaweave.operators.matrix import PIXEL, columns_of

DIRECTIONS = ("horizontal", "vertical")
METRICS = ("pearson", "spearman", "eucl_dist", "rmse", "custom")


def common_chroms(left: DataFrame, right: DataFrame) -> DataFrame:
    """Chromosomes (chrom, size) that both have with one size."""
    return left.select("chrom", "size").intersect(right.select("chrom", "size"))


def conflicting_chroms(left: DataFrame, right: DataFrame) -> DataFrame:
    """Chromosomes that both have with different sizes."""
    return left.join(right.select("chrom", F.col("size").alias("other_size")), "chrom").where("size <> other_size").select("chrom", "size", "other_size")


def invalid_regions(regions: DataFrame, chroms: DataFrame) -> DataFrame:
    """Regions on unknown chromosomes, beyond their ends, or empty."""
    return regions.join(chroms.select("chrom", "size"), "chrom", "left").where("size IS NULL OR end > size OR start >= end").drop("size")


def chroms_without_weights(chroms: DataFrame, weights: DataFrame) -> DataFrame:
    """Chromosomes that no weight is given for."""
    return chroms.select("chrom").join(weights.select("chrom").distinct(), "chrom", "left_anti")


def cut_to_regions(pixels: DataFrame, regions: DataFrame, bin_size: int) -> DataFrame:
    """Pixels inside regions (region, chrom, start, end), under the region's name, bins counted from its first."""
    own = regions.select("region", "chrom", F.floor(F.col("start") / bin_size).alias("_first"), F.ceil(F.col("end") / bin_size).alias("_last"))
    inside = pixels.join(own, "chrom").where((F.col("bin1") >= F.col("_first")) & (F.col("bin2") < F.col("_last")))
    return inside.select(F.col("region").alias("chrom"), (F.col("bin1") - F.col("_first")).alias("bin1"), (F.col("bin2") - F.col("_first")).alias("bin2"), "count")


def reciprocal_weights(weights: DataFrame, reciprocal: bool = True) -> DataFrame:
    """(chrom, diag, weight): missing, NaN and zero weights are 0; others are inverted if asked for."""
    w = F.col("weight").cast("double")
    bad = w.isNull() | F.isnan(w) | (w == 0)
    return weights.select("chrom", "diag", F.when(bad, F.lit(0.0)).otherwise((1 / F.nullif(w, F.lit(0.0))) if reciprocal else w).alias("weight"))


def stripes(reference: DataFrame, target: DataFrame, chroms: DataFrame, bin_size: int) -> DataFrame:
    """(chrom, direction, stripe, k, x, y): both matrices' counts where either is not 0, in rows and in columns from
    the diagonal outwards. A column's stripe ends as far from the diagonal as the column lies from the last one."""
    one = reference.select(*PIXEL, F.col("count").cast("double").alias("x"))
    two = target.select(*PIXEL, F.col("count").cast("double").alias("y"))
    both = one.join(two, PIXEL, "full").na.fill(0.0, ["x", "y"]).where("x <> 0 OR y <> 0")
    shaped = both.join(chroms.select("chrom", columns_of(F.col("size"), bin_size).alias("_n")), "chrom")
    k = F.col("bin2") - F.col("bin1")
    places = F.array(F.struct(F.lit("horizontal").alias("direction"), F.col("bin1").alias("stripe")), F.struct(F.lit("vertical").alias("direction"), F.col("bin2").alias("stripe")))
    out = shaped.select("chrom", "_n", k.alias("k"), "x", "y", F.explode(places).alias("p")).select("chrom", "_n", "p.direction", "p.stripe", "k", "x", "y")
    return out.where("direction = 'horizontal' OR k < _n - stripe").drop("_n")


def _every_stripe(chroms: DataFrame, bin_size: int, nrows: int) -> DataFrame:
    ncols = columns_of(F.col("size"), bin_size)
    return chroms.select("chrom", "size", F.least(ncols, F.lit(nrows)).alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), ncols - 1)).alias("stripe"), F.array(*map(F.lit, DIRECTIONS)).alias("d")).select("chrom", "size", "n", "stripe", F.explode("d").alias("direction"))


def compare(reference: DataFrame, target: DataFrame, chroms: DataFrame, bin_size: int, nrows: int, metric: str, weights: DataFrame | None = None, without_zeros: bool = False, significance: bool = False) -> DataFrame:
    """(chrom, start, end, direction, score[, significance] or correct, incorrect) of every stripe, each padded with zeros
    to the band's width.

    ``weights`` has (chrom, diag, weight); distances it lacks weigh 0. ``without_zeros`` gives pairs that are both 0
    no weight. Correlations of constant stripes are null, but Spearman's is 1 if a side is all 0. ``custom``
    counts, up to the nearer of both sides' outermost contacts, the pixels that agree (correct) and that do not.
    ``significance`` adds two-sided p-values of correlations, null where there are weights.
    """
    key = ["chrom", "direction", "stripe"]
    found = stripes(reference, target, chroms, bin_size)
    total = None
    if weights is not None:
        own = weights.select("chrom", F.col("diag").alias("k"), F.col("weight").alias("w"))
        found = found.join(own, ["chrom", "k"], "left").na.fill(0.0, ["w"])
        total = own.where(F.col("k") < nrows).groupBy("chrom").agg(F.sum("w").alias("_w"))
    else:
        found = found.withColumn("w", F.lit(1.0))
    frame = _every_stripe(chroms, bin_size, nrows)
    frame = frame.join(total, "chrom", "left").na.fill(0.0, ["_w"]) if total is not None else frame.withColumn("_w", F.col("n").cast("double"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    if metric == "custom":
        # a stripe has no more places than the band is wide, so those that differ can be listed
        reach = found.groupBy(*key).agg(F.max(F.when(x != 0, F.col("k"))).alias("_x"), F.max(F.when(y != 0, F.col("k"))).alias("_y"), F.collect_list(F.when(x != y, F.col("k"))).alias("_differ"))
        ends = reach.select(*key, "_differ", F.least(F.coalesce("_x", F.lit(0)), F.coalesce("_y", F.lit(0))).alias("_low"), F.greatest(F.coalesce("_x", F.lit(0)), F.coalesce("_y", F.lit(0))).alias("_high"))
        wrong = ends.select(*key, F.expr("size(filter(_differ, k -> k >= _low AND k < _high))").cast("bigint").alias("incorrect"), (F.col("_high") - F.col("_low")).alias("_span"))
        out = frame.join(wrong, key, "left").na.fill(0, ["incorrect", "_span"])
        return _placed(out, bin_size, [(F.col("_span") - F.col("incorrect")).alias("correct"), F.col("incorrect")])
    if metric == "spearman":
        out = _rank_moments(found, key, frame)
    else:
        moments = found.groupBy(*key).agg(*[F.sum(e).alias(n) for n, e in {"sw": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "syy": w * y * y, "sxy": w * x * y, "sd": w * (x - y) * (x - y)}.items()])
        out = frame.join(moments, key, "left").na.fill(0.0, ["sw", "sx", "sy", "sxx", "syy", "sxy", "sd"])
    n = F.col("sw") if without_zeros else F.col("_w")
    if metric == "eucl_dist":
        score = F.sqrt("sd")
    elif metric == "rmse":
        score = F.sqrt(F.col("sd") / F.nullif(n, F.lit(0.0)))
    elif metric == "pearson":
        score = correlation_of_moments(n, *(F.col(c) for c in ("sx", "sy", "sxx", "syy", "sxy")))
    elif metric == "spearman":
        # ranks of the pairs of zeros, which no row stands for
        zeros = (F.col("n") - F.col("_m")) if not without_zeros else F.lit(0)
        rx, ry = F.col("_zx"), F.col("_zy")
        r = correlation_of_moments(F.col("sw") + zeros, F.col("sx") + zeros * rx, F.col("sy") + zeros * ry, F.col("sxx") + zeros * rx * rx, F.col("syy") + zeros * ry * ry, F.col("sxy") + zeros * rx * ry)
        score = F.when(F.col("_ax") & F.col("_ay"), r).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"{metric!r} is none of {METRICS}")
    values = [score.alias("score")]
    if significance and metric in ("pearson", "spearman"):
        p_value = pearson_significance if metric == "pearson" else spearman_significance
        out = out.withColumn("_score", score)
        values = [F.col("_score").alias("score"), (p_value(F.col("_score"), F.col("n").cast("bigint")) if weights is None else F.lit(None).cast("double")).alias("significance")]
    return _placed(out, bin_size, values)


def _placed(out: DataFrame, bin_size: int, values: list[Column]) -> DataFrame:
    start = F.col("stripe") * bin_size
    return out.select("chrom", start.alias("start"), F.least(start + bin_size, F.col("size")).alias("end"), "direction", *values)


def _rank_moments(found: DataFrame, key: list[str], frame: DataFrame) -> DataFrame:
    """``frame`` with sums over the mean ranks of a stripe's pairs in the padded stripe (sw, sx, sy, sxx, syy, sxy), their number
    _m, the ranks _zx and _zy of a zero, and whether a side has anything but zeros (_ax, _ay).

    A value's rank follows from a window over its stripe's pairs, no more than the band is wide, and the zeros that no row stands for.
    The sums are an aggregation, so that a condition on them is not moved below it and no rank is made twice.
    """
    own = Window.partitionBy(*key)
    sized = found.join(frame.select("chrom", "n").distinct(), "chrom")
    missing = F.col("n") - F.count(F.lit(1)).over(own)
    ranked = sized.withColumn("_missing", missing)
    for side in ("x", "y"):
        v, ties = F.col(side), F.count(F.lit(1)).over(Window.partitionBy(*key, side))
        first = F.rank().over(own.orderBy(side)) - 1
        ranked = ranked.withColumn(f"_r{side}", first + F.when(v > 0, F.col("_missing")).otherwise(0) + (ties - 1 + F.when(v == 0, F.col("_missing")).otherwise(0)) / 2)
    x, y, w = F.col("_rx"), F.col("_ry"), F.col("w")
    sums = {"sw": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "syy": w * y * y, "sxy": w * x * y}
    sides = [c for s in ("x", "y") for c in (F.count_if(F.col(s) < 0).alias(f"_below_{s}"), F.count_if(F.col(s) != 0).alias(f"_others_{s}"))]
    moments = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("_m"), *sides, *[F.sum(e).alias(c) for c, e in sums.items()])
    out = frame.join(moments, key, "left").na.fill(0, ["_m", *(f"_{k}_{s}" for k in ("below", "others") for s in ("x", "y")), *sums])
    zero = {f"_z{s}": F.col(f"_below_{s}") + (F.col("n") - F.col(f"_others_{s}") - 1) / 2 for s in ("x", "y")}
    return out.withColumns(zero | {f"_a{s}": F.col(f"_others_{s}") > 0 for s in ("x", "y")})
