"""Joins of half-open intervals and of points with intervals, as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaweave.tables import running, shared_table


#: Widths of bins: a level's are eight times as wide as those of the one below, from 4,096 bases on; the last spans all of 2^63.
_SMALLEST, _STEP, _TOP = 12, 3, 17


def _level(start: Column, end: Column) -> Column:
    """The first level at which an interval is no longer than a bin, and so lies in two bins at most."""
    bits = F.length(F.bin(F.greatest(end - 1 - start, F.lit(0))))
    return F.greatest(F.lit(0), F.ceil((bits - _SMALLEST) / _STEP)).cast("int")


def _bins(start: Column, end: Column, level: Column) -> tuple[Column, Column]:
    """First and last bin at a level; an empty interval has its start's."""
    shift = F.lit(_SMALLEST) + level * _STEP
    return F.call_function("shiftright", start, shift), F.call_function("shiftright", F.greatest(start, end - 1), shift)


def _dealt(rows: DataFrame, own_levels: Column, prefix: str, left: bool) -> DataFrame:
    """``rows`` once for each bin of each place where partners can be: side ``a`` for pairs whose left interval has the bin's own
    level and the right one that or a lower, side ``b`` for the rest."""
    start, end = F.col(f"{prefix}start"), F.col(f"{prefix}end")
    own = _level(start, end)
    rows = rows.withColumn(f"_{prefix}levels", own_levels)
    up = F.filter(f"_{prefix}levels", lambda x: x > own)
    one = lambda side: lambda x: F.struct(F.lit(side).alias("side"), x.alias("level"))
    home = F.array(own)
    places = F.concat(F.transform(home, one("a")), F.transform(up, one("b"))) if left else F.concat(F.transform(F.concat(home, up), one("a")), F.transform(home, one("b")))
    out = rows.withColumn(f"_{prefix}at", F.explode(places)).drop(f"_{prefix}levels")
    first, last = _bins(start, end, F.col(f"_{prefix}at.level"))
    return out.withColumns({f"_{prefix}first": first, f"_{prefix}bin": F.explode(F.sequence(first, last))})


def _levels_of(rows: DataFrame) -> Column:
    """The levels that intervals of a table have: at most 18 numbers."""
    return rows.select(F.collect_set(_level(F.col("start"), F.col("end")))).scalar()


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs of rows of the same chrom that overlap: columns of ``left``, then those of ``right`` with prefix ``r_``.

    Both sides have chrom, start, end, whole numbers from 0 on. Bins have several levels, eight times as wide each; an interval's
    own level is the first where it lies in two bins at most, and two intervals meet at the higher of their levels. So an
    interval makes two rows at its level and two more at each higher one that the other table has, 38 at most, however long it
    is, and short ones do not meet each other in bins of long ones. A pair is kept in the first bin it shares. ``how="left"``
    keeps unmatched rows of ``left``, repeated ones too.
    """
    named = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    a = _dealt(left, _levels_of(right), "", True)
    b = _dealt(named, _levels_of(left), "r_", False)
    meets = (F.col("chrom") == F.col("r_chrom")) & (F.col("_at") == F.col("_r_at")) & (F.col("_bin") == F.col("_r_bin")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & (F.col("_bin") == F.greatest("_first", "_r_first"))
    pairs = a.join(b, meets).drop("_at", "_first", "_bin", "_r_at", "_r_first", "_r_bin")
    if how == "inner":
        return pairs
    met = pairs.select(*[F.col(c).alias(f"_l_{c}") for c in left.columns]).distinct()  # equal rows have partners alike
    alone = left.join(met, [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in left.columns], "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def _overlap_ends(queries: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Rows (_key, chrom, n, low, high) of which a query's numbers of overlapping intervals are the sum of ``n``, and the first and
    the last of them by (start, end) the least ``low`` and the largest ``high``.

    No pairs are made. Where start < end, the overlapping intervals are those that start before the query's end, and those that end
    after its start, less all. Of the latter the least is the first one, of the former the largest is the last one, if it reaches
    the query: these are running values along a line of starts and one of ends. Queries whose last one does not reach them,
    and empty ones, are joined.
    """
    targets = intervals.select("chrom", "start", "end")
    asked = queries.where("chrom IS NOT NULL").select(F.col(key).alias("_key"), "chrom", "start", "end")
    nobody = F.lit(None).cast(asked.schema["_key"].dataType)

    def line(rows: DataFrame, side: str, pos: Column, target: int) -> DataFrame:
        return rows.select("chrom", F.lit(side).alias("_side"), pos.cast("bigint").alias("_pos"), F.lit(target).cast("bigint").alias("_target"), (nobody if target else F.col("_key")).alias("_key"), F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).alias("_span"))

    start, end, proper = F.col("start"), F.col("end"), asked.where("start < end")
    lines = line(targets, "start", start, 1).unionByName(line(proper, "start", end, 0)).unionByName(line(targets, "end", -end, 1)).unionByName(line(proper, "end", -start, 0))
    spans = F.when(F.col("_target") == 1, F.col("_span"))
    scanned = running(lines, ["chrom", "_side"], ["_pos", "_target", "_span"], {"_n": ("sum", F.col("_target")), "_low": ("min", spans), "_high": ("max", spans)})
    totals = targets.groupBy("chrom").agg(F.count(F.lit(1)).alias("_all"))
    kept = shared_table(scanned.where("_target = 0").join(totals, "chrom", "left"))
    before, after = kept.where("_side = 'start'"), kept.where("_side = 'end'")
    reaches = F.col("_high.end") > F.col("_span.start")
    none = F.lit(None).cast(kept.schema["_span"].dataType)
    one = before.select("_key", "chrom", F.col("_n").alias("n"), none.alias("low"), F.when(reaches, F.col("_high")).alias("high"))
    first = F.when(F.col("_low.start") < F.col("_span.end"), F.col("_low"))
    two = after.select("_key", "chrom", (F.col("_n") - F.coalesce("_all", F.lit(0))).alias("n"), first.alias("low"), none.alias("high"))
    out = one.unionByName(two)
    rest = before.where(~reaches).select("_key", "chrom", F.col("_span.start").alias("start"), F.col("_span.end").alias("end"), F.lit(0).alias("_counts")).unionByName(asked.where("start >= end").withColumns({"start": start.cast("bigint"), "end": end.cast("bigint"), "_counts": F.lit(1)}))
    if rest.isEmpty():
        return out
    span = F.struct(F.col("r_start").cast("bigint").alias("start"), F.col("r_end").cast("bigint").alias("end"))
    return out.unionByName(overlap_join(rest, targets).select("_key", "chrom", F.col("_counts").cast("bigint").alias("n"), span.alias("low"), span.alias("high")))


def overlap_counts(queries: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Each query's key with how many intervals overlap it, the first and the last of them by start and end."""
    hits = _overlap_ends(queries, intervals, key).groupBy(F.col("_key").alias(key)).agg(F.sum("n").alias("n"), F.min("low").alias("_low"), F.max("high").alias("_high"))
    return queries.select(key).join(hits, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("any"), F.col("_low.start").alias("lower_start"), F.col("_high.start").alias("upper_start"))


def equal_range(queries: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Each query's key with the half-open range [lower, upper) from the first to the last interval that overlaps it, as places in
    its chromosome's intervals by start and end, and how many of these do overlap. Without any: both are the number of intervals."""
    ends = _overlap_ends(queries, intervals, key).groupBy("_key", "chrom").agg(F.sum("n").alias("n"), F.min("low").alias("_low"), F.max("high").alias("_high"))
    counted = intervals.groupBy("chrom", F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).alias("_span")).agg(F.count(F.lit(1)).alias("_times"))
    places = running(counted, ["chrom"], ["_span"], {"_to": ("sum", F.col("_times"))})
    low = places.select("chrom", F.col("_span").alias("_low"), (F.col("_to") - F.col("_times")).alias("_lower"))
    high = places.select("chrom", F.col("_span").alias("_high"), F.col("_to").alias("_upper"))
    hits = ends.join(low, ["chrom", "_low"], "left").join(high, ["chrom", "_high"], "left").groupBy(F.col("_key").alias(key)).agg(F.min("_lower").alias("_lower"), F.max("_upper").alias("_upper"), F.sum("n").alias("n"))
    sizes = intervals.groupBy("chrom").agg(F.count("*").alias("_size"))
    size = F.coalesce("_size", F.lit(0))
    return queries.select(key, "chrom").join(sizes, "chrom", "left").join(hits, key, "left").select(key, F.coalesce("_lower", size).alias("lower"), F.coalesce("_upper", size).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def point_lookup(rows: DataFrame, value: str, ranges: list[tuple[float, float, float]], out: str) -> DataFrame:
    """``value`` replaced by the third number of the first range with start < value < end; as it is if there is none."""
    mapped: Column = F.col(value).cast("double")
    for start, end, to in reversed(ranges):
        mapped = F.when((F.col(value) > start) & (F.col(value) < end), F.lit(float(to))).otherwise(mapped)
    return rows.withColumn(out, mapped)


def nearest_below(points: DataFrame, targets: DataFrame, groups: list[str], pos: str, fields: list[str]) -> DataFrame:
    """``points`` with ``fields`` of the last of ``targets`` at a smaller position (strictly), null if none."""
    return _as_of(points, targets, groups, pos, fields, False)


def nearest_above(points: DataFrame, targets: DataFrame, groups: list[str], pos: str, fields: list[str]) -> DataFrame:
    """``points`` with ``fields`` of the first of ``targets`` at a larger position (strictly), null if none."""
    return _as_of(points, targets, groups, pos, fields, True)


def _as_of(points: DataFrame, targets: DataFrame, groups: list[str], pos: str, fields: list[str], above: bool) -> DataFrame:
    one = points.select(*[F.col(c) for c in groups], F.col(pos).alias("_pos"), F.struct(*points.columns).alias("_point"), F.lit(None).cast(targets.select(F.struct(*fields)).schema[0].dataType).alias("_target"))
    two = targets.select(*[F.col(c) for c in groups], F.col(pos).alias("_pos"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_point"), F.struct(*fields).alias("_target"))
    # at equal positions points come before targets below them, and after those above them
    order = [F.desc("_pos") if above else F.asc("_pos"), F.col("_point").isNull(), *[F.col(f"_target.{f}").desc() if above else F.col(f"_target.{f}").asc() for f in fields]]
    both = running(one.unionByName(two), groups, order, {"_seen": ("last", F.col("_target"))}).where(F.col("_point").isNotNull())
    return both.select("_point.*", *[F.col(f"_seen.{f}").alias(f"near_{f}") for f in fields])
