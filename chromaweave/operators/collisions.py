"""Ranks, moves and collisions of extruding units over whole tables: one row per unit, partitioned by cell.

These are the set-oriented forms of what the simulation kernel does epoch by epoch; the kernel shares their rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaweave.tables import numbered, running


def ranked(lefs: DataFrame, cell: list[str]) -> DataFrame:
    """Ranks from 0 by position: rev units by (rev, epoch), fwd units by (fwd, epoch descending), then lef_id."""
    rev = numbered(lefs, cell, ["rev", "epoch", "lef_id"], "rev_rank")
    return numbered(rev, cell, ["fwd", F.desc("epoch"), "lef_id"], "fwd_rank")


def adjusted_moves(ranked_lefs: DataFrame, cell: list[str]) -> DataFrame:
    """Moves lengthened so that no unit overtakes its neighbour: targets stay strictly ordered by rank. One scan up by fwd_rank
    and one down by rev_rank, over many tasks."""
    up = running(ranked_lefs, cell, ["fwd_rank"], {"_far": ("max", F.col("fwd") + F.col("fwd_move") - F.col("fwd_rank"))})
    both = running(up, cell, [F.desc("rev_rank")], {"_near": ("min", F.col("rev") - F.col("rev_move") - F.col("rev_rank"))})
    moves = {"fwd_move": F.col("_far") + F.col("fwd_rank") - F.col("fwd"), "rev_move": F.col("rev") - (F.col("_near") + F.col("rev_rank"))}
    return both.withColumns(moves).drop("_far", "_near")


def clamped_moves(lefs: DataFrame) -> DataFrame:
    """Moves that end inside [start, end) of the row's interval."""
    return lefs.withColumns({"rev_move": F.least("rev_move", F.col("rev") - F.col("start")), "fwd_move": F.least("fwd_move", F.col("end") - 1 - F.col("fwd"))})


def at_boundaries(lefs: DataFrame, cell: list[str]) -> DataFrame:
    """By cell, how many rev units reach the start and how many fwd units reach the last base."""
    return lefs.groupBy(*cell).agg(F.count_if(F.col("rev") - F.col("rev_move") <= F.col("start")).alias("at_start"), F.count_if(F.col("fwd") + F.col("fwd_move") >= F.col("end") - 1).alias("at_end"))


def barrier_collisions(lefs: DataFrame, barriers: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, lef_id, unit, barrier_id, move): units whose move crosses a barrier that blocks them, with the move that
    stops one base short. Of a barrier only the first rev unit above and the last fwd unit below can hit it; of the
    barriers a unit would cross the nearest counts. ``barriers`` has the cell's columns, pos, barrier_id and blocks."""
    from chromaweave.operators.intervals import nearest_above, nearest_below

    fields = ["at", "move", "lef_id"]
    rev = lefs.select(*cell, F.col("rev").alias("pos"), F.col("rev").alias("at"), F.col("rev_move").alias("move"), "lef_id")
    fwd = lefs.select(*cell, F.col("fwd").alias("pos"), F.col("fwd").alias("at"), F.col("fwd_move").alias("move"), "lef_id")
    own = barriers.select(*cell, "pos", "barrier_id", "blocks")
    above = nearest_above(own.where("blocks = 'rev'"), rev, cell, "pos", fields).withColumn("distance", F.col("near_at") - F.col("pos")).withColumn("unit", F.lit("rev"))
    below = nearest_below(own.where("blocks = 'fwd'"), fwd, cell, "pos", fields).withColumn("distance", F.col("pos") - F.col("near_at")).withColumn("unit", F.lit("fwd"))
    hits = above.unionByName(below).where("distance > 0 AND distance <= near_move")
    return hits.groupBy(*cell, F.col("near_lef_id").alias("lef_id"), "unit").agg(F.min_by("barrier_id", "distance").alias("barrier_id"), (F.min("distance") - 1).alias("move"))


def primary_collisions(lefs: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, fwd_lef, rev_lef, pos): neighbouring units that move towards each other and meet, with the place where:
    the rev unit stops there and the fwd unit one base before."""
    rev = lefs.select(*cell, F.col("rev").alias("at"), F.lit(0).alias("kind"), F.col("rev_rank").alias("rank"), F.col("rev_move").alias("move"), "lef_id")
    fwd = lefs.select(*cell, F.col("fwd").alias("at"), F.lit(1).alias("kind"), F.col("fwd_rank").alias("rank"), F.col("fwd_move").alias("move"), "lef_id")
    order = Window.partitionBy(*cell).orderBy("at", "kind", "rank")
    before = F.lag(F.struct("at", "kind", "move", "lef_id")).over(order)
    # rev units at one place form a run; only the first has the fwd unit right before it
    pairs = rev.unionByName(fwd).withColumn("b", before).where("kind = 0 AND b.kind = 1 AND at > b.at AND at - b.at < move + b.move")
    meet = F.col("b.at") + F.round((F.col("at") - F.col("b.at")) * F.col("b.move") / (F.col("move") + F.col("b.move"))).cast("bigint")
    return pairs.select(*cell, F.col("b.lef_id").alias("fwd_lef"), F.col("lef_id").alias("rev_lef"), F.greatest(meet, F.col("b.at") + 1).alias("pos"))


def burnin_stable(epochs: DataFrame, cell: list[str], history: int, width: int, low: float = 0.95, high: float = 1.05) -> DataFrame:
    """(cell, stable): over the last ``history`` epochs (epoch, cv, loop), the smoothed values of both rise about as often
    as they fall: falls over the other steps are within [low, high]."""
    last = Window.partitionBy(*cell).orderBy(F.desc("epoch"))
    order = Window.partitionBy(*cell).orderBy("epoch")
    recent = epochs.withColumn("_age", F.row_number().over(last)).where(F.col("_age") <= history).withColumn("_place", F.row_number().over(order))
    smooth = recent.select("*", *[F.avg(c).over(order.rowsBetween(0, width - 1)).alias(f"_{c}") for c in ("cv", "loop")]).where(F.col("_place") <= history - width)
    steps = smooth.select(*cell, *[(F.col(f"_{c}") < F.lag(f"_{c}").over(order)).alias(f"_{c}") for c in ("cv", "loop")])
    counts = steps.groupBy(*cell).agg(*[F.count_if(F.col(f"_{c}")).alias(f"_{c}") for c in ("cv", "loop")])
    total = history - width
    ratio = lambda c: F.col(f"_{c}") / F.nullif(total - F.col(f"_{c}"), F.lit(0))
    return counts.select(*cell, F.coalesce(ratio("cv").between(low, high) & ratio("loop").between(low, high), F.lit(False)).alias("stable"))
