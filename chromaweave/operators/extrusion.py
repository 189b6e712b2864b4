"""Chance in tables: barrier states, activation, binding, moves and contacts of extruding units over whole tables.

Luck is a column: a digest of the seed, the name of the draw and the row's keys. So a draw is the same wherever and however
often its row is computed, needs no state carried from row to row, and no two draws of different keys depend on each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaweave.functions.formulas import genextreme, occupancy_from_stp
from chromaweave.tables import running

#: Draws that one row of the first step of ``sampled_contacts`` stands for.
_BLOCK = 1_024
#: Largest rate at which exp(-rate) is a normal number.
_MOST = 700


def uniform(seed: int, stream: str, *keys: str | Column) -> Column:
    """A number in [0, 1), 52 bits of it, that depends on the seed, the stream and the keys alone; null keys count as ``-``."""
    named = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("-")) for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *named))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def _numbers(first: Column, last: Column) -> Column:
    return F.sequence(first.cast("bigint"), last.cast("bigint"))


def normal_pair(one: Column, two: Column) -> tuple[Column, Column]:
    """Two independent standard normal numbers from two uniform ones."""
    radius = F.sqrt(-2 * F.log(1 - one))
    return radius * F.cos(2 * math.pi * two), radius * F.sin(2 * math.pi * two)


def poisson(u: Column, rate: Column) -> Column:
    """Inverse distribution function: how many k have P(X <= k) <= u. Rates beyond 700 are errors; null gives null."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("below"), F.lit(0).cast("bigint").alias("k"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["below"] + p).alias("below"), (a["k"] + (a["below"] <= u).cast("bigint")).alias("k"))

    counted = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["k"])
    return F.when(rate > _MOST, F.raise_error(F.lit(f"a Poisson rate is beyond {_MOST}")).cast("bigint")).otherwise(counted)


def poisson_of_any_rate(u: Column, rate: Column) -> Column:
    """``poisson`` without a largest rate. Chances are summed relative to that of the least k that counts, 12 deviations below the
    rate, and set against their total, so exp(-rate) is not needed and the work grows with the rate's root; what lies beyond
    is less than e-30."""
    reach = 12 * F.sqrt(rate) + 24
    first = F.floor(F.greatest(rate - reach, F.lit(0.0))).cast("bigint")
    ks = F.sequence(first + 1, F.ceil(rate + reach).cast("bigint"))
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("below"))

    def add(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["below"] + p).alias("below"))

    total = F.aggregate(ks, start, add, lambda a: a["below"])
    begin = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("below"), first.alias("k"), (u * total).alias("at"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["below"] + p).alias("below"), (a["k"] + (a["below"] <= a["at"]).cast("bigint")).alias("k"), a["at"].alias("at"))

    return F.when(u > 0, F.aggregate(ks, begin, step, lambda a: a["k"])).when(u.isNotNull() & rate.isNotNull(), F.lit(0).cast("bigint"))


def initial_states(barriers: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """``barriers`` with ``active``: bound with the chance that follows from stp_active and stp_inactive, half if both are 1."""
    share = F.coalesce(occupancy_from_stp(F.col("stp_active"), F.col("stp_inactive")), F.lit(0.5))
    return barriers.withColumn("active", uniform(seed, "init", *keys) < share)


def barrier_states(barriers: DataFrame, keys: list[str], epochs: int, seed: int) -> DataFrame:
    """A row for each barrier and each epoch up to ``epochs``, with ``active``: at 0 the initial state, then a Markov chain that
    stays active with chance stp_active and inactive with chance stp_inactive.

    An epoch's luck is a map of the two states: it sends both to one, swaps them, or keeps them. The state is what the last map of
    the first kind left, swapped as often as the maps since then say; so no state is carried, and one window over a barrier's
    epochs answers. Null chances count as 0.
    """
    u = uniform(seed, "step", *keys, "epoch")
    on, off = u <= F.coalesce("stp_active", F.lit(0.0)), u > F.coalesce("stp_inactive", F.lit(0.0))
    each = initial_states(barriers, keys, seed).withColumn("epoch", F.explode(_numbers(F.lit(0), F.lit(epochs))))
    drawn = each.withColumns({"_on": F.when(F.col("epoch") == 0, F.col("active")).otherwise(on), "_off": F.when(F.col("epoch") == 0, F.col("active")).otherwise(off)})
    order = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swaps = drawn.withColumn("_swaps", F.count_if(~F.col("_on") & F.col("_off")).over(order) % 2)
    fixed = F.when(F.col("_on") == F.col("_off"), (F.col("_on").cast("bigint") + F.col("_swaps")) % 2)
    state = (F.last(fixed, ignorenulls=True).over(order) + F.col("_swaps")) % 2 == 1
    return swaps.withColumn("active", state).drop("_on", "_off", "_swaps")


def activation(cells: DataFrame, keys: list[str], epochs: int, activation_epochs: int, seed: int) -> DataFrame:
    """(keys, epoch, arrivals, awake) of a burn-in: units of a cell wake up at a rate of lefs / ``activation_epochs`` an epoch until
    all ``lefs`` are awake. The first epoch's number is drawn until it is not 0, which is a draw above P(X = 0)."""
    rate = F.col("lefs") / float(activation_epochs)
    u = uniform(seed, "awake", *keys, "epoch")
    none = F.exp(-rate)
    each = cells.withColumn("epoch", F.explode(_numbers(F.lit(0), F.lit(epochs - 1))))
    drawn = each.withColumn("arrivals", poisson_of_any_rate(F.when(F.col("epoch") == 0, none + u * (1 - none)).otherwise(u), rate))
    order = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return drawn.select(*keys, "epoch", "arrivals", F.least("lefs", F.sum("arrivals").over(order)).cast("bigint").alias("awake"))


def bound(units: DataFrame, keys: list[str], epoch: int, seed: int) -> DataFrame:
    """``units`` with those that have no place (null rev) bound to one of [start, end - 1], each equally likely, as of ``epoch``."""
    place = F.col("start") + F.floor(uniform(seed, "bind", *keys, F.lit(epoch)) * (F.col("end") - F.col("start"))).cast("bigint")
    free = F.col("rev").isNull()
    return units.withColumns({"rev": F.when(free, place).otherwise(F.col("rev")), "fwd": F.when(free, place).otherwise(F.col("fwd")), "epoch": F.when(free, F.lit(epoch)).otherwise(F.col("epoch"))})


def drawn_moves(units: DataFrame, keys: list[str], epoch: int, speeds: tuple[float, float], spreads: tuple[float, float], seed: int) -> DataFrame:
    """``units`` with rev_move and fwd_move: normal, at least 0, rounded half up; 0 for units that have no place. A spread of 0
    gives the speed itself."""
    luck = normal_pair(uniform(seed, "radius", *keys, F.lit(epoch)), uniform(seed, "angle", *keys, F.lit(epoch)))
    moves = {}
    for name, z, mean, spread in zip(("rev_move", "fwd_move"), luck, speeds, spreads):
        drawn = F.floor(F.greatest(F.lit(0.0), float(mean) + float(spread) * z) + 0.5) if spread else F.floor(F.lit(float(mean)) + 0.5)
        moves[name] = F.when(F.col("rev").isNull(), F.lit(0)).otherwise(drawn).cast("bigint")
    return units.withColumns(moves)


def _noisy(draws: DataFrame, units: DataFrame, keys: list[str], noise: tuple[float, float, float], seed: int, stream: str) -> DataFrame:
    """Each draw with the ends ``pos1`` and ``pos2`` of a unit chosen with equal chances, moved outwards by extreme-value noise;
    draws whose unit or whose ends are not inside the interval are left out."""
    chosen = draws.withColumn("index", F.floor(uniform(seed, f"{stream}-unit", *keys, "nth") * F.col("lefs")).cast("bigint"))
    # sorted and merged: Spark knows the size of the blocks only, and would send all their draws through the driver
    placed = chosen.join(units.select(*keys, "index", "rev", "fwd").hint("merge"), [*keys, "index"])
    jitter = [genextreme(F.greatest(uniform(seed, f"{stream}-{end}", *keys, "nth"), F.lit(1e-300)), *noise) for end in ("low", "high")]
    # as rows of one, so that the conditions below do not compute the noise anew
    ends = placed.select("*", F.inline(F.array(F.struct((F.col("rev") - jitter[0]).alias("_a"), (F.col("fwd") + jitter[1]).alias("_b")))))
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    first, last = F.col("start") + 1, F.col("end") - 1
    good = (F.least("rev", "fwd") > first) & (F.greatest("rev", "fwd") < last) & (low >= first) & (high < last)
    return ends.where(good).withColumns({"pos1": F.floor(low).cast("bigint"), "pos2": F.floor(high).cast("bigint")}).drop("_a", "_b", "index", "rev", "fwd")


def _draws(cells: DataFrame) -> DataFrame:
    """A row for each of a cell's ``n`` draws, numbered from 0: blocks are dealt to tasks first, so no row stands for very many. The
    number of tasks is given, as blocks are so small that few tasks would get them all."""
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = cells.where("n > 0").withColumn("_block", F.explode(_numbers(F.lit(0), F.floor((F.col("n") - 1) / _BLOCK)))).repartition(tasks, F.hash(*cells.columns, "_block"))
    first = F.col("_block") * _BLOCK
    return blocks.withColumn("nth", F.explode(_numbers(first, F.least(first + _BLOCK, F.col("n")) - 1))).drop("_block")


def sampled_contacts(cells: DataFrame, units: DataFrame, keys: list[str], tad_to_loop: float, noise: tuple[float, float, float], seed: int) -> DataFrame:
    """(keys, nth, tad, pos1, pos2) of the contacts that ``n`` draws of each cell register.

    A draw is a loop's with chance 1 / (tad_to_loop + 1), which makes a cell's loops binomial; 0 gives loops only and infinity none.
    A loop's contact joins its unit's noisy ends, another one's two places between them, each equally likely. ``cells`` has the
    keys, start, end, lefs and n; ``units`` the keys, index (from 0 to lefs - 1), rev and fwd. Units without a place are never
    registered. Draws meet units by cell and index, so a large cell is spread over as many tasks as it has units.
    """
    loop = F.lit(1.0 / (tad_to_loop + 1) if math.isfinite(tad_to_loop) else 0.0)
    ends = _noisy(_draws(cells), units, keys, noise, seed, "contact").withColumn("tad", uniform(seed, "kind", *keys, "nth") >= loop)
    one, two = (F.col("pos1") + F.floor(uniform(seed, f"inside-{k}", *keys, "nth") * (F.col("pos2") - F.col("pos1") + 1)).cast("bigint") for k in (1, 2))
    inside = ends.withColumns({"_one": one, "_two": two})
    return inside.select(*keys, "nth", "tad", F.when(F.col("tad"), F.least("_one", "_two")).otherwise(F.col("pos1")).alias("pos1"), F.when(F.col("tad"), F.greatest("_one", "_two")).otherwise(F.col("pos2")).alias("pos2"))


def sampled_occupancy(cells: DataFrame, units: DataFrame, keys: list[str], noise: tuple[float, float, float], bin_size: int, seed: int) -> DataFrame:
    """(keys, bin, n): in which bins, counted from start + 1, the noisy ends of units lie that ``n`` draws of each cell choose."""
    ends = _noisy(_draws(cells), units, keys, noise, seed, "spot")
    spots = ends.select(*keys, F.explode(F.array("pos1", "pos2")).alias("_pos"), "start")
    return spots.groupBy(*keys, F.floor((F.col("_pos") - F.col("start") - 1) / bin_size).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def until_target(epochs: DataFrame, keys: list[str], target: int) -> DataFrame:
    """``epochs`` (keys, epoch, contacts) up to the one in which a cell's contacts reach ``target``, with ``taken``, its contacts that
    count, and ``done``, all up to it. A scan over many tasks; null contacts count as 0."""
    have = running(epochs, keys, ["epoch"], {"_done": ("sum", F.coalesce("contacts", F.lit(0)))})
    before = F.col("_done") - F.coalesce("contacts", F.lit(0))
    return have.where(before < target).select(*epochs.columns, F.least(F.coalesce("contacts", F.lit(0)), target - before).alias("taken"), F.least(F.col("_done"), F.lit(target)).alias("done"))
