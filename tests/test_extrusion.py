import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaweave.operators import extrusion

SEED = 5


def test_draws_do_not_depend_on_partitions_and_differ_by_key(spark):
    rows = spark.range(20_000).withColumn("k", F.when(F.col("id") % 7 != 0, F.col("id")))
    u = rows.select("id", extrusion.uniform(SEED, "s", "id").alias("u"), extrusion.uniform(SEED, "t", "id").alias("v"), extrusion.uniform(SEED, "s", "k").alias("w"))
    a, b = u.toPandas().sort_values("id"), u.repartition(13).toPandas().sort_values("id")
    assert (a["u"].to_numpy() == b["u"].to_numpy()).all()
    assert a["u"].between(0, 1, inclusive="left").all() and a["u"].nunique() == 20_000
    assert abs(a["u"].mean() - 0.5) < 0.01 and abs(np.corrcoef(a["u"], a["v"])[0, 1]) < 0.03
    assert a.loc[a["id"] % 7 == 0, "w"].nunique() == 1  # null keys count as one


def test_normal_pair_has_the_moments_of_two_independent_normals(spark):
    one, two = extrusion.normal_pair(extrusion.uniform(SEED, "a", "id"), extrusion.uniform(SEED, "b", "id"))
    z = spark.range(20_000).select(one.alias("x"), two.alias("y")).toPandas()
    assert abs(z["x"].mean()) < 0.03 and abs(z["y"].mean()) < 0.03
    assert abs(z["x"].std() - 1) < 0.02 and abs(z["y"].std() - 1) < 0.02 and abs(z.corr().iloc[0, 1]) < 0.03


@pytest.mark.parametrize("rate", [0.0, 0.3, 4.0, 80.0, 700.0])
def test_poisson_is_the_inverse_distribution_function(spark, rate):
    u = (np.arange(500) + 0.37) / 500
    below, term, k, wanted = math.exp(-rate), math.exp(-rate), 0, []
    for x in u:
        while below <= x:
            k += 1
            term *= rate / k
            below += term
        wanted.append(k)
    rows = spark.createDataFrame([(float(x),) for x in u], "u double")
    assert [r[0] for r in rows.select(extrusion.poisson(F.col("u"), F.lit(rate))).collect()] == wanted


def test_poisson_of_a_rate_too_large_is_an_error_and_of_null_null(spark):
    with pytest.raises(Exception, match="beyond 700"):
        spark.range(1).select(extrusion.poisson(F.lit(0.5), F.lit(701.0))).collect()
    assert spark.range(1).select(extrusion.poisson(F.lit(None).cast("double"), F.lit(None).cast("double"))).first()[0] is None


@pytest.mark.parametrize("rate", [0.0, 0.3, 80.0, 701.0, 7_500.0, 300_000.0])
def test_poisson_of_any_rate_is_the_inverse_distribution_function(spark, rate):
    u = (np.arange(60) + 0.37) / 60
    k = np.arange(int(rate + 12 * rate**0.5 + 24))
    logs = k * math.log(rate) - rate - np.array([math.lgamma(x + 1) for x in k]) if rate else np.where(k == 0, 0.0, -np.inf)
    wanted = np.searchsorted(np.cumsum(np.exp(logs)), u, "right").tolist()
    rows = spark.createDataFrame([(float(x),) for x in u], "u double")
    assert [r[0] for r in rows.select(extrusion.poisson_of_any_rate(F.col("u"), F.lit(rate))).collect()] == wanted
    assert spark.range(1).select(extrusion.poisson_of_any_rate(F.lit(0.5), F.lit(None).cast("double"))).first()[0] is None


def test_cells_of_very_many_units_wake_up(spark):
    cells = spark.createDataFrame([(1, 9_000), (2, 3_000_000)], "cell long, lefs long")
    rows = extrusion.activation(cells, ["cell"], 40, 12, SEED).toPandas()
    share = rows["arrivals"] / rows["cell"].map({1: 750, 2: 250_000})
    assert ((share - 1).abs() < 0.25).all() and (rows[rows["epoch"] == 39].sort_values("cell")["awake"].to_list() == [9_000, 3_000_000])


def test_barrier_chains_follow_their_maps_one_by_one(spark):
    chances = [(k, a, b) for k, (a, b) in enumerate([(0.7, 0.7), (0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.2, 0.9), (0.95, 0.1)] * 20)]
    table = spark.createDataFrame(chances, "id long, stp_active double, stp_inactive double")
    got = {(r["id"], r["epoch"]): r["active"] for r in extrusion.barrier_states(table, ["id"], 40, SEED).collect()}
    luck = {(r["id"], r["epoch"]): r["u"] for r in table.crossJoin(spark.range(41).withColumnRenamed("id", "epoch")).select("id", "epoch", extrusion.uniform(SEED, "step", "id", "epoch").alias("u")).collect()}
    assert len(got) == len(chances) * 41
    for k, on, off in chances:
        state = got[k, 0]
        for epoch in range(1, 41):
            state = luck[k, epoch] <= on if state else luck[k, epoch] > off
            assert got[k, epoch] == state, (k, epoch)


def test_activation_starts_with_a_unit_and_stops_at_all(spark):
    cells = spark.createDataFrame([(k, 1 + k % 40) for k in range(200)], "cell long, lefs long")
    rows = extrusion.activation(cells, ["cell"], 60, 20, SEED).toPandas().sort_values(["cell", "epoch"])
    first = rows[rows["epoch"] == 0]
    assert (first["arrivals"] >= 1).all() and (first["awake"] >= 1).all()
    for cell, own in rows.groupby("cell"):
        assert (np.minimum(own["arrivals"].cumsum(), 1 + cell % 40) == own["awake"]).all()
    later = rows[rows["epoch"] > 0].merge(cells.toPandas(), on="cell")
    assert abs((later["arrivals"] - later["lefs"] / 20).mean()) < 0.05


def test_bound_and_moves_of_units_without_a_place(spark):
    units = spark.createDataFrame([(k, 100, 110, None if k % 2 else 105, None if k % 2 else 107, 3) for k in range(2_000)], "id long, start long, end long, rev long, fwd long, epoch int")
    placed = extrusion.bound(units, ["id"], 8, SEED).toPandas()
    new = placed[placed["id"] % 2 == 1]
    assert (new["rev"] == new["fwd"]).all() and set(new["rev"]) == set(range(100, 110)) and (new["epoch"] == 8).all()
    old = placed[placed["id"] % 2 == 0]
    assert (old["rev"] == 105).all() and (old["fwd"] == 107).all() and (old["epoch"] == 3).all()
    moved = extrusion.drawn_moves(units, ["id"], 8, (50, 40.5), (20, 0), SEED).toPandas()
    assert (moved.loc[moved["id"] % 2 == 1, ["rev_move", "fwd_move"]] == 0).all().all()
    even = moved[moved["id"] % 2 == 0]
    assert (even["fwd_move"] == 41).all() and (even["rev_move"] >= 0).all() and abs(even["rev_move"].mean() - 50) < 2


@pytest.mark.parametrize("ratio,share", [(0.0, 1.0), (5.0, 1 / 6), (math.inf, 0.0)])
def test_contacts_lie_between_the_ends_that_they_come_from(spark, ratio, share):
    cells = spark.createDataFrame([(1, 0, 100_000, 3, 5_000), (2, 0, 100_000, 1, 0), (3, 0, 100_000, 1, 10)], "cell long, start long, end long, lefs long, n long")
    units = spark.createDataFrame([(1, 0, 40_000, 60_000), (1, 1, 1, 50_000), (1, 2, None, None), (3, 0, 99_999, 99_999)], "cell long, index long, rev long, fwd long")
    got = extrusion.sampled_contacts(cells, units, ["cell"], ratio, (0.0, 1.0, 0.001), SEED).toPandas()
    assert set(got["cell"]) == {1} and abs(len(got) - 5_000 / 3) < 150  # ends of the others are no places inside, or are none
    assert abs((~got["tad"]).mean() - share) < 0.04
    assert (got["pos1"] <= got["pos2"]).all() and got["nth"].is_unique
    assert got["pos1"].between(40_000 - 40, 60_000 + 40).all() and got["pos2"].between(40_000 - 40, 60_000 + 40).all()
    loops = got[~got["tad"]]
    assert (loops["pos1"] <= 40_002).all() and (loops["pos2"] >= 59_998).all()


def test_occupancy_counts_both_ends(spark):
    cells = spark.createDataFrame([(1, 1_000, 101_000, 1, 3_000)], "cell long, start long, end long, lefs long, n long")
    units = spark.createDataFrame([(1, 0, 41_500, 61_500)], "cell long, index long, rev long, fwd long")
    got = {r["bin"]: r["n"] for r in extrusion.sampled_occupancy(cells, units, ["cell"], (0.0, 1.0, 0.001), 1_000, SEED).collect()}
    assert got == {40: 3_000, 60: 3_000}


def test_epochs_stop_where_the_target_is_reached(spark):
    rows = [("a", 0, 4), ("a", 1, None), ("a", 2, 6), ("a", 3, 5), ("b", 0, 2), (None, 0, 11)]
    got = extrusion.until_target(spark.createDataFrame(rows, "cell string, epoch long, contacts long"), ["cell"], 10)
    assert {(r["cell"], r["epoch"]): (r["taken"], r["done"]) for r in got.collect()} == {("a", 0): (4, 4), ("a", 1): (0, 4), ("a", 2): (6, 10), ("b", 0): (2, 2), (None, 0): (10, 10)}
    assert got.limit(0).count() == 0


def test_draws_of_few_blocks_are_dealt_to_all_tasks(spark):
    cells = spark.createDataFrame([(k, 40_000) for k in range(5)], "cell long, n long")
    draws = extrusion._draws(cells)
    parts = draws.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 200_000 and len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("sampled", ["contacts", "occupancy"])
def test_draws_are_never_sent_through_the_driver(spark, sampled):
    """Of the draws Spark knows their blocks' size only, which is small however many draws there are."""
    units = spark.range(90_000).select((F.col("id") % 3).alias("cell"), F.floor(F.col("id") / 3).alias("index"), (F.col("id") + 2_000).alias("rev"), (F.col("id") + 4_000).alias("fwd"))
    cells = spark.range(3).select(F.col("id").alias("cell"), F.lit(0).alias("start"), F.lit(200_000).alias("end"), F.lit(30_000).alias("lefs"), F.lit(240_000).alias("n"))
    noise = (0.0, 1.0, 0.001)
    got = extrusion.sampled_contacts(cells, units, ["cell"], 5.0, noise, SEED) if sampled == "contacts" else extrusion.sampled_occupancy(cells, units, ["cell"], noise, 5_000, SEED)
    assert got.agg(F.sum("pos1" if sampled == "contacts" else "n")).first()[0] > 0
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and "SortMergeJoin" in final and "Broadcast" not in final
