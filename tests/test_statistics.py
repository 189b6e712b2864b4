import math

import pytest
from pyspark.sql import functions as F

from chromaweave.functions import formulas, statistics
from chromaweave.operators import evaluation, matrix
from chromaweave.operators.intervals import overlap_counts, overlap_join

#: Two vectors, and below the results published for them.
V1 = [17, 86, 60, 77, 47, 3, 70, 87, 88, 92]
V2 = [70, 29, 85, 61, 80, 34, 60, 31, 73, 66]


def pairs(spark, v1=V1, v2=V2):
    return spark.createDataFrame([(0, float(a), float(b), (k + 1) / 10) for k, (a, b) in enumerate(zip(v1, v2))], "g int, x double, y double, w double")


def test_pearson(spark):
    row = pairs(spark).agg(statistics.pearson(F.col("x"), F.col("y")).alias("r"), statistics.pearson(F.col("x"), F.col("y"), F.col("w")).alias("rw")).first()
    assert row.r == pytest.approx(-0.033621194725622014, abs=1e-12)
    assert row.rw == pytest.approx(0.18923377172359993, abs=1e-12)
    assert statistics.pearson_p(row.r, 10) == pytest.approx(0.926536715854247, abs=1e-10)


def test_ties(spark):
    v1 = V1[:7] + [47] + V1[8:]
    df = pairs(spark, v1)
    assert df.agg(statistics.pearson(F.col("x"), F.col("y"))).first()[0] == pytest.approx(0.16426413174421572, abs=1e-12)
    ranked = statistics.with_ranks(statistics.with_ranks(df, ["g"], "x", "rx"), ["g"], "y", "ry")
    rho = ranked.agg(statistics.pearson(F.col("rx"), F.col("ry"))).first()[0]
    assert rho == pytest.approx(0.024316221747202587, abs=1e-12)
    assert statistics.spearman_p(rho, 10) == pytest.approx(0.9468397049085097, abs=1e-10)


def test_spearman_without_ties(spark):
    ranked = statistics.with_ranks(statistics.with_ranks(pairs(spark), ["g"], "x", "rx"), ["g"], "y", "ry")
    rho = ranked.agg(statistics.pearson(F.col("rx"), F.col("ry"))).first()[0]
    assert rho == pytest.approx(-0.16363636363636364, abs=1e-12)
    assert statistics.spearman_p(rho, 10) == pytest.approx(0.6514773427962428, abs=1e-10)
    p = spark.createDataFrame([(rho, 10)], "r double, n int").select(statistics.spearman_significance(F.col("r"), F.col("n"))).first()[0]
    assert p == pytest.approx(0.6514773427962428, abs=1e-10)


def test_constant_side_has_no_correlation(spark):
    assert pairs(spark, [5] * 10).agg(statistics.pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_moving_average(spark):
    df = spark.createDataFrame([(0, k, float(k)) for k in range(11)], "g int, k int, v double")
    assert [r.m for r in statistics.moving_average(df, ["g"], "k", "v", 3, "m").orderBy("k").collect()] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [r.m for r in statistics.moving_average(df, ["g"], "k", "v", 50, "m").collect()] == [5.0]


@pytest.mark.parametrize(("active", "inactive", "share"), [(1, 0, 1), (0, 1, 0), (0.7, 0.7, 0.5), (0.7, 0.5, 0.625), (1, 0.5, 1), (0.7, 1, 0)])
def test_occupancy(spark, active, inactive, share):
    got = spark.range(1).select(formulas.occupancy_from_stp(F.lit(float(active)), F.lit(float(inactive)))).first()[0]
    assert got == pytest.approx(share)


def test_occupancy_round_trip(spark):
    for occupancy, inactive in ((0.85, 0.7), (0.93, 0.65)):
        stp = formulas.stp_active_from_occupancy(F.lit(inactive), F.lit(occupancy))
        assert spark.range(1).select(formulas.occupancy_from_stp(stp, F.lit(inactive))).first()[0] == pytest.approx(occupancy)


def test_collision_words(spark):
    df = spark.createDataFrame([(k, i, o) for k in formulas.EVENTS for i in (0, 7, 10**9) for o in (True, False)], "kind string, i long, o boolean")
    coded = df.withColumn("w", formulas.encode_collision(F.col("kind"), F.col("i"), F.col("o")))
    d = formulas.decode_collision(F.col("w"))
    assert coded.where((d["kind"] != F.col("kind")) | (d["index"] != F.col("i")) | (d["occurred"] != F.col("o"))).count() == 0


def test_overlaps(spark):
    held = spark.createDataFrame([("c", 0, 10), ("c", 5, 15)], "chrom string, start long, end long")
    asked = spark.createDataFrame([(k, "c", s, e) for k, (s, e) in enumerate([(0, 4), (0, 10), (5, 15), (0, 25), (16, 25)])], "id int, chrom string, start long, end long")
    assert [r.n for r in overlap_counts(asked, held, "id").orderBy("id").collect()] == [1, 2, 2, 2, 0]
    assert overlap_join(asked, held, how="left").where("r_start IS NULL").select("id").collect() == [(4,)]


def test_overlap_returns_only_overlaps(spark):
    held = spark.createDataFrame([("c", 0, 100), ("c", 10, 20), ("c", 50, 60)], "chrom string, start long, end long")
    asked = spark.createDataFrame([("c", 50, 55)], "chrom string, start long, end long")
    assert {(r.r_start, r.r_end) for r in overlap_join(asked, held).collect()} == {(0, 100), (50, 60)}


def test_blur_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    n, nrows, size = 15, 6, 7_500
    full = np.zeros((n, n))
    rows = []
    for a in range(n):
        for b in range(a, min(n, a + nrows)):
            v = int(rng.integers(0, 5))
            full[a, b] = full[b, a] = v
            if v:
                rows.append(("c", a, b, v))
    kernel = matrix.gaussian(1.0)
    assert len(kernel) == 9 and math.isclose(sum(kernel), 1)
    got = matrix.blurred(spark.createDataFrame(rows, "chrom string, bin1 long, bin2 long, count long"), spark.createDataFrame([("c", size)], "chrom string, size long"), 500, nrows, 1.0)
    for r in got.collect():
        want = sum(kernel[i + 4] * kernel[j + 4] * full[min(max(r.bin1 + i, 0), n - 1), min(max(r.bin2 + j, 0), n - 1)] for i in range(-4, 5) for j in range(-4, 5))
        assert r["count"] == pytest.approx(want, abs=1e-12)
    assert got.count() == sum(1 for a in range(n) for b in range(a, min(n, a + nrows)))


def test_block_sums(spark):
    n = 100
    pixels = spark.createDataFrame([("c", a, b, 1) for a in range(n) for b in range(a, n)], "chrom string, bin1 long, bin2 long, count long")
    centres = spark.createDataFrame([("c", 0, 0), ("c", 22, 27), ("c", 99, 99)], "chrom string, bin1 long, bin2 long")
    chroms = spark.createDataFrame([("c", 500_000)], "chrom string, size long")
    assert {r["sum"] for r in matrix.block_sums(pixels, chroms, centres, 5000, 100, 5).collect()} == {25}


def test_last_column_and_row_have_length_one(spark):
    pixels = spark.createDataFrame([("c", a, b, b - a) for a in range(100) for b in range(a, min(100, a + 10))], "chrom string, bin1 long, bin2 long, count long")
    chroms = spark.createDataFrame([("c", 100)], "chrom string, size long")
    columns = matrix.column_stripes(pixels, chroms, 1)
    assert columns.where("stripe = 25").agg(F.sum("count"), F.count("*")).first() == (45, 10)
    assert columns.where("stripe = 99").count() == 1
    assert matrix.row_stripes(pixels).where("stripe = 99").count() == 1


def test_condition_on_rank_correlations_does_not_make_ranks_again(spark):
    pixels = [spark.createDataFrame([("c", a, a + k, (a * 7 + k * s) % 5) for a in range(20) for k in range(6)], "chrom string, bin1 long, bin2 long, count long") for s in (3, 4)]
    chroms = spark.createDataFrame([("c", 250)], "chrom string, size long")
    scores = evaluation.compare(*pixels, chroms, 10, 8, "spearman")
    kept = scores.where("score > -0.5 AND score < 0.9")
    assert "lambda" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in scores.collect() if r.score is not None and -0.5 < r.score < 0.9}


def test_a_full_band_is_normalised_from_zero(spark):
    chroms = spark.createDataFrame([("c", 20)], "chrom string, size long")
    full = spark.createDataFrame([("c", 0, 0, 2), ("c", 0, 1, 3), ("c", 1, 1, 4)], "chrom string, bin1 long, bin2 long, count long")
    assert {r["count"] for r in matrix.normalised(full, chroms, 10, 2).collect()} == {0.5, 0.75, 1.0}
    assert {r["count"] for r in matrix.normalised(full, chroms, 10, 2, saturation=(2, 4)).collect()} == {0.0, 0.5, 1.0} - {0.0}
