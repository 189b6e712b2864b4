"""Overlaps by brute force: lengths from 1 to a whole chromosome, repeated rows, ranges of places."""

import random

import pytest
from pyspark.sql import functions as F

from chromaweave.operators import barriers, intervals


def made(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        start = rng.randrange(0, 1 << rng.randint(1, 28))
        rows.append((k, rng.choice(["a", "a", "b"]), start, start + rng.randint(0, 1 << rng.randint(0, longest))))
    return rows + rows[:3]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, chrom string, start long, end long").repartition(3)


@pytest.mark.parametrize("one, two", [(5, 5), (28, 6), (6, 28), (28, 28), (14, 20)])
def test_overlaps_of_all_lengths(spark, one, two):
    left, right = made(1, 150, one), made(2, 150, two)
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    a, b = frame(spark, left), frame(spark, right)
    got = intervals.overlap_join(a, b)
    assert got.columns == ["id", "chrom", "start", "end", "r_id", "r_chrom", "r_start", "r_end"]
    assert sorted((r.id, r.r_id) for r in got.collect()) == want
    every = intervals.overlap_join(a, b, how="left")
    met = {i for i, _ in want}
    assert sorted((r.id, r.r_id) for r in every.collect() if r.r_id is not None) == want
    assert sorted(r.id for r in every.collect() if r.r_id is None) == sorted(r[0] for r in left if r[0] not in met)


def test_a_long_interval_among_short_ones_makes_few_rows(spark):
    """One of 250 Mbp among 20,000 of 50 bp."""
    long = frame(spark, [(0, "a", 0, 250_000_000)])
    short = spark.range(20_000).select("id", F.lit("a").alias("chrom"), (F.col("id") * 12_000).alias("start"), (F.col("id") * 12_000 + 50).alias("end"))
    dealt = intervals._dealt(long, intervals._levels_of(short), "", True)
    assert dealt.count() <= 4
    few = intervals._dealt(short, intervals._levels_of(long), "", True)
    assert few.groupBy("id").count().agg(F.max("count")).first()[0] <= 4
    assert intervals.overlap_join(long, short).count() == 20_000 and intervals.overlap_join(short, long).count() == 20_000
    # short ones do not meet one another in the bins of long ones
    both = short.unionByName(long)
    a, b = (intervals._dealt(both.select(*[F.col(c).alias(p + c) for c in both.columns]), intervals._levels_of(both), p, not p) for p in ("", "r_"))
    candidates = a.join(b, (F.col("chrom") == F.col("r_chrom")) & (F.col("_at") == F.col("_r_at")) & (F.col("_bin") == F.col("_r_bin")))
    assert candidates.count() < 4 * 20_000 + 60_000


def test_equal_range(spark):
    queries, held = made(3, 80, 20) , made(4, 120, 18)
    queries = queries[:80] + [(900, "none", 1, 5), (901, "b", 1 << 40, 1 << 41)]
    order = {c: sorted((s, e) for _, k, s, e in held if k == c) for c in ("a", "b", "none")}
    want = []
    for i, c, s, e in queries:
        own = [k for k, (x, y) in enumerate(order[c]) if s < y and x < e]
        want.append((i, own[0] if own else len(order[c]), own[-1] + 1 if own else len(order[c]), len(own)))
    got = intervals.equal_range(frame(spark, queries), frame(spark, held), "id")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    simple = frame(spark, [(0, "a", 0, 10), (1, "a", 5, 15)])
    asked = frame(spark, [(k, "a", s, e) for k, (s, e) in enumerate([(0, 4), (0, 10), (5, 15), (0, 15), (0, 25), (16, 25)])])
    ranges = {r.id: r.upper - r.lower for r in intervals.equal_range(asked, simple, "id").collect()}
    assert [ranges[k] for k in range(6)] == [1, 2, 2, 2, 2, 0]


def test_annotation_keeps_repeated_records(spark):
    records = spark.createDataFrame([("a", 0, 10, "x", 0.0, "+")] * 3 + [("a", 5, 9, "y", 0.0, "-"), ("a", 900, 901, "z", 0.0, "+")], "chrom string, start long, end long, name string, score double, strand string")
    track = spark.createDataFrame([("a", 0, 3, 1.0), ("a", 2, 8, 20.0)], "chrom string, start long, end long, value double")
    got = barriers.annotate(records, track, 20.0).collect()
    assert sorted(r.name for r in got) == ["x", "x", "x", "y"] and len({r.score for r in got}) == 1


def test_overlaps_are_counted_without_making_pairs(spark, monkeypatch):
    from chromaweave.operators import intervals as own

    dice = random.Random(4)

    def some(n, longest):
        starts = [dice.randrange(300) for _ in range(n)]
        return [(k, dice.choice("ab"), s, s + dice.randrange(longest)) for k, s in enumerate(starts)]

    queries, targets = some(60, 40) + [(98, "none", 1, 9), (99, None, 1, 9)], some(80, 9) + some(6, 250)
    frames = [spark.createDataFrame(x, "id long, chrom string, start long, end long") for x in (queries, targets)]
    places = {c: sorted((s, e) for _, x, s, e in targets if x == c) for c in "ab"}
    for q, row in zip(queries, sorted(own.overlap_counts(*frames, "id").collect())):
        met = [t for t in places.get(q[1], []) if q[2] < t[1] and t[0] < q[3]]
        assert tuple(row)[1:] == (len(met), bool(met), min(met)[0] if met else None, max(met)[0] if met else None), q
    for q, row in zip(queries, sorted(own.equal_range(*frames, "id").collect())):
        line = places.get(q[1], [])
        at = [k for k, t in enumerate(line) if q[2] < t[1] and t[0] < q[3]]
        assert tuple(row)[1:] == ((at[0], at[-1] + 1, len(at)) if at else (len(line), len(line), 0)), q

    def pairs(*_, **__):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(own, "overlap_join", pairs)
    plain = spark.range(50).selectExpr("id", "'c' AS chrom", "id AS start", "id + 100 AS end")
    assert {r.n for r in own.overlap_counts(plain, plain, "id").collect()} == {50}
    assert {(r.lower, r.upper) for r in own.equal_range(plain, plain, "id").collect()} == {(0, 50)}
