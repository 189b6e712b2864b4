"""Tiles, backgrounds and scans against plain numpy and Python, with parts small enough to have many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaweave import tables
from chromaweave.functions import statistics
from chromaweave.operators import collisions, intervals, matrix, tiles
from chromaweave.operators.background import Matrix


def banded(seed, sizes, nrows, share=0.2):
    rng = random.Random(seed)
    return [(c, a, b, rng.randint(1, 9)) for c, n in sizes.items() for a in range(n) for b in range(a, min(n, a + nrows)) if rng.random() < share]


def square(rows, chrom, n):
    full = np.zeros((n, n))
    for c, a, b, v in rows:
        if c == chrom:
            full[a, b] = full[b, a] = v
    return full


def tables_of(spark, rows, sizes):
    return spark.createDataFrame(rows, "chrom string, bin1 long, bin2 long, count long").repartition(3), spark.createDataFrame(list(sizes.items()), "chrom string, size long")


@pytest.mark.parametrize("side, sigma", [(8, 0.5), (16, 1.7), (4, 5.0), (256, 5.0), (8, 2.0)])
def test_blur_across_tiles(spark, monkeypatch, side, sigma):
    monkeypatch.setattr(tiles, "_SIDE", side)
    sizes, nrows = {"a": 61, "b": 7, "c": 1}, 12
    rows = banded(1, sizes, nrows)
    pixels, chroms = tables_of(spark, rows, sizes)
    got = {(r.chrom, r.bin1, r.bin2): r["count"] for r in matrix.blurred(pixels, chroms, 1, nrows, sigma).collect()}
    kernel = np.array(matrix.gaussian(sigma))
    reach = len(kernel) // 2
    cells = 0
    for c, n in sizes.items():
        full = np.pad(square(rows, c, n), reach, "edge")
        along = lambda m: np.array([np.convolve(line, kernel, "valid") for line in m])
        want = along(along(full).T).T
        for a in range(n):
            for b in range(a, min(n, a + nrows)):
                assert got.get((c, a, b), 0.0) == pytest.approx(want[a, b], abs=1e-12)
                cells += want[a, b] != 0
    assert len(got) == cells and not any(b < a or b - a >= nrows for _, a, b in got)


def test_what_a_stencil_shuffles_does_not_grow_with_it(spark):
    sizes = {"a": 3000}
    rows = banded(2, sizes, 40, 0.05)
    pixels, chroms = tables_of(spark, rows, sizes)
    shaped = tiles._shaped(pixels, chroms, 1)
    copies = [tiles._dealt(shaped, reach).count() / len(rows) for reach in (2, 18, 60)]
    assert max(copies) < 4  # both triangles: less than twice (1 + 2 * 60 / 256)^2
    assert copies[1] < 1.25 * copies[0]


@pytest.mark.parametrize("width", [1, 5, 9])
def test_block_sums_across_tiles(spark, monkeypatch, width):
    monkeypatch.setattr(tiles, "_SIDE", 8)
    sizes, nrows = {"a": 50, "b": 5}, 9
    rows = banded(3, sizes, nrows)
    pixels, chroms = tables_of(spark, rows, sizes)
    rng = random.Random(4)
    centres = [(c, rng.randrange(n), rng.randrange(n)) for c, n in sizes.items() for _ in range(60)]
    centres += centres[:3] + [("a", 0, 49), ("a", 49, 49), ("b", 4, 0)]
    got = matrix.block_sums(pixels, chroms, spark.createDataFrame(centres + [("a", 0, 50), ("z", 1, 1), ("a", -1, 3)], "chrom string, bin1 long, bin2 long"), 1, nrows, width)
    reach, want = width // 2, []
    for c, a, b in centres:
        full = np.pad(square(rows, c, sizes[c]), reach, "edge")
        want.append((c, a, b, int(full[a : a + width, b : b + width].sum())))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_backgrounds(spark):
    sizes, nrows = {"a": 9, "b": 3, "none": 4, "full": 2}, 4
    rows = banded(5, {"a": 9, "b": 3}, nrows, 0.4) + [("full", 0, 0, 3), ("full", 0, 1, 4), ("full", 1, 1, 3)]
    pixels, chroms = tables_of(spark, rows, sizes)
    cells = {(c, a, b): 0.0 for c, n in sizes.items() for a in range(n) for b in range(a, min(n, a + nrows))}
    cells |= {r[:3]: float(r[3]) for r in rows}
    whole = Matrix.of(pixels, chroms, 1, nrows)
    shown = lambda m: {(r.chrom, r.bin1, r.bin2): r["count"] for r in m.cells().collect()}
    assert shown(whole) == {k: v for k, v in cells.items() if v}
    raised = whole.clamped(2, 5)
    want = {k: max(2.0, min(5.0, v)) for k, v in cells.items()}
    assert shown(raised) == want
    bounds = {r.chrom: (r.low, r.high) for r in raised.bounds().collect()}
    assert bounds == {c: (min(v for k, v in want.items() if k[0] == c), max(v for k, v in want.items() if k[0] == c)) for c in sizes}
    assert bounds["full"] == (3.0, 4.0)  # no cell has the background
    stretched = shown(raised.normalised(-1, 3))
    for k, v in want.items():
        low, high = bounds[k[0]]
        expected = (v - low) / (high - low) * 4 - 1 if high > low else None
        assert (stretched[k] is None) if expected is None else stretched.get(k, 0.0) == pytest.approx(expected)
    assert shown(whole.normalised(0, 1)).keys() == {k for k, v in cells.items() if v and not (k[0] == "full" and v == 3)}
    assert shown(whole.discretised([(-1, 1, 7.0), (2, 4, 0.0)])) == {k: w for k, v in cells.items() if (w := 7.0 if -1 < v < 1 else 0.0 if 2 < v < 4 else v)}
    # nothing of the band is written before the end
    assert raised.pixels.count() == len(rows) and raised.chroms.count() == len(sizes)


@pytest.fixture
def many_parts(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def scanned_rows(seed=0, n=500):
    rng = random.Random(seed)
    return [(k, "big" if k % 3 else rng.choice(["x", None]), rng.randrange(200), rng.choice([None, rng.randrange(1000)])) for k in range(n)]


def test_numbers_and_running_values(spark, many_parts):
    """A group of most rows lies in several tasks; nulls are a group."""
    rows = scanned_rows()
    df = spark.createDataFrame(rows, "id long, g string, at long, v long").repartition(5)
    kept = tables._sorted(df, ["g"], ["at", "id"])
    assert kept.where("g = 'big'").select("_part").distinct().count() > 1
    got = {r.id: (r.pos, r.n) for r in tables.numbered(df, ["g"], ["at", F.desc("id")], total="n").collect()}
    scans = {"s": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v")), "last": ("last", F.col("v"))}
    ran = {r.id: r for r in tables.running(df, ["g"], ["at", "id"], scans).collect()}
    for g in ("big", "x", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], -r[0]))
        assert [got[r[0]] for r in own] == [(k, len(own)) for k in range(len(own))]
        seen = []
        for r in sorted(own, key=lambda r: (r[2], r[0])):
            seen += [r[3]] if r[3] is not None else []
            made = ran[r[0]]
            assert (made.s, made.low, made.high, made["last"]) == ((sum(seen), min(seen), max(seen), seen[-1]) if seen else (None,) * 4)
    assert sorted(r.pos for r in tables.numbered(df, [], ["id"]).collect()) == list(range(len(rows)))
    assert tables.numbered(df.where("false"), ["g"], ["id"]).count() == 0 and tables.running(df.where("false"), ["g"], ["id"], scans).count() == 0


def test_ranks_by_histogram(spark, many_parts):
    rows = [(k, g, v if v is None else v % 40) for k, g, _, v in scanned_rows(1)]
    df = spark.createDataFrame([(*r, 1 + r[0] % 4) for r in rows if r[2] is not None], "id long, g string, v long, w long").repartition(4)
    plain = {r.id: r.place for r in statistics.with_ranks(df, ["g"], "v", "place").collect()}
    heavy = {r.id: r.place for r in statistics.with_weighted_ranks(df, ["g"], "v", "w", "place").collect()}
    for g in ("big", "x", None):
        own = [(k, v, 1 + k % 4) for k, h, v in rows if h == g and v is not None]
        for k, v, _ in own:
            ties = [w for _, u, w in own if u == v]
            assert plain[k] == sum(u < v for _, u, _ in own) + (len(ties) - 1) / 2
            assert heavy[k] == pytest.approx(sum(w for _, u, w in own if u < v) + (len(ties) + 1) / 2 * sum(ties) / len(ties))


@pytest.mark.parametrize("width", [1, 3, 10, 25])
def test_moving_average_across_blocks(spark, monkeypatch, many_parts, width):
    monkeypatch.setattr(statistics, "_BLOCK", 16)
    rows = [("big", k, float(k * k % 17)) for k in range(120)] + [("few", k, float(k)) for k in range(4)]
    df = spark.createDataFrame(rows, "g string, at long, v double").repartition(4)
    got = sorted(map(tuple, statistics.moving_average(df, ["g"], "at", "v", width, "m").select("g", "at", "m").collect()))
    want = []
    for g in ("big", "few"):
        v = [x for h, _, x in rows if h == g]
        want += [(g, 0, sum(v) / len(v))] if len(v) <= width else [(g, k, sum(v[k : k + width]) / width) for k in range(len(v) - width)]
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_moves_and_neighbours_over_many_tasks(spark, many_parts):
    rng = random.Random(6)
    lefs = [("c", k, rng.randrange(3000), rng.randrange(3000), rng.randrange(5), rng.randrange(50), rng.randrange(50)) for k in range(300)]
    df = spark.createDataFrame(lefs, "cell string, lef_id long, rev long, fwd long, epoch long, rev_move long, fwd_move long").repartition(4)
    got = {r.lef_id: r for r in collisions.adjusted_moves(collisions.ranked(df, ["cell"]), ["cell"]).collect()}
    by_rev = sorted(lefs, key=lambda r: (r[2], r[4], r[1]))
    by_fwd = sorted(lefs, key=lambda r: (r[3], -r[4], r[1]))
    assert [got[r[1]].rev_rank for r in by_rev] == list(range(300)) and [got[r[1]].fwd_rank for r in by_fwd] == list(range(300))
    most = None
    for k, r in enumerate(by_fwd):
        most = max(x for x in (most, r[3] + r[6] - k) if x is not None)
        assert got[r[1]].fwd_move == most + k - r[3]
    least = None
    for k, r in reversed(list(enumerate(by_rev))):
        least = min(x for x in (least, r[2] - r[5] - k) if x is not None)
        assert got[r[1]].rev_move == r[2] - (least + k)
    points = spark.createDataFrame([("c", p) for p in range(0, 3100, 7)], "cell string, pos long")
    targets = df.select("cell", F.col("rev").alias("pos"), "lef_id")
    places = sorted({r[2] for r in lefs})
    for r in intervals.nearest_below(points, targets.withColumn("at", F.col("pos")), ["cell"], "pos", ["at"]).collect():
        assert r.near_at == max((p for p in places if p < r.pos), default=None)
    for r in intervals.nearest_above(points, targets.withColumn("at", F.col("pos")), ["cell"], "pos", ["at"]).collect():
        assert r.near_at == min((p for p in places if p > r.pos), default=None)
