"""bigWig files written and read back, in parts, by region and through their summaries."""

import random

import numpy as np
import pytest

from chromaweave.sources import bigwig, chunked, genomic

CHROMS = [("chr2", 500_000), ("chr1", 1_000_000), ("none", 5_000), ("chr10", 90_000)]


def intervals(seed=0, n=4000):
    rng = random.Random(seed)
    rows = []
    for name, size in (c for c in CHROMS if c[0] != "none"):
        at = 0
        while at < size - 200 and len(rows) < n * 3:
            at += rng.choice([0, 0, rng.randrange(400)])
            end = min(size, at + rng.randint(1, 300))
            rows.append((name, at, end, float(np.float32(rng.uniform(-5, 50)))))
            at = end
    return rows


@pytest.fixture
def small_nodes(monkeypatch):
    for name, value in (("_FANOUT", 4), ("_VALUES", 64), ("_SUMMARIES", 16)):
        monkeypatch.setattr(bigwig, name, value)


@pytest.fixture
def chroms(spark):
    return spark.createDataFrame(CHROMS, "chrom string, size long")


def frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start long, end long, value double").repartition(3)


def test_round_trip_in_parts(spark, chroms, tmp_path, small_nodes):
    rows, path = intervals(), str(tmp_path / "a.bw")
    nothing = [("chr1", 999_998, 999_999, None), ("chr1", 999_999, 1_000_000, float("nan"))]
    genomic.write_track(frame(spark, rows + nothing), chroms, path)
    got = genomic.read_track(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert got.rdd.getNumPartitions() > 8
    assert sorted(tuple(r)[1:] for r in bigwig.read_bigwig_chroms(spark, path).collect()) == sorted(CHROMS)
    for query in (("chr1", 200_000, 210_000), ("chr10",), ("none",), ("chr2", 0, 1)):
        name, low, high = (*query, 0, dict(CHROMS)[query[0]])[:3] if len(query) == 1 else query
        want = sorted(r for r in rows if r[0] == name and r[1] < high and r[2] > low)
        assert sorted(map(tuple, bigwig.read_bigwig(spark, path, *query).collect())) == want
    assert not list(tmp_path.glob("*.part"))


def test_a_query_reads_its_blocks_only(spark, chroms, tmp_path, small_nodes, monkeypatch):
    rows, path = intervals(1), str(tmp_path / "a.bw")
    bigwig.write_bigwig(frame(spark, rows), chroms, path)
    track = bigwig._Track(path)
    blocks = {b for node in track.parts(track.root, None, 10**6) for b in track.children(node, None)[1]}
    read = []

    def counting(name):
        plain = chunked.ranged(name)
        return lambda at, n: read.append((at, n)) or plain(at, n)

    monkeypatch.setattr(bigwig, "ranged", counting)
    reader = bigwig._Reader({"path": path, "chrom": "chr2", "start": "100000", "end": "101000"})
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert n == sum(r[0] == "chr2" and r[1] < 101_000 and r[2] > 100_000 for r in rows)
    assert len(blocks) > 60 and 1 <= len(blocks & set(read)) <= 3


@pytest.mark.parametrize("window", [20_000, 137_000, 400])
def test_summaries(spark, chroms, tmp_path, small_nodes, window):
    """Equal to plain sums at every base, but for what lies at a window's ends."""
    rows, path = intervals(2), str(tmp_path / "a.bw")
    bigwig.write_bigwig(frame(spark, rows), chroms, path, levels=4)
    steps = bigwig.summary_steps(path)
    assert len(steps) == 4 and all(b == 4 * a for a, b in zip(steps, steps[1:]))
    base = np.full(1_000_000, np.nan)
    for c, s, e, v in rows:
        if c == "chr1":
            base[s:e] = v
    for step in steps:
        for r in bigwig._load(spark, path, step=step, chrom="chr1", start=0, end=1_000_000).collect():
            own = base[r.start : r.end]
            own = own[~np.isnan(own)]
            assert (r.n, r.least, r.largest) == (len(own), own.min(), own.max())
            assert r["sum"] == pytest.approx(own.sum(), rel=1e-5, abs=1e-3) and r.squares == pytest.approx((own**2).sum(), rel=1e-5)
    exact = {r.window: r for r in genomic.track_statistics(genomic.read_track(spark, path), chroms, "chr1", 0, 800_000, window).collect()}
    step = max((s for s in steps if 2 * s <= window), default=0)
    for r in bigwig.bigwig_statistics(spark, path, "chr1", 0, 800_000, window).collect():
        want = exact[r.window]
        if not step:
            assert (r.n, r.least, r.largest) == (want.n, want.least, want.largest) and r["mean"] == pytest.approx(want["mean"])
        elif want.n:
            assert abs(r.n - want.n) <= 2 * step and r.largest >= want.largest and r.least <= want.least


def test_published_window_means(spark, tmp_path):
    """100 kb bins with their number as value: means of 200 kb windows are 0.5 and 2.5."""
    chroms = spark.createDataFrame([("chr1", 1_000_000), ("chr2", 500_000)], "chrom string, size long")
    rows = [(c, k * 100_000, (k + 1) * 100_000, float(k)) for c, n in (("chr1", 10), ("chr2", 5)) for k in range(n)]
    path = str(tmp_path / "a.bigWig")
    genomic.write_track(frame(spark, rows), chroms, path)
    got = bigwig.bigwig_statistics(spark, path, "chr1", 0, 400_000, 200_000).orderBy("window").collect()
    assert [r["mean"] for r in got] == [0.5, 2.5] and [r.n for r in got] == [200_000, 200_000]


def test_errors_and_nothing(spark, chroms, tmp_path):
    path = str(tmp_path / "a.bw")
    bigwig.write_bigwig(frame(spark, []), chroms, path)
    assert genomic.read_track(spark, path).count() == 0 and bigwig.summary_steps(path) == []
    for bad in ([("chr1", 5, 9, 1.0), ("chr1", 8, 12, 2.0)], [("chrZ", 1, 2, 1.0)], [("chr10", 1, 90_001, 1.0)], [("chr10", 7, 7, 1.0)]):
        with pytest.raises(Exception):
            bigwig.write_bigwig(frame(spark, bad), chroms, path)
    assert genomic.read_track(spark, path).count() == 0  # the file that was there stays
    with pytest.raises(ValueError):
        bigwig.bigwig_statistics(spark, path, "chr1", 0, 1_000_001, 10)
