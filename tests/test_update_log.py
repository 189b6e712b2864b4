"""Updates in runs against the same events one by one, xz text in blocks, and HDF5 matrices through the verbs."""

import lzma
import random

import pytest

from chromaweave.operators import matrix
from chromaweave.operators.update_log import MatrixLog
from chromaweave.plans import workflows
from chromaweave.sources import chunked, genomic, xz

EVENTS = "chrom string, bin1 long, bin2 long, op string, n long, seq long"


def test_runs_and_compaction(spark, tmp_path):
    rng = random.Random(0)
    events = [("a" if rng.random() < 0.7 else "b", rng.randrange(8), rng.randrange(8), rng.choice(["add", "add", "subtract", "set", "erase"]), rng.randint(1, 9), k) for k in range(600)]
    log = MatrixLog.created(spark, str(tmp_path / "log"), nrows=5)
    assert log.pixels().count() == 0
    state = {}
    for run in range(6):
        own = events[100 * run : 100 * (run + 1)]
        log.append(spark.createDataFrame(own, EVENTS).repartition(3))
        for c, a, b, op, n, _ in own:
            key = (c, min(a, b), max(a, b))
            if key[2] - key[1] < 5:
                state[key] = {"add": state.get(key, 0) + n, "subtract": state.get(key, 0) - n, "set": n, "erase": 0}[op]
        want = {k: v for k, v in state.items() if v}
        assert {(r.chrom, r.bin1, r.bin2): r["count"] for r in log.pixels().collect()} == want
        if run in (1, 4):
            log.compact()
            assert {(r.chrom, r.bin1, r.bin2): r["count"] for r in log.pixels().collect()} == want
    plain = [(*e[:3], "set" if e[3] == "erase" else e[3], 0 if e[3] == "erase" else e[4], e[5]) for e in events]
    assert {(r.chrom, r.bin1, r.bin2): r["count"] for r in matrix.updated(spark.createDataFrame(plain, EVENTS), 5).collect()} == want


def test_a_run_that_was_not_noted_does_not_count(spark, tmp_path, monkeypatch):
    log = MatrixLog.created(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([("a", 1, 2, "add", 5, 1)], EVENTS))
    with monkeypatch.context() as m:
        m.setattr(MatrixLog, "_noted", lambda *_: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            log.append(spark.createDataFrame([("a", 1, 2, "add", 100, 2)], EVENTS))
        with pytest.raises(OSError):
            log.compact()
    assert [r["count"] for r in log.pixels().collect()] == [5]
    log.append(spark.createDataFrame([("a", 1, 2, "add", 7, 2)], EVENTS))
    log.compact()
    assert [r["count"] for r in log.pixels().collect()] == [12]


def streams(texts, check=lzma.CHECK_CRC64):
    return b"".join(lzma.compress(t.encode(), check=check) + b"\0" * (4 * (k % 3)) for k, t in enumerate(texts))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_xz_in_parts(spark, tmp_path, seed):
    """Lines that end, begin and run on at block borders, blank ones, one as long as several blocks, no break at the end."""
    rng = random.Random(seed)
    text = "".join(rng.choice(["", "x", "line é ", "y" * 40]) + ("\n" if rng.random() < 0.7 else "") for _ in range(300)) + "z" * 300 + "\nlast"
    cuts = sorted(rng.sample(range(len(text)), 40))
    parts = [text[s:e] for s, e in zip([0, *cuts], [*cuts, len(text)])]
    path = tmp_path / "a.txt.xz"
    path.write_bytes(streams(parts, rng.choice([lzma.CHECK_CRC32, lzma.CHECK_SHA256, lzma.CHECK_NONE])))
    for size in (1, 60, 1 << 20):
        reader = xz._Reader({"path": str(path), "bytesatask": str(size)})
        runs = reader.partitions()
        assert size > 1 or len(runs) > 30
        assert [x for run in runs for b in reader.read(run) for x in b.column(1).to_pylist()] == text.split("\n")
    assert sorted(r.line for r in genomic.text_lines(spark, str(path)).collect()) == sorted(text.split("\n"))


def test_xz_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xz, "_LINES", 50)
    texts = [f"chr{k % 3}\t{k}\t{k + 5}" for k in range(777)]
    path = str(tmp_path / "b.bed.xz")
    genomic.write_lines(spark.createDataFrame([(t,) for t in texts], "line string").coalesce(1), path)
    assert lzma.open(path, "rt").read().splitlines() == texts
    assert len(xz.blocks_of(chunked.ranged(path), chunked.size_of(path))) == 16
    assert genomic.read_bed(spark, path, 3).count() == 777
    assert [r.start for r in genomic.read_first_records(spark, path, 3, 3).collect()] == [0, 1, 2]
    genomic.write_lines(spark.createDataFrame([], "line string"), str(tmp_path / "none.xz"))
    assert genomic.text_lines(spark, str(tmp_path / "none.xz")).count() == 0
    (tmp_path / "bad.xz").write_bytes(b"no xz file at all.")
    with pytest.raises(Exception, match="no xz file"):
        genomic.text_lines(spark, str(tmp_path / "bad.xz")).collect()


def test_verbs_take_hdf5_matrices(spark, tmp_path):
    pixels = spark.createDataFrame([("a", 0, 0, 2), ("a", 0, 3, 1), ("b", 1, 1, 5)], "chrom string, bin1 long, bin2 long, count long")
    chroms = spark.createDataFrame([("a", 50), ("b", 30)], "chrom string, size long")
    one, two = str(tmp_path / "m.cool"), str(tmp_path / "n.cool")
    genomic.write_matrix(pixels, chroms, one, 10, 5, {"x": 1})
    workflows.run_transform(spark, one, two, "normalize", bounds=(0.0, 10.0))
    got, _, about = genomic.read_matrix(spark, two)
    assert {tuple(r) for r in got.collect()} == {("a", 0, 0, 10.0), ("a", 0, 3, 5.0), ("b", 1, 1, 10.0)} and about["nrows"] == 5
    workflows.run_evaluation(spark, one, two, str(tmp_path / "scores"), "pearson", diagonal_width=50)
    assert spark.read.csv(str(tmp_path / "scores"), sep="\t", header=True).count() == 16
