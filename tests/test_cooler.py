"""HDF5 matrices: files written and read back, by region and band; a file put together by hand in the newer layout."""

import random
import struct
import zlib

import numpy as np
import pytest

from chromaweave.sources import chunked, cooler, hdf5

CHROMS = [("chrB", 1_050_000), ("chrA", 400_001), ("empty", 90_000)]
BIN = 1000


def pixels(seed=0, n=3000, band=200, kind=int):
    rng = random.Random(seed)
    found = {}
    for _ in range(n):
        name, size = rng.choice(CHROMS[:2])
        bins = -(-size // BIN)
        a = rng.randrange(bins)
        found[name, a, min(bins - 1, a + rng.randrange(band))] = rng.randint(1, 70_000) if kind is int else rng.randint(1, 70_000) / 8
    return [(*k, v) for k, v in found.items()]


def frame(spark, rows, kind="bigint"):
    return spark.createDataFrame(rows, f"chrom string, bin1 bigint, bin2 bigint, count {kind}").repartition(3)


@pytest.fixture(scope="module")
def chroms(spark):
    return spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(CHROMS)], "chrom_id int, chrom string, size bigint")


@pytest.fixture(params=[64, 1000, 65_536])
def rows_a_chunk(request, monkeypatch):
    monkeypatch.setattr(cooler, "_ROWS_A_CHUNK", request.param)
    return request.param


@pytest.mark.parametrize("kind, sql", [(int, "bigint"), (float, "double")])
def test_round_trip(spark, chroms, tmp_path, rows_a_chunk, kind, sql):
    rows, path = pixels(kind=kind), str(tmp_path / "a.cool")
    cooler.write_cooler(frame(spark, rows + [("chrA", 1, 2, kind(0)), ("none", 1, 1, kind(5))], sql), chroms, path, BIN, {"seed": 1})
    got, found, about = cooler.read_cooler(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(rows) and dict(got.dtypes)["count"] == sql
    assert [tuple(r) for r in found.collect()] == [(k, n, s) for k, (n, s) in enumerate(CHROMS)]
    assert about["bin_size"] == BIN and about["nnz"] == len(rows) and about["format"] == "HDF5::Cooler" and about["metadata"] == '{"seed": 1}'
    assert not list(tmp_path.glob("*.part"))


def test_index_and_bins(spark, chroms, tmp_path, rows_a_chunk):
    rows, path = pixels(1), str(tmp_path / "a.cool")
    cooler.write_cooler(frame(spark, rows), chroms, path, BIN)
    file, _ = cooler.open_cooler(path)
    origin = dict(zip([n for n, _ in CHROMS], np.cumsum([0] + [-(-s // BIN) for _, s in CHROMS]).tolist()))
    one = np.sort([origin[c] + a for c, a, _, _ in rows])
    nbins = sum(-(-s // BIN) for _, s in CHROMS)
    assert (file.dataset("indexes/bin1_offset")[:] == np.searchsorted(one, np.arange(nbins + 1))).all()
    assert (file.dataset("pixels/bin1_id")[:] == one).all()
    assert file.dataset("indexes/chrom_offset")[:].tolist() == [0, 1050, 1451, 1541]
    assert file.dataset("bins/end")[:][[1049, 1450, 1540]].tolist() == [1_050_000, 400_001, 90_000]
    assert file.dataset("bins/chrom")[:][[0, 1050, 1451]].tolist() == [0, 1, 2] and file.dataset("bins/start")[:][1051] == 1000


@pytest.mark.parametrize("chrom, start, end, width", [("chrB", 0, None, 0), ("chrB", 100_000, 500_000, 0), ("chrA", 399_000, 400_001, 0), ("chrB", 0, None, 10_000), ("chrA", 50_500, 200_000, 25_000), ("empty", 0, None, 0), (None, 0, None, 5000)])
def test_region_and_band(spark, chroms, tmp_path, chrom, start, end, width):
    rows, path = pixels(2), str(tmp_path / "a.cool")
    cooler.write_cooler(frame(spark, rows), chroms, path, BIN)
    got, _, about = cooler.read_cooler(spark, path, chrom, start, end, width)
    last = {n: -(-(end or s) // BIN) for n, s in CHROMS}
    near = -(-width // BIN) or 10**9
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if (chrom is None or r[0] == chrom) and r[1] >= start // BIN and r[2] < last[r[0]] and r[2] - r[1] < near)


def test_many_tasks_and_only_the_chunks_needed(spark, chroms, tmp_path, monkeypatch):
    monkeypatch.setattr(cooler, "_ROWS_A_CHUNK", 64)
    rows, path = pixels(3, 9000, 900), str(tmp_path / "a.cool")
    cooler.write_cooler(frame(spark, rows), chroms, path, BIN)
    parts = cooler._Reader({"path": path, "chrom": "chrB", "rowsatask": "500"}).partitions()
    assert len(parts) > 5 and all(p.high - p.low <= 500 for p in parts)
    read = []

    def counting(name):
        plain = chunked.ranged(name)
        return lambda at, n: read.append((at, n)) or plain(at, n)

    monkeypatch.setattr(cooler, "ranged", counting)
    file, _ = cooler.open_cooler(path)
    places = {at for at, *_ in (c[1:] for c in ((f, a, s, x) for f, a, s, x in file.dataset("pixels/bin2_id").chunks(0, 10**9)))}

    def touched(**options):
        reader = cooler._Reader({"path": path, **options})
        found = [b for p in reader.partitions() for b in reader.read(p)]
        count = len(places & {at for at, _ in read})
        read.clear()
        return count, sum(b.num_rows for b in found)

    read.clear()
    every, n = touched()
    assert every == len(places) and n == len(rows)
    few, n = touched(chrom="chrB", start="500000", end="510000")
    assert few < every / 20 and n == sum(r[0] == "chrB" and r[1] >= 500 and r[2] < 510 for r in rows)


def test_band_skips_chunks_inside_long_rows(spark, tmp_path, monkeypatch):
    """Few bins with very many pixels each: what lies beyond the band is not read."""
    monkeypatch.setattr(cooler, "_ROWS_A_CHUNK", 32)
    one = spark.createDataFrame([(0, "c", 2000)], "chrom_id int, chrom string, size bigint")
    rows = [("c", a, b, 1 + (a + b) % 7) for a in range(0, 2000, 400) for b in range(a, 2000)]
    path = str(tmp_path / "a.cool")
    cooler.write_cooler(frame(spark, rows), one, path, 1)
    reader = cooler._Reader({"path": path, "nrows": "10"})
    (p,) = reader.partitions()
    file, _ = cooler.open_cooler(path)
    ranges = reader._ranges(file, "", p, 32)
    assert len(ranges) == 5 and sum(h - s for s, h in ranges) == 50
    assert sorted(map(tuple, cooler.read_cooler(spark, path, diagonal_width=10)[0].collect())) == [r for r in rows if r[2] - r[1] < 10]


def test_errors(spark, chroms, tmp_path):
    path = str(tmp_path / "a.cool")
    cooler.write_cooler(frame(spark, []), chroms, path, BIN)
    assert cooler.read_cooler(spark, path)[0].count() == 0
    for args in (("chrZ",), ("chrA", 5, 5), ("chrA", 0, 400_002), ("chrA", -1, 5)):
        with pytest.raises(ValueError):
            cooler.read_cooler(spark, path, *args)
    (tmp_path / "b.cool").write_bytes(b"no matrix" * 40)
    with pytest.raises(ValueError):
        cooler.read_cooler(spark, str(tmp_path / "b.cool"))
    with pytest.raises(ValueError):
        cooler.write_cooler(frame(spark, []), chroms, "hdfs://host/a.cool", BIN)


def newer_file(path):
    """Superblock 2, headers with marks and checksums, groups of links, data in one piece, big-endian, compact and checksummed."""
    data, base = bytearray(48), lambda: len(data)

    def put(raw):
        at = base()
        data.extend(raw)
        return at

    def header(messages, split=False):
        body = b"".join(struct.pack("<BHB", kind, len(m), 0) + m for kind, m in messages)
        if split:  # the last message in a continuation
            last = struct.pack("<BHB", messages[-1][0], len(messages[-1][1]), 0) + messages[-1][1]
            at = put(b"OCHK" + last + b"\0" * 4)
            body = body[: -len(last)] + struct.pack("<BHBQQ", 0x10, 16, 0, at, len(last) + 8)
        return put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"\0" * 4)

    space = lambda n: (1, struct.pack("<BBBBQ", 2, 1, 0, 1, n))
    link = lambda name, at: (6, struct.pack("<BBB", 1, 0, len(name)) + name.encode() + struct.pack("<Q", at))
    big = (3, struct.pack("<BBBBIHH", 0x10, 9, 0, 0, 4, 0, 32))
    long = (3, struct.pack("<BBBBIHH", 0x10, 8, 0, 0, 8, 0, 64))
    piece = lambda raw: (8, struct.pack("<BBQQ", 3, 1, put(raw), len(raw)))
    counts = np.array([5, 6, 7, 8, 9], "<i8")
    raw = zlib.compress(counts[:4].tobytes()) + b"sum!"
    rest = counts[4:].tobytes() + bytes(24) + b"sum!"
    keys = struct.pack("<IIQQQ", len(raw), 0, 0, 0, put(raw)) + struct.pack("<IIQQQ", len(rest), 1, 4, 0, put(rest)) + struct.pack("<IIQQ", 0, 0, 8, 0)
    tree = put(struct.pack("<4sBBHQQ", b"TREE", 1, 0, 2, hdf5.NOWHERE, hdf5.NOWHERE) + keys)
    filters = (0x0B, struct.pack("<BB", 2, 2) + struct.pack("<HHHI", 1, 0, 1, 6) + struct.pack("<HHH", 3, 0, 0))
    tables = {
        "chroms": {"name": [space(2), (3, struct.pack("<BBBBI", 0x13, 0, 0, 0, 4)), (8, struct.pack("<BBH", 3, 0, 8) + b"c1\0\0long")], "length": [space(2), big, piece(np.array([300, 200], ">i4").tobytes())]},
        "indexes": {"chrom_offset": [space(3), long, piece(np.array([0, 3, 5], "<i8").tobytes())], "bin1_offset": [space(6), long, piece(np.array([0, 2, 3, 3, 4, 5], "<i8").tobytes())]},
        "pixels": {"bin1_id": [space(5), long, piece(np.array([0, 0, 1, 3, 4], "<i8").tobytes())], "bin2_id": [space(5), long, piece(np.array([0, 4, 2, 4, 4], "<i8").tobytes())], "count": [space(5), long, filters, (8, struct.pack("<BBBQII", 3, 2, 2, tree, 4, 8))]},
    }
    groups = [link(g, header([link(n, header(m)) for n, m in inside.items()], split=True)) for g, inside in tables.items()]
    attribute = (0x0C, struct.pack("<BBHHHB", 3, 0, 9, 12, 4, 0) + b"bin-size\0" + big[1] + struct.pack("<BBBB", 2, 0, 0, 0) + struct.pack(">i", 100))
    inner = header([*groups, attribute])
    root = header([link("resolutions", header([link("100", inner)]))])
    data[:48] = hdf5.SIGNATURE + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, hdf5.NOWHERE, len(data), root, 0)
    path.write_bytes(bytes(data))


def test_a_file_of_the_newer_layout(spark, tmp_path):
    newer_file(tmp_path / "m.mcool")
    got, chroms, about = cooler.read_cooler(spark, f"{tmp_path}/m.mcool::/resolutions/100")
    assert [tuple(r)[1:] for r in chroms.collect()] == [("c1", 300), ("long", 200)] and about["bin_size"] == 100
    # the pixel between chromosomes is left out; the second chunk was not deflated
    assert sorted(map(tuple, got.collect())) == [("c1", 0, 0, 5), ("c1", 1, 2, 7), ("long", 0, 1, 8), ("long", 1, 1, 9)]
