"""Contact matrices in HDF5 files of bins, pixels and indexes (.cool), read and written by many tasks.

A read is planned on the driver from a few numbers of the file's own index: which rows of pixels a region has. Tasks get
runs of rows and read the chunks that hold them; with a band they skip the chunks that lie wholly beyond it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chromaweave.sources import hdf5
from chromaweave.sources.chunked import PlannedFile, ranged
from chromaweave.tables import numbered

#: Rows of pixels of a task, and of those that it holds at once.
_ROWS_A_TASK, _ROWS_AT_ONCE = 2_000_000, 262_144
#: Rows of a chunk that is written.
_ROWS_A_CHUNK = 65_536


def open_cooler(uri: str) -> tuple[hdf5.File, str]:
    """The file, and the group in it: ``path`` or ``path::/group``."""
    path, _, group = uri.partition("::")
    return hdf5.File(ranged(path)), group.strip("/")


@dataclass
class Description:
    """Chromosomes in file order, bin size, first bin of each chromosome, type of counts and attributes."""

    chroms: list[tuple[str, int]]
    bin_size: int
    first_bins: list[int]
    whole: bool
    attributes: dict[str, object]


def describe(uri: str) -> Description:
    file, group = open_cooler(uri)
    attributes = file.attributes(group)
    names = [n.decode() for n in file.dataset(f"{group}/chroms/name")[:].tolist()]
    sizes = [int(s) for s in file.dataset(f"{group}/chroms/length")[:]]
    first = [int(b) for b in file.dataset(f"{group}/indexes/chrom_offset")[:]]
    if "bin-size" not in attributes:
        raise ValueError(f"{uri} has no fixed bin size")
    return Description(list(zip(names, sizes)), int(attributes["bin-size"]), first, file.dataset(f"{group}/pixels/count").dtype.kind in "iu", attributes)


@dataclass
class _Rows(InputPartition):
    """Rows [low, high) of pixels: of a chromosome that begins at bin ``origin``, bins [first, last)."""

    chrom: str
    origin: int
    first: int
    last: int
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.chrom, self.start = options.get("chrom"), int(options.get("start", 0))
        self.end = int(options["end"]) if "end" in options else None
        self.nrows = int(options.get("nrows", 0))
        self.rows_a_task = int(options.get("rowsatask", _ROWS_A_TASK))

    def partitions(self) -> list[_Rows]:
        about = describe(self.uri)
        file, group = open_cooler(self.uri)
        index = file.dataset(f"{group}/indexes/bin1_offset")
        found = []
        for k, (name, size) in enumerate(about.chroms):
            if self.chrom is not None and name != self.chrom:
                continue
            origin = about.first_bins[k]
            first = origin + (self.start // about.bin_size if self.chrom is not None else 0)
            last = origin + -(-(self.end if self.end is not None else size) // about.bin_size)
            low, high = int(index[first : first + 1][0]), int(index[last : last + 1][0])
            for at in range(low, high, self.rows_a_task):
                found.append(_Rows(name, origin, first, last, at, min(high, at + self.rows_a_task)))
        return found

    def _ranges(self, file: hdf5.File, group: str, p: _Rows, chunk: int) -> list[tuple[int, int]]:
        """Runs of rows to read: all, or with a band those in it, joined where less than a chunk lies between."""
        if not self.nrows:
            return [(p.low, p.high)]
        bins = file.dataset(f"{group}/pixels/bin1_id")
        one, two = int(bins[p.low : p.low + 1][0]), int(bins[p.high - 1 : p.high][0])
        index = file.dataset(f"{group}/indexes/bin1_offset")[one : two + 2].astype(np.int64)
        low = np.maximum(index[:-1], p.low)
        high = np.minimum(np.minimum(index[1:], index[:-1] + self.nrows), p.high)  # a bin has one row at most for each distance
        some = high > low
        low, high = low[some], high[some]
        if not len(low):
            return []
        heads = np.flatnonzero(np.append(True, low[1:] - high[:-1] >= chunk))
        return list(zip(low[heads].tolist(), high[np.append(heads[1:], len(low)) - 1].tolist()))

    def read(self, p: _Rows | None) -> Iterator[pa.RecordBatch]:
        if p is None:  # there are no rows, and so no parts
            return
        file, group = open_cooler(self.uri)
        bin1, bin2, counts = (file.dataset(f"{group}/pixels/{name}") for name in ("bin1_id", "bin2_id", "count"))
        chunk = bin1.rows_of_chunk if bin1.layout[1] == 2 else 1
        for low, high in self._ranges(file, group, p, chunk):
            for at in range(low, high, _ROWS_AT_ONCE):
                until = min(high, at + _ROWS_AT_ONCE)
                one, two, count = (d[at:until] for d in (bin1, bin2, counts))
                one, two = one.astype(np.int64), two.astype(np.int64)
                keep = (two < p.last) & ((two - one < self.nrows) if self.nrows else True)
                name = pa.array([p.chrom]).take(pa.array(np.zeros(int(keep.sum()), np.int64)))
                count = count[keep].astype(np.int64 if counts.dtype.kind in "iu" else np.float64)
                yield pa.RecordBatch.from_arrays([name, pa.array(one[keep] - p.origin), pa.array(two[keep] - p.origin), pa.array(count)], names=["chrom", "bin1", "bin2", "count"])


class CoolerSource(DataSource):
    """``spark.read.format("cooler")``: pixels (chrom, bin1, bin2, count) within chromosomes. Options: ``chrom``, ``start``, ``end``
    (bases) and ``nrows`` (bins from the diagonal) for a region and band, ``rowsATask``."""

    @classmethod
    def name(cls) -> str:
        return "cooler"

    def schema(self) -> str:
        return f"chrom string, bin1 bigint, bin2 bigint, count {'bigint' if describe(self.options['path']).whole else 'double'}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_cooler(spark: SparkSession, uri: str, chrom: str | None = None, start: int = 0, end: int | None = None, diagonal_width: int = 0) -> tuple[DataFrame, DataFrame, dict]:
    """Pixels, chroms (chrom_id, chrom, size) and description of a matrix; of one region and band only, if asked for.

    Bins are counted from the chromosome's start. An unknown chromosome, an empty region and an end beyond the chromosome are
    errors; pixels between chromosomes are left out.
    """
    about = describe(uri)
    if chrom is not None:
        size = dict(about.chroms).get(chrom)
        if size is None:
            raise ValueError(f"no chromosome {chrom!r}")
        if not 0 <= start < (size if end is None else end) <= size:
            raise ValueError(f"{chrom}:{start}-{end} is no part of a chromosome of {size} bases")
    spark.dataSource.register(CoolerSource)
    asked = {"chrom": chrom, "start": start, "end": end, "nrows": -(-diagonal_width // about.bin_size) or None}
    if chrom is None:
        asked |= {"start": None, "end": None}
    pixels = spark.read.format("cooler").options(**{k: v for k, v in asked.items() if v is not None}).load(uri)
    chroms = spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(about.chroms)], "chrom_id int, chrom string, size bigint")
    widest = max((-(-s // about.bin_size) for _, s in about.chroms), default=0)
    return pixels, chroms, {"bin_size": about.bin_size, "nrows": asked["nrows"] or widest, **about.attributes}


def write_cooler(pixels: DataFrame, chroms: DataFrame, path: str, bin_size: int, metadata: dict | None = None, assembly: str = "unknown") -> None:
    """Pixels that are not 0 as one file, chromosomes in the order of ``chrom_id`` or else of names; counts are whole numbers if
    their column has such, else doubles. Pixels of unknown chromosomes are left out.

    Tasks sort the pixels, pack them in chunks of 65,536 rows and write these to their places; the driver sees the sizes of
    chunks and writes what points to them.
    """
    spark = pixels.sparkSession
    listed = [(r["chrom"], r["size"]) for r in chroms.orderBy("chrom_id" if "chrom_id" in chroms.columns else "chrom").select("chrom", "size").collect()]
    per = [-(-size // bin_size) for _, size in listed]
    first = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    nbins = int(first[-1])
    origins = spark.createDataFrame([(n, int(f)) for (n, _), f in zip(listed, first)], "chrom string, _origin bigint")
    own = pixels.where("count <> 0").join(origins, "chrom").select((F.col("bin1") + F.col("_origin")).alias("bin1_id"), (F.col("bin2") + F.col("_origin")).alias("bin2_id"), "count")
    placed = numbered(own, [], ["bin1_id", "bin2_id"]).withColumn("chunk", F.floor(F.col("pos") / _ROWS_A_CHUNK))
    total, largest = placed.agg(F.count(F.lit(1)), F.max(F.abs("count"))).first()
    whole = dict(pixels.dtypes)["count"] in ("tinyint", "smallint", "int", "bigint")
    count = np.dtype(("<i4" if (largest or 0) < 2**31 else "<i8") if whole else "<f8")
    kind = "kind string, chunk bigint, body binary"

    def bodies(chunk: int, columns: dict[str, np.ndarray]) -> pa.Table:
        return pa.table({"kind": list(columns), "chunk": pa.array([chunk] * len(columns), pa.int64()), "body": pa.array([hdf5.packed(_filled(v, _ROWS_A_CHUNK)) for v in columns.values()], pa.binary())})

    def pixel_chunk(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        values = {n: rows[n].to_numpy() for n in ("bin1_id", "bin2_id", "count")}
        return bodies(key[0].as_py(), {"pixels/bin1_id": values["bin1_id"].astype("<i8"), "pixels/bin2_id": values["bin2_id"].astype("<i8"), "pixels/count": values["count"].astype(count)})

    by_bin = placed.groupBy("bin1_id").agg(F.count(F.lit(1)).alias("n")).withColumn("chunk", F.floor(F.col("bin1_id") / _ROWS_A_CHUNK))
    n_chunks = nbins // _ROWS_A_CHUNK + 1
    sums = dict(by_bin.groupBy("chunk").agg(F.sum("n")).collect())  # a number for 65,536 bins
    before = np.cumsum([0] + [sums.get(k, 0) for k in range(n_chunks)])
    sizes = np.array([s for _, s in listed], np.int64)

    def bin_chunk(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        low = chunk * _ROWS_A_CHUNK
        here = min(_ROWS_A_CHUNK, nbins + 1 - low)
        counts = np.zeros(here, np.int64)
        held = rows.filter(rows["bin1_id"].is_valid()) if rows["bin1_id"].null_count else rows
        counts[held["bin1_id"].to_numpy() - low] = held["n"].to_numpy()
        columns = {"indexes/bin1_offset": (before[chunk] + np.cumsum(counts) - counts).astype("<i8")}
        bins = np.arange(low, min(low + _ROWS_A_CHUNK, nbins))
        if len(bins):
            chrom = np.searchsorted(first, bins, side="right") - 1
            start = (bins - first[chrom]) * bin_size
            columns |= {"bins/chrom": chrom.astype("<i4"), "bins/start": start.astype("<i4"), "bins/end": np.minimum(start + bin_size, sizes[chrom]).astype("<i4")}
        return bodies(chunk, columns)

    every = by_bin.select("chunk", "bin1_id", "n").unionByName(spark.range(n_chunks).select(F.col("id").alias("chunk"), F.lit(None).cast("bigint").alias("bin1_id"), F.lit(None).cast("bigint").alias("n")))
    chunks = placed.groupBy("chunk").applyInArrow(pixel_chunk, kind).unionByName(every.groupBy("chunk").applyInArrow(bin_chunk, kind))
    out = PlannedFile(path)
    places, at, _ = out.write_chunks(chunks, hdf5.HEAD)
    small = {"chroms/name": np.array([n.encode() for n, _ in listed] or [b""])[: len(listed)], "chroms/length": sizes.astype("<i4"), "indexes/chrom_offset": first.astype("<i8")}
    planned = {}
    for name, values in small.items():
        body = hdf5.packed(values)
        places[name] = [(at, len(body))] if len(values) else []
        planned[name] = hdf5.Planned(len(values), values.dtype, max(1, len(values)), places[name])
        out.write(at, body)
        at += len(body)
    for name, rows, dtype in (("bins/chrom", nbins, "<i4"), ("bins/start", nbins, "<i4"), ("bins/end", nbins, "<i4"), ("pixels/bin1_id", total, "<i8"), ("pixels/bin2_id", total, "<i8"), ("pixels/count", total, count), ("indexes/bin1_offset", nbins + 1, "<i8")):
        planned[name] = hdf5.Planned(rows, np.dtype(dtype), _ROWS_A_CHUNK, places.get(name, []))
    root = hdf5.PlannedGroup(attributes={"format": "HDF5::Cooler", "format-version": 3, "bin-type": "fixed", "bin-size": bin_size, "storage-mode": "symmetric-upper", "genome-assembly": assembly, "nbins": nbins, "nchroms": len(listed), "nnz": total, "generated-by": "chromaweave", "metadata": json.dumps(metadata or {})})
    for name, data in planned.items():
        group, leaf = name.split("/")
        root.members.setdefault(group, hdf5.PlannedGroup()).members[leaf] = data
    at = -(-at // 8) * 8
    head, index = hdf5.superblock_and_index(root, at)
    out.write(at, index)
    out.write(0, head)
    out.done()


def _filled(values: np.ndarray, n: int) -> np.ndarray:
    """A chunk has all its rows in the file, the last one too."""
    return np.concatenate([values, np.zeros(n - len(values), values.dtype)]) if len(values) < n else values
