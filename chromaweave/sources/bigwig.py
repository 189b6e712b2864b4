"""bigWig tracks, after the published description of the format: read in parts of the file's own index, written by many tasks.

A read is planned on the driver by going down the index until there are parts enough; each task goes on from its node and
reads the blocks below it that the query meets, by byte range. Statistics of wide windows read the file's summaries.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chromaweave.sources.chunked import PlannedFile, local_files, ranged
from chromaweave.tables import numbered, shared_table

# Fixed values of the format: marks of the file, of its tree of names and of its index, and kinds of blocks.
_FILE, _NAMES, _INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
_BED_GRAPH, _VARIABLE_STEP, _FIXED_STEP = 1, 2, 3

#: Parts to plan for in a file, if its index has so many nodes.
_PARTS = 64
#: Children of an index node, values of a block, and summaries of a block that are written.
_FANOUT, _VALUES, _SUMMARIES = 256, 1024, 512


class _Track:
    """One file's names and index."""

    def __init__(self, path: str):
        self.path, self.read = path, ranged(path)
        head = self.read(0, 64)
        self.order = next((o for o in "<>" if len(head) == 64 and struct.unpack_from(o + "I", head)[0] == _FILE), None)
        if self.order is None:
            raise ValueError(f"{path} is no bigWig file")
        _, zooms, names_at, _, index_at = struct.unpack_from(self.order + "HHQQQ", head, 4)
        self.packed = struct.unpack_from(self.order + "I", head, 52)[0] > 0
        mark, _, width, _ = self._fields("IIII", names_at)
        if mark != _NAMES or self._fields("I", index_at)[0] != _INDEX:
            raise ValueError(f"{path} is damaged")
        self.chroms: dict[int, tuple[str, int]] = {}
        for is_leaf, body in self._all_below(names_at + 32, width):
            number, size = struct.unpack_from(self.order + "II", body, width)
            self.chroms[number] = (body[:width].rstrip(b"\0").decode(), size)
        self.root = index_at + 48
        #: Bases of a summary, and the index of these.
        self.zooms = sorted((step, at + 48) for step, _, _, at in (self._fields("IIQQ", 64 + 24 * k) for k in range(zooms)))

    def _fields(self, fields: str, at: int) -> tuple:
        return struct.unpack(self.order + fields, self.read(at, struct.calcsize(self.order + fields)))

    def _all_below(self, at: int, width: int) -> Iterator[tuple[bool, bytes]]:
        is_leaf, _, count = self._fields("BBH", at)
        body = self.read(at + 4, count * (width + 8))
        for k in range(count):
            item = body[k * (width + 8) : (k + 1) * (width + 8)]
            if is_leaf:
                yield True, item
            else:
                yield from self._all_below(struct.unpack_from(self.order + "Q", item, width)[0], width)

    def children(self, at: int, query: tuple[int, int, int] | None) -> tuple[bool, list[tuple[int, ...]]]:
        """Whether a node is a leaf, and its children that meet the query (chromosome, start, end): (address,) of a node, (address,
        bytes) of a block."""
        is_leaf, _, count = self._fields("BBH", at)
        width = 32 if is_leaf else 24
        body = self.read(at + 4, count * width)
        found = []
        for k in range(count):
            first, low, last, high = struct.unpack_from(self.order + "IIII", body, k * width)
            if query is None or ((first, low) < (query[0], query[2]) and (last, high) > (query[0], query[1])):
                found.append(struct.unpack_from(self.order + ("QQ" if is_leaf else "Q"), body, k * width + 16))
        return bool(is_leaf), found

    def parts(self, root: int, query: tuple[int, int, int] | None, wanted: int) -> list[int]:
        """Nodes that together hold what the query meets: as near to the root as gives ``wanted`` of them, or leaves."""
        nodes = [root]
        while len(nodes) < wanted:
            below = []
            for at in nodes:
                is_leaf, found = self.children(at, query)
                below += [at] if is_leaf else [f[0] for f in found]
            if below == nodes:
                break
            nodes = below
        return nodes

    def blocks(self, at: int, query: tuple[int, int, int] | None) -> Iterator[bytes]:
        """Unpacked blocks below a node."""
        is_leaf, found = self.children(at, query)
        for f in found:
            if is_leaf:
                raw = self.read(*f)
                yield zlib.decompress(raw) if self.packed else raw
            else:
                yield from self.blocks(f[0], query)

    def values(self, raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Chromosome, starts, ends and values of a block."""
        number, begin, _, step, span, kind, _, n = struct.unpack_from(self.order + "IIIIIBBH", raw)
        place, value = np.dtype(self.order + "u4"), np.dtype(self.order + "f4")
        fields = {_BED_GRAPH: [("start", place), ("end", place), ("value", value)], _VARIABLE_STEP: [("start", place), ("value", value)], _FIXED_STEP: [("value", value)]}
        if kind not in fields:
            raise ValueError(f"{self.path} has a block of kind {kind}")
        items = np.frombuffer(raw, np.dtype(fields[kind]), n, 24)
        starts = begin + step * np.arange(n) if kind == _FIXED_STEP else items["start"].astype(np.int64)
        ends = items["end"].astype(np.int64) if kind == _BED_GRAPH else starts + span
        return number, starts, ends, items["value"].astype(np.float64)

    def summaries(self, raw: bytes) -> np.ndarray:
        names = ["chrom", "start", "end", "n"], ["least", "largest", "sum", "squares"]
        return np.frombuffer(raw, np.dtype([(n, self.order + k) for part, k in zip(names, ("u4", "f4")) for n in part]))

    def query(self, chrom: str, start: int, end: int | None) -> tuple[int, int, int]:
        number, size = next(((k, s) for k, (name, s) in self.chroms.items() if name == chrom), (None, 0))
        until = size if end is None else end
        if number is None or start < 0 or start >= until or until > size:
            raise ValueError(f"{chrom}:{start}-{end} is no part of a chromosome of {self.path}")
        return number, start, until


@dataclass
class _Node(InputPartition):
    path: str
    at: int


class _Reader(DataSourceReader):
    """``step`` 0: values; else the summaries of so many bases."""

    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("step", 0))
        self.chrom, self.start = options.get("chrom"), int(options.get("start", 0))
        self.end = int(options["end"]) if "end" in options else None
        self.wanted = int(options.get("parts", _PARTS))

    def _query(self, track: _Track) -> tuple[int, int, int] | None:
        return None if self.chrom is None else track.query(self.chrom, self.start, self.end)

    def partitions(self) -> list[_Node]:
        found = []
        for path in local_files(self.path):
            track = _Track(path)
            root = dict(track.zooms)[self.step] if self.step else track.root
            found += [_Node(path, at) for at in track.parts(root, self._query(track), self.wanted)]
        return found

    def read(self, part: _Node | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        track = _Track(part.path)
        query = self._query(track)
        names = pa.array([track.chroms[k][0] if k in track.chroms else None for k in range(max(track.chroms, default=0) + 1)], pa.string())
        for raw in track.blocks(part.at, query):
            if self.step:
                rows = track.summaries(raw)
                rows = rows if query is None else rows[(rows["chrom"] == query[0]) & (rows["start"] < query[2]) & (rows["end"] > query[1])]
                whole, real = ({n: rows[n].astype(kind) for n in which} for which, kind in ((("start", "end", "n"), np.int64), (("least", "largest", "sum", "squares"), np.float64)))
                yield pa.RecordBatch.from_pydict({"chrom": names.take(pa.array(rows["chrom"].astype(np.int64))), **whole, **real})
                continue
            own, low, high, value = track.values(raw)
            if query is not None:
                keep = (low < query[2]) & (high > query[1]) & (own == query[0])
                low, high, value = low[keep], high[keep], value[keep]
            yield pa.RecordBatch.from_pydict({"chrom": names.take(pa.array(np.full(len(low), own))), "start": pa.array(low.astype(np.int64)), "end": pa.array(high.astype(np.int64)), "value": pa.array(value)})


class BigWigSource(DataSource):
    """``spark.read.format("bigwig")``: (chrom, start, end, value), or with the option ``step`` the summaries of so many bases.
    Further options: ``chrom``, ``start``, ``end``, ``parts``."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        if int(self.options.get("step", 0)):
            return "chrom string, start bigint, end bigint, n bigint, least double, largest double, sum double, squares double"
        return "chrom string, start bigint, end bigint, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_bigwig_chroms(spark: SparkSession, path: str) -> DataFrame:
    """(path, chrom, size) of every chromosome that the files name."""
    rows = [(f, name, size) for f in local_files(path) for name, size in _Track(f).chroms.values()]
    return spark.createDataFrame(rows, "path string, chrom string, size bigint")


def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(BigWigSource)
    return spark.read.format("bigwig").options(**{k: v for k, v in options.items() if v is not None}).load(path)


def read_bigwig(spark: SparkSession, path: str, chrom: str | None = None, start: int = 0, end: int | None = None) -> DataFrame:
    """(chrom, start, end, value) of the files' intervals; with ``chrom`` of those only that meet start to end (null: the
    chromosome's end), and of other blocks none is read.

    Unknown chromosomes, empty queries, ends beyond the chromosome and files of another format are errors; a file without
    values has no rows.
    """
    for f in local_files(path):
        track = _Track(f)
        if chrom is not None:
            track.query(chrom, start, end)
    return _load(spark, path, chrom=chrom, start=start if chrom is not None else None, end=end if chrom is not None else None)


def summary_steps(path: str) -> list[int]:
    """Bases that the file's summaries cover, ascending."""
    return [step for step, _ in _Track(path).zooms]


def bigwig_statistics(spark: SparkSession, path: str, chrom: str, start: int, end: int, window: int) -> DataFrame:
    """(window, mean, least, largest, n) of equal windows of a query, null where there is no value, from the coarsest summaries that
    are at most half a window wide, else from the values.

    A summary that lies in two windows counts for each by the share of it that does, so n and mean can be off by what lies at
    a window's ends, and least and largest can come from just beyond.
    """
    track = _Track(path)
    track.query(chrom, start, end)
    step = max((s for s, _ in track.zooms if 2 * s <= window), default=0)
    rows = _load(spark, path, chrom=chrom, start=start, end=end, step=step or None)
    if not step:
        rows = rows.select("chrom", "start", "end", (F.col("end") - F.col("start")).alias("n"), F.col("value").alias("least"), F.col("value").alias("largest"), (F.col("value") * (F.col("end") - F.col("start"))).alias("sum"))
    low, high = F.greatest("start", F.lit(start)), F.least("end", F.lit(end))
    dealt = rows.withColumn("window", F.explode(F.sequence(F.floor((low - start) / window), F.floor((high - 1 - start) / window))))
    begins = F.col("window") * window + start
    share = (F.least(high, begins + window) - F.greatest(low, begins)) / (F.col("end") - F.col("start"))
    found = dealt.groupBy("window").agg(F.sum(share * F.col("n")).alias("n"), F.sum(share * F.col("sum")).alias("_sum"), F.min("least").alias("least"), F.max("largest").alias("largest"))
    windows = spark.range(0, -(-(end - start) // window)).select(F.col("id").alias("window"))
    return windows.join(found, "window", "left").select("window", (F.col("_sum") / F.col("n")).alias("mean"), "least", "largest", F.round("n").cast("bigint").alias("n"))


# ---- writing


def _tree(items: list[tuple[bytes, tuple[int, int], tuple[int, int]]], at: int, inner: int) -> tuple[bytes, int]:
    """Nodes of a tree over leaf items (bytes, first key, last key), root first, from ``at`` on; keys are written with ``inner`` = 16
    bytes of two places, or are names. Returns the bytes and their number."""
    levels: list[list[tuple[list, bool]]] = [[(items[k : k + _FANOUT], True) for k in range(0, len(items), _FANOUT)] or [([], True)]]
    while len(levels[0]) > 1:
        below = levels[0]
        levels.insert(0, [(list(range(k, min(k + _FANOUT, len(below)))), False) for k in range(0, len(below), _FANOUT)])
    size_of = lambda node: 4 + (sum(len(i[0]) for i in node[0]) if node[1] else len(node[0]) * (inner + 8))
    places, here = [], at
    for level in levels:
        places.append([])
        for node in level:
            places[-1].append(here)
            here += size_of(node)

    def span(depth: int, k: int) -> tuple:
        node, leaf = levels[depth][k]
        ends = [(i[1], i[2]) for i in node] if leaf else [span(depth + 1, c) for c in node]
        return min(e[0] for e in ends), max(e[1] for e in ends)

    out = b""
    for depth, level in enumerate(levels):
        for node, leaf in level:
            out += struct.pack("<BBH", leaf, 0, len(node))
            for child in node:
                if leaf:
                    out += child[0]
                else:
                    first, last = span(depth + 1, child)
                    key = struct.pack("<IIII", *first, *last) if inner == 16 else first[0]
                    out += key + struct.pack("<Q", places[depth + 1][child])
    return out, here - at


def _block_index(blocks: list[tuple[int, int, int, int, int, int]], at: int, end_of_data: int) -> bytes:
    """Index over blocks (first chromosome, start, last chromosome, end, address, bytes), in order."""
    items = [(struct.pack("<IIIIQQ", *b), (b[0], b[1]), (b[2], b[3])) for b in blocks]
    nodes, _ = _tree(items, at + 48, 16)
    first = (blocks[0][0], blocks[0][1]) if blocks else (0, 0)
    last = max((b[2], b[3]) for b in blocks) if blocks else (0, 0)
    return struct.pack("<IIQIIIIQII", _INDEX, _FANOUT, len(blocks), *first, *last, end_of_data, 1, 0) + nodes


def write_bigwig(track: DataFrame, chroms: DataFrame, path: str, levels: int = 8) -> None:
    """(chrom, start, end, value) as one file, with summaries of up to ``levels`` widths, each four times the one before.

    Tasks sort the intervals, pack blocks of 1,024 values or 512 summaries and write them to their places; the driver sees a row
    for each block and writes names, indexes and totals. Null and NaN values are left out; unknown chromosomes, empty
    intervals, overlaps and ends beyond the chromosome are errors.
    """
    spark = track.sparkSession
    listed = sorted((r["chrom"], r["size"]) for r in chroms.select("chrom", "size").collect())
    numbers = spark.createDataFrame([(n, k, s) for k, (n, s) in enumerate(listed)], "chrom string, c int, size bigint")
    given = track.where("value IS NOT NULL AND NOT isnan(value)").select("chrom", "start", "end", F.col("value").cast("float").alias("value"))
    bad = F.col("c").isNull() | (F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.col("size"))
    where = F.concat(F.lit("no interval of a known chromosome: "), F.col("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    checked = given.join(numbers, "chrom", "left").withColumn("start", F.when(bad, F.raise_error(where)).otherwise(F.col("start"))).select("c", "start", "end", "value", "size")
    rows = shared_table(numbered(checked, ["c"], ["start", "end"]))
    bases = F.col("end") - F.col("start")
    value = F.col("value").cast("double")
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(bases).alias("n"), F.min("value").alias("least"), F.max("value").alias("largest"), F.sum(bases * value).alias("sum"), F.sum(bases * value * value).alias("squares")).first()
    kind = "kind string, chunk bigint, body binary, c int, first bigint, last bigint"

    def chunk_of(size: int):
        return F.shiftleft(F.col("c").cast("bigint"), 32) + F.floor(F.col("pos") / size)

    def made(name: str, key: tuple, table: pa.Table, dtype: np.dtype, head) -> pa.Table:
        table = table.sort_by("pos")
        items = np.zeros(table.num_rows, dtype)
        for field in dtype.names:
            items[field] = table[field].to_numpy()
        start, end = table["start"].to_numpy(), table["end"].to_numpy()
        if (start[1:] < end[:-1]).any():
            raise ValueError("intervals overlap")
        c = table["c"][0].as_py()
        body = zlib.compress(head(c, items, start, end) + items.tobytes())
        return pa.table({"kind": [name], "chunk": [key[0].as_py()], "body": pa.array([body], pa.binary()), "c": pa.array([c], pa.int32()), "first": [int(start[0])], "last": [int(end.max())]})

    def values(key: tuple, table: pa.Table) -> pa.Table:
        dtype = np.dtype([("start", "<u4"), ("end", "<u4"), ("value", "<f4")])
        return made("values", key, table, dtype, lambda c, items, s, e: struct.pack("<IIIIIBBH", c, int(s[0]), int(e[-1]), 0, 0, _BED_GRAPH, 0, len(items)))

    def summaries_of(name: str):
        dtype = np.dtype([("c", "<u4"), ("start", "<u4"), ("end", "<u4"), ("n", "<u4"), ("least", "<f4"), ("largest", "<f4"), ("sum", "<f4"), ("squares", "<f4")])

        def summaries(key: tuple, table: pa.Table) -> pa.Table:
            return made(name, key, table, dtype, lambda *_: b"")

        return summaries

    chunks = rows.drop("size").withColumn("chunk", chunk_of(_VALUES)).groupBy("chunk").applyInArrow(values, kind)
    steps: list[int] = []
    if total["rows"]:
        step = max(10, 10 * total["n"] // total["rows"])
        begin = F.col("bin") * step
        lap = F.least("end", begin + step) - F.greatest("start", begin)
        sums = [F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares")]
        near = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("end") - 1) / step)))).select("c", "size", "bin", lap.alias("n"), value.alias("least"), value.alias("largest"), (lap * value).alias("sum"), (lap * value * value).alias("squares"))
        longest = max(s for _, s in listed)
        while len(steps) < levels and (not steps or step < longest):
            level = shared_table(near.groupBy("c", "size", "bin").agg(*sums))
            steps.append(step)
            name = f"zoom{len(steps):02d}"
            placed = numbered(level, ["c"], ["bin"]).select("c", (F.col("bin") * step).alias("start"), F.least((F.col("bin") + 1) * step, F.col("size")).alias("end"), "n", "least", "largest", "sum", "squares", "pos")
            chunks = chunks.unionByName(placed.withColumn("chunk", chunk_of(_SUMMARIES)).groupBy("chunk").applyInArrow(summaries_of(name), kind))
            near, step = level.withColumn("bin", F.floor(F.col("bin") / 4)), step * 4
    out = PlannedFile(path)
    width = max((len(n.encode()) for n, _ in listed), default=1)
    names_at = 64 + 24 * len(steps) + 40
    leaves = [(n.encode().ljust(width, b"\0") + struct.pack("<II", k, s), (n.encode().ljust(width, b"\0"),), (b"",)) for k, (n, s) in enumerate(listed)]
    nodes, _ = _tree(leaves, names_at + 32, width)
    names = struct.pack("<IIIIQQ", _NAMES, min(_FANOUT, max(1, len(listed))), width, 8, len(listed), 0) + nodes
    data_at = names_at + len(names)
    places, at, kept = out.write_chunks(chunks, data_at + 8)
    spans: dict[str, list[tuple[int, int, int]]] = {}
    for r in sorted(kept.select("kind", "chunk", "c", "first", "last").collect()):  # a row for each block
        spans.setdefault(r["kind"], []).append((r["c"], r["first"], r["last"]))
    for k, (one, two) in enumerate(zip(spans.get("values", []), spans.get("values", [])[1:])):
        if one[0] == two[0] and one[2] > two[1]:
            raise ValueError("intervals overlap")
    heads, index_at = [], {}
    for name in ["values", *(f"zoom{k + 1:02d}" for k in range(len(steps)))]:
        blocks = [(c, first, c, last, a, n) for (c, first, last), (a, n) in zip(spans.get(name, []), places.get(name, []))]
        index_at[name] = at
        index = _block_index(blocks, at, at)
        out.write(at, index)
        at += len(index)
    for k, step in enumerate(steps):
        name = f"zoom{k + 1:02d}"
        heads.append(struct.pack("<IIQQ", step, 0, places[name][0][0], index_at[name]))
    head = struct.pack("<IHHQQQHHQQIQ", _FILE, 4, len(steps), names_at, data_at, index_at["values"], 0, 0, 0, 64 + 24 * len(steps), max(24 + 12 * _VALUES, 32 * _SUMMARIES), 0)
    summary = struct.pack("<Qdddd", total["n"] or 0, total["least"] or 0, total["largest"] or 0, total["sum"] or 0, total["squares"] or 0)
    out.write(0, head + b"".join(heads) + summary + names + struct.pack("<Q", len(spans.get("values", []))))
    out.write(at, struct.pack("<I", _FILE))
    out.done()
