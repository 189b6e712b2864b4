"""Text in xz files, block by block: the index at a file's end tells where blocks are, and each is unpacked by itself."""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chromaweave.sources.chunked import PlannedFile, local_files, ranged, size_of

# Fixed values of the format: marks of a stream's start and end.
_START, _END = b"\xfd7zXZ\0", b"YZ"
#: Unpacked bytes of a task, and lines of a stream that is written.
_BYTES_A_TASK, _LINES = 32 << 20, 65_536


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, and where it ends."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _coded(value: int) -> bytes:
    out = b""
    while value >= 128:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


@dataclass
class Block:
    """Where a block is, its bytes without padding, those of its text, and the flags of its stream."""

    at: int
    packed: int
    unpacked: int
    flags: bytes


def blocks_of(read: Callable[[int, int], bytes], size: int) -> list[Block]:
    """The blocks of a file, whose streams are gone through from the last to the first."""
    found: list[list[Block]] = []
    end = size
    while end > 0:
        if read(end - 4, 4) == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        foot = read(end - 12, 12)
        if foot[10:] != _END:
            raise ValueError("no xz file")
        index_size = (struct.unpack_from("<I", foot, 4)[0] + 1) * 4
        index = read(end - 12 - index_size, index_size)
        count, at = _number(index, 1)
        sizes = []
        for _ in range(count):
            packed, at = _number(index, at)
            unpacked, at = _number(index, at)
            sizes.append((packed, unpacked))
        start = end - 12 - index_size - sum(-(-p // 4) * 4 for p, _ in sizes) - 12
        if start < 0 or read(start, 6) != _START:
            raise ValueError("damaged xz file")
        at, own = start + 12, []
        for packed, unpacked in sizes:
            own.append(Block(at, packed, unpacked, foot[8:10]))
            at += -(-packed // 4) * 4
        found.append(own)
        end = start
    return [b for own in reversed(found) for b in own]


def unpacked(read: Callable[[int, int], bytes], block: Block) -> bytes:
    """A block's text: it is put into a stream of its own."""
    index = b"\0" + _coded(1) + _coded(block.packed) + _coded(block.unpacked)
    index = index.ljust(-(-len(index) // 4) * 4, b"\0")
    index += struct.pack("<I", zlib.crc32(index))
    tail = struct.pack("<I", len(index) // 4 - 1) + block.flags
    return lzma.decompress(_START + block.flags + struct.pack("<I", zlib.crc32(block.flags)) + read(block.at, -(-block.packed // 4) * 4) + index + struct.pack("<I", zlib.crc32(tail)) + tail + _END)


@dataclass
class _Run(InputPartition):
    """Blocks [low, high) of a file."""

    path: str
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.bytes = options["path"], int(options.get("bytesatask", _BYTES_A_TASK))

    def partitions(self) -> list[_Run]:
        found = []
        for path in local_files(self.path):
            low = held = 0
            blocks = blocks_of(ranged(path), size_of(path))
            for k, block in enumerate(blocks):
                held += block.unpacked
                if held >= self.bytes or k + 1 == len(blocks):
                    found.append(_Run(path, low, k + 1))
                    low, held = k + 1, 0
        return found

    def read(self, run: _Run | None) -> Iterator[pa.RecordBatch]:
        """The lines that begin in a run's blocks, but for one that begins right at its start, which the run before has: it
        reads on to the next line break."""
        if run is None:
            return
        read = ranged(run.path)
        blocks = blocks_of(read, size_of(run.path))
        rest, begun = b"", run.low == 0
        for k, block in enumerate(blocks[run.low :], run.low):
            inside = k < run.high
            if not inside and not begun:
                return
            text = rest + unpacked(read, block)
            if not begun:
                cut = text.find(b"\n")
                if cut < 0:
                    continue
                text, begun = text[cut + 1 :], True
            if not inside:
                cut = text.find(b"\n", len(rest))
                if cut >= 0:
                    yield _lines(run.path, text[: cut + 1])
                    return
                rest = text
                continue
            cut = text.rfind(b"\n") + 1
            if cut:
                yield _lines(run.path, text[:cut])
            rest = text[cut:]
        if rest:
            yield _lines(run.path, rest)


def _lines(path: str, text: bytes) -> pa.RecordBatch:
    found = text.decode().replace("\r\n", "\n").removesuffix("\n").split("\n")
    return pa.RecordBatch.from_pydict({"path": [path] * len(found), "line": pa.array(found, pa.string())})


class XzTextSource(DataSource):
    """``spark.read.format("xztext")``: (path, line) of xz files. Option: ``bytesATask`` (unpacked)."""

    @classmethod
    def name(cls) -> str:
        return "xztext"

    def schema(self) -> str:
        return "path string, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of a file, of all in a folder, or of all that a pattern names. A file of one block is one task."""
    spark.dataSource.register(XzTextSource)
    return spark.read.format("xztext").load(path)


def write_xz_lines(lines: DataFrame, path: str) -> None:
    """(line) in its order as one file of many streams, each of up to 65,536 lines packed and written by a task."""
    row = F.monotonically_increasing_id()
    numbered = lines.select("line", row.alias("row")).withColumn("chunk", F.shiftright("row", 33) * (1 << 33) + F.floor(F.col("row").bitwiseAND((1 << 33) - 1) / _LINES))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        text = "".join(f"{x}\n" for x in rows.sort_by("row")["line"].to_pylist())
        return pa.table({"kind": ["text"], "chunk": [key[0].as_py()], "body": pa.array([lzma.compress(text.encode())], pa.binary())})

    out = PlannedFile(path)
    out.write_chunks(numbered.groupBy("chunk").applyInArrow(packed, "kind string, chunk bigint, body binary"), 0)
    out.done()
