"""Byte ranges of files read by tasks, and files that tasks write side by side at places planned beforehand."""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.tables import shared_table


def ranged(path: str) -> Callable[[int, int], bytes]:
    """``read(offset, length)`` of a file, local or in a store that Arrow knows by its URI."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    opened = store.open_input_file(name)
    return lambda at, n: opened.read_at(n, at)


def size_of(path: str) -> int:
    """Bytes of a file."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.get_file_info(name).size


def local_files(path: str) -> list[str]:
    """The files of a path: one, all in a folder, or all that a pattern names."""
    if "://" in path:
        return [path]
    found = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path) if glob.has_magic(path) else [path])
    return [f for f in found if os.path.isfile(f) and not os.path.basename(f).startswith(("_", "."))] or [path]


def local_path(path: str) -> str:
    """The path of a file that tasks can write at any place."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: a file of this format is written in place, so it needs a folder that all executors have mounted")
    return unquote(parts.path) if parts.scheme else path


class PlannedFile:
    """A file under a passing name until all of it is there."""

    def __init__(self, path: str):
        self.path = local_path(path)
        self.passing = f"{self.path}.{uuid.uuid4().hex}.part"
        with open(self.passing, "wb"):
            pass

    def write(self, at: int, data: bytes) -> None:
        with open(self.passing, "r+b") as f:
            os.pwrite(f.fileno(), data, at)

    def done(self) -> None:
        os.replace(self.passing, self.path)

    def write_chunks(self, chunks: DataFrame, at: int) -> tuple[dict[str, list[tuple[int, int]]], int, DataFrame]:
        """(kind, chunk, body, ...) written from ``at`` on, by kind and chunk: of each kind the places (address, bytes) in order of
        chunk, where the last ends, and the chunks as a table.

        Chunks are made once, into a table; their sizes (a row for each chunk) give the places, and then every task writes its
        own. A task that is run again writes the same bytes to the same places.
        """
        kept = shared_table(chunks)
        sizes = sorted((r["kind"], r["chunk"], r["size"]) for r in kept.select("kind", "chunk", F.length("body").alias("size")).collect())
        places: dict[str, list[tuple[int, int]]] = {}
        listed = []
        for kind, chunk, size in sizes:
            places.setdefault(kind, []).append((at, size))
            listed.append((kind, chunk, at))
            at += size
        if not listed:
            return places, at, kept
        passing = self.passing

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with open(passing, "r+b") as f:
                for batch in batches:
                    for where, body in zip(batch.column(0), batch.column(1)):
                        os.pwrite(f.fileno(), body.as_py(), where.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

        where = kept.sparkSession.createDataFrame(listed, "kind string, chunk bigint, address bigint")
        written = kept.select("kind", "chunk", "body").join(where, ["kind", "chunk"]).select("address", "body").mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0]
        if written != len(listed):
            raise OSError(f"{written} of {len(listed)} chunks were written to {self.path}")
        return places, at, kept
