"""Removal of repeated byte strings with two-stage suffix arrays.

Candidates come from ``repeats``: runs of bytes that share an anchor with others. Where hashes do not settle them, a
suffix array of the runs does: only suffixes smaller than their successors are sorted directly, the others are induced
by scanning the buckets of first bytes, and neighbours with long enough common prefixes are equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.llm import arrays
from chromaweave.llm.repeats import LAST, Windows, all_but, covered, keyed, put_back, with_spans


def _byte_units(column: pa.Array):
    data, starts, ends = arrays.text_buffers(column)
    return arrays._BYTE_VALUES[data], starts, ends, data


def _eights(text: np.ndarray) -> np.ndarray:
    """Eight symbols from each place on as one number, in dictionary order; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(text)]
    return out


def _sort_directly(eights: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """``which`` suffixes in order of their first ``depth`` symbols at least."""
    which = which[np.argsort(eights[which], kind="stable")]
    key = eights[which]
    tied_to = np.zeros(len(which), bool)
    tied_to[1:] = key[1:] == key[:-1]
    n = len(eights)
    for at in range(8, depth, 8):
        inside = tied_to.copy()
        inside[:-1] |= tied_to[1:]
        places = np.flatnonzero(inside)
        if not len(places):
            break
        group = np.cumsum(~tied_to)[places]
        some = which[places]
        key = np.where(some + at < n, eights[np.minimum(some + at, n - 1)], 0)
        order = np.lexsort((key, group))
        which[places] = some[order]
        key = key[order]
        equal = np.zeros(len(places), bool)
        equal[1:] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        tied_to[places] = equal
    return which


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a byte array by their first ``depth`` symbols at least, in two stages."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # a suffix is smaller than its successor if the next other symbol is larger
    change = np.flatnonzero(text[1:] != text[:-1])
    run = np.searchsorted(change, np.arange(n))
    smaller = np.zeros(n, bool)
    has = run < len(change)
    smaller[has] = text[change[run[has]] + 1] > text[np.flatnonzero(has)]
    direct = _sort_directly(_eights(text), np.flatnonzero(smaller), depth)
    edges = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))
    out = []

    def induce(suffixes: np.ndarray, symbol: int) -> np.ndarray:
        """Deal the predecessors out to the buckets of larger symbols; those of the same symbol are returned."""
        before = suffixes[suffixes > 0] - 1
        head = text[before]
        larger = before[head > symbol]
        heads = text[larger]
        order = np.argsort(heads, kind="stable")
        names, at = np.unique(heads[order], return_index=True)
        for name, some in zip(names, np.split(larger[order], at[1:])):
            induced[name].append(some)
        return before[head == symbol]

    for symbol in range(256):
        wave = np.concatenate(induced[symbol]) if induced[symbol] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, symbol)
        own = direct[edges[symbol] : edges[symbol + 1]]
        if len(own):
            out.append(own)
            induce(own, symbol)
    return np.concatenate(out)


def common_prefixes(eights: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in ``order``, up to ``most``; 0 for the first."""
    n = len(eights)
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, most, 8):
        a, b = order[alive] + at, order[alive - 1] + at
        x = np.where(a < n, eights[np.minimum(a, n - 1)], 0) ^ np.where(b < n, eights[np.minimum(b, n - 1)], 0)
        same = np.full(len(x), 8)
        differs = np.flatnonzero(x)
        same[differs] = _leading_zero_bytes(x[differs])
        out[alive] += same
        alive = alive[same == 8]
    return np.minimum(out, most)


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    """Of numbers that are not 0."""
    return (x[:, None] >> (np.arange(7, -1, -1, dtype=np.uint64) * np.uint64(8)) > 0).argmax(1)


def compare_with_suffix_array(w: Windows, anchors: list[int], pieces: list[bytes], orders: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a piece that also occur in a piece of an earlier document."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1)  # one separator behind each
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).copy()
    apart = np.zeros(len(text), bool)
    apart[ends - 1] = True
    text = np.where(apart, 0, np.minimum(text, 254) + 1).astype(np.uint8)  # UTF-8 has no byte above 0xF4
    order = suffix_array(text, w.length)
    longest = common_prefixes(_eights(text), order, w.length)
    piece = np.searchsorted(ends, order, "right")
    start = order - (ends - sizes - 1)[piece]
    valid = start + w.length <= sizes[piece]
    group = np.cumsum(longest < w.length)
    order, group, piece, start = order[valid], group[valid], piece[valid], start[valid]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    earliest = np.minimum.reduceat(orders[piece], fresh)
    late = orders[piece] > np.repeat(earliest, np.diff(np.append(fresh, len(group))))
    by = np.lexsort((start[late], piece[late]))
    return piece[late][by], start[late][by]


def _without(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer((text or "").encode(), np.uint8)
                gone = covered(spans, len(data))
                kept = data[~gone].tobytes()
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0])))
                rows.append((doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if with_text else [])))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if with_text else [])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=names)

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = 50, gram: int = 16, with_text: bool = False, hot: int = 500) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text: the kept text, too.

    A byte is removed if a ``length``-byte string that covers it also starts in a document of smaller doc_id,
    as judged on the input. Null and empty texts, and those under ``length`` bytes, lose nothing; rows that
    share a doc_id do not count against each other; a null doc_id is larger than all others; repeated rows are
    answered each; other columns are ignored. ``hot``: runs that more others share meet window by window. The kept text leaves out bytes of cut characters.
    """
    joined = with_spans(keyed(docs), Windows(length, gram, _byte_units, False), compare_with_suffix_array, hot=hot).select(F.when(F.col("order_id") != LAST, F.col("order_id")).alias("doc_id"), "text", "spans")
    return joined.mapInArrow(arrays.freeing(_without(with_text)), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", text string" if with_text else ""))


def cut_repeated_bytes(docs: DataFrame, length: int = 50, gram: int = 16) -> DataFrame:
    """``docs`` with all its columns, its texts without what ``remove_repeated_bytes`` removes, and n_chars to match.

    Bytes of characters that a cut leaves in part go as well; a null text stays null.
    """
    joined = with_spans(keyed(docs, all_but(docs, "text")), Windows(length, gram, _byte_units, False), compare_with_suffix_array).select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if spans:
                    data = np.frombuffer(text.encode(), np.uint8)
                    text = data[~covered(spans, len(data))].tobytes().decode("utf-8", "ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    cut = put_back(joined.mapInArrow(arrays.freeing(run), joined.drop("spans").schema), docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut
