"""Removal of repeated word runs with suffix automata.

Candidates come from ``repeats``: runs of words that share an anchor with others, or that are equal by hash. The runs of
one anchor or hash are one reference shard: in document order each run is streamed through the suffix automaton of those
before it, and its matching statistics tell which of its windows occurred earlier. The reference is the corpus itself,
which has no size bound; so the automata are not broadcast, but built where the runs of their shard meet. Only runs that
are equal to an earlier one of the same task, in their own hash and in every word's, are not sent there again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.llm import arrays
from chromaweave.llm.repeats import LAST, Windows, covered, keyed, with_spans


class SuffixAutomaton:
    """All substrings of the sequences added."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, step: dict, link: int, length: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, before: int, symbol, target: int) -> int:
        """The state of ``before``'s longest string with ``symbol``, apart from longer ones in ``target``."""
        if self.length[target] == self.length[before] + 1:
            return target
        copy = self._state(dict(self.next[target]), self.link[target], self.length[before] + 1)
        self.link[target] = copy
        while before >= 0 and self.next[before].get(symbol) == target:
            self.next[before][symbol] = copy
            before = self.link[before]
        return copy

    def add(self, symbols: list) -> None:
        last = 0
        for symbol in symbols:
            target = self.next[last].get(symbol)
            if target is not None:
                last = self._split(last, symbol, target)
                continue
            new = self._state({}, 0, self.length[last] + 1)
            before = last
            while before >= 0 and symbol not in self.next[before]:
                self.next[before][symbol] = new
                before = self.link[before]
            if before >= 0:
                self.link[new] = self._split(before, symbol, self.next[before][symbol])
            last = new

    def matching_statistics(self, symbols: list) -> list[int]:
        """For each place, the length of the longest run that ends there and was added before."""
        state = size = 0
        out = []
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            target = self.next[state].get(symbol)
            if target is None:
                size = 0
            else:
                state, size = target, size + 1
            out.append(size)
        return out


def compare_with_automata(w: Windows, anchors: list[int], pieces: list[bytes], orders: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a piece that also occur in an earlier piece of its anchor; pieces come in order."""
    which, starts = [], []
    at = 0
    while at < len(pieces):
        until = at + 1
        while until < len(pieces) and anchors[until] == anchors[at]:
            until += 1
        automaton = SuffixAutomaton()
        while at < until:
            tied = at + 1  # rows that repeat an id: neither is earlier
            while tied < until and orders[tied] == orders[at] and lows[tied] == lows[at]:
                tied += 1
            fresh = []
            for k in range(at, tied):
                words = np.frombuffer(pieces[k], np.uint64).tolist()
                ends = [e for e, size in enumerate(automaton.matching_statistics(words)) if size >= w.length]
                which += [k] * len(ends)
                starts += [e - w.length + 1 for e in ends]
                if len(ends) < len(words) - w.length + 1:  # else all its windows are known
                    fresh.append(words)
            for words in fresh:
                automaton.add(words)
            at = tied
    return np.array(which, np.int64), np.array(starts, np.int64)


def _word_units(column: pa.Array):
    data, starts, ends = arrays.text_buffers(column)
    begin, end = arrays.word_spans(data, starts, arrays.white_space())
    hashes = arrays.hash_words(data, begin, end)
    return hashes, np.searchsorted(begin, starts), np.searchsorted(begin, ends), hashes


def _without(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").encode().split()
                gone = covered(spans, len(words))
                kept = b" ".join([x for x, g in zip(words, gone) if not g] if spans else words)
                rows.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if with_text else [])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=names)

    return run


def remove_repeated_words(docs: DataFrame, length: int = 20, gram: int = 8, with_text: bool = False, hot: int = 500) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256; with_text: the kept words, joined by one space.

    A word is removed if a run of ``length`` words that covers it also starts earlier: in a document of smaller
    doc_id, or further ahead in the same one, as judged on the input. Null texts have no words; texts of fewer
    words lose nothing; rows that share a doc_id count as one document and are compared by place; a null
    doc_id is larger than all others; repeated rows are answered each; other columns are ignored.
    """
    joined = with_spans(keyed(docs), Windows(length, gram, _word_units, True, whole=True), compare_with_automata, block_units=1 << 21, hot=hot).select(F.when(F.col("order_id") != LAST, F.col("order_id")).alias("doc_id"), "text", "spans")
    return joined.mapInArrow(arrays.freeing(_without(with_text)), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", text string" if with_text else ""))
