"""SentencePiece encoding and decoding with N-best segmentations of the piece lattice.

A text is normalised as its model file says and cut where no piece can reach across: before each run of space
marks. Each such unit is a lattice of pieces. A forward Viterbi pass gives the best score up to every place; these
scores are exact heuristics for an A* search from the end back to the start, which therefore yields segmentations
best first, and needs to leave no place more than N times. A document's N best combine those of its units: at most
N - 1 of these can differ from their best, and what A* finds for them is taken; for the others the best path alone
is needed, which is found for many units at once.

Of equal scores the segmentation with the longer first piece comes first, then the one with the longer second, and
so on. Piece scores are 32-bit floats, so their sums in 64 bits are exact and equal ones compare as equal.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.llm.arrays import freeing
from chromaweave.llm.arrays import slices as text_slices

SPACE = "▁"


_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longer units are searched one by one, not in arrays; what is found is the same.
_LONGEST = 48


@dataclass
class PieceLattice:
    """Pieces of a model, their scores, and searches over the lattices of units."""

    table: dict[str, tuple]  # (score, (id,)) of pieces, and () of what only begins one
    texts: list[str]
    byte_ids: list[int]
    unknown: int
    penalty: float
    hashes: np.ndarray  # of the table's strings, sorted, with their scores and ids (-1: no piece)
    hash_scores: np.ndarray
    hash_ids: np.ndarray

    @classmethod
    def of(cls, processor) -> PieceLattice:
        size = processor.get_piece_size()
        texts = [processor.id_to_piece(i) for i in range(size)]
        scores = [processor.get_score(i) for i in range(size)]
        usable = [i for i in range(size) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
        if any(SPACE in texts[i].lstrip(SPACE) for i in usable):
            raise ValueError("pieces that hold a space mark after other characters are not supported")
        byte_ids = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(processor.is_byte(i) for i in byte_ids):
            byte_ids = []
        table = {texts[i][:k]: () for i in usable for k in range(1, len(texts[i]))} | {texts[i]: (scores[i], (i,)) for i in usable}
        hashes = np.zeros(len(table), np.uint64)
        for k, string in enumerate(table):
            h = 0
            for char in string:
                h = (h * int(_BASE) + ord(char) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[k] = h
        order = np.argsort(hashes)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        values = list(table.values())
        return cls(table, texts, byte_ids, processor.unk_id(), min(scores[i] for i in usable if len(texts[i]) == 1) - 10, hashes[order], np.array([v[0] if v else 0.0 for v in values])[order], np.array([v[1][0] if v else -1 for v in values], np.int32)[order])

    def _of_unknown(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode()) if self.byte_ids else (self.unknown,)

    def _forward(self, unit: str) -> tuple[list[float], list[list[tuple[int, tuple]]]]:
        """The best score of unit[:k], and the edges (start, (score, ids)) that end at k, for each k."""
        size, look = len(unit), self.table.get
        ahead = [0.0] + [float("-inf")] * size
        ending: list[list[tuple[int, tuple]]] = [[] for _ in ahead]
        for at in range(size):
            so_far = ahead[at]
            for end in range(at + 1, size + 1):
                got = look(unit[at:end])
                edge = got
                if not got and end == at + 1:
                    edge = (self.penalty, self._of_unknown(unit[at]))
                if edge:
                    ending[end].append((at, edge))
                    ahead[end] = max(ahead[end], so_far + edge[0])
                if got is None:
                    break
        return ahead, ending

    def best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best (score, ids) of a unit, best first.

        The k-th state to leave a place is the k-th best way from there to the end: among equal totals places near
        the end go first, then states with the longer first piece, then with the better rest. So no place is left
        more than ``n`` times, and the work is in proportion to the unit's length.
        """
        ahead, ending = self._forward(unit)
        left = [0] * len(ahead)
        found: list[tuple[float, tuple[int, ...]]] = []
        heap: list[tuple] = [(-ahead[-1], -len(unit), 0, 0, 0.0, None)]
        while heap and len(found) < n:
            _, place, _, _, behind, way = heapq.heappop(heap)
            rank = left[-place]
            if rank == n:
                continue
            left[-place] += 1
            if place == 0:
                ids: list[int] = []
                while way:
                    ids += way[0]
                    way = way[1]
                found.append((behind, tuple(ids)))
                continue
            for start, (score, piece) in ending[-place]:
                if left[start] == n:
                    continue
                total = behind + score
                heapq.heappush(heap, (-(ahead[start] + total), -start, place, rank, total, (piece, way)))
        return found

    def first(self, units: list[str]) -> list[tuple[bytes, float, str, float]]:
        """Of each unit: the ids of its best segmentation, their score, the text they show, and what the second best loses."""
        out: list = [None] * len(units)
        by_width: dict[int, list[int]] = {}
        for k, unit in enumerate(units):
            by_width.setdefault(-(-len(unit) // 8) * 8, []).append(k)
        for width, which in by_width.items():
            left = which if width > _LONGEST else []
            for s in range(0, len(which) if not left else 0, 20_000):
                left = left + self._first_of_width([units[k] for k in which[s : s + 20_000]], which[s : s + 20_000], width, out)
            for k in left:
                ways = self.best(units[k], 2)
                ids = ways[0][1]
                out[k] = (np.array(ids, "<i4").tobytes(), ways[0][0], self.shown(ids), ways[0][0] - ways[1][0] if len(ways) > 1 else float("inf"))
        return out

    def _first_of_width(self, units: list[str], names: list[int], width: int, out: list) -> list[int]:
        """``first`` of units of up to ``width`` characters, all at once; those with a character that is no piece are returned."""
        n = len(units)
        sizes = np.array([len(u) for u in units])
        chars = np.zeros((n, width), np.uint64)
        chars[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        ahead = np.full((n, width + 1), -np.inf)
        ahead[:, 0] = 0
        edges = []
        odd = np.zeros(n, bool)
        for at in range(width):
            rows = np.flatnonzero(sizes > at)
            h, single = np.zeros(len(rows), np.uint64), np.zeros(n, bool)
            for end in range(at + 1, width + 1):
                h = h * _BASE + chars[rows, end - 1]
                place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = (self.hashes[place] == h) & (sizes[rows] >= end)
                rows, h, place = rows[known], h[known], place[known]
                ids = self.hash_ids[place]
                whole = ids >= 0
                own, score = rows[whole], self.hash_scores[place[whole]]
                if end == at + 1:
                    single[own] = True
                ahead[own, end] = np.maximum(ahead[own, end], ahead[own, at] + score)
                edges.append((own, at, end, score, ids[whole]))
                if not len(rows):
                    break
            odd |= ~single & (sizes > at)
        fine = np.flatnonzero(~odd)
        behind = np.full((n, width + 1), -np.inf)
        behind[np.arange(n), sizes] = 0
        next_end = np.zeros((n, width + 1), np.int32)
        piece = np.zeros((n, width), np.int32)
        for own, start, end, score, ids in reversed(edges):  # of one start, long pieces come first
            total = behind[own, end] + score
            better = total > behind[own, start]
            own = own[better]
            behind[own, start], next_end[own, start], piece[own, start] = total[better], end, ids[better]
        chosen = np.full((n, width), -1, np.int32)
        at = np.where(odd, sizes, 0)
        while (live := np.flatnonzero(at < sizes)).size:
            chosen[live, at[live]] = piece[live, at[live]]
            at[live] = next_end[live, at[live]]
        second = np.full(n, -np.inf)
        for own, start, end, score, _ in edges:
            off = (chosen[own, start] < 0) | (next_end[own, start] != end)
            own = own[off]
            second[own] = np.maximum(second[own], ahead[own, start] + score[off] + behind[own, end])
        best = behind[:, 0]
        counts = (chosen >= 0).sum(1)
        ids = chosen[fine][chosen[fine] >= 0]
        flat = ids.astype("<i4").tobytes()
        pieces = [self.texts[i] for i in ids.tolist()]
        ends = np.cumsum(counts[fine])
        begin = 0
        for k, end, score, loss in zip(fine.tolist(), ends.tolist(), best[fine].tolist(), (best[fine] - second[fine]).tolist()):
            out[names[k]] = (flat[4 * begin : 4 * end], score, "".join(pieces[begin:end]), loss)
            begin = end
        return [names[k] for k in np.flatnonzero(odd)]

    def shown(self, ids: tuple[int, ...]) -> str:
        """The text that a unit's ids show, with its space marks."""
        return self.decode((*self.table[SPACE][1], *ids)).replace(" ", SPACE)

    @cached_property
    def _byte_of(self) -> dict[int, int]:
        return {p: b for b, p in enumerate(self.byte_ids)}

    def decode(self, ids) -> str:
        """The text of ids, as the model's own library gives it (without its first space)."""
        out = bytearray()
        for i in ids:
            if i in self._byte_of:
                out.append(self._byte_of[i])
            else:
                out += self.texts[i].encode()
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def choices(losses_of_units: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best combinations of units, each with ascending losses, the first 0: loss, and which way of each unit."""
    found: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for own in losses_of_units:
        found = sorted((a + b, (*way, k)) for a, way in found for k, b in enumerate(own))[:n]
    return found


def combine(losses_of_units: list[list[float]], n: int) -> list[float]:
    """Losses of the ``n`` best combinations of units, each with ascending losses, the first 0."""
    return [loss for loss, _ in choices(losses_of_units, n)]


class _Remembered:
    """What was found for units, up to ``most`` characters of them: when half of that is new, what was not asked for
    since the half before goes."""

    def __init__(self, most: int):
        self.half, self.size = most // 2, 0
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def absent(self, units: set[str]) -> list[str]:
        """Those of ``units`` that are not known; the others are as if found now."""
        out = []
        for unit in units.difference(self.young):
            got = self.old.get(unit)
            if got is None:
                out.append(unit)
            else:
                self._keep(unit, got)
        return out

    def put(self, units: list[str], found: list[tuple]) -> None:
        for unit, got in zip(units, found):
            self._keep(unit, got)

    def _keep(self, unit: str, got: tuple) -> None:
        self.young[unit] = got
        self.size += len(unit) + 1

    def turn(self) -> None:
        """To be called when a batch is done."""
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0


_RESULT = "doc_id bigint, n_pieces bigint, score double, nbest_scores array<double>, nbest_sha256 array<string>, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def _encoded(model: bytes, n: int, memory: int, with_ids: bool, with_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # what is remembered has no cycles; scanning it over and over takes most of the time
        try:
            yield from encode(batches)
        finally:
            gc.enable()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        lattice = PieceLattice.of(processor)
        alone = "".join(c for c in "\n\t\r" if c not in lattice.table)  # no piece reaches across what is in none
        cut = regex.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        known, searched = _Remembered(memory), _Remembered(memory // 8)
        first, second, third, fourth = (itemgetter(k) for k in range(4))
        for batch in (part for b in batches for part in text_slices(b, 1)):
            rows: list[list] = [[] for _ in range(9)]
            texts = [text or "" for text in batch.column(1).to_pylist()]
            cuts = [cut(processor.normalize(text)) for text in texts]
            new = known.absent(set().union(*cuts))
            known.put(new, lattice.first(new))
            found = known.young
            for doc_id, text, units in zip(batch.column(0).to_pylist(), texts, cuts):
                chosen = [found[u] for u in units]
                # only the n - 1 units whose second best loses least can be in one of the n best
                losses = list(map(fourth, chosen))
                closest = sorted(heapq.nsmallest(n - 1, range(len(losses)), key=losses.__getitem__)) if n > 1 else []
                new = searched.absent({units[k] for k in closest})
                searched.put(new, [lattice.best(u, n) for u in new])
                ways = [searched.young[units[k]] for k in closest]
                parts = list(map(first, chosen))
                score = float(sum(map(second, chosen)))
                shown = list(map(third, chosen))
                for k, own in zip(closest, ways):
                    shown[k] = lattice.shown(own[0][1])
                decoded = "".join(shown).replace(SPACE, " ")
                decoded = decoded[1:] if decoded.startswith(" ") else decoded
                scores, packs = [], []
                for loss, way in choices([[w[0][0] - s for s, _ in w] for w in ways], n):
                    for k, own, which in zip(closest, ways, way):
                        parts[k] = np.array(own[which][1], "<i4").tobytes()
                    scores.append(score - loss)
                    packs.append(b"".join(parts))
                digests = [hashlib.sha256(p).hexdigest() for p in packs]
                values = (doc_id, len(packs[0]) // 4, score, scores, digests, digests[0], hashlib.sha256(decoded.encode()).hexdigest(), decoded == text, [np.frombuffer(p, "<i4") for p in packs] if with_ids else None)
                for column, value in zip(rows, values):
                    column.append(value)
            known.turn()
            searched.turn()
            arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.list_(pa.float64())), pa.array(rows[4], pa.list_(pa.string())), pa.array(rows[5], pa.string()), pa.array(rows[6], pa.string()), pa.array(rows[7], pa.bool_())]
            names = ["doc_id", "n_pieces", "score", "nbest_scores", "nbest_sha256", "ids_sha256", "decoded_sha256", "round_trip"]
            if with_ids:
                arrays += [pa.array([x[0] for x in rows[8]], pa.list_(pa.int32())), pa.array(rows[8], pa.list_(pa.list_(pa.int32())))]
                names += ["ids", "nbest_ids"]
            if with_text:
                arrays.append(batch.column(1))
                names.append("text")
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode_pieces(docs: DataFrame, model_path: str, n_best: int = 3, characters_in_memory: int = 4_000_000, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_pieces and score of the best segmentation, scores of the ``n_best`` best and
    SHA-256 of the ids of each (32-bit little-endian), that of the best by itself, SHA-256 of the text decoded from
    the best ids, and whether that is the text.

    Characters without a piece become byte pieces at a fixed penalty. Null and empty texts have no pieces, score
    0, one segmentation and a round trip to the empty text. Texts that hold the space mark itself come back with
    spaces. Repeated rows are answered each; a null doc_id stays null; other columns are ignored. ``ids`` (the
    best) and ``nbest_ids`` (each of the ``n_best``) are returned with ``with_ids`` only, the text as it came with
    ``with_text``; ``characters_in_memory`` bounds the units that a task remembers. Of equal scores the longer first
    piece comes first within a unit; of equal documents the one that differs from the best in a later unit.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    more = (", ids array<int>, nbest_ids array<array<int>>" if with_ids else "") + (", text string" if with_text else "")
    return texts.mapInArrow(freeing(_encoded(model, n_best, characters_in_memory, with_ids, with_text)), _RESULT + more)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with (doc_id, ids); null ids decode to the empty text."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        lattice = PieceLattice.of(sentencepiece.SentencePieceProcessor(model_proto=model))
        for batch in batches:
            texts = [lattice.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")
