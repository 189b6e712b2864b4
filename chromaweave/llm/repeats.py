"""Which windows of documents also occur earlier: the candidate search of the two repeat-removal operators.

A document is a sequence of units (bytes or words), a window ``length`` consecutive ones. Each window is assigned to
an anchor, the k-gram of smallest hash in it, so equal windows have equal anchors. The windows of one anchor form a
context: a short run of units. Then, for all contexts of the corpus:

1. blocks of documents send one packed row for each bucket of anchors, with a context's first occurrence only;
2. buckets find which contexts occurred earlier (their windows are all repeats) and which share their anchor and half
   of what a window has besides with other contexts (some of their windows may be);
3. the second kind is cut out of the texts, brought together by anchor, and compared unit by unit with the operator's
   own method; the first kind is done, or, with ``whole``, brought together with its first occurrence and compared like
   the second, after each task has kept one of those that are equal unit by unit.

Where a very common passage begins or ends, its contexts differ from document to document, so an anchor may have any
number of them. Halves that more than ``hot`` contexts share are therefore not brought together by anchor: each task
keeps the first occurrence of each of their windows only (equal in hash and unit by unit), and these few are brought
together by window and compared like the other contexts.

Only hashes, flags and the contexts in question travel, besides the texts on their way to the flags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaweave.llm import arrays

_U64 = np.uint64
_LOCAL = 0xFFFF  # layout mark: an equal context came earlier in the block
MAX_BUCKETS = 0xFFFE
#: Sorts after all other documents.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Windows:
    """What a window is: ``length`` units, anchored at k-grams of ``gram`` units. ``units`` gives a text column's unit
    values, each row's first and last place among them, and the array that contexts are cut from. ``ordered``:
    within a document earlier windows count too. ``whole``: contexts with equal hashes are compared as well."""

    length: int
    gram: int
    units: Callable
    ordered: bool
    whole: bool = False


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


#: Units that the context search holds at once; longer rows are searched stretch by stretch, which cuts contexts in two
#: at places that depend on the row alone.
_STRETCH = 1 << 17


def contexts(w: Windows, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
    """What ``_contexts`` returns, found in stretches of rows, and of a long row."""
    found, row = [], 0
    while row < len(first):
        until = max(row + 1, int(np.searchsorted(last, first[row] + _STRETCH, "right")))
        low, high = int(first[row]), int(last[until - 1])
        for begin in range(low, max(low + 1, high - w.length + 1), _STRETCH) if high - low > _STRETCH else (low,):
            end = min(begin + _STRETCH + w.length - 1, high)
            alone = until == row + 1
            got = _contexts(w, values[begin:end], np.array([0]) if alone else first[row:until] - begin, np.array([end - begin]) if alone else last[row:until] - begin)
            got["row"] += row
            for name in ("low", "high", "at"):
                got[name] += begin
            found.append(got)
        row = until
    return {name: np.concatenate([f[name] for f in found]) for name in found[0]} if found else _contexts(w, values, first, last)


def _contexts(w: Windows, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
    """Of each context: its row, first and last window start, and hashes of its anchor, of itself, and of the anchor
    with the units to its left and right that some of its windows must have (0: none of them).

    A window has ``spare`` units besides the anchor: at least ``reach`` to the left, or more than the rest to the right.
    """
    n, width = len(values), w.length - w.gram + 1
    counts = np.maximum(last - first - w.length + 1, 0)
    if n < w.length or not counts.sum():
        return {"row": np.zeros(0, np.int64), "low": np.zeros(0, np.int64), "high": np.zeros(0, np.int64), "at": np.zeros(0, np.int64), "anchor": np.zeros(0, _U64), "own": np.zeros(0, _U64), "left": np.zeros(0, np.uint32), "right": np.zeros(0, np.uint32)}
    sums, scale = arrays.running_sum(values)
    grams = arrays.mix((sums[w.gram :] - sums[: n - w.gram + 1]) * scale[: n - w.gram + 1])
    keys = (grams & _U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U64)
    smallest = _sliding_min(keys, width)
    row = np.repeat(np.arange(len(first)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]
    at = (smallest[start] & _U64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(fresh)
    low, high, at = start[head], start[np.append(head[1:], len(at)) - 1], at[head]
    end = high + w.length

    def hashed(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (sums[e] - sums[s]) * scale[s]

    own = arrays.mix(hashed(low, end) ^ arrays.mix((end - low).astype(_U64) << _U64(32) | (at - low).astype(_U64)))
    spare = w.length - w.gram
    reach = (spare + 1) // 2
    has_left, has_right = at - low >= reach, at - high < reach
    left = np.where(has_left, arrays.mix(hashed(np.maximum(at - reach, 0), at + w.gram)) >> _U64(32) | _U64(1), 0).astype(np.uint32)
    right = np.where(has_right, arrays.mix(hashed(at, np.minimum(at + w.gram + spare - reach + 1, n))) >> _U64(32) | _U64(1), 0).astype(np.uint32)
    return {"row": row[head], "low": low, "high": high, "at": at, "anchor": arrays.mix(grams[at] ^ _U64(0x5851F42D4C957F2D)), "own": own, "left": left, "right": right}


def _pack(left: np.ndarray, right: np.ndarray, own: np.ndarray, order: np.ndarray, place: np.ndarray, again: np.ndarray | None) -> bytes:
    """The hashes as they are; order and place as differences and marks, if any, compressed."""
    tail = np.concatenate([np.diff(c, prepend=np.int64(0)) for c in (order, place)]).tobytes()
    tail += b"" if again is None else again.tobytes()
    return left.tobytes() + right.tobytes() + own.tobytes() + pa.compress(tail, "zstd", asbytes=True)


def _unpack(n: int, packed: bytes, marked: bool) -> tuple[np.ndarray, ...]:
    raw = pa.decompress(packed[16 * n :], (17 if marked else 16) * n, "zstd", asbytes=True)
    tail, again = np.frombuffer(raw[: 16 * n], np.int64), np.frombuffer(raw[16 * n :], bool) if marked else np.zeros(n, bool)
    return np.frombuffer(packed[: 4 * n], np.uint32), np.frombuffer(packed[4 * n : 8 * n], np.uint32), np.frombuffer(packed[8 * n : 16 * n], _U64), np.cumsum(tail[:n]), np.cumsum(tail[n:]), again


def _with_late(by: np.ndarray, new: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Which contexts have an equal one that is late; ``by`` sorts equal ones together, each of ``new`` begins some."""
    group = np.cumsum(new) - 1
    out = np.zeros(len(by), bool)
    out[by] = (np.bincount(group, weights=late[by]) > 0)[group]
    return out


_SENT = "bucket bigint, block bigint, n int, packed binary"


def _sent(w: Windows, buckets: int, block_rows: int, block_units: int):
    """Blocks of rows to packed contexts by bucket, and one row (bucket null) with the block's layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        found: list[dict[str, np.ndarray]] = []
        rows = units = 0

        def flush() -> pa.RecordBatch:
            doc, key = np.concatenate(ids), np.concatenate(keys)
            c = {name: np.concatenate([f[name] for f in found]) for name in found[0]}
            order = doc[c["row"]]
            place = c["low"] if w.ordered else np.zeros(len(order), np.int64)
            by = np.lexsort((place, order, c["own"]))
            new = np.ones(len(by), bool)
            new[1:] = c["own"][by][1:] != c["own"][by][:-1]
            first = by[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(by) else by
            late = np.zeros(len(by), bool)
            late[by] = (order[by] > order[first]) | (place[by] > place[first])
            again = _with_late(by, new, late) if w.whole else None
            bucket = np.where(late, _LOCAL, (c["anchor"] % _U64(buckets)).astype(np.int64)).astype(np.uint16)
            counts = np.bincount(c["row"], minlength=len(doc)).astype(np.int64)
            layout = np.concatenate([doc, key, counts]).tobytes() + bucket.tobytes()
            chosen = np.argsort(bucket, kind="stable")
            chosen = chosen[bucket[chosen] != _LOCAL]
            names, at = np.unique(bucket[chosen], return_index=True)
            out = [(None, block, len(doc), pa.compress(layout, "zstd", asbytes=True) + len(layout).to_bytes(8, "little"))]
            for name, s, e in zip(names, at, np.append(at[1:], len(chosen))):
                own = chosen[s:e]
                out.append((int(name), block, e - s, _pack(c["left"][own], c["right"][own], c["own"][own], order[own], place[own], again[own] if w.whole else None)))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "block", "n", "packed"])

        for batch in (part for b in batches for part in arrays.slices(b, 2)):
            values, first, last, _ = w.units(batch.column(2))
            got = contexts(w, values, first, last)
            if w.ordered:
                got["low"] = got["low"] - first[got["row"]]
            got["row"] += rows
            del got["high"], got["at"]
            found.append(got)
            ids.append(batch.column(0).to_numpy())
            keys.append(batch.column(1).to_numpy())
            rows += batch.num_rows
            units += len(values)
            if rows >= block_rows or units >= block_units:
                yield flush()
                block += 1
                rows = units = 0
                ids, keys, found = [], [], []
        if rows:
            yield flush()

    return run


#: Flags of a context: all its windows occurred earlier; it must be compared; its windows with enough units to the left of
#: the anchor, or to the right, are hashed one by one; an equal one is late.
_LATE, _COMPARE, _HOT_LEFT, _HOT_RIGHT, _REPEATED = 1, 2, 4, 8, 16


def _flagged(w: Windows, hot: int):
    """For each packed row, the flags of its contexts."""

    def sharing(half: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How many different contexts have each one's half."""
        by = np.lexsort((own, half))
        h, o = half[by], own[by]
        new_half = np.ones(len(by), bool)
        new_half[1:] = h[1:] != h[:-1]
        new = new_half.copy()
        new[1:] |= o[1:] != o[:-1]
        out = np.zeros(len(by), np.int64)
        out[by] = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_half))[np.cumsum(new_half) - 1]
        return np.where(half > 0, out, 0)

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        parts = [_unpack(n, packed, w.whole) for _, _, n, packed in rows]
        left, right, own, order, place, again = (np.concatenate(x) for x in zip(*parts))
        by = np.lexsort((place, order, own))
        o = own[by]
        new = np.ones(len(by), bool)
        new[1:] = o[1:] != o[:-1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = np.zeros(len(by), bool)
        late[by] = (order[by] > order[by][first]) | ((place[by] > place[by][first]) if w.ordered else False)
        lefts, rights = sharing(left, own), sharing(right, own)
        some = ((lefts > 1) & (lefts <= hot)) | ((rights > 1) & (rights <= hot))
        flags = np.where(late, _LATE, _COMPARE * some + _HOT_LEFT * (lefts > hot) + _HOT_RIGHT * (rights > hot) + _REPEATED * (w.whole & _with_late(by, new, late | again))).astype(np.uint8)
        at = np.cumsum([0, *(r[2] for r in rows)])
        packed = [pa.compress(flags[s:e].tobytes(), "zstd", asbytes=True) for s, e in zip(at, at[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "block", "n", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            layouts = batch.filter(batch.column(0).is_null())
            if layouts.num_rows:
                yield layouts
            rows = batch.filter(batch.column(0).is_valid())
            for row in zip(*(c.to_pylist() for c in rows.columns)):  # sorted by bucket
                if held and held[-1][0] != row[0]:
                    yield answer(held)
                    held = []
                held.append(row)
        if held:
            yield answer(held)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's layout and flags (sorted by block, layout first) to one row for each document with a flag."""
    layout, flags = None, None

    def finish() -> pa.RecordBatch:
        doc, key, counts, bucket, flag = *layout, flags
        ends = np.cumsum(counts)
        some = [k for k, (s, e) in enumerate(zip(ends - counts, ends)) if flag[s:e].any()]
        return pa.RecordBatch.from_arrays([pa.array(doc[some], pa.int64()), pa.array(key[some], pa.int64()), pa.array([flag[ends[k] - counts[k] : ends[k]].tobytes() for k in some], pa.binary())], names=["order_id", "text_key", "flags"])

    for batch in batches:
        for bucket, _, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket is None:
                if layout is not None:
                    yield finish()
                size = int.from_bytes(packed[-8:], "little")
                whole = pa.decompress(packed[:-8], size, "zstd", asbytes=True)
                doc, key, counts = np.frombuffer(whole[: 24 * n], np.int64).reshape(3, n)
                buckets = np.frombuffer(whole[24 * n :], np.uint16)
                layout = (doc, key, counts, buckets)
                flags = np.where(buckets == _LOCAL, _LATE, 0).astype(np.uint8)
                places = np.argsort(buckets, kind="stable")
                edges = buckets[places]
            else:
                s = np.searchsorted(edges, bucket)
                flags[places[s : s + n]] = np.frombuffer(pa.decompress(packed, n, "zstd", asbytes=True), np.uint8)
    if layout is not None:
        yield finish()


_PIECE_NAMES = ["anchor", "order_id", "text_key", "low", "packed"]


def _spans_of(order: np.ndarray, key: np.ndarray, low: np.ndarray, end: np.ndarray) -> tuple[list, list, list]:
    """Runs to one row of spans for each document."""
    by = np.lexsort((low, key, order))
    order, key, low, end = order[by], key[by], low[by], end[by]
    head = np.flatnonzero(np.concatenate([[True], (order[1:] != order[:-1]) | (key[1:] != key[:-1])])) if len(by) else by
    return order[head].tolist(), key[head].tolist(), [x.astype(np.int64).tobytes() for x in np.split(np.stack([low, end], 1), head[1:])] if len(by) else []


#: Ends the bytes of a context sent with half of each unit's hash.
_HALVES = b"\1"


def _cut(w: Windows, most_windows: int = 1 << 17, most_units: int = 1 << 22):
    """Flagged texts to spans that are repeats (anchor null), contexts that need comparing, and windows of hot contexts, each
    in its task's first occurrence; those come under the window's hash as anchor. With ``whole`` equal contexts come as well,
    in their task's first occurrence, under their own hash; so half of each unit's hash is enough for them."""
    reach = (w.length - w.gram + 1) // 2

    def hot_windows(values: np.ndarray, c: dict, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row, start and hash of the windows on hot sides."""
        low = np.concatenate([c["low"][left := np.flatnonzero(flag & _HOT_LEFT)], np.maximum(c["low"], c["at"] - reach + 1)[right := np.flatnonzero(flag & _HOT_RIGHT)]])
        high = np.concatenate([np.minimum(c["high"], c["at"] - reach)[left], c["high"][right]])
        row = np.concatenate([c["row"][left], c["row"][right]])
        counts = np.maximum(high - low + 1, 0)
        start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        sums, scale = arrays.running_sum(values)
        return np.repeat(row, counts), start, arrays.mix((sums[start + w.length] - sums[start]) * scale[start] ^ _U64(0x2545F4914F6CDD1D))

    def first_of(held: list[tuple]) -> pa.RecordBatch:
        order, key, low, window, units = (np.concatenate(x) for x in zip(*held))
        by = np.lexsort((low, order, window))
        order, key, low, window, units = order[by], key[by], low[by], window[by], units[by]
        head = np.concatenate([[True], window[1:] != window[:-1]])
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        late = ((order > order[first]) | ((low > low[first]) if w.ordered else False)) & (units == units[first]).all(1)
        ids, keys, spans = _spans_of(order[late], key[late], low[late], low[late] + w.length)
        sent = ~late
        none = [None] * len(ids)
        columns = [[*none, *window[sent].view(np.int64).tolist()], [*ids, *order[sent].tolist()], [*keys, *key[sent].tolist()], [*none, *low[sent].tolist()]]
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns], pa.array([*spans, *(x.tobytes() for x in units[sent])], pa.binary())], names=_PIECE_NAMES)

    def first_of_equal(held: list[tuple]) -> pa.RecordBatch:
        order, key, low, end, own = (np.concatenate([h[k] for h in held]) for k in range(5))
        units = [x for h in held for x in h[5]]
        by = np.lexsort((low, order))
        places = list(zip(order.tolist(), low.tolist() if w.ordered else [0] * len(by)))
        first, late = {}, np.zeros(len(by), bool)
        for k, name in zip(by.tolist(), own[by].tolist()):
            late[k] = first.setdefault((name, units[k]), places[k]) < places[k]
        ids, keys, spans = _spans_of(order[late], key[late], low[late], end[late])
        sent = np.flatnonzero(~late)
        none = [None] * len(ids)
        columns = [[*none, *own[sent].view(np.int64).tolist()], [*ids, *order[sent].tolist()], [*keys, *key[sent].tolist()], [*none, *low[sent].tolist()]]
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns], pa.array([*spans, *(units[k] + _HALVES for k in sent)], pa.binary())], names=_PIECE_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        equal, equal_size = [], 0
        for batch in (part for b in batches for part in arrays.slices(b, b.schema.get_field_index("text"))):
            values, first, last, source = w.units(batch.column("text"))
            c = contexts(w, values, first, last)
            flag = np.frombuffer(b"".join(batch.column("flags").to_pylist()), np.uint8)
            if len(flag) != len(c["row"]):
                raise ValueError("a text changed between two reads")
            low, end = c["low"] - first[c["row"]], c["high"] + w.length - first[c["row"]]
            ids, keys = batch.column("order_id").to_numpy(), batch.column("text_key").to_numpy()
            if w.whole and len(again := np.flatnonzero(flag & (_LATE | _REPEATED))):
                halves = (source >> _U64(32)).astype(np.uint32)
                units = [halves[s:e].tobytes() for s, e in zip(c["low"][again].tolist(), (c["high"][again] + w.length).tolist())]
                row = c["row"][again]
                equal.append((ids[row], keys[row], low[again], end[again], c["own"][again], units))
                equal_size += int((end - low)[again].sum())
                if equal_size >= most_units:
                    yield first_of_equal(equal)
                    equal, equal_size = [], 0
            done = np.flatnonzero(flag & _LATE) if not w.whole else np.zeros(0, np.int64)
            rows, edges = np.unique(c["row"][done], return_index=True)
            spans = [np.stack([low[x], end[x]], 1).astype(np.int64).tobytes() for x in np.split(done, edges[1:])] if len(rows) else []
            open_ = np.flatnonzero(flag & _COMPARE)
            pieces = [source[s:e].tobytes() for s, e in zip(c["low"][open_], c["high"][open_] + w.length)]
            owner = c["row"][open_]
            none = [None] * len(rows)
            columns = [[*none, *c["anchor"][open_].view(np.int64).tolist()], np.concatenate([ids[rows], ids[owner]]), np.concatenate([keys[rows], keys[owner]]), [*none, *low[open_].tolist()]]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns], pa.array([*spans, *pieces], pa.binary())], names=_PIECE_NAMES)
            if (flag & (_HOT_LEFT | _HOT_RIGHT)).any():
                every_row, every_start, every_window = hot_windows(values, c, flag)
                for at in range(0, len(every_row), most_windows):
                    row, start, window = (x[at : at + most_windows] for x in (every_row, every_start, every_window))
                    held.append((ids[row], keys[row], start - first[row], window, np.lib.stride_tricks.sliding_window_view(source, w.length)[start]))
                    size += len(row)
                    if size >= most_windows:
                        yield first_of(held)
                        held, size = [], 0
        if held:
            yield first_of(held)
        if equal:
            yield first_of_equal(equal)

    return run


def _compared(w: Windows, compare: Callable, chunk_bytes: int):
    """Contexts by anchor to spans; rows that are spans already pass."""

    def units(packed: bytes) -> bytes:
        if w.whole and len(packed) % 4:
            return np.frombuffer(packed[: -len(_HALVES)], np.uint32).astype(_U64).tobytes()
        return packed

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        found = compare(w, [r[0] for r in rows], [units(r[4]) for r in rows], np.array([r[1] for r in rows]), np.array([r[3] for r in rows]))  # (context, window start in it) arrays
        which, start = found
        low = np.array([r[3] for r in rows])[which] + start
        keep = np.unique(which)
        edges = np.searchsorted(which, keep)
        spans = [np.stack([x, x + w.length], 1).astype(np.int64).tobytes() for x in np.split(low, edges[1:])] if len(keep) else []
        return pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in keep], pa.int64()), pa.array([rows[k][2] for k in keep], pa.int64()), pa.array(spans, pa.binary())], names=["order_id", "text_key", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            spans = batch.filter(batch.column(0).is_null())
            if spans.num_rows:
                yield spans.select(["order_id", "text_key", "packed"])
            rows = batch.filter(batch.column(0).is_valid())
            for row in zip(*(c.to_pylist() for c in rows.columns)):  # sorted by anchor, order and low
                if size >= chunk_bytes and held[-1][0] != row[0]:
                    yield answer(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield answer(held)

    return run


def keyed(docs: DataFrame, *others: Column) -> DataFrame:
    """order_id (doc_id, null last), text_key (a hash of the text) and text of each row, and ``others``. The first two tell
    rows apart, up to equal ones."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("order_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("text"), *others)


def all_but(docs: DataFrame, *names: str) -> Column:
    """The other columns as one struct, so that their names meet no others."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in names]).alias("row")


def put_back(packed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``row``, and those beside it, in their old order."""
    beside = set(packed.columns)
    return packed.select(*[F.col(f"`{c}`") if c == "text" and "text" in beside else F.col(f"row.`{c}`") for c in columns])


def with_spans(docs: DataFrame, w: Windows, compare: Callable, block_rows: int = 60_000, block_units: int = 1 << 23, chunk_bytes: int = 1 << 19, hot: int = 500) -> DataFrame:
    """``docs``, which has order_id, text_key and text, with ``spans``: null, or binaries of pairs of int64 (from, to) in
    units that are repeats; they may overlap.

    ``compare(w, anchors, contexts, orders, lows)`` returns, ascending by context, the windows (context, start in
    it) that also occur in one of the contexts that is earlier. Both joins read one and the same shuffle of ``docs``.
    """
    buckets = min(MAX_BUCKETS, max(256, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sent = docs.select("order_id", "text_key", "text").mapInArrow(arrays.freeing(_sent(w, buckets, block_rows, block_units)), _SENT)
    by_bucket = sent.repartition(F.coalesce("bucket", -F.col("block") - 1)).sortWithinPartitions("bucket")
    flagged = by_bucket.mapInArrow(arrays.freeing(_flagged(w, hot)), _SENT)
    by_block = flagged.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("bucket"))
    flags = by_block.mapInArrow(arrays.freeing(_by_document), "order_id bigint, text_key bigint, flags binary").dropDuplicates(["order_id", "text_key"])
    texts = docs.join(flags, ["order_id", "text_key"]).select(*docs.columns, "flags")
    cut = texts.mapInArrow(arrays.freeing(_cut(w)), "anchor bigint, order_id bigint, text_key bigint, low bigint, packed binary")
    by_anchor = cut.repartition(F.coalesce("anchor", "text_key")).sortWithinPartitions("anchor", "order_id", "low")
    spans = by_anchor.mapInArrow(arrays.freeing(_compared(w, compare, chunk_bytes)), "order_id bigint, text_key bigint, packed binary")
    gathered = spans.groupBy("order_id", "text_key").agg(F.collect_list("packed").alias("spans"))
    return docs.join(gathered, ["order_id", "text_key"], "left").select(*docs.columns, "spans")


def covered(spans: list[bytes] | None, size: int) -> np.ndarray:
    """Which of ``size`` units the spans cover."""
    out = np.zeros(size + 1, np.int32)
    if spans:
        pairs = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
        np.add.at(out, pairs[:, 0], 1)
        np.add.at(out, pairs[:, 1], -1)
    return np.cumsum(out[:-1]) > 0
