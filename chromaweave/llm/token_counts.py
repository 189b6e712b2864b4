"""Token counts of whole texts without token ids.

Texts are cut into pre-tokens; a block of documents becomes one posting list per distinct pre-token
(which documents hold it, how often). The lists are hash-partitioned and sorted by pre-token, so equal
pre-tokens of all blocks stand side by side: their pieces are counted once, merged with the lists, and the
products are summed by document. Only counts travel, never ids.
"""

from __future__ import annotations

import json
import os
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published split pattern of this byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Lists of more postings (three bytes each) go to one of so many tasks by their block; a pre-token has few such lists a
#: block, so it is counted once, or once for each of these tasks if it is common.
_LONG_LIST, _SPREAD = 3 * 1024, 64

#: A block's base is the number of its first row. piece null: ``packed`` describes the block's rows; else it is
#: the posting list, 2 bytes of place in the block and 1 byte of count for each posting.
_LISTS = "piece string, base bigint, packed binary"
#: piece null: as above. Otherwise 2 bytes of place and 4 bytes of pieces for each row counted.
_SUMS = "described boolean, base bigint, packed binary"
_ROWS = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def special_strings(tokenizer_json: str) -> list[str]:
    """The vocabulary's own special strings, longest first. Variants that eat neighbouring space are refused."""
    added = json.loads(tokenizer_json).get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("special tokens that strip or need word edges are not supported")
    return sorted((t["content"] for t in added), key=len, reverse=True)


def _posting_lists(specials: list[str], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(SPLIT).findall
        cut = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        base, held = TaskContext.get().partitionId() << 40, 0
        lists: dict[str, tuple[array, bytearray]] = {}
        heads: list[tuple[int, int, int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pieces = [None, *lists]
            packed = [np.array(heads, np.int64).tobytes(), *(a.tobytes() + b for a, b in lists.values())]
            for at in range(0, len(pieces), 20_000):
                some = pieces[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([base] * len(some), pa.int64()), pa.array(packed[at : at + 20_000], pa.binary())], names=["piece", "base", "packed"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                parts, special = [text], 0
                if cut is not None and cut.search(text):
                    parts = cut.split(text)
                    special = len(parts) - 1
                found = Counter(split(parts[0]))
                for part in parts[1:]:
                    found.update(split(part))
                place = len(heads)
                for piece, times in found.items():
                    got = lists.get(piece)
                    if got is None:
                        got = lists[piece] = (array("H"), bytearray())
                    while times > 255:
                        got[0].append(place)
                        got[1].append(255)
                        times -= 255
                    got[0].append(place)
                    got[1].append(times)
                held += len(found)
                heads.append((doc_id or 0, doc_id is None, len(text.encode()), special))
                if len(heads) == 65_535 or held >= most:
                    yield from flush()
                    base, held = base + len(heads), 0
                    lists.clear()
                    heads.clear()
        if heads:
            yield from flush()

    return run


def _piece_counts(tokenizer_json: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.encode_special_tokens = True
        bases: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        held, last, last_n = 0, None, 0

        def flush() -> pa.RecordBatch:
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate(sums)).astype(np.uint32)
            first = np.unique(np.concatenate(bases))
            edges = np.searchsorted(key, [*first, np.iinfo(np.int64).max])
            packed = [(key[s:e] - f).astype(np.uint16).tobytes() + n[s:e].tobytes() for f, s, e in zip(first, edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array([False] * len(first)), pa.array(first), pa.array(packed, pa.binary())], names=["described", "base", "packed"])

        for batch in batches:
            heads = batch.filter(batch.column(0).is_null())
            if heads.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([True] * heads.num_rows), heads.column(1), heads.column(2)], names=["described", "base", "packed"])
            rows = batch.filter(batch.column(0).is_valid())
            if not rows.num_rows:
                continue
            pieces = rows.column(0).to_pylist()  # sorted: equal ones are neighbours
            fresh = [k for k in range(len(pieces)) if pieces[k] != (pieces[k - 1] if k else last)]
            counted = [len(e) for e in tokenizer.encode_batch([pieces[k] for k in fresh], add_special_tokens=False)]
            per_row = np.repeat(np.array([last_n, *counted]), np.diff([0, *fresh, len(pieces)]))
            last, last_n = pieces[-1], int(per_row[-1])
            packed = rows.column(2).to_pylist()
            lengths = np.array([len(x) // 3 for x in packed])
            base = rows.column(1).to_numpy()
            bases.append(np.unique(base))
            keys.append(np.repeat(base, lengths) + np.frombuffer(b"".join(x[: len(x) // 3 * 2] for x in packed), np.uint16))
            sums.append(np.repeat(per_row, lengths) * np.frombuffer(b"".join(x[len(x) // 3 * 2 :] for x in packed), np.uint8))
            held += len(keys[-1])
            if held >= most:
                yield flush()
                bases, keys, sums, held = [], [], [], 0
        if keys:
            yield flush()

    return run


def _row_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, heads, base = np.zeros(1 << 16, np.int64), None, None

    def finished() -> pa.RecordBatch:
        tokens = total[: len(heads)] + heads[:, 3]
        return pa.RecordBatch.from_arrays([pa.array(heads[:, 0], pa.int64(), mask=heads[:, 1] > 0), pa.array(heads[:, 2]), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for described, at, packed in zip(*(c.to_pylist() for c in batch.columns)):  # sorted by block
            if at != base:
                if base is not None:
                    yield finished()
                base, heads = at, None
                total[:] = 0
            if described:
                heads = np.frombuffer(packed, np.int64).reshape(-1, 4)
            else:
                n = len(packed) // 6
                total[np.frombuffer(packed[: 2 * n], np.uint16)] += np.frombuffer(packed[2 * n :], np.uint32)
    if base is not None:
        yield finished()


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, postings_in_memory: int = 1_500_000) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (``n_tokens > limit``).

    Counts are those of the vocabulary file's own library: no begin, end or padding tokens, no truncation;
    the special strings it lists count as one token each. Null and empty texts have 0 bytes and 0 tokens; a
    null doc_id stays null; repeated rows and repeated ids are counted and returned row by row; other columns
    are ignored. ``postings_in_memory`` bounds what a task holds before it passes lists on.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    lists = texts.mapInArrow(_posting_lists(special_strings(vocabulary), postings_in_memory), _LISTS)
    spread = F.when(F.length("packed") > _LONG_LIST, F.pmod(F.xxhash64("base"), F.lit(_SPREAD))).otherwise(F.lit(0))
    by_piece = lists.repartition(F.coalesce("piece", F.col("base").cast("string")), spread).sortWithinPartitions("piece")
    sums = by_piece.mapInArrow(_piece_counts(vocabulary, postings_in_memory), _SUMS)
    rows = sums.repartition("base").sortWithinPartitions("base").mapInArrow(_row_totals, _ROWS)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
