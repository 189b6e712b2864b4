"""Near-duplicate documents by a grouped prefix join on word shingles.

Two sets can only be similar enough if the first parts of both, in one global order of shingles, share one. Documents
of equal sets are one class; classes of equal prefix and size are one group, joined once. Groups are joined on their
prefix shingles; pairs whose shared prefix shingles leave too few others are dropped; those left are expanded to
classes and verified on their whole texts.

Components, not pairs, are wanted, so classes are first verified against the earliest document that shares most with
them; of the remaining pairs only those that would join two components are looked at. That keeps large groups of near
copies from being expanded into all pairs and loses no link between components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.llm import arrays
from chromaweave.llm.components import connected_components
from chromaweave.llm.lineage import shared_checkpoint, shared_table
from chromaweave.llm.repeats import LAST, all_but, keyed, put_back

_U64 = np.uint64
#: Up to this many rows a side is broadcast (some 24 bytes each); above, it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingle_sets(column: pa.Array, width: int, common: np.ndarray | None = None, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles, by row and then rare before common (``ranks`` of ``common``)."""
    data, starts, ends = arrays.text_buffers(column)
    data = arrays.lower_table()[data]
    begin, end = arrays.word_spans(data, starts, arrays.white_space())
    words = arrays.hash_words(data, begin, end)
    first, last = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
    counts = np.maximum(last - first - width + 1, 0)
    row = np.repeat(np.arange(len(starts)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]
    hashes = arrays.hash_windows(words, width)[at] if len(at) else np.zeros(0, _U64)
    short = np.flatnonzero((last > first) & (last - first < width))
    if len(short):
        sums, scale = arrays.running_sum(words)
        size = (last - first)[short]
        own = arrays.mix((sums[last[short]] - sums[first[short]]) * scale[first[short]] ^ size.astype(_U64) * _U64(0xC2B2AE3D27D4EB4F))
        row, hashes = np.concatenate([row, short]), np.concatenate([hashes, own])
    rank = np.zeros(len(hashes), np.uint8)
    if common is not None and len(common):
        place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[place] == hashes, ranks[place], 0).astype(np.uint8)
    order = np.lexsort((hashes, rank, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def _locally_common(width: int, least: int, block: int):
    """Shingles that at least ``least`` documents of a block hold, with how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found, n = arrays.counted(held)
            some = n >= least
            return pa.RecordBatch.from_arrays([pa.array(found[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["shingle", "n"])

        for batch in (part for b in batches for part in arrays.slices(b, 0)):
            held.append(shingle_sets(batch.column(0), width)[1])
            size += len(held[-1])
            if size >= block:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def prefix_length(n, percent: int):
    """How many first shingles of a set of ``n`` a set of Jaccard similarity ``percent`` / 100 must meet."""
    return n - (percent * n + 99) // 100 + 1


_SENT = "bucket bigint, n int, packed binary, doc array<bigint>"


def _prefixes(width: int, percent: int, common: np.ndarray, ranks: np.ndarray, buckets: int, block_rows: int, block_units: int):
    """One row (bucket null) for each document, and packed prefix shingles by bucket for each block's groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        tokens: list[tuple[np.ndarray, ...]] = []
        sent: dict[int, int] = {}
        rows = units = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs, tokens, rows, units
            every = np.concatenate(docs)
            for s in range(0, len(every), 20_000):
                some = every[s : s + 20_000]
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), pa.nulls(len(some), pa.binary()), pa.array(list(some), pa.list_(pa.int64()))], names=["bucket", "n", "packed", "doc"])
            token, place, group, order = (np.concatenate(x) for x in zip(*tokens))
            bucket = (token % _U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            names, at = np.unique(bucket[by], return_index=True)
            packed, sizes = [], []
            for s, e in zip(at, np.append(at[1:], len(by))):
                own = by[s:e]
                tail = pa.compress(np.diff(order[own], prepend=np.int64(0)).tobytes(), "zstd", asbytes=True)
                packed.append((token[own] >> _U64(32)).astype(np.uint32).tobytes() + place[own].tobytes() + group[own].tobytes() + tail)
                sizes.append(e - s)
            if len(names):
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), pa.nulls(len(names), pa.list_(pa.int64()))], names=["bucket", "n", "packed", "doc"])
            docs, tokens, rows, units = [], [], 0, 0
            sent.clear()

        for batch in (part for b in batches for part in arrays.slices(b, 2)):
            row, hashes = shingle_sets(batch.column(2), width, common, ranks)
            n = np.bincount(row, minlength=batch.num_rows)
            order = batch.column(0).to_numpy()
            starts = np.cumsum(n) - n
            filled = np.flatnonzero(n)
            whole = np.zeros(batch.num_rows, _U64)
            prefix = np.zeros(batch.num_rows, _U64)
            place = np.arange(len(row)) - starts[row]
            inside = place < prefix_length(n, percent)[row]
            if len(filled):
                heads = starts[filled]
                for out, used in ((whole, np.ones(len(row), bool)), (prefix, inside)):
                    a = np.add.reduceat(np.where(used, arrays.mix(hashes), _U64(0)), heads)
                    b = np.add.reduceat(np.where(used, arrays.mix(hashes ^ _U64(0xA0761D6478BD642F)), _U64(0)), heads)
                    out[filled] = arrays.mix(a ^ arrays.mix(b ^ n[filled].astype(_U64)))
            docs.append(np.stack([order, batch.column(1).to_numpy(), n, whole.view(np.int64), prefix.view(np.int64)], 1))
            fresh = np.zeros(batch.num_rows, bool)
            for k in filled:  # a group's prefix is sent once by a block, with its smallest id
                group = int(prefix[k])
                if group not in sent or order[k] < sent[group]:
                    sent[group] = int(order[k])
                    fresh[k] = True
            take = inside & fresh[row]
            tokens.append((hashes[take], np.minimum(place[take], 0xFFFF).astype(np.uint16), prefix[row[take]], order[row[take]]))
            rows += batch.num_rows
            units += int(take.sum())
            if rows >= block_rows or units >= block_units:
                yield from flush()
        if rows:
            yield from flush()

    return run


_FOUND = "kind int, a bigint, b bigint, c bigint, d bigint, e bigint"
_DOCUMENT, _STAR, _POSTING = 0, 1, 2


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of prefix shingles to what groups share: each group with the earliest one, and the groups of a shingle."""

    def rows_of(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(columns[0])
        for s in range(0, n, 100_000):
            some = [pa.array(np.ascontiguousarray(c[s : s + 100_000]).view(np.int64)) for c in columns]
            m = len(some[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), *some, *[pa.nulls(m, pa.int64())] * (5 - len(some))], names=["kind", "a", "b", "c", "d", "e"])

    def answer(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        token = np.concatenate([np.frombuffer(p[: 4 * n], np.uint32) for n, p in held])
        place = np.concatenate([np.frombuffer(p[4 * n : 6 * n], np.uint16) for n, p in held])
        group = np.concatenate([np.frombuffer(p[6 * n : 14 * n], _U64) for n, p in held])
        order = np.concatenate([np.cumsum(np.frombuffer(pa.decompress(p[14 * n :], 8 * n, "zstd", asbytes=True), np.int64)) for n, p in held])
        by = np.lexsort((order, place, group, token))
        token, place, group, order = token[by], place[by], group[by], order[by]
        new = np.ones(len(token), bool)  # two shingles of a group whose tokens are equal stay two
        new[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1]) | (place[1:] != place[:-1])
        token, place, group, order = token[new], place[new], group[new], order[new]
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(head, len(token)))
        shared = np.repeat(size > 1, size)
        token, place, group, order = token[shared], place[shared], group[shared], order[shared]
        if not len(token):
            return
        yield from rows_of(_POSTING, token.astype(np.int64) | np.int64(bucket << 32), group, place.astype(np.int64))
        size = size[size > 1]
        head = np.cumsum(size) - size
        by = np.lexsort((group, order, np.repeat(np.arange(len(size)), size)))
        leader = np.repeat(group[by[head]], size)
        other = group != leader
        pair = np.stack([group[other], leader[other]], 1)
        by = np.lexsort((pair[:, 1], pair[:, 0]))
        pair = pair[by]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)]))
        yield from rows_of(_STAR, pair[new, 0], pair[new, 1], np.diff(np.append(new, len(pair))).astype(np.int64))

    bucket, held = None, []
    for batch in batches:
        docs = batch.filter(batch.column(0).is_null())
        if docs.num_rows:
            values = docs.column(3).flatten().to_numpy().reshape(-1, 5)
            yield from rows_of(_DOCUMENT, *values.T)
        rows = batch.filter(batch.column(0).is_valid())
        for name, n, packed in zip(*(rows.column(k).to_pylist() for k in range(3))):  # sorted by bucket
            if name != bucket and held:
                yield from answer(bucket, held)
                held = []
            bucket = name
            held.append((n, packed))
    if held:
        yield from answer(bucket, held)


def _verified(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for whole in arrays.slices(b, 2) for part in arrays.slices(whole, 3)):
            left, right = (shingle_sets(batch.column(k), width) for k in (2, 3))
            row, hashes = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
            by = np.lexsort((hashes, row))
            row, hashes = row[by], hashes[by]
            twice = np.zeros(len(row), bool)
            twice[1:] = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
            common = np.bincount(row[twice], minlength=batch.num_rows)
            union = np.bincount(row, minlength=batch.num_rows) - common
            good = pa.array((100 * common >= percent * union) & (union > 0))
            yield batch.select([0, 1]).filter(good)

    return run


def _labelled(docs: DataFrame, width: int, percent: int, common_shingles: int, common_least: int, block_rows: int, block_units: int) -> DataFrame:
    """(order_id, text_key, n, first) of each row: ``first`` is the (order_id, text_key) that comes first in its component;
    null if n is 0.

    What a component has in common is found over its classes and joined to rows by class, each table written before it
    is joined: so a component or a class with very many rows is a side that Spark can split.
    """
    spark = docs.sparkSession
    own = keyed(docs)
    frequent = own.select("text").mapInArrow(arrays.freeing(_locally_common(width, common_least, 2 * block_units)), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(common_shingles).toPandas()
    common = frequent["shingle"].to_numpy(np.int64).view(_U64)
    by = np.argsort(common)
    ranks = (1 + np.log2(np.maximum(frequent["n"].to_numpy(np.float64), 1)) * 4).astype(np.uint8)[by]

    buckets = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = own.mapInArrow(arrays.freeing(_prefixes(width, percent, common[by], ranks, buckets, block_rows, block_units)), _SENT)
    by_bucket = sent.repartition(F.coalesce("bucket", -F.abs(F.xxhash64("doc")) - 1)).sortWithinPartitions("bucket")
    found = shared_table(by_bucket.mapInArrow(arrays.freeing(_shared), _FOUND), "kind")

    rows = found.where(f"kind = {_DOCUMENT}").select(F.col("a").alias("order_id"), F.col("b").alias("text_key"), F.col("c").alias("n"), F.col("d").alias("class"), F.col("e").alias("group"))
    filled = rows.where("n > 0")
    classes = shared_checkpoint(filled.groupBy("class").agg(F.min(F.struct("order_id", "text_key")).alias("first"), F.min("n").alias("n"), F.min("group").alias("group")))
    groups = classes.groupBy("group").agg(F.min_by("class", "first").alias("leader"), F.min("n").alias("n"), F.min("first.order_id").alias("order_id"), F.count("*").alias("classes"))
    groups = shared_checkpoint(groups)

    def sized(pairs: DataFrame) -> DataFrame:
        """Group pairs (a, b, c) whose ``c`` shared prefix shingles leave enough others."""
        one = groups.select(F.col("group").alias("a"), F.col("n").alias("n_a"), F.col("leader").alias("leader_a"))
        two = groups.select(F.col("group").alias("b"), F.col("n").alias("n_b"), F.col("leader").alias("leader_b"), F.col("order_id").alias("order_b"))
        rest = [F.col(n) - prefix_length_of(F.col(n), percent) for n in ("n_a", "n_b")]
        enough = (100 + percent) * (F.col("c") + F.greatest(*rest)) >= percent * (F.col("n_a") + F.col("n_b"))
        near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        return pairs.join(one, "a").join(two, "b").where(enough & near)

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = shared_checkpoint(pairs.select("a", "b").distinct())
        need = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct().join(classes, "class").select("class", "first.order_id", "first.text_key")
        need = shared_checkpoint(need)
        if need.count() <= BROADCAST_ROWS:
            need = F.broadcast(need)
        texts = own.join(need, ["order_id", "text_key"]).select("class", "text").dropDuplicates(["class"])
        left = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
        both = left.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        return shared_checkpoint(both.mapInArrow(arrays.freeing(_verified(width, percent)), "a bigint, b bigint"))

    # each group with the one it shares most with, of those that hold a shingle's earliest document; each class with its group's first
    stars = found.where(f"kind = {_STAR}").groupBy("a", "b").agg(F.sum("c").alias("c"))
    best = sized(stars).groupBy("a").agg(F.min("leader_a").alias("leader_a"), F.max_by("leader_b", F.struct("c", -F.col("order_b"))).alias("leader_b"))
    members = classes.join(groups.where("classes > 1").select("group", "leader"), "group").where("class <> leader")
    links = verify(best.select(F.col("leader_a").alias("a"), F.col("leader_b").alias("b")).unionByName(members.select(F.col("class").alias("a"), F.col("leader").alias("b"))))

    # pairs that would join two of the components found
    labels = connected_components(links)
    labelled = shared_checkpoint(classes.join(labels, classes["class"] == labels["node"], "left").select("class", "group", "n", F.coalesce("label", "class").alias("label")))
    spans = labelled.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("n"))
    postings = found.where(f"kind = {_POSTING}").select(F.col("a").alias("token"), F.col("b").alias("group"), F.col("c").alias("place")).join(spans, "group")
    open_tokens = postings.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("token")
    listed = postings.join(open_tokens, "token")
    # the first shingle that two similar sets share leaves enough in both for the overlap that they must have
    one, two = (listed.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("group", "low", "high", "n", "place")]) for side in "ab")
    need = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    apart = one.join(two, "token").where("group_a < group_b AND NOT (low_a = high_a AND low_a = low_b AND low_b = high_b)").where((F.col("n_a") - F.col("place_a") >= need) & (F.col("n_b") - F.col("place_b") >= need))
    met = shared_checkpoint(apart.select("group_a", "group_b").distinct())
    # and their prefixes share so many that the rest of the longer one may hold the others; shingles of one hash count all
    meeting = met.select(F.col("group_a").alias("group")).unionByName(met.select(F.col("group_b").alias("group"))).distinct()
    prefixes = found.where(f"kind = {_POSTING}").select(F.col("b").alias("group"), F.hash("a").alias("token")).join(meeting, "group", "left_semi").groupBy("group").agg(F.collect_set("token").alias("tokens"), F.count("*").alias("held"))
    known = prefixes.join(groups, "group").select("group", "tokens", "n", (F.col("held") - F.size("tokens")).alias("spare"))
    sides = [known.select(*[F.col(c).alias(f"{c}_{side}") for c in known.columns]) for side in "ab"]
    shared = F.size(F.array_intersect("tokens_a", "tokens_b")) + F.greatest("spare_a", "spare_b")
    rest = F.greatest(*[F.col(n) - prefix_length_of(F.col(n), percent) for n in ("n_a", "n_b")])
    like = met.join(sides[0], "group_a").join(sides[1], "group_b").where((100 + percent) * (shared + rest) >= percent * (F.col("n_a") + F.col("n_b")))
    pairs = like.select(F.col("group_a").alias("a"), F.col("group_b").alias("b")).unionByName(spans.where("low <> high").select(F.col("group").alias("a"), F.col("group").alias("b")))
    left = labelled.select(F.col("group").alias("a"), F.col("class").alias("class_a"), F.col("label").alias("label_a"))
    right = labelled.select(F.col("group").alias("b"), F.col("class").alias("class_b"), F.col("label").alias("label_b"))
    expanded = pairs.join(left, "a").join(right, "b").where("label_a <> label_b").select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))
    labels = connected_components(links.unionByName(verify(expanded)))

    named = shared_checkpoint(classes.join(labels, classes["class"] == labels["node"], "left").select("class", "first", F.coalesce("label", "class").alias("label")))
    least = shared_checkpoint(named.groupBy("label").agg(F.min("first").alias("least")))
    ahead = shared_checkpoint(named.join(least, "label").select("class", F.col("least").alias("first")))
    blank = rows.where("n = 0").select("order_id", "text_key", "n", F.lit(None).cast(ahead.schema["first"].dataType).alias("first"))
    return filled.join(ahead, "class").select("order_id", "text_key", "n", "first").unionByName(blank)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, common_shingles: int = 131_072, common_least: int = 4, block_rows: int = 60_000, block_units: int = 1 << 21) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    Texts with fewer than ``width`` words are one shingle; null and blank texts have none and link with nothing,
    so their component is their own id. Rows that share a doc_id are told apart by their texts; repeated rows
    are answered each; a null doc_id links as others do but names no component; other columns are ignored.
    ``common_shingles`` bounds the table of shingles that come last in the order; it only moves work.
    """
    named = _labelled(docs, width, percent, common_shingles, common_least, block_rows, block_units)
    doc_id = F.when(F.col("order_id") != LAST, F.col("order_id"))
    least = F.col("first.order_id")
    return named.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, doc_id).when(least != LAST, least).alias("component_id"))


def prefix_length_of(n, percent: int):
    """``prefix_length`` of a column."""
    return n - F.floor((percent * n + 99) / 100) + 1


def keep_first_of_component(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first (by doc_id, null last) in their component.

    Rows without words all stay; of rows that are equal in doc_id and text, one does.
    """
    named = _labelled(docs, width, percent, 131_072, 4, 60_000, 1 << 21)
    first = named.where("n > 0 AND first = struct(order_id, text_key)").select("order_id", "text_key").distinct()
    own = keyed(docs, all_but(docs, "text"))
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    stay = own.where(~blank).join(first, ["order_id", "text_key"], "left_semi").dropDuplicates(["order_id", "text_key"])
    return put_back(stay.unionByName(own.where(blank)).select("row", "text"), docs.columns)
