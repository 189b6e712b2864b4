"""Merkle manifests of a dataset: a digest for each row, tree and proof, in DataFrame expressions.

Rows are placed by a range sort over many tasks and gathered in blocks of ``8^4`` neighbours; a block collapses four levels of
the tree with higher-order functions (sequence, transform, slice, aggregate), and the blocks' roots are the next tier's leaves.
So no group is ever in one task: a tier has a 4096th of the rows of the tier below. Coming down again, each block is told
the siblings above it, and each leaf adds its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaweave.llm.lineage import shared_table

#: Children of a node as a power of two, levels of a block, and the leaves that make.
_BITS, _LEVELS = 3, 4
_ARITY, _WIDTH = 1 << _BITS, 1 << _BITS * _LEVELS
#: Fields of a document that its leaf covers.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 over fields, each ``-`` if null, else its length in bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (grp, ...) with pos, the place by ``order`` in its grp, and n, the size of that. Null groups count as one.

    A range sort, written with row numbers by task; where each task's part of a group begins follows from counts by task.
    """
    sorted_rows = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    kept = shared_table(sorted_rows.withColumn("row", F.monotonically_increasing_id())).withColumn("part", F.shiftright("row", 33))
    parts = kept.groupBy("grp", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("here"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("here").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("grp").alias("g"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("here").over(group).alias("n"))
    joined = kept.join(starts, _same("grp", "g") & (F.col("part") == F.col("p")))
    return joined.withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "g", "p", "shift")


def _blocks(nodes: DataFrame) -> DataFrame:
    """``nodes`` (grp, n, pos, node, ...) as rows (grp, n, block, items), items in order."""
    rest = [c for c in nodes.columns if c not in ("grp", "n", "pos")]
    gathered = nodes.groupBy("grp", "n", F.shiftright("pos", _BITS * _LEVELS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("items"))
    return shared_table(gathered)


def _collapsed(nodes: Column) -> Column:
    """Digests of every eight consecutive nodes, the last of fewer."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / _ARITY).cast("int"))
    return F.transform(runs, lambda i: _digest(F.aggregate(F.slice(nodes, i * _ARITY + 1, F.lit(_ARITY)), F.lit(""), lambda a, x: F.concat(a, x))))


def _levels(blocks: DataFrame) -> DataFrame:
    """``blocks`` with height, how many levels its tree collapses inside a block, and the nodes of each, l0 to l4."""
    height = F.lit(0)
    for k in range(_LEVELS):
        height = height + (F.col("n") > (1 << _BITS * k)).cast("int")
    out = blocks.withColumns({"height": height, "l0": F.transform("items", lambda x: x["node"])})
    for k in range(_LEVELS):
        out = out.withColumn(f"l{k + 1}", F.when(F.col("height") > k, _collapsed(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return out


def _siblings(i: Column) -> Column:
    """Of the block's item ``i``, the siblings to its left and right on each level inside the block, joined."""
    found = []
    for k in range(_LEVELS):
        own = F.shiftright(i, _BITS * k)
        among = own.bitwiseAND(F.lit(_ARITY - 1))
        left, right = F.slice(f"l{k}", own - among + 1, among), F.slice(f"l{k}", own + 2, F.lit(_ARITY - 1) - among)
        found.append(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
    return F.slice(F.array(*found), 1, F.col("height"))


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tiers of blocks from the leaves up, and (grp, top) of each group."""
    tiers, tops = [], None
    while True:
        tier = _blocks(nodes)
        tiers.append(tier)
        roots = shared_table(_levels(tier).select("grp", "n", "block", F.get(f"l{_LEVELS}", F.lit(0)).alias("node")))
        done = roots.where(F.col("n") <= _WIDTH).select("grp", F.col("node").alias("top"))
        tops = done if tops is None else tops.unionByName(done)
        nodes = roots.where(F.col("n") > _WIDTH).select("grp", F.ceil(F.col("n") / _WIDTH).cast("bigint").alias("n"), F.col("block").alias("pos"), "node")
        if nodes.isEmpty():
            return tiers, tops


_PATH = "array<struct<left:string,right:string>>"


def _below(tier: DataFrame, above: DataFrame, over: DataFrame | None) -> DataFrame:
    """``tier`` with each block's siblings above it: from the tier above, or for a whole tree those ``over`` its group."""
    top = F.array().cast(_PATH)
    if over is not None:
        tier = tier.join(over.select(F.col("grp").alias("g"), F.col("path").alias("over")), _same("grp", "g")).drop("g")
        top = F.col("over")
    if above is None:
        return tier.withColumn("above", top)
    joined = tier.join(above.select(F.col("grp").alias("g"), F.col("pos").alias("p"), F.col("path").alias("found")), _same("grp", "g") & (F.col("block") == F.col("p")), "left")
    return joined.withColumn("above", F.coalesce("found", top)).drop("g", "p", "found", "over")


def _paths(tiers: list[DataFrame], over: DataFrame | None = None) -> DataFrame:
    """The lowest tier with what is above each of its blocks."""
    above = None
    for tier in tiers[:0:-1]:
        blocks = _levels(_below(tier, above, over))
        found = F.posexplode(F.transform("items", lambda x, i: F.concat(_siblings(i), F.col("above")))).alias("i", "path")
        above = blocks.select("grp", "block", found).select("grp", (F.col("block") * _WIDTH + F.col("i")).alias("pos"), "path")
        above = shared_table(above)
    return _levels(_below(tiers[0], above, over))


def manifest(docs: DataFrame, found: Column | None = None, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A row for each row of ``docs``: ``order``, ``group``, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves cover ``fields``; in each group they ascend by ``order``, nulls first, rows of one ``order`` by leaf and ``found``; eight nodes
    make one of the next level until one is left, the group's subroot, and subroots by group, null first, likewise make the root.
    ``found`` is the leaf found now, where that is to be verified against the manifest (null: the leaf itself): it is folded with
    the siblings of the manifest. Null fields count as such, empty texts as texts; equal rows are leaves of their own; an empty
    table gives no rows; other columns are ignored.
    """
    leaf = leaf_digest(*[F.col(f) for f in fields])
    taken = docs.select(F.col(group).alias("grp"), F.col(order).alias("at"), leaf.alias("node"), (F.lit(None).cast("string") if found is None else found).alias("found"))
    tiers, subroots = _climb(placed(taken, ["at", "node", "found"]))
    one = F.lit(0).alias("grp")
    group_tiers, roots = _climb(placed(subroots.select(one, F.col("grp").alias("name"), F.col("top").alias("node")), ["name"]))
    root = roots.first()
    every = _paths(group_tiers)
    item = F.explode(F.transform("items", lambda x, i: F.struct(x["name"].alias("grp"), x["node"].alias("subroot"), F.concat(_siblings(i), F.col("above")).alias("path")))).alias("x")
    over = shared_table(every.select(item).select("x.*"))
    leaves = _paths(tiers, over).join(over.select(F.col("grp").alias("g2"), "subroot"), _same("grp", "g2"))

    def proved(x: Column, i: Column) -> Column:
        path = F.concat(_siblings(i), F.col("above"))
        proof = _digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))
        folded = F.aggregate(path, F.coalesce(x["found"], x["node"]), lambda a, p: _digest(F.concat(p["left"], a, p["right"])))
        return F.struct(x["at"].alias("at"), x["node"].alias("leaf"), proof.alias("proof_sha256"), folded.alias("folded_root"))

    rows = leaves.select("grp", "subroot", F.explode(F.transform("items", proved)).alias("x"))
    top = F.lit(root["top"] if root else None).cast("string")
    return rows.select(F.col("x.at").alias(order), F.col("grp").alias(group), F.col("x.leaf").alias("leaf"), "subroot", top.alias("root"), F.col("x.proof_sha256").alias("proof_sha256"), F.col("x.folded_root").alias("folded_root"), (F.col("x.folded_root") == top).alias("verified"))
