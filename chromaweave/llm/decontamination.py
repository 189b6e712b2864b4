"""Benchmark decontamination by winnowing, in DataFrame expressions only.

A document's fingerprints are the smallest k-gram hashes of its sliding windows. Every run of ``window`` equal
words holds such a window, whose smallest hash both sides keep: joining fingerprints loses no shared run. The windows
of joined documents around each hit are then looked up, word by word, among the benchmark's distinct windows. Each of those
is there once, with the set of items that have it, and each set of sets is joined once: no row is made for a document and an item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chromaweave.llm.lineage import shared_checkpoint

#: Fixed value: what separates words, with A-Z still in the text; words are lower-cased afterwards.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Above this many bytes of a table of fingerprints or windows it is joined by a shuffle, not a broadcast.
BROADCAST_BYTES = 16 << 20
#: Up to this many fingerprints, those that no item has are dropped before rows are made of them for the join.
PREFILTER_PRINTS = 20_000


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS), "")


def _word_hashes(words: str) -> Column:
    """Full lower-casing may merge more words than A-Z alone; never fewer."""
    return F.expr(f"transform({words}, x -> xxhash64(lower(x)))")


def _grams(hashes: str, k: int) -> Column:
    """Hashes of all runs of k words."""
    run = ", ".join(["x", *(f"get({hashes}, i + {j})" for j in range(1, k))])
    return F.expr(f"slice(transform({hashes}, (x, i) -> xxhash64({run})), 1, greatest(size({hashes}) - {k - 1}, 0))")


def _smallest(grams: str, width: int) -> str:
    """SQL: the smallest hash of each window of ``width`` hashes."""
    run = ", ".join(["x", *(f"get({grams}, i + {j})" for j in range(1, width))])
    return f"slice(transform({grams}, (x, i) -> {'least(' + run + ')' if width > 1 else 'x'}), 1, greatest(size({grams}) - {width - 1}, 0))"


def _winnowed(grams: str, width: int) -> Column:
    """Those without repeats."""
    return F.expr(f"array_distinct({_smallest(grams, width)})")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(n, win, set_key, items): the distinct windows of all items, words joined by spaces, with the items that have them."""
    runs = F.expr(f"CASE WHEN size(iw) < {window} THEN array(array_join(iw, ' ')) ELSE transform(sequence(1, size(iw) - {window - 1}), i -> array_join(slice(iw, i, {window}), ' ')) END")
    every = items.select("item", F.expr(f"CASE WHEN size(iw) < {window} THEN size(iw) ELSE 0 END").alias("n"), F.explode(F.array_distinct(runs)).alias("win"))
    held = every.groupBy("n", "win").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return held.withColumn("set_key", F.sha2(F.to_json("items").cast("binary"), 256))


def _item_digests(sets_of: DataFrame, windows: DataFrame) -> DataFrame:
    """(hit_id, hit_key, n_items, items_sha256) of documents (doc_id, text_key, sets): documents with the same sets share the work."""
    keyed = sets_of.withColumn("all_sets", F.sha2(F.array_join("sets", ",").cast("binary"), 256))
    one = keyed.groupBy("all_sets").agg(F.first("sets").alias("sets")).select("all_sets", F.explode("sets").alias("set_key"))
    members = windows.groupBy("set_key").agg(F.first("items").alias("items"))
    united = one.join(members, "set_key").groupBy("all_sets").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    digests = united.select("all_sets", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"))
    return keyed.join(digests, "all_sets").select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "n_items", "items_sha256")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, one_in: int) -> DataFrame:
    """What ``decontaminate`` returns, with text_key (xxhash64 of the text)."""
    reach = window - gram
    lowered = F.transform(_words("text"), lambda w: F.translate(w, _UPPER, _LOWER))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where("item IS NOT NULL").select("item", lowered.alias("iw")).where("size(iw) > 0").withColumn("ih", _word_hashes("iw"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").alias("text"))

    short = sorted(r["n"] for r in items.where(f"size(iw) < {window}").select(F.size("iw").alias("n")).distinct().collect())  # at most window - 1 numbers

    long_items = items.where(f"size(iw) >= {window}").withColumn("g", _grams("ih", gram))
    prints = long_items.select(F.lit(0).alias("n"), F.explode(_winnowed("g", reach + 1)).alias("print"))
    whole = [items.where(f"size(iw) = {n}").select(F.lit(n).alias("n"), _grams("ih", n)[0].alias("print")) for n in short]
    wanted = shared_checkpoint(reduce(DataFrame.unionByName, whole, prints).distinct())
    windows = shared_checkpoint(_windows(items, window))
    small_prints = F.broadcast if 16 * wanted.count() <= BROADCAST_BYTES else (lambda df: df)
    size = windows.agg(F.sum(F.octet_length("win") + 80).alias("bytes")).first()["bytes"] or 0
    small_windows = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    few = [(r["n"], r["print"]) for r in wanted.limit(PREFILTER_PRINTS + 1).collect()]

    def marks(n: int, hashes: Column) -> Column:
        if len(few) <= PREFILTER_PRINTS:
            own = [h for m, h in few if m == n]
            hashes = F.filter(hashes, lambda h: h.isin(own)) if own else F.filter(hashes, lambda h: F.lit(False))
        return F.transform(hashes, lambda h: F.struct(F.lit(n).alias("n"), h.alias("print")))

    sized = texts.select("doc_id", "text_key", _words("text").alias("w")).select("doc_id", "text_key", F.size("w").alias("n_words"), _word_hashes("w").alias("h"))
    every = [marks(0, _winnowed("g", reach + 1)), *(marks(n, F.array_distinct(_grams("h", n))) for n in short)]
    count = F.array(F.struct(F.lit(-1).alias("n"), F.col("n_words").cast("bigint").alias("print")))  # one for each row
    exploded = sized.withColumn("g", _grams("h", gram)).select("doc_id", "text_key", F.explode(F.concat(count, *every)).alias("m")).select("doc_id", "text_key", "m.n", "m.print")
    joined = exploded.join(small_prints(wanted.withColumn("known", F.lit(True))), ["n", "print"], "left").where("known OR n = -1")
    rows = shared_checkpoint(
        joined.groupBy("doc_id", "text_key").agg(
            F.max(F.when(F.col("n") == -1, F.col("print"))).alias("n_words"),
            F.sum(F.when(F.col("n") == -1, 1)).alias("times"),
            F.collect_set(F.when(F.col("n") >= 0, F.struct("n", "print"))).alias("found"),
        )
    )
    candidates = rows.where("size(found) > 0").select("doc_id", "text_key", "found")
    again = candidates.join(texts.withColumnRenamed("doc_id", "own_id").withColumnRenamed("text_key", "own_key"), (F.col("text_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("doc_id", "text_key", "found", lowered.alias("w"))
    again = again.withColumn("h", _word_hashes("w"))
    for n in (0, *short):
        again = again.withColumn(f"g{n}", _grams("h", n or gram)).withColumn(f"wanted{n}", F.expr(f"transform(filter(found, x -> x.n = {n}), x -> x.print)"))
    # windows whose fingerprint some item has; a short item's words are their own fingerprint
    again = again.withColumn("least0", F.expr(_smallest("g0", reach + 1)))
    places = [F.expr(f"transform(filter(sequence(0, size({a}) - 1), p -> size({a}) > 0 AND array_contains(wanted{n}, get({a}, p))), p -> named_struct('n', {n}, 's', p, 'e', p + {n or window}, 'win', array_join(slice(w, p + 1, {n or window}), ' ')))") for n, a in ((n, f"g{n}" if n else "least0") for n in (0, *short))]
    hits = again.select("doc_id", "text_key", F.explode(F.concat(*places)).alias("m")).select("doc_id", "text_key", "m.*")
    spans = hits.join(small_windows(windows.select("n", "win", "set_key")), ["n", "win"]).select("doc_id", "text_key", "set_key", "s", "e")
    by_item = _item_digests(spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("set_key")).alias("sets")), windows)
    whole_doc = Window.partitionBy("doc_id", "text_key").orderBy("s", "e")
    reached = F.coalesce(F.max("e").over(whole_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_word = (
        spans.select("doc_id", "text_key", "s", "e").distinct()
        .withColumn("fresh", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), reached)))
        .groupBy("doc_id", "text_key").agg(F.sum("fresh").alias("n_hit"))
    )
    judged = by_item.join(by_word, F.col("hit_key").eqNullSafe(F.col("text_key")) & F.col("hit_id").eqNullSafe(F.col("doc_id"))).select("hit_id", "hit_key", "n_items", "items_sha256", "n_hit")
    return (
        rows.join(judged, (F.col("text_key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .select(
            "doc_id",
            "text_key",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 7, one_in: int = 20) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. A document word inside
    any occurrence of a window is hit; ``contaminated`` means ``n_hit > 0 and one_in * n_hit >= n_words``.
    Null and empty texts have no words, and items without words have no window. Repeated rows are answered
    each; rows that share a doc_id but not the text are judged apart; repeated item_ids count once and null
    ones not at all; other columns are ignored. With an empty benchmark nothing is hit.
    """
    return _judged(docs, benchmark, window, gram, one_in).drop("text_key")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 7, one_in: int = 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``decontaminate`` does not find contaminated."""
    judged = _judged(docs, benchmark, window, gram, one_in).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    kept = whole.join(judged, (F.col("own_key") == F.col("bad_key")) & F.col("own_id").eqNullSafe(F.col("bad_id")), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])
