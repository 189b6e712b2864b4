"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is described by features of its bytes and words and encoded by a
small network; gated attention weighs the codes, and a logistic layer scores the weighted sum. Only documents
carry labels: which passages matter is learnt from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaweave.llm import arrays

#: Features of a passage, in the order in which ``_passages`` builds them.
FEATURES = (
    "words", "mean word length", "long words", "distinct words", "word repeats its neighbour", "upper case", "digits", "white space beyond one a word",
    "non-ASCII", "full stops and commas", "exclamation and question marks", "bars", "other symbols", "line breaks", "mark-up brackets", "words ending in a symbol", "words with an upper-case initial", "one-letter words",
)


def _byte_classes() -> dict[str, np.ndarray]:
    table = {}
    for name, chars in {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,", "call": b"!?", "bar": b"|", "odd": b"#$%&*@^~=+_\\`;:/\"'(){}", "line": b"\n\r", "angle": b"<>[]", "space": b" \t\x0b\x0c"}.items():
        table[name] = np.zeros(256, np.int32)
        table[name][list(chars)] = 1
    table["high"] = np.zeros(256, np.int32)
    table["high"][192:] = 1
    return table


def _passages(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each passage's row and features; a row without words has one passage of zeros."""
    data, starts, ends = arrays.text_buffers(column)
    begin, end = arrays.word_spans(data, starts, arrays.white_space())
    rows = len(starts)
    row = arrays.row_of(begin, starts, ends)
    per_row = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(per_row)])[:-1]
    place = np.arange(len(begin)) - first[row]
    heads = np.flatnonzero(place % size == 0)
    if not len(heads):
        return np.arange(rows), np.zeros((rows, len(FEATURES)), np.float32)
    owner = row[heads]
    passage = np.repeat(np.arange(len(heads)), np.diff([*heads, len(begin)]))
    n = np.diff([*heads, len(begin)]).astype(np.float64)
    lo, hi = begin[heads], end[np.concatenate([heads[1:], [len(begin)]]) - 1]
    width = np.maximum(hi - lo, 1)
    length = end - begin
    hashes = arrays.hash_words(data, begin, end)
    same = np.zeros(len(begin), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    classes = _byte_classes()

    def within(name: str) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(classes[name][data], dtype=np.int64)])
        return sums[hi] - sums[lo]

    def of_words(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag.astype(np.float64), heads)

    last, initial = data[end - 1], data[begin]
    symbol = (classes["odd"] + classes["bar"] + classes["call"]).astype(bool)
    columns = [
        np.log1p(n) / np.log1p(size), of_words(length) / n / 10, of_words(length > 14) / n, np.bincount(passage[order], weights=fresh, minlength=len(heads)) / n, of_words(same) / n,
        within("upper") / width, within("digit") / width, np.maximum(within("space") - n + 1, 0) / width,
        within("high") / width, within("stop") / n, within("call") / n, within("bar") / n, within("odd") / n, within("line") / n, within("angle") / n,
        of_words(symbol[last]) / n, of_words(classes["upper"][initial]) / n, of_words(length == 1) / n,
    ]
    made = np.stack(columns, 1).astype(np.float32)
    bare = np.flatnonzero(per_row == 0)
    if len(bare):
        owner = np.concatenate([owner, bare])
        made = np.concatenate([made, np.zeros((len(bare), len(FEATURES)), np.float32)])
        order = np.argsort(owner, kind="stable")
        owner, made = owner[order], made[order]
    return owner, made


@dataclass
class AttentionModel:
    """Weights of the encoder (w, b), the gates (v, u, a), the score layer (c, d), and the features' scaling."""

    weights: dict[str, np.ndarray]
    centre: np.ndarray
    spread: np.ndarray

    def score(self, owner: np.ndarray, features: np.ndarray, rows: int) -> np.ndarray:
        """Score of each row from its passages; ``owner`` ascends and names every row."""
        return _forward(self.weights, (features - self.centre) / self.spread, owner, rows)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray, rows: int) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["w"] + w["b"])
    t, g = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    e = np.clip(((t * g) @ w["a"]), -30, 30)
    raw = np.exp(e)
    share = raw / np.bincount(owner, weights=raw, minlength=rows)[owner]
    heads = np.searchsorted(owner, np.arange(rows))
    z = np.add.reduceat(share[:, None] * h, heads, axis=0)
    return {"x": x, "h": h, "t": t, "g": g, "share": share, "z": z, "heads": heads, "p": _sigmoid(z @ w["c"] + w["d"][0])}


def _gradients(w: dict[str, np.ndarray], f: dict[str, np.ndarray], owner: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    dy = (f["p"] - labels) / len(labels)
    dz = dy[:, None] * w["c"]
    dz_row = dz[owner]
    dh = f["share"][:, None] * dz_row
    d_share = (dz_row * f["h"]).sum(1)
    mean = np.add.reduceat(f["share"] * d_share, f["heads"])
    de = f["share"] * (d_share - mean[owner])
    dt = de[:, None] * (f["g"] * w["a"]) * (1 - f["t"] ** 2)
    dg = de[:, None] * (f["t"] * w["a"]) * f["g"] * (1 - f["g"])
    dh = (dh + dt @ w["v"].T + dg @ w["u"].T) * (1 - f["h"] ** 2)
    return {"w": f["x"].T @ dh, "b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}


def fit_attention(owner: np.ndarray, features: np.ndarray, labels: np.ndarray, width: int = 24, gates: int = 12, rounds: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Adam on the log loss of documents; ``owner`` ascends from 0 to ``len(labels) - 1``."""
    rng = np.random.default_rng(seed)
    k = features.shape[1]
    centre, spread = features.mean(0), features.std(0) + 1e-3
    w = {"w": rng.normal(0, k**-0.5, (k, width)), "b": np.zeros(width), "v": rng.normal(0, width**-0.5, (width, gates)), "u": rng.normal(0, width**-0.5, (width, gates)), "a": rng.normal(0, gates**-0.5, gates), "c": rng.normal(0, width**-0.5, width), "d": np.zeros(1)}
    moments = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in w.items()}
    scaled = ((features - centre) / spread).astype(np.float64)
    edges = np.searchsorted(owner, np.arange(len(labels) + 1))
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            counts = edges[docs + 1] - edges[docs]
            take = np.repeat(edges[docs] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            local = np.repeat(np.arange(len(docs)), counts)
            made = _gradients(w, _forward(w, scaled[take], local, len(docs)), local, labels[docs])
            step += 1
            for name, g in made.items():
                g = g + decay * w[name]
                m, s = moments[name]
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                w[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return AttentionModel(w, centre, spread)


def _features_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in arrays.slices(b, 2)):
            owner, made = _passages(batch.column(2), size)
            edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            blobs = [made[s:e].tobytes() for s, e in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["doc_id", "label", "passages"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, passage_words: int = 64, sample: int = 4000, sample_passages: int = 400_000) -> AttentionModel | float:
    """Fit on labelled documents, all their passages: those with the smallest hashes of doc_id, at most ``sample``; of these, where
    they have more than ``sample_passages`` passages together (72 bytes each on the driver), the shortest that have so many.

    ``labels`` has (doc_id, label); a document with several labels takes the largest; null and other labels
    than 0 and 1 are left out. With labels of one kind only, the model is that label; with none, it is 0.5.
    """
    wanted = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chosen = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "label", "text")
    made = chosen.mapInArrow(arrays.freeing(_features_of(passage_words)), "doc_id bigint, label int, passages binary")
    made = made.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("passages").alias("passages"))  # of repeated ids one
    order = Window.orderBy(F.length("passages"), F.xxhash64("doc_id"), "doc_id")  # at most ``sample`` rows
    got = made.withColumn("_sum", F.sum(F.length("passages")).over(order)).where(F.col("_sum") <= 4 * len(FEATURES) * sample_passages).orderBy("doc_id").toPandas()
    target = got["label"].to_numpy(np.float64)
    if len(set(target)) < 2:
        return float(target[0]) if len(target) else 0.5
    bags = [np.frombuffer(x, np.float32).reshape(-1, len(FEATURES)) for x in got["passages"]]
    return fit_attention(np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.concatenate(bags), target)


def _scores(model: AttentionModel | float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in arrays.slices(b, b.num_columns - 1)):
            if isinstance(model, float):
                score = np.full(batch.num_rows, model)
            else:
                owner, made = _passages(batch.column(batch.num_columns - 1), size)
                score = model.score(owner, made, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score_quality(docs: DataFrame, model: AttentionModel | float, threshold: float = 0.3, passage_words: int = 64) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if ``score >= threshold``) of every row; only ``text`` is looked at.

    Null and empty texts are scored as one passage without words; repeated rows are scored each; a null
    doc_id stays null; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = rows.mapInArrow(_scores(model, passage_words), "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: AttentionModel | float, threshold: float = 0.3, passage_words: int = 64) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score_quality`` predicts to be good."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in arrays.slices(b, at)):
            owner, made = _passages(batch.column(at), passage_words)
            score = np.full(batch.num_rows, model) if isinstance(model, float) else model.score(owner, made, batch.num_rows)
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
