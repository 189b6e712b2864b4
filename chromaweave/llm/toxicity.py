"""Toxic documents and sentences by multiple-instance learning.

A document is a bag of sentences. A sentence's words raise its chance to offend, ``p = sigmoid(bias + sum of weights)``, and a
document offends if any of its sentences does: ``1 - product of (1 - p)`` (noisy-or). Only documents carry labels; once one
sentence explains a label, the others get no gradient, so the weights come to tell which sentences they are. Only words that
documents of label 1 have significantly more often are candidates, and a sentence is scored by what its words add to the bias,
so sentences without such words add nothing, however many a document has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaweave.llm import arrays

#: Bytes that end a sentence, and words after which a run without any is cut.
_STOPS, _LONGEST = b".!?\n\r", 64
_LOWER = arrays.lower_table()


def _separators() -> np.ndarray:
    """Words are of ASCII letters, digits and bytes beyond ASCII."""
    table = np.ones(256, bool)
    table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return table


def _sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and each one's sentence; each sentence's row, and its first and last byte in the row's text. Sentences without
    words are none."""
    data, starts, ends = arrays.text_buffers(column)
    begin, end = arrays.word_spans(data, starts, _separators())
    if not len(begin):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    row = arrays.row_of(begin, starts, ends)
    stop = np.zeros(256, np.int64)
    stop[list(_STOPS)] = 1
    run = np.cumsum(stop[data])[begin]
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(fresh)
    place = np.arange(len(begin)) - np.repeat(heads, np.diff([*heads, len(begin)]))
    heads = np.flatnonzero(place % _LONGEST == 0)
    of = np.repeat(np.arange(len(heads)), np.diff([*heads, len(begin)]))
    owner = row[heads]
    last = end[np.append(heads[1:], len(begin)) - 1]
    return arrays.hash_words(_LOWER[data], begin, end), of, owner, begin[heads] - starts[owner], last - starts[owner]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class ToxicityModel:
    """Words by ascending 64-bit hash, their weights (0 or more), and the bias of a sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def sentence_scores(self, hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """The chance of each of ``n`` sentences to offend."""
        if not len(self.words):
            return np.full(n, 1.0 if self.bias > 0 else 0.0)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[at] == hashes
        bare = 1 / (1 + np.exp(-self.bias))
        return np.clip((_sigmoid(self.bias + np.bincount(of[known], weights=self.weights[at[known]], minlength=n)) - bare) / (1 - bare), 0, 1)


def _noisy_or(p: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """A row without sentences has 0."""
    return -np.expm1(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=rows))


def _log_ratio(of_one: np.ndarray, of_all: np.ndarray, usual: float) -> np.ndarray:
    """G of ``of_one`` of ``of_all`` documents against the usual share; 0 where it is not larger."""
    share = of_one / np.maximum(of_all, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(of_one > 0, of_one * np.log(share / usual), 0) + np.where(of_one < of_all, (of_all - of_one) * np.log((1 - share) / (1 - usual)), 0))
    return np.where(share > usual, g, 0)


def fit_noisy_or(hashes: np.ndarray, of: np.ndarray, owner: np.ndarray, labels: np.ndarray, weight: np.ndarray, least: int = 3, significance: float = 20.0, rounds: int = 200, rate: float = 0.1, decay: float = 3e-5, bias: float = -6.0) -> ToxicityModel:
    """Adam on the weighted log loss of documents, all at once, with an L1 penalty on the weights. Candidates are words of at least
    ``least`` documents that label 1 has more often, with a log-likelihood ratio (G) of ``significance`` or more. ``of`` is each word's sentence, ``owner`` each sentence's document, both ascending."""
    rows, n = len(labels), len(owner)
    bag = owner[of]
    order = np.lexsort((bag, hashes))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (bag[order[1:]] != bag[order[:-1]])
    first = order[fresh]  # of each word in each document
    words, documents = arrays.counted([hashes[first].copy()])
    of_one = np.bincount(np.searchsorted(words, hashes[first]), weights=labels[bag[first]], minlength=len(words))
    del order, fresh, first
    words = words[(documents >= least) & (_log_ratio(of_one, documents, labels.mean()) >= significance)]
    at = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
    known = words[at] == hashes if len(words) else np.zeros(len(hashes), bool)
    column, sentence = at[known], of[known]
    share = weight / weight.sum()
    w, b = np.zeros(len(words)), bias
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, rounds + 1):
        p = _sigmoid(b + np.bincount(sentence, weights=w[column], minlength=n))
        whole = np.maximum(_noisy_or(p, owner, rows), 1e-12)
        pull = np.where(labels == 1, -(1 - whole) / whole, 1.0) * share
        g_sentence = p * pull[owner]
        g = np.append(np.bincount(column, weights=g_sentence[sentence], minlength=len(words)) + decay, g_sentence.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
        w = np.maximum(w - move[:-1], 0.0)
        b -= move[-1]
    kept = w > 1e-3
    return ToxicityModel(words[kept], w[kept], float(b))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in arrays.slices(b, 2)):
        hashes, of, owner, _, _ = _sentences(batch.column(2))
        first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        words = np.searchsorted(of, first)
        made = [(hashes[s:e].tobytes(), (of[s:e] - f).astype(np.int32).tobytes()) for s, e, f in zip(words, words[1:], first)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in made], pa.binary()), pa.array([b for _, b in made], pa.binary())], names=["doc_id", "label", "words", "sentences"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_words: int = 3_000_000) -> ToxicityModel:
    """Fit on labelled documents, whole texts: of each label those with the smallest hashes of doc_id, at most ``sample``, weighted
    back to the share their label has; of these, where they have more than ``sample_words`` words together (12 bytes each on the
    driver), the shortest that have so many.

    ``labels`` has (doc_id, label); a document with several labels takes the largest; null and other labels than 0 and 1 and
    null ids are left out. With labels of one kind only, every sentence has that score; with none, 0.
    """
    every = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = {r["label"]: r["count"] for r in every.groupBy("label").count().collect()}  # two rows
    wanted = None
    for label in (0, 1):
        some = every.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        wanted = some if wanted is None else wanted.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "label", "text").mapInArrow(arrays.freeing(_bags), "doc_id bigint, label int, words binary, sentences binary")
    one = made.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct("words", "sentences")).alias("bag")).select("doc_id", "label", "bag.words", "bag.sentences")  # of repeated ids one
    shortest = Window.orderBy(F.length("words"), F.xxhash64("doc_id"), "doc_id")  # at most twice ``sample`` rows
    got = one.withColumn("sum", F.sum(F.length("words")).over(shortest)).where(F.col("sum") <= 8 * sample_words).orderBy("doc_id").toArrow()
    y = got["label"].to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 40.0 if len(y) and y[0] == 1 else -40.0)
    hashes, _ = _joined(got["words"], np.uint64)
    within, ends = _joined(got["sentences"], np.int32)
    lengths = np.diff(ends, prepend=0)
    sizes = np.zeros(len(y), np.int64)
    sizes[lengths > 0] = within[ends[lengths > 0] - 1] + 1
    of = within.astype(np.int64) + np.repeat(np.cumsum(sizes) - sizes, lengths)
    taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, total[1] / taken[1], total[0] / taken[0])
    return fit_noisy_or(hashes, of, np.repeat(np.arange(len(y)), sizes), y, weight)


def _joined(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and where each row's end in them."""
    size = np.dtype(dtype).itemsize
    values = [np.frombuffer(x.as_buffer(), dtype) for chunk in column.chunks for x in chunk]
    return np.concatenate(values), np.cumsum([len(v) for v in values])


_SPANS = "array<struct<start:int,end:int,score:double>>"


def _scored(model: ToxicityModel, level: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in arrays.slices(b, 1)):
            hashes, of, owner, start, end = _sentences(batch.column(1))
            p = model.sentence_scores(hashes, of, len(owner))
            rows = batch.num_rows
            bad = np.flatnonzero(p >= level)
            edges = np.searchsorted(owner[bad], np.arange(rows + 1))
            spans = pa.StructArray.from_arrays([pa.array(start[bad], pa.int32()), pa.array(end[bad], pa.int32()), pa.array(p[bad])], names=["start", "end", "score"])
            columns = [batch.column(0), pa.array(np.clip(_noisy_or(p, owner, rows), 0, 1) + 0.0), pa.array(np.bincount(owner, minlength=rows), pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "n_sentences", "offending"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, sentence_threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if ``score >= threshold``), n_sentences and offending of every row; only ``text`` is
    looked at. ``offending`` has start and end (bytes of the UTF-8 text, end exclusive) and score of each sentence that reaches
    ``sentence_threshold``.

    Sentences end at full stops, exclamation and question marks and line breaks, and after 64 words. Null and empty texts and
    those without words have no sentence and score 0; repeated rows are scored each; a null doc_id stays null; other columns
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = rows.mapInArrow(_scored(model, sentence_threshold), f"doc_id bigint, score double, n_sentences bigint, offending {_SPANS}")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, start, end, score and the text of each sentence whose own score reaches ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in arrays.slices(b, 1)):
            hashes, of, owner, start, end = _sentences(batch.column(1))
            p = model.sentence_scores(hashes, of, len(owner))
            data, begins, _ = arrays.text_buffers(batch.column(1))
            bad = np.flatnonzero(p >= threshold)
            texts = [data[begins[owner[k]] + start[k] : begins[owner[k]] + end[k]].tobytes().decode("utf-8", "replace") for k in bad]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[bad])), pa.array(start[bad], pa.int32()), pa.array(end[bad], pa.int32()), pa.array(p[bad]), pa.array(texts, pa.string())], names=["doc_id", "start", "end", "score", "sentence"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, start int, end int, score double, sentence string")
