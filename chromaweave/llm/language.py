"""Language identification with interpolated Kneser-Ney models of characters, one per language.

Symbols are the code points of the lower-cased text, as they are; a run of white space is one space. Counts are
taken over all training rows; a document gets the language with the lowest cross-entropy a symbol.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.llm import arrays

ORDER = 4
#: Size of the alphabet of ``_kneser_ney``'s packed 4-grams.
SYMBOLS = 40
_SPACE = 32
_BLANK, _LETTER = 1, 2
#: A task sends on what it counted when it holds more entries than this.
_ENTRIES = 1 << 20
#: Languages whose code lengths are in memory at once.
_BLOCK = 32


def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point (the first one, if there are several), and whether it is a blank or a letter."""
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    kind = np.zeros(len(lower), np.uint8)
    for point in range(len(lower)):
        char = chr(point)
        if char.isspace():
            kind[point] = _BLANK
        elif unicodedata.category(char)[0] == "L":
            kind[point] = _LETTER
            lower[point] = ord(char.lower()[0])
    lower[kind == _BLANK] = _SPACE
    return lower, kind


_TABLE: list[tuple[np.ndarray, np.ndarray]] = []


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows that hold a letter on end, with the row of each."""
    if not _TABLE:
        _TABLE.append(_alphabet())
    data, starts, ends = arrays.text_buffers(column)
    heads = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    sums = np.concatenate([[0], np.cumsum(heads)])
    lengths = sums[ends] - sums[starts]
    if len(points) != sums[-1]:  # bytes that are no UTF-8: decode row by row
        each = [np.frombuffer(data[s:e].tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) for s, e in zip(starts, ends)]
        points, lengths = np.concatenate(each), np.array([len(x) for x in each])
    row = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
    lower, kinds = _TABLE[0]
    kind = kinds[points]
    keep = np.bincount(row[kind == _LETTER], minlength=len(starts))[row] > 0
    blank = kind == _BLANK
    keep[:1] &= ~blank[:1]
    keep[1:] &= ~blank[1:] | (~blank[:-1] & (row[1:] == row[:-1]))
    return lower[points[keep]], row[keep]


def _grams(sym: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each symbol, one a line; a row's start is padded with spaces."""
    out = np.full((len(sym), ORDER), _SPACE, np.uint32)
    if len(sym):
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        place = np.arange(len(sym)) - np.repeat(head, np.diff([*head, len(sym)]))
        for back in range(ORDER):
            own = np.flatnonzero(place >= back)
            out[own, ORDER - 1 - back] = sym[own - back]
    return out


def _hash(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line."""
    h = np.full(len(grams), grams.shape[1] + 1, np.uint64)
    for k in range(grams.shape[1]):
        h = arrays.mix(h * np.uint64(0x9E3779B97F4A7C15) + grams[:, k])
    return h


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (pairs, n) in totals.items():
            for at in range(0, len(n), 50_000):
                some = pairs[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some[:, 0]), pa.array(some[:, 1]), pa.array(n[at : at + 50_000])], names=["lang", "a", "b", "n"])
        totals.clear()

    for batch in (part for b in batches for part in arrays.slices(b, 1)):
        sym, row = _symbols(batch.column(1))
        grams = _grams(sym, row)
        h = _hash(grams)
        names, of = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
        for k, lang in enumerate(names.tolist()):
            own = np.flatnonzero(of[row] == k)
            _, some, n = np.unique(h[own], return_index=True, return_counts=True)
            got = grams[own[some]].astype(np.int64)
            pairs = np.stack([got[:, 0] << 32 | got[:, 1], got[:, 2] << 32 | got[:, 3]], 1)
            if lang in totals:
                pairs, n = np.concatenate([totals[lang][0], pairs]), np.concatenate([totals[lang][1], n])
                _, some, where = np.unique(_hash(pairs.view(np.uint32)), return_index=True, return_inverse=True)
                pairs, n = pairs[some], np.bincount(where, weights=n).astype(np.int64)
            totals[lang] = pairs, n
        if sum(len(n) for _, n in totals.values()) > _ENTRIES:
            yield from flush()
    yield from flush()


@dataclass
class _Table:
    """Values by gram and language: sorted hashes, where each one's entries begin, and (language, value) entries."""

    hashes: np.ndarray
    bounds: np.ndarray
    langs: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> _Table:
        """From the (hashes, values) of each language."""
        h = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint64)
        values = np.concatenate([np.log2(v).astype(np.float32) for _, v in parts]) if parts else np.zeros(0, np.float32)
        langs = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x, _ in parts])
        order = np.argsort(h, kind="stable")
        hashes, begin = np.unique(h[order], return_index=True)
        return cls(hashes, np.append(begin, len(h)), langs[order], values[order])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The line of ``h``, the language and the value of each entry there is."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        line = np.flatnonzero(self.hashes[at] == h)
        begin, n = self.bounds[at[line]], self.bounds[at[line] + 1] - self.bounds[at[line]]
        entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(line, n), self.langs[entry], self.values[entry]


@dataclass
class LanguageModels:
    """Log2 probabilities of the grams seen and back-off weights of the contexts seen, for each order from 1 on."""

    langs: list[str]
    symbols: int
    seen: list[_Table]
    weights: list[_Table]
    sharpness: float = 1.0
    worst: np.ndarray | None = None

    def bits(self, grams: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Code length of each 4-gram's last symbol, for one block of languages after the other, with its first language."""
        found = [(self.weights[k - 1].find(_hash(grams[:, ORDER - k : ORDER - 1])), self.seen[k - 1].find(_hash(grams[:, ORDER - k :]))) for k in range(1, ORDER + 1)]
        for low in range(0, len(self.langs), _BLOCK):
            width = min(_BLOCK, len(self.langs) - low)
            out = np.full((len(grams), width), np.log2(self.symbols))
            for (c_line, c_lang, weight), (line, lang, value) in found:
                own = (c_lang >= low) & (c_lang < low + width)
                out[c_line[own], c_lang[own] - low] -= weight[own]
                own = (lang >= low) & (lang < low + width)
                out[line[own], lang[own] - low] = -value[own]
            yield low, out


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def _fitted(grams: np.ndarray, n: np.ndarray, symbols: int) -> list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """For one language and each order: (hash, probability) of the grams seen, and (hash, back-off weight) of contexts."""
    out: list = []
    for order in range(1, ORDER + 1):
        if order == ORDER:
            key, first = np.unique(_hash(grams), return_index=True)
            count = n[first].astype(np.float64)
        else:  # how many symbols precede it
            _, longer = np.unique(_hash(grams[:, ORDER - 1 - order :]), return_index=True)
            key, first, count = np.unique(_hash(grams[longer, ORDER - order :]), return_index=True, return_counts=True)
            first, count = longer[first], count.astype(np.float64)
        d = _discount(count)
        contexts, of = np.unique(_hash(grams[first, ORDER - order : ORDER - 1]), return_inverse=True)
        total = np.bincount(of, weights=count)
        weight = d * np.bincount(of) / total
        if order == 1:
            lower = 1 / symbols
        else:
            keys, values = out[-1][0]
            lower = values[np.searchsorted(keys, _hash(grams[first, ORDER + 1 - order :]))]
        out.append(((key, np.maximum(count - d, 0) / total[of] + weight[of] * lower), (contexts, weight)))
    return out


def _kneser_ney(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 4-grams packed to the base ``SYMBOLS``: probability of each, and dense 3-gram probabilities and back-off weights."""

    def unpacked(codes: np.ndarray, length: int) -> np.ndarray:
        return np.stack([codes // SYMBOLS**k % SYMBOLS for k in reversed(range(length))], 1).astype(np.uint32)

    fitted = _fitted(unpacked(code, ORDER), n, SYMBOLS)
    parts = LanguageModels([""], SYMBOLS, [_Table.of([seen]) for seen, _ in fitted], [_Table.of([w]) for _, w in fitted])
    three = np.arange(SYMBOLS ** (ORDER - 1))
    shorter = LanguageModels([""], SYMBOLS, [*parts.seen[:-1], _Table.of([])], [*parts.weights[:-1], _Table.of([])])
    lower = 2.0 ** -next(shorter.bits(unpacked(three, ORDER)))[1][:, 0]
    backoff = np.ones(len(three))
    line, _, weight = parts.weights[-1].find(_hash(unpacked(three, ORDER - 1)))
    backoff[line] = 2.0**weight
    return 2.0 ** -next(parts.bits(unpacked(code, ORDER)))[1][:, 0], lower, backoff


def fit_languages(docs: DataFrame, most_languages: int | None = None, rejected: float = 0.005) -> LanguageModels:
    """Count 4-grams over every row with text and lang, and build one model per language.

    There may be any number of lang values, unless ``most_languages`` is given: then more are refused. A model has an entry for each gram seen. The
    scores' sharpness and each language's rejection level (the ``1 - rejected`` quantile of its own
    cross-entropies) are set on all training rows.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.select("lang", "text").mapInArrow(_counted, "lang string, a bigint, b bigint, n bigint")
    got = counts.groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(got["lang"].unique().to_pylist())
    if most_languages is not None and len(langs) > most_languages:
        raise ValueError(f"{len(langs)} languages; at most {most_languages} are supported")
    of = pc.index_in(got["lang"], pa.array(langs, pa.string())).to_numpy()
    a, b = got["a"].to_numpy(), got["b"].to_numpy()
    grams, n = np.stack([a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF], 1).astype(np.uint32), got["n"].to_numpy()
    symbols = len(np.unique(grams[:, -1])) + 1  # one for all that were not seen
    fitted = []
    order = np.argsort(of, kind="stable")
    for own in np.split(order, np.searchsorted(of[order], np.arange(1, len(langs)))) if langs else []:
        fitted.append(_fitted(grams[own], n[own], symbols))
    models = LanguageModels(langs, symbols, [_Table.of([f[k][0] for f in fitted]) for k in range(ORDER)], [_Table.of([f[k][1] for f in fitted]) for k in range(ORDER)])
    if langs:
        _calibrate(models, rows, rejected)
    return models


def _entropies(models: LanguageModels, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits a symbol of each row under each language, and the number of symbols."""
    rows = len(column)
    sym, row = _symbols(column)
    grams = _grams(sym, row)
    length = np.bincount(row, minlength=rows).astype(np.float64)
    _, some, where = np.unique(_hash(grams), return_index=True, return_inverse=True)
    out = np.zeros((rows, len(models.langs)))
    for low, bits in models.bits(grams[some]):
        for k in range(bits.shape[1]):
            out[:, low + k] = np.bincount(row, weights=bits[where, k], minlength=rows) / np.maximum(length, 1)
    return out, length


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _calibrate(models: LanguageModels, rows: DataFrame, rejected: float) -> None:
    tried = 2.0 ** np.arange(-2, 7)
    names = ["lang", "own", *(f"loss{k}" for k in range(len(tried)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: k for k, lang in enumerate(models.langs)}
        for batch in (part for b in batches for part in arrays.slices(b, 1)):
            h, length = _entropies(models, batch.column(1))
            some = np.flatnonzero(length)
            langs = batch.column(0).take(pa.array(some))
            h, truth = h[some], np.array([place[x] for x in langs.to_pylist()], int)
            lines = np.arange(len(some))
            losses = [-np.log(np.maximum(_softmax(-h * t)[lines, truth], 1e-12)) for t in tried]
            yield pa.RecordBatch.from_arrays([langs, *(pa.array(x, pa.float64()) for x in (h[lines, truth], *losses))], names=names)

    scored = rows.select("lang", "text").mapInArrow(run, ", ".join(["lang string", *(f"{x} double" for x in names[1:])]))
    got = scored.groupBy("lang").agg(F.percentile_approx("own", 1 - rejected, 10_000).alias("level"), *(F.sum(x).alias(x) for x in names[2:])).toPandas()
    models.worst = np.full(len(models.langs), np.inf)
    if len(got):
        models.sharpness = float(tried[got[names[2:]].sum().to_numpy().argmin()])
        models.worst[[models.langs.index(x) for x in got["lang"]]] = got["level"]


def identify_language(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and rejected of every row; only ``text`` is looked at.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if no language was
    learnt; ties go to the first name. ``rejected`` marks texts whose cross-entropy is above the calibrated
    level of the language given. Repeated rows are answered each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in arrays.slices(b, 1)):
            if models.langs:
                h, length = _entropies(models, batch.column(1))
                best = h.argmin(1)
                score = _softmax(-h * models.sharpness)[np.arange(len(h)), best]
                lowest = h[np.arange(len(h)), best]
                level = models.worst[best] if models.worst is not None else np.inf
            else:
                length, best, score, lowest, level = np.zeros(batch.num_rows), np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.zeros(batch.num_rows), 0.0
            some = length > 0 if models.langs else np.zeros(batch.num_rows, bool)
            names = [models.langs[b] if s else "und" for b, s in zip(best, some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(~some | (lowest > level))], names=["doc_id", "lang_pred", "score", "rejected"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
