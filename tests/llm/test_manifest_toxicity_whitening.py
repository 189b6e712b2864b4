"""Manifest against a plain tree and SQL, toxicity by held-out rows and located sentences, whitening against numpy."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from chromaweave.llm import manifest as merkle
from chromaweave.llm import queries
from chromaweave.llm.toxicity import fit_noisy_or, fit_toxicity, offending_sentences, score_toxicity
from chromaweave.llm.whitening import whiten
from compare import assert_same, connect

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LEAF = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, k):
    out = []
    for nodes in levels[:-1]:
        s = k // 8 * 8
        out.append(("".join(nodes[s:k]), "".join(nodes[k + 1 : s + 8])))
        k //= 8
    return out


def plain_manifest(rows, found):
    leaf = [sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)) for r in rows]
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[2], []).append(k)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf[k], found[k] is not None, found[k] or ""))
    trees = {g: tree([leaf[k] for k in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, k in enumerate(groups[g]):
            path, now = siblings(trees[g], i) + siblings(top, at), found[k] or leaf[k]
            for left, right in path:
                now = sha(left, now, right)
            out.append((rows[k][0], g, leaf[k], trees[g][-1][0], top[-1][0], sha(*(a + b for a, b in path)), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels, n, langs", [(4, 1, 1), (4, 700, 12), (1, 600, 70), (2, 1500, 2)])
def test_manifest_against_a_plain_tree(spark, monkeypatch, levels, n, langs):
    """Blocks of fewer levels make more tiers; nulls in every field, equal rows, a group of most rows, one row alone."""
    monkeypatch.setattr(merkle, "_LEVELS", levels)
    monkeypatch.setattr(merkle, "_WIDTH", 8**levels)
    rng = random.Random(n)
    names = [None, "", "é", *map(str, range(100))][:langs]
    rows = [(rng.choice([None, k, k]), rng.choice([None, "a", "ü"]), names[0] if k % 3 else rng.choice(names), rng.choice([None, 7]), rng.choice([None, "", "ÄB c", str(k)])) for k in range(n)]
    rows += rows[:4] if n > 1 else []
    found = [sha("x") if k % 5 == 0 else None for k in range(len(rows))]
    made = spark.createDataFrame([(*r, x, 1) for r, x in zip(rows, found)], LEAF + ", found string, pos int").repartition(3)
    got = merkle.manifest(made, F.col("found")).select("doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows, found)


def test_manifest_of_awkward_tables(spark):
    docs = fx.table(spark, fx.corpus(0) + [(980, "w " * 300_000)])
    got = merkle.manifest(docs)
    assert got.count() == docs.count() and got.where("NOT verified").count() == 0 and got.select("root").distinct().count() == 1
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 980, "other").otherwise(F.col("text")))
    assert merkle.manifest(changed).first()["root"] != got.first()["root"]
    assert merkle.manifest(fx.empty(spark)).count() == 0


@pytest.mark.parametrize("sf", [SMALL, SF])
def test_manifest_query_equals_sql(spark, sf):
    assert_same(queries.op11_merkle_manifest(spark, sf).toPandas(), connect(sf).execute(queries.ORACLES["op11_merkle_manifest"]).df())


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op12_toxicity(spark, sf).toPandas()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert len(got) == 10_000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.01


def invented(seed=0, n=400):
    """Half with one bad sentence among up to 30 clean ones; also that sentence's number."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for k in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 30))]
        bad = rng.randrange(len(sentences)) if k % 2 else None
        if bad is not None:
            sentences[bad] += " " + rng.choice(["VILEWORD", "zxgrim", "nastygé"])
        rows.append((k, ". ".join(sentences) + ".", int(k % 2), bad))
    return rows


def test_toxicity_finds_the_sentence(spark):
    rows = invented()
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y, _ in rows if k < 300], "doc_id long, label int")
    model = fit_toxicity(docs, labels)
    scored = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    texts = {}
    for r in offending_sentences(docs, model).collect():
        texts.setdefault(r.doc_id, []).append((r.start, r.end, r.sentence))
    for k, text, y, bad in rows:
        assert scored[k].predicted == y
        if y:
            (start, end, sentence), = texts[k]
            assert sentence == text.split(".")[bad].strip() and text.encode()[start:end].decode() == sentence
            assert [(s.start, s.end) for s in scored[k].offending] == [(start, end)]
            assert scored[k].score == pytest.approx(scored[k].offending[0].score)
        else:
            assert k not in texts and scored[k].score == 0


def test_long_clean_documents_do_not_add_up(spark):
    rows = invented(1)
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in rows] + [(9000, " ".join(t for _, t, y, _ in rows if not y) * 20), (9001, "word " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y, _ in rows], "doc_id long, label int")
    got = {r.doc_id: r for r in score_toxicity(docs.where("doc_id >= 9000"), fit_toxicity(docs, labels)).collect()}
    assert got[9000].predicted == 0 and got[9000].n_sentences > 30_000 and got[9001].score == 0 and got[9001].n_sentences == 3125


def test_toxicity_of_awkward_rows(spark):
    rows = fx.corpus(0)
    docs = fx.table(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, None), (None, 1), (2, 7), (3, 0)], "doc_id long, label int")
    model = fit_toxicity(docs, labels)
    got = score_toxicity(docs, model)
    assert got.count() == len(rows) and got.where("score IS NULL OR score < 0 OR score > 1 OR predicted IS NULL OR offending IS NULL").count() == 0
    blank = {i for i, t in rows if not (t or "").strip()}
    assert all(r.score == 0 and r.n_sentences == 0 for r in got.collect() if r.doc_id in blank)
    assert score_toxicity(docs, fit_toxicity(docs, labels.where("false"))).where("score <> 0").count() == 0
    assert score_toxicity(docs, fit_toxicity(docs, labels.where("label = 1"))).where("n_sentences > 0 AND score < 0.99").count() == 0
    assert score_toxicity(fx.empty(spark), model).count() == 0 and offending_sentences(fx.empty(spark), model).count() == 0
    assert not len(fit_toxicity(fx.empty(spark), labels).words)


def test_an_overlong_labelled_document_is_no_cliff(spark):
    rows = invented(2)
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in rows] + [(5000, "calm " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y, _ in rows] + [(5000, 0)], "doc_id long, label int")
    assert len(fit_toxicity(docs, labels, sample_words=60_000).words) >= 3


def test_noisy_or_explains_a_label_once():
    """A word that only comes along with a bad one gets less weight than that."""
    bad, along, other = np.uint64(1), np.uint64(2), np.uint64(3)
    hashes, of, owner, labels = [], [], [], []
    for k in range(200):
        own = [[other], [bad, other] if k % 2 else [other], [along, other] if k % 2 and k % 4 == 1 or k % 10 == 0 else [other]]
        for words in own:
            hashes += words
            of += [len(owner)] * len(words)
            owner.append(k)
        labels.append(float(k % 2))
    model = fit_noisy_or(np.array(hashes, np.uint64), np.array(of), np.array(owner), np.array(labels), np.ones(200))
    weight = dict(zip(model.words.tolist(), model.weights))
    assert weight[1] > 5 and weight.get(2, 0) < 1 and 3 not in weight


def plain_whitening(rows):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    return kept, ((n * x - s) ** 2).sum(1), (x - s / n) @ vectors / np.sqrt(values), values / values.sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate((rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7))).astype(np.float32))]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (900, None), (901, []), (902, [1.0, None] * 3 + [1.0]), (903, [math.nan] * 7), (904, [math.inf] * 7), (905, [1.0] * 3), (906, [1e30] * 7)]
    vectors = spark.createDataFrame([(i, v, "k", 1.0) for i, v in rows], "vec_id long, embedding array<float>, key string, deviation double").repartition(3)
    got = whiten(vectors, components=5).toPandas()
    kept, deviation, white, share = plain_whitening([r for r in rows if r[0] is None or r[0] < 905])
    n = len(kept)
    assert len(got) == 5 * n and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    order = lambda table: sorted((tuple(np.round(np.abs(r), 6)) for r in table))
    one = got.assign(vec_id=got.vec_id.fillna(-1))
    wide = one[one.vec_id != 5].pivot(index="vec_id", columns="component", values="whitened")
    want = np.array([w[:5] for (i, _), w in zip(kept, white) if i != 5])
    assert np.allclose(order(wide.to_numpy()), order(want), atol=1e-5) and (wide.loc[-1] == wide.loc[6]).all()
    by = dict(zip([-1 if i is None else i for i, _ in kept], deviation.tolist()))
    assert all(by[r.vec_id] == r.deviation for r in one.itertuples())
    assert np.allclose(got.groupby("component").explained.first(), share[:5], rtol=1e-9)


def test_whitening_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [math.nan])], schema)).count() == 0
    assert whiten(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], schema)).count() == 0  # no variance
    flat = whiten(spark.createDataFrame([(k, [k / 2, 3.0, k / 4]) for k in range(8)], schema)).toPandas()  # one direction
    assert len(flat) == 8 and (flat.component == 1).all() and flat.identity_error.max() < 1e-9 and flat.explained.iloc[0] == pytest.approx(1)


def test_whitening_query(spark):
    got = queries.op13_whitening(spark, SMALL)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    kept, deviation, white, share = plain_whitening(rows)
    got = got.toPandas()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in kept]].to_numpy()
    assert np.allclose(np.abs(wide), np.abs(white[:, :32]), atol=1e-8) and got.identity_error[0] < 1e-9
    assert np.allclose(np.sign(wide * white[:, :32]), np.sign(wide[0] * white[0, :32]))  # one sign for all rows
    assert got[got.component == 1].set_index("vec_id").deviation.loc[[i for i, _ in kept]].tolist() == deviation.tolist()
