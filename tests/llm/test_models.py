"""Operators that learn, search or segment: held-out accuracy, recall, brute force and round trips."""

import dataclasses
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import fixtures as fx
from chromaweave.llm import queries
from chromaweave.llm.language import SYMBOLS, _kneser_ney, fit_languages, identify_language
from chromaweave.llm.neighbours import nearest
from chromaweave.llm.pieces import SPACE, PieceLattice, combine, decode_pieces, encode_pieces
from chromaweave.llm.quality import _forward, _gradients, fit_quality, keep_good, score_quality

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_quality_on_held_out_rows(spark):
    got = queries.op4_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() > 0.93
    good = held[held.quality == 1]
    assert (good.predicted == 1).mean() > 0.98


def test_quality_of_awkward_rows(spark):
    rows = fx.corpus(0)
    docs = fx.table(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, None), (None, 1), (2, 7), (3, 0)], "doc_id long, label int")
    model = fit_quality(docs, labels)
    got = score_quality(docs, model)
    assert got.count() == len(rows) and got.where("score IS NULL OR score < 0 OR score > 1 OR predicted IS NULL").count() == 0
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == got.where("predicted = 1").count()
    assert fit_quality(docs, labels.where("false")) == 0.5 and fit_quality(docs, labels.where("label = 1")) == 1.0
    assert score_quality(docs, 0.5).where("score <> 0.5").count() == 0
    assert score_quality(fx.empty(spark), model).count() == 0 and fit_quality(fx.empty(spark), labels) == 0.5


def test_attention_gradients():
    rng = np.random.default_rng(0)
    owner, x, y = np.array([0, 0, 1, 2, 2, 2]), rng.normal(size=(6, 4)), np.array([1.0, 0.0, 1.0])
    w = {"w": rng.normal(size=(4, 3)), "b": rng.normal(size=3), "v": rng.normal(size=(3, 2)), "u": rng.normal(size=(3, 2)), "a": rng.normal(size=2), "c": rng.normal(size=3), "d": rng.normal(size=1)}

    def loss():
        p = _forward(w, x, owner, 3)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    made = _gradients(w, _forward(w, x, owner, 3), owner, y)
    for name, value in w.items():
        for at in np.ndindex(value.shape):
            kept = value[at]
            value[at] = kept + 1e-6
            up = loss()
            value[at] = kept - 1e-6
            down = loss()
            value[at] = kept
            assert made[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_language_on_held_out_rows(spark):
    got = queries.op7_language(spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out & both.lang.notna()]
    assert len(got) == 1000 and (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_of_awkward_rows(spark):
    docs = fx.table(spark, fx.corpus(0) + [(950, "1234 !?"), (951, None), (952, "𐐀𐐁 Ωμέγα")])
    models = fit_languages(docs)
    assert models.langs == ["de", "en"]
    got = {r.doc_id: r for r in identify_language(docs, models).collect()}
    assert got[950].lang_pred == got[951].lang_pred == "und" and got[950].score == 0
    assert got[952].lang_pred in models.langs
    assert identify_language(fx.empty(spark), models).count() == 0
    none = fit_languages(fx.empty(spark))
    assert {r.lang_pred for r in identify_language(docs, none).collect()} == {"und"}
    with pytest.raises(ValueError):
        fit_languages(docs, most_languages=1)


def test_language_by_letters_that_differ(spark):
    rng = random.Random(4)
    words = {"fr": "été élève forêt où", "de": "öl über größe schön", "es": "niño año señal él", "ru": "ыры эльф съел ёлка это", "uk": "їжа ґава єдність її ці", "zh": "我们的语言文字国家", "ja": "ことばにほんごの国"}
    docs = [(k, " ".join(rng.choices(w.split() if " " in w else list(w), k=6)), lang) for lang, w in words.items() for k in range(20)]
    models = fit_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    asked = [("é", "fr"), ("ö", "de"), ("ñ", "es"), ("ы э", "ru"), ("ї ґ", "uk"), ("我们", "zh"), ("ことば", "ja")]
    got = identify_language(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(asked)], "doc_id long, text string"), models)
    assert [r.lang_pred for r in got.orderBy("doc_id").collect()] == [lang for _, lang in asked]


def test_any_number_of_languages(spark):
    letters = [chr(0x4E00 + k) for k in range(70)]
    docs = spark.createDataFrame([(10 * k + j, f"{c}{c} ab {c}", f"l{k:02}") for k, c in enumerate(letters) for j in range(3)], "doc_id long, text string, lang string")
    got = identify_language(docs, fit_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == 210 and got.where("lang_pred <> lang OR score <= 0 OR score > 1").count() == 0


def test_rare_languages_have_a_level(spark):
    rows = [(k, f"the cat {k} sat on a mat", "en") for k in range(4000)] + [(5000, "ça été", "fr")]
    models = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert models.langs == ["en", "fr"] and np.isfinite(models.worst).all()


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(2)
    code = np.unique(rng.integers(0, SYMBOLS**4, 400))
    n = rng.integers(1, 9, len(code))
    seen, lower, backoff = _kneser_ney(code, n)
    assert np.allclose(lower.reshape(-1, SYMBOLS).sum(1), 1)
    for context in np.unique(code // SYMBOLS)[:20]:
        z = np.arange(SYMBOLS)
        p = backoff[context] * lower[(context * SYMBOLS + z) % SYMBOLS**3]
        own = code // SYMBOLS == context
        p[code[own] % SYMBOLS] = seen[own]
        assert p.sum() == pytest.approx(1)


def exact(vectors, query, k):
    good = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    q = next(v for i, v in good if i == query)
    best = {}
    for i, v in good:
        if i != query and len(v) == len(q):
            best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - q) ** 2).sum())))
    return sorted((d, i) for i, d in best.items())[:k]


def test_neighbours_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = nearest(vectors, vectors.where("vec_id % 20 = 0"), k=10, least_blocks=3, block_rows=200).toPandas()
    hit = total = 0
    for q, own in got.groupby("query_id"):
        want = exact(rows, q, 10)
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and own.score.is_monotonic_increasing
        hit += len({i for _, i in want} & set(own.vec_id))
        total += 10
    assert hit / total >= 0.95


def test_neighbours_of_awkward_rows(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(30)]
    rows += [(40, [1.0, 1.0, 1.0, 1.0]), (41, [1.0, 1.0, 1.0, 1.0]), (42, [1.0, 1.0, 1.0, 1.0]), (41, [1.0, 1.0, 1.0, 1.0]), (50, None), (51, []), (52, [0.0] * 4), (53, [1.0, None, 1.0, 1.0]), (54, [float("nan")] + [1.0] * 3), (55, [float("inf")] + [1.0] * 3), (None, [1.0] * 4), (56, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, block int")
    got = nearest(vectors, vectors, k=5, least_blocks=2).toPandas()
    assert set(got.query_id) == {*range(30), 40, 41, 42}
    own = got[got.query_id == 40].sort_values("rank")
    assert own.vec_id.tolist()[:2] == [41, 42] and own.score.tolist()[:2] == [0, 0]
    for q in (0, 7, 40, 41):
        want = exact(rows, q, 5)
        found = got[got.query_id == q].sort_values("rank")
        assert found.score.tolist() == [d for d, _ in want] and found.vec_id.tolist() == [i for _, i in want]
    few = nearest(vectors.where("vec_id < 3"), vectors.where("vec_id = 0"), k=10)
    assert few.count() == 2 and nearest(vectors.where("false"), vectors, k=3).count() == 0 and nearest(vectors, vectors.where("false"), k=3).count() == 0


@pytest.fixture(scope="module")
def lattice():
    return PieceLattice.of(sentencepiece.SentencePieceProcessor(model_file=MODEL))


def every_way(lattice, unit):
    if not unit:
        return [(0.0, ())]
    out = []
    for end in range(1, len(unit) + 1):
        got = lattice.table.get(unit[:end])
        if not got and end == 1:
            got = (lattice.penalty, lattice._of_unknown(unit[0]))
        if got:
            out += [(got[0] + s, got[1] + i) for s, i in every_way(lattice, unit[end:])]
    return out


def test_n_best_segmentations(lattice):
    rng = random.Random(3)
    units = [f"{SPACE}the", f"{SPACE}thntatwh", "ñas", SPACE, SPACE * 3 + "a", "x\ny", "日本龘", "Ciónarll,"] + ["".join(rng.choice("abethñ,.") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    for unit, (packed, score, shown, loss) in zip(units, lattice.first(units)):
        ways = sorted(every_way(lattice, unit), key=lambda w: -w[0])
        assert [s for s, _ in lattice.best(unit, 5)] == [s for s, _ in ways[:5]]
        assert len(set(lattice.best(unit, 5))) == min(5, len(ways))
        assert score == ways[0][0] and (score, tuple(np.frombuffer(packed, "<i4"))) in ways and shown == unit
        assert loss == (ways[0][0] - ways[1][0] if len(ways) > 1 else float("inf"))


def test_n_best_of_documents():
    units = [[0.0, 1.0, 4.0], [0.0, 2.0], [0.0, 0.5, 9.0]]
    every = sorted(a + b + c for a in units[0] for b in units[1] for c in units[2])
    assert combine(units, 4) == every[:4]


def test_ids_of_the_n_best(spark, lattice):
    texts = ["the thntatwh", "ñas日 x", "", "龘", "abeth an abeth", "a" * 60, "an an an an", "x\ny\nx a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(encode_pieces(docs, MODEL, n_best=4, with_ids=True).collect())
    plain = sorted(encode_pieces(docs, MODEL, n_best=4).collect())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r, p, text in zip(got, plain, texts):
        assert r.nbest_ids[0] == r.ids and len({tuple(x) for x in r.nbest_ids}) == len(r.nbest_ids) == len(r.nbest_scores)
        assert p.nbest_sha256 == r.nbest_sha256 == [fx.sha(np.array(x, "<i4").tobytes()) for x in r.nbest_ids] and p.ids_sha256 == p.nbest_sha256[0]
        assert all(library.decode(x) == text for x in r.nbest_ids)
        if 0 < len(text) < 20:
            ways = sorted(every_way(lattice, library.normalize(text)), key=lambda w: -w[0])
            assert r.nbest_scores == [s for s, _ in ways[:4]]
            assert all((s, tuple(x)) in ways for s, x in zip(r.nbest_scores, r.nbest_ids))


def test_first_is_the_first_of_the_search(lattice):
    """On both sides of the length up to which units are searched in arrays, with many ties."""
    rng = random.Random(5)
    units = ["".join(rng.choice("abethñ,.日") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    units += ["".join(rng.choice("aab-=.x") for _ in range(rng.randint(40, 56))) for _ in range(200)] + [c * k for c in "ax-." for k in (47, 48, 49, 50, 300)]
    for unit, (packed, score, shown, loss) in zip(units, lattice.first(units)):
        ways = lattice.best(unit, 3)
        assert (score, tuple(np.frombuffer(packed, "<i4"))) == ways[0] and shown == unit and ways[:2] == lattice.best(unit, 2)
        assert loss == (score - ways[1][0] if len(ways) > 1 else float("inf"))


def test_ties_go_to_the_longer_first_piece(lattice):
    for unit in ["aaa", "abab", "----", "xxxxx", SPACE * 4, "..,,.."]:
        want = sorted(every_way(lattice, unit), key=lambda w: (-w[0], [-len(lattice.texts[i]) for i in w[1]]))
        for n in (1, 2, 5, 9):
            assert lattice.best(unit, n) == want[:n]


def test_very_long_units(lattice):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for unit in ["x" * 30_000, "日" * 3_000, "ab" * 10_000]:
        ways = lattice.best(unit, 2)
        assert len(ways) == 1 or ways[0][0] >= ways[1][0]
        assert library.decode(list(ways[0][1])) == unit


def test_shown_text_comes_from_the_ids(lattice):
    wrong = dataclasses.replace(lattice, hash_ids=np.where(lattice.hash_ids == lattice.table["the"][1][0], lattice.table["an"][1][0], lattice.hash_ids))
    packed, _, shown, _ = wrong.first(["the"])[0]
    assert tuple(np.frombuffer(packed, "<i4")) == lattice.table["an"][1] and shown == "an"


def test_pieces_round_trip(spark, lattice):
    rows = fx.corpus(0) + [(960, "spaces   inside\nand  lines\t"), (961, "a" * 300)]
    docs = fx.table(spark, rows)
    got = encode_pieces(docs, MODEL, n_best=3, characters_in_memory=3000, with_ids=True)
    found = got.collect()
    assert len(found) == len(rows) and all(r.round_trip for r in found)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in found[:40]:
        assert r.n_pieces == len(r.ids) and r.nbest_scores[0] == r.score and r.nbest_scores == sorted(r.nbest_scores, reverse=True)
    texts = sorted((t or "") for _, t in rows)
    assert sorted(library.decode(list(r.ids)) for r in found) == texts
    assert sorted(r.text for r in decode_pieces(got, MODEL).collect()) == texts
    assert encode_pieces(fx.empty(spark), MODEL).count() == 0
    assert got.where(F.col("doc_id").isNull()).count() == 2


def test_an_overlong_labelled_document_is_no_cliff(spark):
    """More passages than the bound in one document: the others are still learnt from."""
    rows = [(k, ("calm words in a row. " if k % 2 else "BUY!!! $$$ NOW | | | ") * (5 + k % 7)) for k in range(200)]
    first = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    rows = [(k, t * 8000 if k == first else t) for k, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, label int")
    model = fit_quality(docs, labels, sample_passages=1000)
    assert not isinstance(model, float)
    got = {r.doc_id: r.predicted for r in score_quality(docs, model).collect()}
    assert all(got[k] == k % 2 for k, _ in rows if k != first)


def test_held_out_is_never_null(spark, tmp_path):
    docs = fx.table(spark, fx.corpus(0))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op4_quality", "op7_language", "op12_toxicity"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert got.count() == docs.count() and got.where("held_out IS NULL").count() == 0
        assert got.where("doc_id IS NULL AND held_out").count() == 0
