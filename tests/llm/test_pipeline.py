"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import fixtures as fx
from chromaweave.llm.quality import fit_quality, score_quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_strings", "decontamination", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "pieces":
            assert out.columns == docs.columns
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
            scored = score_quality(docs, fit_quality(docs, labels), threshold=0.3)
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in scored.where("predicted = 1").collect())
            good = {r.doc_id for r in labels.where("label = 1").collect()} & {i for i, _ in before}
            assert len(good & {r.doc_id for r in out.collect()}) >= 0.97 * len(good) and out.count() < len(before)
        elif name == "near_duplicates":
            components, _ = fx.near_components(before)
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, c in components if i == c)
        elif name == "repeated_strings":
            removed = {i: sha for i, _, n, _, sha in fx.repeated_bytes(before, 50)}
            kept = {r.doc_id: r.text for r in out.collect()}
            assert kept.keys() == removed.keys()
            texts = dict(before)
            cut = fx.without_repeated_bytes(before, 50)
            assert removed and kept == {i: t and cut[i].decode("utf-8", "ignore") for i, t in texts.items()}
        elif name == "decontamination":
            want = sorted(i for i, *_, bad in fx.contamination(before, items) if not bad)
            assert sorted(r.doc_id for r in out.collect()) == want
        else:
            assert out.count() == len(before) and out.where("NOT round_trip").count() == 0
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert all(library.decode(list(r.ids)) == (r.text or "") and list(r.ids) == list(r.nbest_ids[0]) for r in out.collect())
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names; labels that are null; then empty tables."""
    rows = fx.corpus(0) + [(970, "word " * 200_000)]
    fx.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("a", rows[0][1]), (None, "x"), ("b", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # labels of one kind: nothing is rejected; one of each group of near copies stays, and all blank rows
    components, roots = fx.near_components(rows)
    blank = [i for (i, t), root in zip(rows, roots) if root is None]
    left = {root: None for root in roots if root is not None}
    assert sum(not (r.text or "").strip() for r in out) >= len(blank) and len(blank) < len(out) <= len(blank) + len(left)
    assert all(r.round_trip for r in out) and {r.doc_id for r in out} <= {i for i, _ in rows}
    for name, schema in (("documents", fx.SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
