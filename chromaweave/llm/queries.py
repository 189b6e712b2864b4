"""One query per corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaweave.llm.decontamination import decontaminate
from chromaweave.llm.jaccard_join import jaccard_components
from chromaweave.llm.language import fit_languages, identify_language
from chromaweave.llm.licences import KNOWN, scan_licences
from chromaweave.llm.licences import oracle_sql as licences_sql
from chromaweave.llm.manifest import FIELDS, leaf_digest, manifest
from chromaweave.llm.neighbours import nearest
from chromaweave.llm.pieces import encode_pieces
from chromaweave.llm.quality import fit_quality, score_quality
from chromaweave.llm.session import for_long_texts
from chromaweave.llm.substring_dedup import remove_repeated_words
from chromaweave.llm.suffix_dedup import remove_repeated_bytes
from chromaweave.llm.token_counts import token_counts
from chromaweave.llm.toxicity import fit_toxicity, score_toxicity
from chromaweave.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for_long_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def _fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n: fixes which rows a model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _held_out(n: int, remainder: int) -> Column:
    """Rows of that remainder; a null doc_id is none, and no label or language is learnt from it."""
    return F.coalesce(_fold(n) == remainder, F.lit(False)).alias("held_out")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=50)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(docs, fit_quality(docs, labels), threshold=0.3)
    return scored.select("doc_id", _held_out(5, 0), "score", "predicted")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents"), spark.createDataFrame(KNOWN, "license_id string, text string"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=5, percent=75)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify_language(docs, fit_languages(docs.where(_fold(4) != 2)))
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score", "rejected")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(_table(spark, sf_dir, "documents"), length=20)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n_best=3)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, one_in=20)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = leaf_digest(*[lowered if f == "text" else F.col(f) for f in FIELDS])
    return manifest(docs, F.when(_fold(3) == 0, found)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_fold(4) != 2).select("doc_id", F.col("toxic").alias("label"))
    scored = score_toxicity(docs, fit_toxicity(docs, labels), threshold=0.3)
    return scored.select("doc_id", _held_out(4, 2), "score", "predicted", "n_sentences", F.size("offending").cast("bigint").alias("n_offending"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_neighbours": op3_neighbours,
    "op4_quality": op4_quality,
    "op5_licences": op5_licences,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_language": op7_language,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_pieces": op9_pieces,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_whitening": op13_whitening,
}

#: DuckDB SQL of those queries that SQL can express.
ORACLES: dict[str, str] = {
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT both_ways.b, r.c FROM r JOIN both_ways ON both_ways.a = r.doc_id WHERE both_ways.b > r.c)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL
""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM x
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM n WHERE k > 1
), g AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id
), kept AS (SELECT doc_id, string_agg(w[j], ' ' ORDER BY j) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op2_suffix_dedup": """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)
), f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1
), hit AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > first
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS b FROM hit
), runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (b <> coalesce(p, -2) + 1) AS n_spans, list(b ORDER BY b) AS bs
  FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS p FROM gone) GROUP BY doc_id
), kept AS (SELECT doc_id, string_agg(substring(h, 2 * b + 1, 2), '' ORDER BY b) AS k
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS b FROM d SEMI JOIN runs USING (doc_id)) x ANTI JOIN gone USING (doc_id, b) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN runs.doc_id IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op5_licences": licences_sql(),
    "op10_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, len(k) AS n, array_to_string(k, ' ') AS k
  FROM (SELECT item_id, unnest(CASE WHEN len(w) >= 13 THEN [w[i : i + 12] FOR i IN range(1, len(w) - 11)] WHEN len(w) > 0 THEN [w] ELSE [] END) AS k FROM b)
), lengths AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, k)
), words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE c AS (SELECT *, list_reduce(list_concat([4294967295], flatten([[ord(substring(s, k, 1)), -1, -1, -1, -1, -1, -1, -1, -1] FOR k IN range(1, length(s) + 1)])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS r FROM (SELECT *, doc_id::VARCHAR AS s FROM documents)
), d AS (SELECT *, CASE WHEN xor(r, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS tampered FROM c
), f AS (SELECT *, concat(coalesce(strlen(s) || ':' || s, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM d
), l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS found FROM f
), placed AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l
), tree AS (SELECT g, 0 AS level, pos, leaf AS node, n FROM placed
  UNION ALL SELECT g, any_value(level) + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY g, pos // 8
), subs AS (SELECT g, node AS subroot, (SELECT count(DISTINCT g) FROM placed) AS n FROM tree WHERE tree.n = 1
), top AS (SELECT 0 AS level, g AS pos, subroot AS node, n FROM subs
  UNION ALL SELECT any_value(level) + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY pos // 8
), root AS (SELECT node AS root FROM top WHERE n = 1
), sib AS (SELECT a.g, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi
  FROM tree a JOIN tree b ON a.g = b.g AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
  UNION ALL SELECT NULL, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''), coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
  FROM top a JOIN top b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
), walk AS (SELECT g AS own, pos AS own_pos, g AS tree_of, 0 AS level, pos, n, found AS node, '' AS proof FROM placed
  UNION ALL SELECT own, own_pos, CASE WHEN w.n = 1 THEN NULL ELSE tree_of END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN own ELSE w.pos // 8 END,
    CASE WHEN w.n = 1 THEN (SELECT count(DISTINCT g) FROM placed) ELSE (w.n + 7) // 8 END, CASE WHEN w.n = 1 THEN w.node ELSE sha256(lo || w.node || hi) END, CASE WHEN w.n = 1 THEN proof ELSE proof || lo || hi END
  FROM walk w LEFT JOIN sib ON w.tree_of IS NOT DISTINCT FROM sib.g AND w.level = sib.level AND w.pos = sib.pos WHERE w.n > 1 OR w.tree_of IS NOT NULL)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM placed JOIN subs USING (g) CROSS JOIN root JOIN (SELECT own, own_pos, node, proof FROM walk WHERE tree_of IS NULL AND n = 1) ON own = placed.g AND own_pos = placed.pos
""",
}
