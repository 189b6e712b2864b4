"""The corpus pipeline: five operators over ``documents``, each stage's result written as Parquet and read by the next."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaweave.llm.decontamination import keep_uncontaminated
from chromaweave.llm.jaccard_join import keep_first_of_component
from chromaweave.llm.lineage import shared_table
from chromaweave.llm.pieces import encode_pieces
from chromaweave.llm.quality import fit_quality, keep_good
from chromaweave.llm.session import for_long_texts
from chromaweave.llm.suffix_dedup import cut_repeated_bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier fitted on ``labels.quality`` does not reject, with all their columns.

    Null and empty texts are scored as one passage without words; repeated rows are judged each, alike; without labels
    all documents stay; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return keep_good(docs, fit_quality(docs, labels), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id (null last) of each group of near duplicates: five-word shingles, similarity 0.75 or
    more. Null and blank texts are in no group and all stay; of equal rows one does."""
    return keep_first_of_component(docs, width=5, percent=75)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, texts without the 50-byte strings that also start in a document of smaller doc_id (null last), and
    without what a cut leaves of a character. Null texts stay null; shorter ones stay whole."""
    return cut_repeated_bytes(docs, length=50)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of which is in 13-word windows of ``benchmark``. Null and empty texts stay, and so does
    everything with an empty benchmark; repeated rows are judged each, alike."""
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, one_in=20)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's text and the ids of its three best segmentations, with scores, and digests of ids and of the text
    decoded from the best. Null and empty texts have no ids."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), n_best=3, with_ids=True, with_text=True)


def _tuned(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for_long_texts(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(stage.__name__, _tuned(stage)) for stage in (quality, near_duplicates, repeated_strings, decontamination, pieces)]

#: SQL cannot express the first stage; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
