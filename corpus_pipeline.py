"""Corpus pipeline: quality, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``docs``; each works on all rows its predecessor kept. A row is named by its place in
the stage's input, so decisions hold for rows, not for ids: rows that share a doc_id, or have
none, are documents of their own. Of equal or near equal texts exactly one row stays; a document
that the mix takes twice is there twice, and has its ids twice.

Defined cases: null texts count as empty; columns beside those of ``documents`` are carried
along, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featureflow.llm.bpe import bpe_encode
from featureflow.llm.common import located, read, ship, stored
from featureflow.llm.exact_dedup import exact_dedup
from featureflow.llm.mixing import mixed_documents
from featureflow.llm.near_dup import near_classes
from featureflow.llm.quality import keep_good


def _keeping(docs: DataFrame, decided: DataFrame, names: list, name: str) -> DataFrame:
    """Rows of ``docs`` that ``decided`` keeps, found by their names (w_file, w_pos)."""
    kept = stored(decided.where("kept").select("w_file", "w_pos"), name)
    # Merged at every size: names grow with the documents, so a broadcast that happens to fit is no plan.
    return docs.join(kept.hint("merge"), (names[0] == kept["w_file"]) & (names[1] == kept["w_pos"]), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    return keep_good(docs, read(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id stays."""
    ship(spark)
    docs, names = located(docs)
    return _keeping(docs, exact_dedup(docs, names=names), names, "exact-kept")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest doc_id stays."""
    ship(spark)
    docs, names = located(docs)
    return _keeping(docs, near_classes(docs, names), names, "near-kept")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, once for each pass."""
    ship(spark)
    return mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    ship(spark)
    return bpe_encode(docs, digests_only=True)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
