"""The corpus pipeline: quality, near-duplicates, decontamination, encoding.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ancestra.llm import bpe, decontam, quality, simhash
from ancestra.llm.common import fresh_path, remove_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts have no n-gram and are judged by that; a very long text is counted whole; repeated rows and ties with the
    last one accepted go or stay together. Without labels all stay; an empty table stays empty.
    """
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of texts whose sets of five-word shingles are similar to 0.8 or more; SimHashes find the candidates.

    Null and empty texts are one class; a very long text's shingles are compared whole. Of repeated rows one stays; rows without an id come last
    in their class, and a class of such rows keeps one. An empty table stays empty.
    """
    return simhash.keep_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark.

    Null and empty texts hold none; a very long one is searched whole; repeated rows each stay or go. Without benchmark items, or
    with none that has a word, all stay; an empty table stays empty.
    """
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left.

    A null text counts as empty: no token, and the digests of the empty string; a very long one is encoded whole. Null and repeated
    ids each give a row. An empty table gives none.
    """
    return bpe.encode_documents(docs, bpe.read_text(spark, bpe.default_path()))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: SQL expresses neither the hashed resampling nor BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are written below the shared folder and go once the next are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return docs
