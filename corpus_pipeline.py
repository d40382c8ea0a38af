"""The corpus pipeline: language ID, quality, exact duplicates, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return all columns that they got, those of documents. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.llm import exact_dedup, language_id, near_dedup, packing, quality
from pipeloom.llm.common import crc_mod, fresh, shared_dir, table
from pipeloom.llm.vocab import default_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _added(docs: DataFrame, name: str) -> Column:
    """The column that an operator adds to those of docs under this name."""
    return F.col(fresh(name, docs.columns))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; null texts and texts without letters go, and those far from all centroids."""
    model = language_id.fit(docs.where(crc_mod("doc_id", 3) != 1))
    return language_id.identify(docs, model, carry=True).where(~_added(docs, "rejected")).select(docs.columns)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, learned from their labels, scores at 0.3 or more."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    scored = quality.score(docs, quality.fit(docs, labels), threshold=0.3, carry=True)
    return scored.where(_added(docs, "predicted") == 1).select(docs.columns)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts (the longest original, then the smallest id)."""
    return exact_dedup.exact_groups(docs, carry=True).where(_added(docs, "kept")).select(docs.columns)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates; documents without id stay."""
    gone = near_dedup.near_duplicates(docs, percent=75).where("not kept and doc_id is not null").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents."""
    pieces = packing.pack(docs, default_path("word_bpe_49k.json"), size=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", stage_language),
    ("quality", stage_quality),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("packing", stage_packing),
]

#: Language, quality and packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
