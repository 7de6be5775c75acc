"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.

Rows may have nulls in any column, repeat, share ids, and have further columns of any names; tables may be empty. A null text
counts as empty: the quality classifier gives it weight 0, near-dedup keeps one text without words, substring dedup drops
it, decontamination keeps it, and packing gives it its end id. A null id is larger than any other; near-dedup keeps its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.decontaminate import clean
from quadrille.llm.packing import pack
from quadrille.llm.quality_classifier import selected
from quadrille.llm.simhash import without_near_duplicates
from quadrille.llm.storage import written
from quadrille.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling chooses."""
    return selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike to 0.8 or more in their five-word shingles the one with the smallest id."""
    return without_near_duplicates(docs, shingle=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without passages of 25 words or more that a document with a smaller id has. A document without words,
    from the start or then, goes. Twice op1's 13 words, since windows of 13 also repeat by chance (see the README)."""
    cut = without_repeats(docs, min_words=25)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where(r"text rlike '[^\\x20\\x09-\\x0D]'")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 ids."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: SQL can't express the fitted models, fingerprints or ids. The tests hold near-dedup and substring dedup against brute
#: force on whole tables, and the other stages' operators on small ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
