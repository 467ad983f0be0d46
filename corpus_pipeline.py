"""Corpus pipeline: toxicity, line dedup, near duplicates, substring dedup, packing.

Every stage takes all rows that the one before it kept, whole, and returns the
columns of ``documents`` (the last returns placed pieces).  ``run`` writes each
stage's rows as Parquet to the shared folder and rereads them for the next.

Null or repeated rows, empty and very long texts: each stage's operator defines
them.  Extra columns pass through all stages but the last, whatever their names.
``n_chars`` follows the text where a stage changes it.  Among near duplicates the
smallest id stays; rows with a null id stay, and repeated rows of that id all
stay.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborkit.llm import line_dedup, ngram_join, packing, substring_dedup, toxicity
from arborkit.llm.common import discard, materialize
from arborkit.llm.queries import MIN_SITES, vocabulary

#: Shingles of five words and a similarity of 0.8; windows of 35 words.
SHINGLE, PERCENT, WINDOW = 5, 80, 35


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Bring ``n_chars`` up to date where the table has it."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(line_dedup.remove_boilerplate_lines(docs, MIN_SITES), docs.columns)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_jaccard_components(docs, SHINGLE, PERCENT)
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(others, docs["doc_id"] == others["gone"], "left_anti")


def drop_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(substring_dedup.remove_repeated_windows(docs, WINDOW), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("n-gram Jaccard join", keep_one_near_duplicate),
    ("substring dedup", drop_repeated_windows),
    ("best-fit packing", pack_sequences),
]

#: Tokenising and a trained model are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
