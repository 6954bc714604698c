"""The corpus pipeline: quality, line dedup, near-dedup, mixing and encoding of the documents, each stage stored as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import bpe, cotrain, linededup, mixing, nearcopies
from clauseloom.llm.common import free_name, table
from clauseloom.session import materialize, small_batches

#: Rows under this chance of good quality go.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the co-trained classifier takes for good, learned from the labels among these documents."""
    return cotrain.good_documents(docs, cotrain.fit(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that repeat a line kept elsewhere. A text that loses all its lines is empty."""
    with small_batches(spark):
        return linededup.without_duplicate_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by a five-word Jaccard similarity of 0.8 or more: the one with the smallest doc_id.

    Rows are told apart by a number of their own, so doc_ids may be null or repeat. Rows without a doc_id stay only if no row of
    their group has one; of rows with the same smallest doc_id the first stays.
    """
    number, group = free_name("_row", docs.columns), free_name("_group", docs.columns)
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "near-duplicates-rows")
    with small_batches(spark):
        groups = materialize(nearcopies.near_copies(numbered.select(F.col(number).alias("doc_id"), "text")).select(
            F.col("doc_id").alias(number), F.col("component_id").alias(group)), "near-duplicates")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col(number).alias("row"))
    stay = materialize(numbered.select(number, "doc_id").join(groups, number).groupBy(group).agg(F.min(order).alias("at")).select(
        F.col("at.row").alias(number)), "near-duplicates-stay")
    return numbered.join(stay, number, "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them: never, once or twice."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit numbers) and the text that they decode to."""
    coded = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("mixing", mix), ("bpe", encode)]
#: Classifier, near-duplicates and encoding are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
