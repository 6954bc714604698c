"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.session import materialize

#: A word: a run of bytes that are none of the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same, several times faster, where a text has no other characters than ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or with underscores in front, so that it is none of the columns."""
    while name.lower() in [c.lower() for c in columns]:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], purpose: str) -> DataFrame:
    """``df`` with exclusive prefix sums ``sums`` in the global ``order``, for any distribution of keys.

    Rows are dealt by range, so equal pieces hold even if one key has most rows. The dealt table is stored, because the
    ranges are sampled and may differ when they are computed again. Only one total per piece meets in one task.
    """
    spark = df.sparkSession
    staged = materialize(
        df.withColumns(dict(sums)).repartitionByRange(partitions(spark), *order).withColumn("_piece", F.spark_partition_id()), purpose)
    totals = staged.groupBy("_piece").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_piece", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums))
    inside = Window.partitionBy("_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per piece, whatever the input: the number of pieces is a session setting.
    joined = staged.withColumns({f"_b_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).join(F.broadcast(offsets), "_piece")
    return joined.withColumns({c: F.col(f"_b_{c}") + F.col(f"_o_{c}") for c in sums}).select(
        *(c for c in df.columns if c not in sums), *sums)
