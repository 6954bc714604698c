"""Stored tables (Parquet) and exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.operators.clauses import default_type
from clauseloom.operators.scan import Run, dense_chunk, ordered_concat, scan

TABLES = ("tasks", "task_logs", "sections", "clauses")
BUCKETS = 64
#: Bits of the map of deleted tasks, 8 MiB in all. More tasks let more rows through to the join; nothing is lost.
MAP_BITS = 1 << 26

# Headers of the exported clause matrix and the suffix of its name.
MATRIX_HEADERS = ["层级关系", "章节标题", "章节概述", "条款ID", "条款内容", "页码", "条款类型", "结构化信息"]
MATRIX_SUFFIX = "_需求矩阵"
MATRIX_COLUMNS = ["label", "title", "summary", "clause_id", "clause_text", "page", "clause_type", "structured"]


def task_bucket(task: str | Column = "task_id", buckets: int = BUCKETS) -> Column:
    """Folder number of a task: a few folders however many tasks there are."""
    return F.pmod(F.xxhash64(task), F.lit(buckets)).cast("int").alias("bucket")


def append_rows(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append to a table foldered by task bucket.

    A rebalance on the bucket lets adaptive execution split a bucket that holds
    a very large task over several tasks and files.
    """
    (df.withColumn("bucket", task_bucket("task_id", buckets)).hint("rebalance", "bucket")
     .write.mode("append").partitionBy("bucket").parquet(path))


def read_task(spark, path: str, task_id: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of one task, read from its folder only."""
    folder = task_bucket(F.lit(task_id), buckets)
    return spark.read.parquet(path).filter((F.col("bucket") == folder) & (F.col("task_id") == task_id)).drop("bucket")


def positions_json(positions: Column | str = "positions") -> Column:
    """Positions as a JSON list of 5-number lists; null without positions."""
    arr = F.transform(positions, lambda p: F.array(p["page_idx"].cast("double"), p["x0"], p["y0"], p["x1"], p["y1"]))
    return F.when(F.coalesce(F.size(positions), F.lit(0)) > 0, F.to_json(arr))


def section_rows(sections: DataFrame) -> DataFrame:
    return sections.withColumn("positions_json", positions_json()).drop("positions")


def append_sections(sections: DataFrame, path: str) -> None:
    append_rows(section_rows(sections), path)


def clause_rows(clauses: DataFrame) -> DataFrame:
    return default_type(clauses).withColumn("positions_json", positions_json()).drop("positions")


def append_clauses(clauses: DataFrame, path: str) -> None:
    append_rows(clause_rows(clauses), path)


def without_tasks(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a table that do not belong to the given tasks."""
    return table.join(ids.select("task_id").distinct(), "task_id", "left_anti")


def delete_tasks(spark, base: str, ids: DataFrame, target: str) -> dict[str, str]:
    """Rewrite the four tables without the tasks into ``target``; the caller swaps the folders."""
    out = {}
    for name in TABLES:
        out[name] = f"{target}/{name}"
        append_rows(without_tasks(spark.read.parquet(f"{base}/{name}").drop("bucket"), ids), out[name])
    return out


def _maybe_among(ids: DataFrame) -> Callable[[Column], Column]:
    """A test whether a task may be one of ``ids``: exact where it says no. The bit map has a fixed size, whatever the number of tasks."""
    place = F.xxhash64("task_id").bitwiseAND(MAP_BITS - 1)
    words = ids.select(F.shiftright(place, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(31).cast("int")).alias("m")).groupBy(
        "w").agg(F.bit_or("m").alias("m")).toArrow()
    marks = np.zeros(MAP_BITS >> 5, np.uint32)
    marks[words["w"].to_numpy()] = words["m"].to_numpy()
    known = ids.sparkSession.sparkContext.broadcast(marks)

    @F.pandas_udf("boolean")
    def marked(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy() & (MAP_BITS - 1)
        return pd.Series((known.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool))

    return lambda task: marked(F.xxhash64(task))


def delete_tasks_in_place(spark, base: str, ids: DataFrame, names: Sequence[str] = TABLES, buckets: int = BUCKETS) -> list[int]:
    """Delete the tasks' rows from the stored tables under ``base``; returns the buckets that were touched.

    Only folders of the tasks' buckets are read and written again, others keep their files. Rows of tasks that a bit map rules out are
    written as they are read; only the others meet the tasks in a join. What stays is written once, into a hidden folder of the table,
    and its folders replace the touched ones one by one.
    """
    # As many numbers as there are buckets, at most.
    touched = sorted(r[0] for r in ids.select(task_bucket("task_id", buckets)).distinct().collect())
    if not touched:
        return []
    maybe = _maybe_among(ids)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in names:
        path = f"{base}/{name}"
        staged = f"{path}/_delete-{uuid.uuid4().hex}"
        stored = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).withColumn("_maybe", F.coalesce(maybe(F.col("task_id")), F.lit(False)))
        kept = stored.filter(~F.col("_maybe")).drop("_maybe")
        open_ = without_tasks(stored.filter("_maybe").drop("_maybe"), ids).select(*kept.columns).hint("rebalance", "bucket")
        kept.union(open_).write.partitionBy("bucket").parquet(staged)
        for bucket in touched:
            old, new = (jvm.org.apache.hadoop.fs.Path(f"{at}/bucket={bucket}") for at in (path, staged))
            files = old.getFileSystem(conf)
            files.delete(old, True)
            if files.exists(new) and not files.rename(new, old):
                raise OSError(f"{new} could not be moved to {old}")
        files.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
    return touched


def matrix_name(doc_name: str | Column) -> Column:
    """Export name of a document: without ``.pdf``, with the matrix suffix."""
    return F.concat(F.regexp_replace(doc_name, r"(?i)\.pdf$", ""), F.lit(MATRIX_SUFFIX))


def write_matrix(matrix: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write export rows under the user headers, in document and preorder order across the files."""
    named = matrix.repartitionByRange("doc_id", "node_idx", "clause_id").sortWithinPartitions("doc_id", "node_idx", "clause_id")
    out = named.select("doc_id", *[F.col(c).alias(h) for c, h in zip(MATRIX_COLUMNS, MATRIX_HEADERS)])
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def tree_json(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """One nested JSON tree per document.

    In preorder every node knows from its successor's level which brackets it
    opens or closes, so the tree is one ordered concatenation at any depth.
    """
    fields = [c for c in ("node_id", "title", "start_index", "end_index", "summary", "original_text") if c in nodes.columns]
    ahead = scan(nodes, ["doc_id"], ["node_idx"], [Run("_next", "lead", F.col("level"))], dense_chunk("node_idx", rows))
    own = F.to_json(F.struct(*fields))
    closing = F.concat(F.lit("}"), F.repeat(F.lit("]}"), (F.col("level") - F.coalesce("_next", F.lit(1))).cast("int")),
                       F.when(F.col("_next").isNotNull(), ",").otherwise(""))
    piece = F.concat(own.substr(F.lit(1), F.length(own) - 1),
                     F.when(F.col("_next") > F.col("level"), ',"nodes":[').otherwise(closing))
    trees = ordered_concat(ahead, ["doc_id"], ["node_idx"], piece, "", "_j", dense_chunk("node_idx", rows))
    return trees.select("doc_id", F.concat(F.lit('{"structure":['), "_j", F.lit("]}")).alias("json"))


def write_tree_json(nodes: DataFrame, path: str) -> None:
    tree_json(nodes).write.mode("overwrite").json(path)
