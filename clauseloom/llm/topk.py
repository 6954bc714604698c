"""Exact top-k inner products by three-phase uniform thresholds over vertical segments of the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.session import materialize

#: Segments of the components, each with score lists of its own, and the most vectors of a data block and of a query block.
SEGMENTS, DATA_BLOCK, QUERY_BLOCK = 2, 4096, 1024
SCALE = 1024


def whole_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for vectors without null, NaN or infinite components."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return table.where(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _ranked(rows: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key; tasks keep that many each before the shuffle, so a frequent key stays small."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= most)


def _blocks(rows: int, most: int) -> int:
    return max(1, -(-rows // most))


def _segment_blocks(vectors: DataFrame, role: str, own: int, other: int, segments: int) -> DataFrame:
    """Rows (seg, data, query, id, part): each vector's part of each segment, once per block of the other side it meets.

    A query block and a data block meet once per segment; both are bounded, so a task holds a bounded number of vectors. This is the
    work of a stated query set against all rows, in blocks.
    """
    block = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
    mine, yours = ("data", "query") if role == "data" else ("query", "data")
    width = F.ceil(F.size("v") / segments).cast("int")
    return vectors.withColumn(mine, block).withColumn(yours, F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).withColumn(
        "seg", F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))).select(
        "seg", "data", "query", "id", F.slice("v", F.col("seg") * width + 1, width).alias("part"), *(["cut"] if "cut" in vectors.columns else []))


def _scores(queries: pd.DataFrame, data: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    if not len(queries) or not len(data) or not len(queries["part"].iloc[0]):
        return None
    q, d = np.stack(queries["part"].to_numpy()).astype(np.float64), np.stack(data["part"].to_numpy()).astype(np.float64)
    return queries["id"].to_numpy(), data["id"].to_numpy(), q @ d.T  # whole numbers below 2**53: exact


def top_k(vectors: DataFrame, query_ids: Column, k: int = 10, segments: int = SEGMENTS, data_block: int = DATA_BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query with all other rows of ``vectors`` (vec_id, v).

    ``query_ids`` selects the query rows; a row is no candidate for itself; ties go to the smaller vec_id; fewer candidates give
    fewer rows. Vectors of another length than most, or empty, take no part. Repeated rows are one. Empty tables give empty tables.

    A score is the sum of ``segments`` partial scores. First, every segment and block gives its best partial scores of each query,
    and the k-th best full score among those vectors is a safe cutoff: no result is below it. Second, each segment gives every
    vector whose partial score reaches cutoff / segments; a vector that is below everywhere cannot reach the cutoff. Last, the
    vectors found are scored in full. Equal vectors are scored once: of each, only the k + 1 smallest ids can be in any result.
    """
    usual = vectors.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    vectors = vectors.where(F.size("v") == (usual["n"] if usual else 0)).dropDuplicates(["vec_id"])
    vectors = materialize(vectors, "topk-vectors")
    copies = materialize(_ranked(vectors, ["v"], [F.col("vec_id")], k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
                         "topk-copies")
    data = materialize(copies.withColumn("id", F.element_at("ids", 1)), "topk-data")
    asked = vectors.where(query_ids)
    # A query is asked once for all its equal rows; its name is the smallest id that bears the vector.
    names = materialize(asked.join(data.select("v", "id"), "v").select("vec_id", "id"), "topk-names")
    queries = materialize(data.join(names.select("id").distinct(), "id", "left_semi").select("id", "v"), "topk-queries")
    blocks, asks = _blocks(data.count(), data_block), _blocks(queries.count(), query_block)
    key = ["seg", "data", "query"]

    def best(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found = _scores(queries, data)
        if found is None:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64")})
        q, d, s = found
        n = min(k + 1, len(d))
        at = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(d) else np.tile(np.arange(len(d)), (len(q), 1))
        return pd.DataFrame({"q": np.repeat(q, n), "id": d[at].ravel()})

    def reach(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found = _scores(queries, data)
        if found is None:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64")})
        q, d, s = found
        i, j = np.nonzero(s * segments >= queries["cut"].to_numpy(np.float64)[:, None])
        return pd.DataFrame({"q": q[i], "id": d[j]})

    parts = _segment_blocks(data.select("id", "v"), "data", blocks, asks, segments)
    firsts = _segment_blocks(queries, "query", asks, blocks, segments)
    lists = firsts.groupBy(*key).cogroup(parts.groupBy(*key)).applyInPandas(best, "q long, id long")
    known = materialize(_full_scores(lists.distinct(), queries, data), "topk-first")
    # Equal rows count as often as they can be taken, a query's own row not at all.
    places = F.size("ids") - (F.col("q") == F.col("id")).cast("int")
    so_far = F.sum("places").over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    cutoff = known.withColumn("places", places).where("places > 0").withColumn("so_far", so_far).where(F.col("so_far") >= k).groupBy("q").agg(
        F.max("score").alias("cut"))
    limits = materialize(queries.join(cutoff.withColumnRenamed("q", "id"), "id", "left").withColumn(
        "cut", F.coalesce(F.col("cut").cast("double"), F.lit(float("-inf")))), "topk-cutoffs")
    seconds = _segment_blocks(limits, "query", asks, blocks, segments)
    entries = seconds.groupBy(*key).cogroup(parts.groupBy(*key)).applyInPandas(reach, "q long, id long")
    full = _full_scores(entries.distinct(), queries, data)
    kept = _ranked(full, ["q"], [F.desc("score"), F.col("id")], k + 1).select("q", "score", F.explode("ids").alias("vec_id"))
    answers = materialize(_ranked(kept, ["q"], [F.desc("score"), F.col("vec_id")], k + 1).select("q", "score", "vec_id"), "topk-answers")
    rows = names.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")).join(answers, "q").where("query_id <> vec_id")
    return _ranked(rows, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select(
        "query_id", F.col("_r").cast("int").alias("rank"), "vec_id", "score")


def _full_scores(pairs: DataFrame, queries: DataFrame, data: DataFrame) -> DataFrame:
    """(q, id, ids, score) with the whole inner product of each pair (q, id)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 5000):
                part = pdf.iloc[at:at + 5000]
                scores = np.einsum("ij,ij->i", np.stack(part["qv"].to_numpy()), np.stack(part["v"].to_numpy())) if len(part) else []
                yield pd.DataFrame({"q": part["q"], "id": part["id"], "ids": part["ids"], "score": scores})

    wide = pairs.join(data, "id").join(queries.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q").select("q", "id", "ids", "qv", "v")
    return wide.mapInPandas(run, "q long, id long, ids array<long>, score long")
