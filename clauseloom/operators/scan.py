"""Ordered scans that survive a hot key.

A plain window over ``partitionBy(doc_id)`` sends a whole document to one task.
Here each key is cut into chunks of consecutive rows: a window runs inside each
chunk, one summary row per chunk is scanned over the key, and its result (the
carry) is joined back on key and chunk. Sum, max, "last known value" and "next
known value" all combine this way, and lead, lag and row_number follow from
them. The rows that meet in one task are a chunk, or the summaries of a key
(one row per ``CHUNK_ROWS`` rows).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.session import materialize

CHUNK_ROWS = 1 << 16

_FORWARD = ("sum", "max", "last", "lag")
_BACKWARD = ("first", "lead", "suffix_sum")


@dataclass(frozen=True)
class Run:
    """One output of a scan.

    ``kind``: ``sum``/``max``/``last`` look back, ``suffix_sum``/``first`` look
    ahead; ``last`` and ``first`` skip nulls; ``lag``/``lead`` are the direct
    neighbour, nulls included. ``inclusive`` counts the row itself.
    """

    name: str
    kind: str
    value: Column
    inclusive: bool = True


#: Most chunks of a key that ``with_adaptive_chunk`` splits.
PIECES = 256


def dense_chunk(ordinal: str | Column, rows: int | None = None) -> Column:
    """Chunk number of a dense 0-based ordinal such as a block or node index."""
    col = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor(col / F.lit(float(rows or CHUNK_ROWS))).cast("long")


def with_adaptive_chunk(df: DataFrame, keys: Sequence[str], position: Column, name: str,
                        rows: int | None = None) -> DataFrame:
    """Add a chunk number that never decreases with a numeric ``position`` of any spread.

    Only keys above ``rows`` rows are split, at quantiles of their own positions, so that outliers don't leave all other rows in
    one chunk. Rows of one position stay together.
    """
    rows = rows or CHUNK_ROWS
    keys = list(keys)
    with_pos = df.withColumn("_pos", position.cast("long"))
    hot = with_pos.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    shares = [i / PIECES for i in range(1, PIECES)]
    cuts = with_pos.join(hot, keys).groupBy(*keys).agg(F.percentile_approx("_pos", shares, 20 * PIECES).alias("_cuts"), F.max("_n").alias("_n"))
    stride = F.ceil(PIECES / F.least(F.lit(PIECES), F.ceil(F.col("_n") / F.lit(float(rows)))))
    place = F.size(F.filter("_cuts", lambda c: c < F.col("_pos")))
    return (with_pos.join(cuts, keys, "left")
            .withColumn(name, F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.floor(place / stride)).cast("long"))
            .drop("_pos", "_n", "_cuts"))


def with_range_chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, purpose: str) -> DataFrame:
    """Add a chunk number that never decreases along ``order`` within a key, for any values, spread and number of rows.

    Rows are dealt by ranges of (keys, order), so chunks are of equal size whatever the keys; their number is the session's number
    of shuffle partitions. The dealt table is stored, as ranges are sampled and may differ when they are computed again.
    """
    return materialize(df.repartitionByRange(*keys, *order).withColumn(name, F.spark_partition_id()), purpose)


def _neighbour(kind: str) -> bool:
    return kind in ("lag", "lead")


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], runs: Sequence[Run],
         chunk: Column | str) -> DataFrame:
    """``df`` plus one column per run. ``order`` must be ascending and ``chunk`` must not decrease along it."""
    keys, order = list(keys), list(order)
    chunk_col = F.col(chunk) if isinstance(chunk, str) else chunk
    base = df.withColumn("_chunk", chunk_col)
    for r in runs:
        value = F.struct(r.value.alias("v")) if _neighbour(r.kind) else r.value
        base = base.withColumn(f"_v_{r.name}", value)

    # A frame that ends with the last row is evaluated anew for every row: what looks ahead runs over the reversed order instead.
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    inside_back = Window.partitionBy(*keys, "_chunk").orderBy(*[F.desc(c) for c in order])
    across = Window.partitionBy(*keys).orderBy("_chunk")
    across_back = Window.partitionBy(*keys).orderBy(F.desc("_chunk"))
    at = F.struct(*order)

    summaries, carries = [], []
    for r in runs:
        v = F.col(f"_v_{r.name}")
        summary, carry = f"_s_{r.name}", f"_c_{r.name}"
        known = F.when(v.isNotNull(), at)
        past = across.rowsBetween(Window.unboundedPreceding, -1)
        ahead = across_back.rowsBetween(Window.unboundedPreceding, -1)
        if r.kind in ("sum", "suffix_sum"):
            summaries.append(F.sum(v).alias(summary))
            carries.append(F.sum(summary).over(past if r.kind == "sum" else ahead).alias(carry))
        elif r.kind == "max":
            summaries.append(F.max(v).alias(summary))
            carries.append(F.max(summary).over(past).alias(carry))
        elif r.kind in ("last", "lag"):
            summaries.append(F.max_by(v, known).alias(summary))
            carries.append(F.last(summary, ignorenulls=True).over(past).alias(carry))
        elif r.kind in ("first", "lead"):
            summaries.append(F.min_by(v, known).alias(summary))
            carries.append(F.last(summary, ignorenulls=True).over(ahead).alias(carry))
        else:
            raise ValueError(f"unknown scan kind {r.kind}")
    needed = keys + order + ["_chunk"] + [f"_v_{r.name}" for r in runs]
    carry_rows = (base.select(*dict.fromkeys(needed)).groupBy(*keys, "_chunk").agg(*summaries)
                  .select(*keys, "_chunk", *carries))

    out = base
    for r in runs:
        v = F.col(f"_v_{r.name}")
        step = 0 if r.inclusive else 1
        frame = (inside if r.kind in _FORWARD else inside_back).rowsBetween(Window.unboundedPreceding, -step)
        if r.kind in ("sum", "suffix_sum"):
            local = F.sum(v).over(frame)
        elif r.kind == "max":
            local = F.max(v).over(frame)
        elif r.kind == "lag":
            local = F.lag(v).over(inside)
        elif r.kind == "lead":
            local = F.lead(v).over(inside)
        else:
            local = F.last(v, ignorenulls=True).over(frame)
        out = out.withColumn(f"_l_{r.name}", local)
    out = out.join(carry_rows, keys + ["_chunk"], "left")
    result = []
    for r in runs:
        local, carry = F.col(f"_l_{r.name}"), F.col(f"_c_{r.name}")
        if r.kind in ("sum", "suffix_sum"):
            value = F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif r.kind == "max":
            value = F.greatest(local, carry)
        else:
            value = F.coalesce(local, carry)
            if _neighbour(r.kind):
                value = value["v"]
        result.append(value.alias(r.name))
    names = {r.name for r in runs}
    return out.select(*[c for c in df.columns if c not in names], *result)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
            chunk: Column | str) -> DataFrame:
    """1-based row number within the keys."""
    return scan(df, keys, order, [Run(name, "sum", F.lit(1).cast("long"))], chunk)


def ordered_concat(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: Column, sep: str,
                   name: str, chunk: Column | str) -> DataFrame:
    """One string per key: the non-null texts in order, built per chunk first and then over the chunks."""
    chunk_col = F.col(chunk) if isinstance(chunk, str) else chunk
    # Nulls are left out while collecting: a filter on the text would be pushed down and compute it twice.
    row = F.when(F.col("_t").isNotNull(), F.struct(*order, "_t"))
    parts = (df.withColumn("_t", text).withColumn("_chunk", chunk_col)
             .groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(row)).alias("_p")).filter(F.size("_p") > 0)
             .withColumn("_p", F.array_join(F.transform("_p", lambda p: p["_t"]), sep)))
    return (parts.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("_chunk", "_p"))).alias("_p"))
            .select(*keys, F.array_join(F.transform("_p", lambda p: p["_p"]), sep).alias(name)))
