"""Nearest rows of a smaller level, and what is open above a row, for any depth and any size of a key.

A row of some level closes all open rows of its level or deeper ones and is open itself from then on. Rows of a key are cut into
chunks. What a chunk leaves open are its suffix minima, found by a window inside the chunk. A fold over these few rows per key tells
what is open where each chunk begins, and a second pass over the rows keeps the stack and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OWN = ("_level", "_value", "_side", "_at")


def _close(levels: list, values: list, level: int) -> None:
    """Take off the stack all rows of this level or deeper."""
    while levels and levels[-1] >= level:
        levels.pop()
        values.pop()


def _carried() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fold of one key's chunk ends, in order: (keys, chunk, level, value) of what is open where each chunk but the first begins."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk, levels, values, lowest, waiting = None, None, [], [], None, []

        def close_chunk():
            # What was open before stays open if nothing in the chunk was as low; the chunk's own ends come on top.
            _close(levels, values, lowest)
            levels.extend(level for level, _ in waiting)
            values.extend(value for _, value in waiting)

        for batch in batches:
            out = []
            for *at, number, low, level, value in zip(*(c.to_pylist() for c in batch.columns)):
                if at != key:
                    key, chunk, levels, values, waiting = at, number, [], [], []
                elif number != chunk:
                    close_chunk()
                    chunk, waiting = number, []
                    out.extend((*key, number, lv, v) for lv, v in zip(levels, values))
                lowest = low
                waiting.append((level, value))
            columns = list(zip(*out)) or [[] for _ in batch.schema.names if _ != "low"]
            names = [n for n in batch.schema.names if n != "low"]
            yield pa.record_batch([pa.array(c, batch.schema.field(n).type) for c, n in zip(columns, names)], names)

    return fold


def _stacked(keys: int, equal: bool, whole: bool):
    """The pass over the rows of a chunk; rows of side 0 are those that are open where it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, levels, values = None, [], []
        for batch in batches:
            names = batch.schema.names
            own = [batch.column(names.index(n)).to_pylist() for n in _OWN[:3]]
            keyed = zip(*(batch.column(i).to_pylist() for i in range(keys)))
            out = []
            for at, level, value, side in zip(keyed, *own):
                if at != key:
                    key, levels, values = at, [], []
                if side:
                    # Levels are whole numbers: what is not deeper than this level is left by closing the next one.
                    _close(levels, values, level + equal)
                    out.append(list(values) if whole else values[-1] if values else None)
                _close(levels, values, level)
                levels.append(level)
                values.append(value)
            kept = batch.filter(pa.array([bool(s) for s in own[2]]))
            kind = batch.schema.field("_value").type
            found = pa.array(out, pa.list_(kind) if whole else kind)
            keep = [n for n in names if n not in _OWN]
            yield pa.record_batch([*(kept.column(names.index(n)) for n in keep), found], [*keep, "_found"])

    return run


def above(df: DataFrame, keys: Sequence[str], order: str, level: str, value: Column, name: str, chunk: Column,
          later: bool = False, equal: bool = False, whole: bool = False) -> DataFrame:
    """``df`` plus ``name``: ``value`` of the nearest row before with a smaller level, null if there is none.

    ``later`` looks at the rows behind instead, ``equal`` lets a row of the same level count, and ``whole`` gives the values of all
    rows that are open at the row, outermost first, as an array: the ancestors, if rows are a tree in preorder. Levels are positive and may
    leave gaps; a row without a level has level 1. ``chunk`` must not decrease along ``order``, and ``order`` must be numeric.
    """
    keys = list(keys)
    sign = -1 if later else 1
    rows = df.withColumns({"_level": F.coalesce(F.col(level).cast("long"), F.lit(1)), "_value": value, "_side": F.lit(1),
                           "_at": F.col(order).cast("long") * sign, "_part": chunk.cast("long") * sign})
    narrow = rows.select(*keys, "_part", "_at", "_level", "_value")
    split = narrow.groupBy(*keys).agg(F.min("_part").alias("_a"), F.max("_part").alias("_b")).filter("_a < _b").select(*keys)
    # The rows behind, in reversed order: a frame up to the last row would be evaluated anew for every row.
    back = Window.partitionBy(*keys, "_part").orderBy(F.desc("_at"))
    behind = F.min("_level").over(back.rowsBetween(Window.unboundedPreceding, -1))
    stays = F.col("_behind").isNull() | (F.col("_level") < F.col("_behind"))
    # The lowest level of the chunk goes with every row, so that the fold needs no more than the ends.
    ends = (narrow.join(split, keys, "left_semi").withColumn("_behind", behind).filter(stays)
            .withColumn("low", F.min("_level").over(Window.partitionBy(*keys, "_part"))))
    folded = ends.select(*keys, "_part", "low", "_level", "_value", "_at").repartition(*keys).sortWithinPartitions(*keys, "_part", "_at").drop("_at")
    types = dict(rows.dtypes)
    carried = folded.mapInArrow(_carried(), ", ".join(f"`{c}` {types[c]}" for c in (*keys, "_part", "_level", "_value")))
    # Open rows stand before the first row of the chunk, by level.
    carried = carried.withColumn("_side", F.lit(0)).withColumn("_at", F.col("_level"))
    first = [*keys, "_part"]
    dealt = rows.select(*first, *(c for c in rows.columns if c not in first)).unionByName(carried, allowMissingColumns=True)
    passed = dealt.repartition(*first).sortWithinPartitions(*first, "_side", "_at")
    kept = [c for c in dealt.columns if c not in _OWN]
    found = f"array<{types['_value']}>" if whole else types["_value"]
    ddl = ", ".join(f"`{c}` {types[c]}" for c in kept) + f", _found {found}"
    return passed.mapInArrow(_stacked(len(first), equal, whole), ddl).withColumnRenamed("_found", name).select(
        *(c for c in df.columns if c != name), name)
