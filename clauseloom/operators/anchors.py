"""Where texts hold a needle, by an equi join on hashes of short anchors.

A needle is looked up by one substring, its anchor. Which hashes are looked up at all is known as a bit map of fixed size; the texts
are hashed at every place while they are scanned, and only places whose bit is set become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Anchor sizes, powers of two; a needle takes the largest that fits into it.
ANCHOR_SIZES = (16, 8, 4, 2, 1)
#: Bits of the map, one MiB in all. More anchors set more bits, which lets more places through to the join; nothing is lost.
BITS = 1 << 23
#: Found places to an output batch, about.
ROWS = 1 << 15


def _hashed(text: str, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size the hashes of the substrings at all places: windows of doubled length come from pairs of shorter ones."""
    windows = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    found, size, base = {}, 1, 0x9E3779B97F4A7C15
    while sizes and size <= max(sizes):
        if size in sizes:
            mixed = windows * np.uint64(0xD6E8FEB86659FD93)
            found[size] = (mixed ^ mixed >> np.uint64(32)).view(np.int64)
        if len(windows) <= size:
            break
        windows = windows[:-size] * np.uint64(base) + windows[size:]
        base = base * base % (1 << 64)
        size *= 2
    return found


def anchor_size(text: Column) -> Column:
    out = F.lit(None).cast("int")
    for size in sorted(ANCHOR_SIZES):
        out = F.when(F.length(text) >= size, F.lit(size)).otherwise(out)
    return out


def _options(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The substrings at a needle's start, thirds and end: (keys, size, at, anchor)."""
    for batch in batches:
        take, sizes, ats, anchors = [], [], [], []
        for row, needle in enumerate(batch.column("needle").to_pylist()):
            size = next(s for s in ANCHOR_SIZES if s <= len(needle))
            room = len(needle) - size
            hashes = _hashed(needle, [size])[size]
            for at in sorted({0, room // 3, 2 * room // 3, room}):
                take.append(row)
                sizes.append(size)
                ats.append(at)
                anchors.append(int(hashes[at]))
        kept = batch.select([n for n in batch.schema.names if n != "needle"]).take(pa.array(take, pa.int64()))
        yield pa.record_batch([*kept.columns, pa.array(sizes, pa.int32()), pa.array(ats, pa.int32()), pa.array(anchors, pa.int64())],
                              [*kept.schema.names, "_size", "_at", "_anchor"])


def needle_anchors(needles: DataFrame, scope: list[str], name: str = "_needle") -> DataFrame:
    """(scope, name, _size, _at, _anchor): for each distinct (scope, name) the anchor that fewest needles offer, and its place.

    ``needles`` has the scope, the key ``name`` and the text ``needle``; empty needles have no anchor.
    """
    types = dict(needles.dtypes)
    keys = [*scope, name]
    distinct = needles.filter(F.length("needle") > 0).dropDuplicates(keys).select(*keys, "needle")
    ddl = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", _size int, _at int, _anchor long"
    options = distinct.mapInArrow(_options, ddl)
    offered = options.groupBy(*scope, "_size", "_anchor").agg(F.count(F.lit(1)).alias("_n"))
    best = options.join(offered, [*scope, "_size", "_anchor"]).groupBy(*keys).agg(
        F.min_by(F.struct("_size", "_at", "_anchor"), F.struct("_n", "_anchor", "_at")).alias("_a"))
    return best.select(*keys, "_a.*")


def anchor_places(texts: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _size, _anchor, _place): the places, from 0, of column ``hay`` whose hash may be one of ``anchors``.

    Asks for the bit map and the sizes in use when called: at most BITS / 64 numbers whatever the number of anchors.
    """
    bit = F.col("_anchor").bitwiseAND(BITS - 1)
    words = anchors.groupBy((F.shiftright(bit, 6)).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits"))
    table = np.zeros(BITS // 64, np.int64)
    for word, bits in words.collect():
        table[word] = bits
    sizes = sorted(r[0] for r in anchors.select("_size").distinct().collect())
    known = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(keys)
            waiting, rows = [], 0

            def found() -> pa.RecordBatch:
                row, size, anchor, place = (np.concatenate(c) for c in zip(*waiting))
                return pa.record_batch([*kept.take(pa.array(row)).columns, pa.array(size), pa.array(anchor), pa.array(place)],
                                       [*keys, "_size", "_anchor", "_place"])

            for at, text in enumerate(batch.column("hay")):
                for size, hashes in _hashed(text.as_py() or "", sizes).items():
                    spot = hashes & (BITS - 1)
                    place = np.flatnonzero(known.value[spot >> 6] >> (spot & 63) & 1)
                    if len(place):
                        waiting.append((np.full(len(place), at), np.full(len(place), size, np.int32), hashes[place], place))
                        rows += len(place)
                if rows >= ROWS:
                    yield found()
                    waiting, rows = [], 0
            if waiting:
                yield found()

    types = dict(texts.dtypes)
    return texts.select(*keys, "hay").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", _size int, _anchor long, _place long")
