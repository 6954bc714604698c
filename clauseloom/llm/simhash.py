"""SimHash near-duplicates: fingerprints, a popcount grid that finds close ones, and their groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.components import components
from clauseloom.session import materialize

#: Seed of the shingle hash.
SEED = 42
_LANES = np.uint64(0x0101010101010101)
#: Segments of two bits: their counts (0 to 2) lie side by side in a 32-bit number, one number for each half of a fingerprint.
_FIELDS, _LOW_BITS = 16, 0x55555555
#: Pairs of fingerprints are compared one by one in a cell of up to so many; larger cells are linked without pairs.
CROWD = 2048


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included; of the whole sequence if it is shorter, none if there is no word."""
    found = text.encode().lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], SEED) for i, j in zip(starts, (ends[words - 1:] - 1).tolist())]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per document from the hashes of all documents in a row, ``counts`` of each: bits set in over half of them.

    The eight bytes of a number add up eight bits at once, in blocks of at most 255 hashes; then blocks are added up.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begins = (np.cumsum(counts) - counts)[full]
    blocks = -(-counts[full] // 255)
    first = np.cumsum(blocks) - blocks
    inner = np.arange(blocks.sum()) - np.repeat(first, blocks)
    starts = np.repeat(begins, blocks) + 255 * inner
    half = counts[full]
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * sums[:, byte] > half).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp, the 64-bit fingerprint as a signed number. Null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                parts = [np.array(shingle_hashes(t.as_py() or "", words), np.uint64) for t in texts[at:at + 256]]
                counts = np.fromiter(map(len, parts), np.int64, len(parts))
                prints = majority_bits(np.concatenate(parts), counts)
                yield pa.record_batch([ids[at:at + 256], pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _cells(fp: Column, reach: int) -> Column:
    """The grid cells of a fingerprint: for both halves, its segment counts and all that lie within ``reach`` (0 or 1) of them."""

    def around(half: int) -> Column:
        bits = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        counts = bits - F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_LOW_BITS))
        cells = F.array(counts)
        for field in range(_FIELDS if reach else 0):
            value = F.shiftright(counts, 2 * field).bitwiseAND(F.lit(3))
            cells = F.concat(cells, F.when(value < 2, F.array(counts + (1 << 2 * field))).otherwise(F.array().cast("array<bigint>")),
                             F.when(value > 0, F.array(counts - (1 << 2 * field))).otherwise(F.array().cast("array<bigint>")))
        return F.transform(cells, lambda c: c + (half << 32))

    return F.concat(around(0), around(1))


def _crowd_links(prints: DataFrame, bits: int) -> DataFrame:
    """Links among ``prints`` (fp) that need no pairs: fingerprints within ``bits`` meet in a number half that far from both.

    All that meet there are within ``bits`` of each other, so each is linked to the smallest. One row per fingerprint and number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = (np.uint64(1) << np.arange(64, dtype=np.uint64))
        masks, level = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        for _ in range(bits // 2):
            level = np.unique((level[:, None] ^ one[None, :]).ravel())
            masks = np.unique(np.concatenate([masks, level]))
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 64):
                part = fps[at:at + 64]
                yield pa.record_batch([pa.array((part[:, None] ^ masks[None, :]).ravel().view(np.int64)),
                                       pa.array(np.repeat(part, len(masks)).view(np.int64))], ["near", "fp"])

    met = materialize(prints.mapInArrow(run, "near long, fp long"), "simhash-crowd")
    least = materialize(met.groupBy("near").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "simhash-least")
    return met.join(least, "near").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def _least_labels(linked: np.ndarray) -> np.ndarray:
    """Per row of a symmetric link matrix the smallest row that links reach."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(1)
        near = np.minimum(near, label)
        near = near[near]
        if (near == label).all():
            return label
        label = near


def _cell_links(entries: DataFrame, bits: int, crowd: int) -> DataFrame:
    """(a, b) links of the fingerprints that share a cell of ``entries`` (cell, fp), and (a, null) members of crowded cells.

    The members of a cell arrive one behind the other. All are compared, but only as many links come out as connect them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        cells, prints = none, none

        def link(cells, prints, crowded):
            starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            sizes = np.diff(np.append(starts, len(cells)))
            left, right, lone = [], [], []
            few = np.flatnonzero((sizes > 1) & (sizes <= 8))
            for step in range(1, 8):  # small cells side by side: each member with the one ``step`` behind it
                at = np.flatnonzero(np.append(cells[:-step] == cells[step:], np.zeros(min(step, len(cells)), bool))) if len(few) else none
                near = np.bitwise_count((prints[at] ^ prints[at + step]).view(np.uint64)) <= bits
                left.append(prints[at[near]])
                right.append(prints[at[near] + step])
            for i in np.flatnonzero((sizes > min(8, crowd)) | (cells[starts] == crowded)):
                own = prints[starts[i]:starts[i] + sizes[i]]
                if len(own) > crowd or cells[starts[i]] == crowded:
                    lone.append(own)
                    continue
                near = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= bits
                label = _least_labels(near)
                left.append(own[label != np.arange(len(own))])
                right.append(own[label[label != np.arange(len(own))]])
            a, b, c = (np.concatenate(x or [none]) for x in (left, right, lone))
            return pa.record_batch([pa.array(np.concatenate([a, c])), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(c), pa.int64())])],
                                   ["a", "b"])

        crowded = None  # the cell whose members pass through, once they are too many to hold
        for batch in batches:
            cells = np.concatenate([cells, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy()])
            last = int(np.searchsorted(cells, cells[-1]))
            if last:
                yield link(cells[:last], prints[:last], crowded)
                cells, prints = cells[last:], prints[last:]
            if crowded == cells[0] or len(cells) > crowd:
                crowded = cells[0]
                yield pa.record_batch([pa.array(prints[:-1]), pa.nulls(len(prints) - 1, pa.int64())], ["a", "b"])
                cells, prints = cells[-1:], prints[-1:]
        if len(cells):
            yield link(cells, prints, crowded)

    return entries.select("cell", "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def fingerprint_groups(prints: DataFrame, bits: int = 4, crowd: int = CROWD) -> DataFrame:
    """(fp, label): distinct fingerprints of ``prints`` (fp) that links of up to ``bits`` differing bits connect with others.

    A fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such points is at most
    the number of differing bits, so of two linked fingerprints one half of 16 segments differs by ``bits // 2`` = 2 at most, and
    both lie within 1 of a common point: each fingerprint enters the grid cells within 1 of it, and linked ones meet in a cell,
    where they are verified on all bits. ``bits`` may be 0 to 5.

    A dense clump of near copies has links without number; a cell gives only as many as connect its members. The members of a
    cell beyond ``crowd`` pass through, and are linked through common neighbours instead, again exactly.
    """
    if not 0 <= bits <= 5:
        raise ValueError("the grid finds up to 5 differing bits")
    prints = prints.select("fp").distinct()
    entries = prints.select("fp", F.explode(_cells(F.col("fp"), 1)).alias("cell"))
    found = materialize(_cell_links(entries, bits, crowd).distinct(), "simhash-links")
    links, crowded = found.where("b IS NOT NULL"), found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if not crowded.isEmpty():
        links = links.union(_crowd_links(crowded, bits))
    return components(links).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of ``docs`` (doc_id, text, any other columns).

    Null texts count as empty; all texts without a word share fingerprint zero and are linked like any other. Repeated rows are
    copies. component_id is the smallest doc_id reachable over links, null only if no document in reach has one. Empty tables
    give empty tables. Runs Spark jobs when called; equal fingerprints are handled once, so copies cost nothing more.
    """
    prints = materialize(fingerprints(docs, words), "simhash-docs")
    known = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-known-prints")
    labels = materialize(fingerprint_groups(known, bits, crowd), "simhash-groups")
    members = materialize(known.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "least"), "simhash-members")
    groups = materialize(members.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-components")
    by_print = materialize(members.join(groups, "label").select("fp", "component_id"), "simhash-ids")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
