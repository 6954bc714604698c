"""Near copies by exact Jaccard similarity of word shingles: fingerprints find the closest, prefix filters the rest, sets verify them, links group them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.components import components
from clauseloom.llm.simhash import fingerprint_groups, majority_bits, shingle_hashes
from clauseloom.session import discard, materialize

#: Words to a shingle, and the least Jaccard similarity of two shingle sets that links their texts.
WORDS, SIMILARITY = 5, 0.8
#: Fingerprints that differ in so many bits make candidates; the grid finds no wider radius.
BITS = 5
#: Counters that tell rare items from common ones, and how many of them make a row.
COUNTERS, BLOCK = 1 << 22, 1 << 16


def sizes_fit(n: Column, m: Column, least: float) -> Column:
    return F.least(n, m) >= F.greatest(n, m) * least - 1e-6


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many items of ``sets`` fall on each of COUNTERS counters; at most 16 MB reach the driver, whatever the number of items."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            at, times = np.unique(batch.column(0).flatten().to_numpy() & (COUNTERS - 1), return_counts=True)
            counters[at] += times.astype(np.uint32)
        for block, part in enumerate(counters.reshape(-1, BLOCK)):
            if part.any():
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], ["block", "counts"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
                blocks[block] = blocks[block] + part if block in blocks else part
        for block, part in blocks.items():
            full = np.minimum(part, np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([full.tobytes()])], ["block", "counts"])

    summed = sets.select("items").mapInArrow(local, "block int, counts binary").repartition(COUNTERS // BLOCK, "block").mapInArrow(
        merged, "block int, counts binary")
    out = np.zeros(COUNTERS, np.uint32)
    for block, counts in summed.toLocalIterator():
        out[block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(counts, np.uint32)
    return out


def rare_pairs(sets: DataFrame, least: float, within: DataFrame | None = None) -> DataFrame:
    """(a, b) of the ``sets`` (nid, label, items: distinct numbers) whose labels differ and that may reach ``least``; none is missed.

    Items are ordered from the rarest on, so a prefix holds what is peculiar to a set: what many share is in no prefix, unless
    a set has little else. Any order that all sets share is exact; this one takes an item's frequency from counters of a fixed number,
    which items may share, so items are not shuffled to be counted. Items alone on their counter are in one set only: they take
    places of the prefix, but are not moved.
    """
    sets = materialize(sets.select("nid", "label", F.size("items").alias("n"), "items"), "rare-sets")
    counters = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, offsets = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
            rows, found = [], []
            for row, (begin, end) in enumerate(zip(offsets.tolist(), offsets.tolist()[1:])):
                own = items[begin:end]
                times = counters.value[own & (COUNTERS - 1)]
                first = np.lexsort((own, times))[:len(own) - int(np.ceil(len(own) * least - 1e-6)) + 1]
                first = first[times[first] > 1]
                rows.append(np.full(len(first), row))
                found.append(own[first])
            rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            kept = batch.select(["nid", "label", "n"]).take(pa.array(rows))
            yield pa.record_batch([*kept.columns, pa.array(np.concatenate(found) if found else [], pa.int64())], ["nid", "label", "n", "item"])

    prefix = materialize(sets.mapInArrow(heads, "nid long, label long, n int, item long"), "rare-prefix")
    discard(sets)
    keys = ["item"] if within is None else ["item", "band"]
    if within is not None:
        banded = materialize(prefix.join(within.select("nid", "band"), "nid"), "rare-bands")
        discard(prefix)
        prefix = banded
    mixed = prefix.groupBy(*keys).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(*keys)
    met = materialize(prefix.join(mixed, keys, "left_semi"), "rare-mixed")
    discard(prefix)
    other = met.select(F.col("nid").alias("b"), F.col("label").alias("other"), F.col("n").alias("m"), *keys)
    return met.join(other, keys).where((F.col("label") < F.col("other")) & sizes_fit(F.col("n"), F.col("m"), least)).select(
        F.col("nid").alias("a"), "b").distinct()


def _set(text: str | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text or "", WORDS), np.uint64))


def _prefixes(docs: DataFrame) -> DataFrame:
    """(doc_id, own, n, fp, prefix): a digest of the shingle set, its size, its fingerprint and its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [_set(t.as_py()) for t in batch.column(1)[at:at + 256]]
                heads = [s[:len(s) - int(np.ceil(len(s) * SIMILARITY - 1e-6)) + 1].view(np.int64) for s in sets]
                prints = majority_bits(np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets)))
                yield pa.record_batch([batch.column(0)[at:at + 256], pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]),
                                       pa.array([len(s) for s in sets], pa.int32()), pa.array(prints.view(np.int64)), pa.array(heads, pa.list_(pa.int64()))],
                                      ["doc_id", "own", "n", "fp", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, own binary, n int, fp long, prefix array<long>")


def fingerprint_stars(known: DataFrame) -> DataFrame:
    """(a, b) of the ``known`` sets (nid, n, fp): each set of a group of close fingerprints with the first set of its group, if their sizes fit."""
    groups = materialize(fingerprint_groups(known, BITS), "copies-prints-groups")
    member = materialize(known.select("nid", "n", "fp").join(groups, "fp", "left").select("nid", "n", F.coalesce("label", "fp").alias("group")), "copies-members")
    first = member.groupBy("group").agg(F.min(F.struct("nid", "n")).alias("at"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return member.join(first, "group").where((F.col("nid") != F.col("at.nid")) & sizes_fit(F.col("n"), F.col("at.n"), SIMILARITY)).select(
        F.col("nid").alias("a"), F.col("at.nid").alias("b"))


def _items(docs: DataFrame) -> DataFrame:
    """(nid, label, items) of ``docs`` (nid, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [_set(t.as_py()).view(np.int64) for t in batch.column(2)[at:at + 256]]
                yield pa.record_batch([batch.column(0)[at:at + 256], batch.column(1)[at:at + 256], pa.array(sets, pa.list_(pa.int64()))],
                                      ["nid", "label", "items"])

    return docs.select("nid", "label", "text").mapInArrow(run, "nid long, label long, items array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of ``texts`` (doc_id, text) that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep, a = [], batch.column(2)
            for i, b in enumerate(batch.column(1).to_pylist()):
                if b != last:
                    last, own = b, _set(batch.column(3)[i].as_py())
                other = _set(a[i].as_py())
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(common >= SIMILARITY * (len(own) + len(other) - common) - 1e-6)
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for ``docs`` (doc_id, text), whose doc_ids are numbers that do not repeat.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; component_id is the smallest
    doc_id that links reach. Texts without a word have equal sets. A text under five words is one shingle. No link is missed.

    First, sets whose SimHash fingerprints are connected by steps of up to ``BITS`` bits are compared with the first set of their
    group. Similar sets may differ in more bits than any grid of 64 can look for, so what is still in different groups meets by
    hashes: two similar sets share one of the smallest fifth of them. Texts that share such a hash are compared with the first text
    that has it; what this leaves in different groups meets again by its rarest shingles (``rare_pairs``). So groups of copies give
    about as many comparisons as texts, and passages that many texts share give none between them.
    """
    prints = materialize(_prefixes(docs), "copies-prints")
    known = materialize(prints.groupBy("own").agg(F.min("doc_id").alias("nid"), F.first("n").alias("n"), F.first("fp").alias("fp"),
                                                  F.first("prefix").alias("prefix")), "copies-known")
    close = materialize(_verified(fingerprint_stars(known), docs), "copies-close")
    named = materialize(known.select("nid", "n", "prefix").join(components(close), F.col("nid") == F.col("node"), "left").select(
        "nid", "n", F.coalesce("label", "nid").alias("label"), "prefix"), "copies-named")
    entries = named.select("nid", "n", "label", F.explode("prefix").alias("item"))
    least = materialize(entries.groupBy("item").agg(F.min(F.struct("nid", "n", "label")).alias("at"), F.count(F.lit(1)).alias("c"),
                                                    F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").drop("lo", "hi"), "copies-least")
    shared = materialize(entries.join(least, "item").select(
        "item", "nid", "n", "label", F.col("at.nid").alias("least"), F.col("at.n").alias("m"), F.col("at.label").alias("other"), "c"), "copies-shared")
    discard(least, named)
    stars = materialize(shared.where((F.col("label") != F.col("other")) & sizes_fit(F.col("n"), F.col("m"), SIMILARITY)).select(
        F.col("nid").alias("a"), F.col("least").alias("b")).distinct(), "copies-stars")
    links = materialize(close.union(_verified(stars, docs)), "copies-links")
    first = components(links)
    # Groups of two have been compared, and those whose members carry one label need no more comparing.
    labelled = materialize(shared.where("c > 2").select("item", "nid").join(first, F.col("nid") == F.col("node"), "left").select(
        "item", "nid", F.coalesce("label", "nid").alias("label")), "copies-labels")
    discard(shared)
    mixed = labelled.groupBy("item").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("item")
    open_ = materialize(labelled.join(mixed, "item", "left_semi").select("nid", "label").distinct(), "copies-open")
    discard(labelled)
    if not open_.isEmpty():
        texts = docs.select(F.col("doc_id").alias("nid"), "text").join(open_, "nid")
        more = materialize(rare_pairs(_items(texts), SIMILARITY), "copies-rare")
        first = components(links.union(materialize(_verified(more, docs), "copies-more")))
    groups = materialize(known.select("own", "nid").join(first, F.col("nid") == F.col("node"), "left").select(
        "own", F.coalesce("label", "nid").alias("component_id")), "copies-groups")
    return prints.select("doc_id", "own").join(groups, "own").select("doc_id", "component_id")
