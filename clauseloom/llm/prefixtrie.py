"""The trie of conversation prefixes, screened by a count-min sketch of prefix digests.

Counters never fall short of the true number of conversations, so an estimate of one proves that a prefix belongs to a single
conversation; its node is emitted where its row lies. Only prefixes that may be shared are shuffled and grouped exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import partitions, running_sums
from clauseloom.session import materialize

#: The digest of a prefix adds up six lanes of this many bits over its turns, each lane a hash of turn and position. Sums of
#: lanes over all turns of a corpus stay within 64 bits.
LANE = 24
#: Counters of a sketch row: four to a prefix, within these bounds. Beyond the upper one more prefixes are grouped exactly, with
#: the same result; it bounds a task's sketch to 64 MB and the broadcast to 8 MB.
NARROWEST, WIDEST = 1 << 16, 1 << 25
#: Counters to a block of the sketch, and bytes of joined ids to a row.
BLOCK, JOINED = 1 << 16, 1 << 16
ROWS = 2
_KEY = ("k1", "k2", "k3")
_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """c, pos (from 1), content (digest of role and text), size (code points of the text), first (global rank of the first turn), own_n.

    Ranks come from prefix sums over the whole table, so a conversation of any length is spread over tasks. Turns of equal number
    stand in the order of their digests.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.unhex(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), content.alias("content"),
        F.length(text).cast("long").alias("size"))
    ranked = materialize(running_sums(turns, [F.col("c").asc(), F.col("turn").asc_nulls_first(), F.col("content").asc()],
                                      {"place": F.lit(1)}, "trie-turns").select("c", "content", "size", "place"), "trie-places")
    ends = ranked.groupBy("c").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("own_n"))
    return ranked.join(ends, "c").select("c", (F.col("place") - F.col("first") + 1).alias("pos"), "content", "size", "own_n")


def rebuilt(conversations: DataFrame, family: int = 100, longest: int = 6) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (c, n) for each, and their turns (c, n, pos, content, size).

    Conversation c has the first h turns of conversation c - c % ``family``, h = crc32(decimal c) % ``longest``, then its own turns
    after its first h.
    """
    turns = materialize(numbered_turns(conversations), "trie-numbered")
    own = turns.where("pos = 1").select("c", "own_n")
    heads = own.where(F.col("c") % family == 0).select(F.col("c").alias("base"), F.col("own_n").alias("base_n"))
    convs = own.withColumn("h", F.crc32(F.encode(F.col("c").cast("string"), "UTF-8")) % longest).withColumn("base", F.col("c") - F.col("c") % family)
    convs = convs.join(heads, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.select("c", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own_n") - F.col("h"), F.lit(0))).alias("n")),
                        "trie-conversations")
    lent = turns.where((F.col("c") % family == 0) & (F.col("pos") < longest)).select(F.col("c").alias("base"), "pos", "content", "size")
    head = convs.where("lent > 0").join(lent, "base").where("pos <= lent").select("c", "n", "pos", "content", "size")
    tail = turns.join(convs, "c").where("pos > h").select("c", "n", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "content", "size")
    return convs.select("c", "n"), head.unionByName(tail)


def prefixes(turns: DataFrame) -> DataFrame:
    """c, n, pos, size, the digest k1-k3 of the first pos turns and p1-p3 of the turns before; the empty prefix has zeros.

    A digest is a sum over (position, turn), so prefix sums give it for every prefix, however long a conversation is.
    """
    mask = (1 << LANE) - 1
    hashed = turns.select("c", "n", "pos", "size", *(F.xxhash64("content", "pos", F.lit(i)).alias(f"x{i}") for i in range(3)))
    lanes = {f"l{i}": (F.shiftright(f"x{i // 2}", LANE * (i % 2)).bitwiseAND(mask)).cast("int") for i in range(6)}
    sums = materialize(running_sums(hashed, [F.col("c").asc(), F.col("pos").asc()], lanes, "trie-lanes"), "trie-sums")
    starts = sums.where("pos = 1").select("c", *(F.col(f"l{i}").alias(f"s{i}") for i in range(6)))
    both = sums.join(starts, "c")

    def key(own: bool) -> list[Column]:
        out = []
        for k in range(3):
            low, high = (F.col(f"l{i}") - F.col(f"s{i}") + (F.shiftright(f"x{k}", LANE * (i % 2)).bitwiseAND(mask) if own else F.lit(0))
                         for i in (2 * k, 2 * k + 1))
            out.append((low.bitwiseAND(mask) + F.shiftleft(high.bitwiseAND(mask), LANE)).alias(f"{'k' if own else 'p'}{k + 1}"))
        return out

    return both.select("c", "n", "pos", "size", *key(True), *key(False))


def _local_sketch(width: int):
    """Blocks of a partition's counters: which are one or more, and which are more than one, as compressed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = None
        for batch in batches:
            if counters is None:
                counters = np.zeros(ROWS * width, np.uint8)
            for row in range(ROWS):
                at, times = np.unique((batch.column(row).to_numpy() & (width - 1)) + row * width, return_counts=True)
                counters[at] = np.minimum(2, counters[at] + np.minimum(2, times))
        if counters is None:
            return
        for block in range(len(counters) // BLOCK):
            part = counters[block * BLOCK:(block + 1) * BLOCK]
            if part.any():
                bits = [zlib.compress(np.packbits(part >= least).tobytes(), 1) for least in (1, 2)]
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([bits[0]], pa.binary()), pa.array([bits[1]], pa.binary())],
                                      ["block", "seen", "twice"])

    return run


def _merged_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters that are exactly one in the sum of all partitions' blocks."""
    blocks: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, *bits in zip(*(c.to_pylist() for c in batch.columns)):
            seen, twice = (np.frombuffer(zlib.decompress(b), np.uint8) for b in bits)
            if block in blocks:
                before = blocks[block]
                blocks[block] = [before[0] | seen, before[1] | twice | (before[0] & seen)]
            else:
                blocks[block] = [seen, twice]
    for block, (seen, twice) in blocks.items():
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([(seen & ~twice).tobytes()], pa.binary())], ["block", "ones"])


def sketch_width(n: int) -> int:
    return min(WIDEST, max(NARROWEST, 1 << (4 * n).bit_length()))


def singles(found: DataFrame, width: int) -> np.ndarray:
    """The count-min sketch of all prefix digests, as the packed bits of its counters that are one. At most ROWS * WIDEST bits."""
    local = found.select("k1", "k2").mapInArrow(_local_sketch(width), "block int, seen binary, twice binary")
    merged = local.repartition(partitions(found.sparkSession), "block").mapInArrow(_merged_sketch, "block int, ones binary")
    bits = np.zeros(ROWS * width // 8, np.uint8)
    for block, ones in merged.toLocalIterator():
        bits[block * BLOCK // 8:(block + 1) * BLOCK // 8] = np.frombuffer(ones, np.uint8)
    return bits


def screened(found: DataFrame, width: int | None = None) -> DataFrame:
    """``prefixes`` with ``kind``: 2 if the prefix before is proven to be of one conversation, else 1 if this one is, else 0."""
    width = width or sketch_width(found.count())
    spark = found.sparkSession
    bits = spark.sparkContext.broadcast(singles(found, width))

    def one(*rows: pd.Series) -> np.ndarray:
        proven = np.zeros(len(rows[0]), bool)
        for row, key in enumerate(rows):
            at = (key.to_numpy() & (width - 1)) + row * width
            proven |= (bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return proven

    @F.pandas_udf("int")
    def kind(pos: pd.Series, k1: pd.Series, k2: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.Series:
        return pd.Series(np.where((pos.to_numpy() > 1) & one(p1, p2), 2, one(k1, k2).astype(int)))

    return found.withColumn("kind", kind("pos", "k1", "k2", "p1", "p2"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, c) rows to (key, first c, ids joined by commas), a bounded piece to a row."""
    key, ids, size = None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.record_batch([*(pa.array([k], pa.int64()) for k in key), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])],
                               [*_KEY, "c", "ids"])

    for batch in batches:
        for *at, c in zip(*(x.to_pylist() for x in batch.columns)):
            if at != key or size >= JOINED:
                if ids:
                    yield piece()
                key, ids, size = at, [], 0
            ids.append(c)
            size += 12
    if ids:
        yield piece()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, SHA-256 of all its ids) from sorted pieces; only the state of one digest is held."""
    key, digest = None, None

    def node() -> pa.RecordBatch:
        return pa.record_batch([*(pa.array([k], pa.int64()) for k in key), pa.array([digest.hexdigest()])], [*_KEY, "ends_sha256"])

    for batch in batches:
        for *at, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
            if at != key:
                if digest:
                    yield node()
                key, digest = at, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if digest:
        yield node()


def _ends(members: DataFrame) -> DataFrame:
    """k1-k3 and ends_sha256 from (k1-k3, c). A node with most conversations is joined piece by piece in many tasks; its digest
    then reads the pieces in order, as SHA-256 must."""
    key, order = [F.col(k) for k in _KEY], [*_KEY, "c"]
    dealt = members.select(*order).repartitionByRange(partitions(members.sparkSession), *order).sortWithinPartitions(*order)
    pieces = dealt.mapInArrow(_joined_ids, "k1 long, k2 long, k3 long, c long, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*order).mapInArrow(_hashed_ids, "k1 long, k2 long, k3 long, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """key and the sums of ``values`` over each node's subtree; ``nodes`` has key, up (null at the root) and the values.

    Each round doubles the distance: a node adds what the nodes that far below have gathered, and looks twice as far up.
    """
    state = nodes.select("key", "up", *values)
    while True:
        state = materialize(state, "trie-subtrees")
        if state.where("up IS NOT NULL").isEmpty():
            return state.drop("up")
        gathered = state.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(*(F.sum(v).alias(f"below_{v}") for v in values))
        above = state.select(F.col("key").alias("up"), F.col("up").alias("above"))
        state = state.join(gathered, "key", "left").join(above, "up", "left").select(
            "key", F.col("above").alias("up"), *((F.col(v) + F.coalesce(f"below_{v}", F.lit(0))).alias(v) for v in values))


def _sha(ids: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(ids.cast("string"), F.lit("")), "UTF-8"), 256)


def trie(convs: DataFrame, turns: DataFrame, width: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of conversations (c, n) with their turns (c, n, pos, content, size); see ``conversation_trie``."""
    rows = materialize(screened(materialize(prefixes(turns), "trie-prefixes"), width), "trie-screened")
    key, up = F.struct(*_KEY).alias("key"), F.struct("p1", "p2", "p3").alias("up")
    zero = [F.lit(0).cast("long").alias(k) for k in _KEY]

    shared = rows.where("kind = 0")
    groups = shared.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.min("pos").alias("depth"),
                                       F.min("size").alias("size"), *(F.min(p).alias(p) for p in ("p1", "p2", "p3"))).select(
        key, up, "n_convs", "conv_id", "depth", "size")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0").select(
        F.struct(*zero).alias("key"), F.lit(None).cast(groups.schema["up"].dataType).alias("up"), "n_convs", "conv_id",
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"))
    groups = materialize(root.unionByName(groups), "trie-nodes")

    hung = rows.where("kind = 1")
    children = groups.where("up IS NOT NULL").select("up", F.lit(0).alias("alone")).unionByName(hung.select(up, F.lit(1).alias("alone"))).groupBy(
        F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("alone").alias("alone"))
    # Proven singles have one leaf and save nothing, so they only count as leaves of the group that they hang from.
    valued = materialize(groups.join(children, "key", "left").select(
        "key", "up", "n_convs", "conv_id", "depth", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce(F.when(F.col("n_children") > 0, F.col("alone")), F.lit(1)).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")), "trie-valued")
    sums = _subtree_sums(valued, ["n_leaves", "saved_tokens"])
    members = shared.where("pos = n").select(*_KEY, "c").unionByName(convs.where("n = 0").select(*zero, "c"))
    ends = _ends(members).select(key, "ends_sha256")
    names = valued.select(F.col("key").alias("up"), F.col("conv_id").alias("parent"))
    # A parent that is no group is a proven single, of the same conversation.
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    grouped = valued.drop("n_leaves", "saved_tokens").join(sums, "key").join(ends, "key", "left").join(names, "up", "left").select(
        "conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", _sha(F.lit(None))).alias("ends_sha256"))

    def alone(df: DataFrame, above: Column) -> DataFrame:
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        return df.select(F.col("c").alias("conv_id"), F.col("pos").alias("depth"), above.alias("parent_conv_id"), one.alias("n_convs"),
                         (F.col("pos") < F.col("n")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
                         _sha(F.when(F.col("pos") == F.col("n"), F.col("c"))).alias("ends_sha256"))

    tops = alone(hung.withColumn("up", F.struct("p1", "p2", "p3")).join(names, "up", "left"), F.coalesce("parent", "c"))
    tails = alone(rows.where("kind = 2"), F.col("c"))
    return grouped.unionByName(tops).unionByName(tails).select(*(F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in _COLUMNS))


def conversation_trie(conversations: DataFrame, family: int = 100, longest: int = 6, width: int | None = None) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (see ``rebuilt``) of (conv_id, turn, role, text, any others).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (code points
    that its subtree stores once instead of n_convs times) and ends_sha256 (of the ids of the conversations that end there).

    Turns are ordered by number, null first, and by digest where numbers are equal; a repeated row is a turn of its own. Null role
    or text is empty. Rows without a conv_id belong to no conversation. Without conversations there are no nodes. Runs Spark jobs
    when called. No conversation, node or level is gathered in one task or cell; only SHA-256 reads a node's ids in one task, as
    prepared pieces.
    """
    convs, turns = rebuilt(conversations, family, longest)
    return trie(convs, turns, width)
