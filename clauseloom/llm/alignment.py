"""Alignment of two tokenizers' tokens over the same bytes, by merge-path pieces.

The ends of the A tokens and of the B tokens of a text are two sorted lists. Binary searches on the diagonals of their merge grid
cut the merge into pieces of equal work that need nothing of each other. A piece emits its overlaps and the groups that end in it;
what is open at its borders is stitched to its neighbours. Pieces of long documents are dealt to different tasks.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.bpe import byte_letters
from clauseloom.session import materialize

#: Token ends to a piece; links to a chunk, whose distinct id pairs are looked up together; characters and documents encoded at a time.
WORK, CHUNK, CHARS, DOCS = 1 << 15, 1 << 17, 1 << 20, 256
#: An id pair as one number: the B id above these bits, the A id below.
A_BITS = 24
#: Chunk numbers of merged pieces begin here, those of whole documents at zero.
_PIECES = 1 << 62


class Tokens:
    """Both vocabularies: ids of a text, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = {c: b for b, c in enumerate(byte_letters())}
        self.a_bytes = [b""] * (1 + max(model["vocab"].values()))
        for text, i in model["vocab"].items():
            self.a_bytes[i] = bytes(of[c] for c in text)
        # Merges by the rank of their result are this file's merges in order, if ids follow the order of merges.
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError(f"ids of {path_a} do not follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                   mergeable_ranks={b: i for i, b in enumerate(self.a_bytes) if b})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_sizes = np.array([len(b) for b in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(b) for b in self.b_bytes], np.int64)
        #: What a token is written as within a group, and at the end of its side there.
        self.written = [f"{i}{mark}" for i in range(len(self.a_bytes)) for mark in ",|"]
        self.b_written = len(self.written)
        self.written += [f"{i}{mark}" for i in range(len(self.b_bytes)) for mark in ",;"]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides for each text; none where the joined bytes of a side differ from space + text."""
        out = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            whole = b" " + text.encode() if text else b""
            a = self.a.encode_ordinary(" " + text) if text else []
            if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
                a = b = []
            out.append((np.array(a, np.int64), np.array(b, np.int64)))
        return out

    def groups(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
        """The written tokens of whole groups in order; ``cut_a`` and ``cut_b`` are the last tokens of each group's sides."""
        out = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a] = last_b[cut_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        out[np.arange(len(a)) + np.concatenate(([0], cut_b + 1))[group_a]] = 2 * a + last_a
        out[np.arange(len(b)) + (cut_a + 1)[group_b]] = self.b_written + 2 * b + last_b
        written = self.written
        return [written[i] for i in out.tolist()]


@functools.lru_cache(maxsize=1)
def tokens(path_a: str, path_b: str) -> Tokens:
    return Tokens(path_a, path_b)


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> list[tuple[int, int]]:
    """Where the merge of two sorted lists stands, as (taken of a, taken of b), at its start, after each ``work`` steps and at its end.

    All diagonals are searched at once. Of equal ends the one of ``a`` comes first, and a border never parts the two.
    """
    d = np.arange(work, len(a) + len(b), work)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = np.minimum(middle, len(a) - 1), np.clip(d - 1 - middle, 0, len(b) - 1)
        first_b = b[at[1]] < a[at[0]]
        high = np.where(open_ & first_b, middle, high)
        low = np.where(open_ & ~first_b, middle + 1, low)
    found = [(0, 0)]
    for i, j in zip(low.tolist(), (d - low).tolist()):
        found.append((i, j + (0 < i and j < len(b) and a[i - 1] == b[j])))
    return [*found, (len(a), len(b))]


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and in ``b`` of the ends that both have; both lists are sorted and have no repeats."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    cut_a = np.flatnonzero(b[at] == a)
    return cut_a, at[cut_a]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of all pairs that overlap, one pair for each distinct end, from the two lists of ends."""
    steps = np.union1d(a, b)
    return np.searchsorted(a, steps), np.searchsorted(b, steps)


@dataclass
class _Found:
    """What a document or a piece of one yields."""

    row: int
    doc_id: int | None
    piece: int
    n_a: int
    n_b: int
    pairs: np.ndarray
    sha: str | None = None
    open: dict | None = None


_RECORD = pa.schema([("chunk", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("n_a", pa.int64()),
                     ("n_b", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string()), ("links", pa.list_(pa.int32())),
                     ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
_PIECE = pa.schema([("a_ids", pa.binary()), ("a_at", pa.int64()), ("b_ids", pa.binary()), ("b_at", pa.int64())])
_BORDER = pa.schema([("head", pa.string()), ("head_b", pa.string()), ("body", pa.string()), ("tail", pa.string()), ("tail_b", pa.string())])
_RECORD_DDL = ("chunk long, row long, doc_id long, piece int, n_a long, n_b long, n_links long, sha string, links array<int>, "
               "pairs array<long>, times array<int>")
_PIECE_DDL = "a_ids binary, a_at long, b_ids binary, b_at long"
_BORDER_DDL = "head string, head_b string, body string, tail string, tail_b string"


def _chunks(found: Iterator[_Found], base: int, extra: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Records in chunks of about CHUNK links. The first record of a chunk has the chunk's distinct id pairs and how often each
    occurs in it; links are positions in that list."""
    schema = pa.schema([*_RECORD, *extra])
    number = base | TaskContext.get().partitionId() << 32
    waiting, size = [], 0

    def chunk() -> pa.RecordBatch:
        pairs, links, times = np.unique(np.concatenate([f.pairs for f in waiting]), return_inverse=True, return_counts=True)
        offsets = np.cumsum([0, *(len(f.pairs) for f in waiting)], dtype=np.int32)
        first = [pairs.tolist(), *[None] * (len(waiting) - 1)], [times.tolist(), *[None] * (len(waiting) - 1)]
        columns = [[number] * len(waiting), [f.row for f in waiting], [f.doc_id for f in waiting], [f.piece for f in waiting],
                   [f.n_a for f in waiting], [f.n_b for f in waiting], [len(f.pairs) for f in waiting], [f.sha for f in waiting],
                   pa.ListArray.from_arrays(pa.array(offsets), pa.array(links.astype(np.int32))), *first]
        columns += [[f.open[name] if f.open else None for f in waiting] for name in extra.names]
        return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    for f in found:
        waiting.append(f)
        size += len(f.pairs) + (len(f.open["a_ids"]) if f.open and "a_ids" in f.open else 0)
        if size >= CHUNK or len(waiting) >= 1 << 14:
            yield chunk()
            number, waiting, size = number + 1, [], 0
    if waiting:
        yield chunk()


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return b << A_BITS | a


def _documents(batches: Iterator[pa.RecordBatch], t: Tokens) -> Iterator[_Found]:
    """Documents of one piece are merged at once, many together; longer ones come out as pieces to be merged elsewhere."""
    for batch in batches:
        rows, ids, texts = (batch.column(i).to_pylist() for i in range(3))
        start = 0
        while start < len(rows):
            stop, chars = start, 0
            while stop < len(rows) and stop - start < DOCS and (stop == start or chars < CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            coded = t.encode(texts[start:stop])
            short = [k for k, (a, b) in enumerate(coded) if len(a) + len(b) <= WORK]
            yield from _short(t, [(rows[start + k], ids[start + k], *coded[k]) for k in short])
            for k in sorted({*range(len(coded))} - {*short}):
                yield from _cut(t, rows[start + k], ids[start + k], *coded[k])
            start = stop


def _short(t: Tokens, docs: list[tuple[int, int | None, np.ndarray, np.ndarray]]) -> Iterator[_Found]:
    if not docs:
        return
    a, b = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs])
    # Both sides of a document have the same bytes, so one behind the other they make two sorted lists with the same borders.
    cut_a, cut_b = common_ends(np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b]))
    written, pairs = t.groups(a, b, cut_a, cut_b), _pairs(a[cut_a], b[cut_b])
    ends_a, ends_b = np.cumsum([len(d[2]) for d in docs]), np.cumsum([len(d[3]) for d in docs])
    cuts = np.searchsorted(cut_a, ends_a).tolist()
    at = cut = 0
    for (row, doc_id, x, y), end_a, end_b, end_cut in zip(docs, ends_a.tolist(), ends_b.tolist(), cuts):
        text = "".join(written[at:end_a + end_b])[:-1]
        yield _Found(row, doc_id, 0, len(x), len(y), pairs[cut:end_cut], hashlib.sha256(text.encode()).hexdigest() if text else "")
        at, cut = end_a + end_b, end_cut


def _cut(t: Tokens, row: int, doc_id: int | None, a: np.ndarray, b: np.ndarray) -> Iterator[_Found]:
    """A long document's pieces, with their ids and the byte at which each side begins."""
    ends_a, ends_b = np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b])
    borders = diagonals(ends_a, ends_b, WORK)
    for n, ((i, j), (i2, j2)) in enumerate(zip(borders, borders[1:])):
        open_ = {"a_ids": a[i:i2].astype("<u4").tobytes(), "a_at": int(ends_a[i - 1]) if i else 0,
                 "b_ids": b[j:j2].astype("<u4").tobytes(), "b_at": int(ends_b[j - 1]) if j else 0}
        yield _Found(row, doc_id, n, i2 - i, j2 - j, np.zeros(0, np.int64), None, open_)


def _merge(t: Tokens, row: int, doc_id: int | None, piece: int, a: np.ndarray, a_at: int, b: np.ndarray, b_at: int) -> _Found:
    """A piece's links and its text: whole groups, and what belongs to the groups that are open at its two borders."""
    cut_a, cut_b = common_ends(a_at + np.cumsum(t.a_sizes[a]), b_at + np.cumsum(t.b_sizes[b]))

    def ids(x: np.ndarray) -> str:
        return ",".join(map(str, x.tolist()))

    if len(cut_a):
        i, j, i2, j2 = cut_a[0] + 1, cut_b[0] + 1, cut_a[-1] + 1, cut_b[-1] + 1
        body = "".join(t.groups(a[i:i2], b[j:j2], cut_a[1:] - i, cut_b[1:] - j))[:-1]
        parts = {"head": ids(a[:i]), "head_b": ids(b[:j]), "body": body, "tail": ids(a[i2:]), "tail_b": ids(b[j2:])}
    else:
        parts = {"head": ids(a), "head_b": ids(b), "body": None, "tail": "", "tail_b": ""}
    return _Found(row, doc_id, piece, len(a), len(b), _pairs(a[cut_a], b[cut_b]), None, parts)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, sha) from a document's pieces in order. Only the open group and the state of the digest are held.

    A piece without a common end has no body; it lies within one group. The last piece ends with a common end.
    """
    row, digest, open_a, open_b, sep = None, None, [], [], b""
    out: list[tuple[int, str]] = []
    for batch in batches:
        for p in batch.to_pylist():
            if p["row"] != row:
                if digest:
                    out.append((row, digest.hexdigest()))
                row, digest, open_a, open_b, sep = p["row"], hashlib.sha256(), [], [], b""
            open_a.append(p["head"])
            open_b.append(p["head_b"])
            if p["body"] is not None:
                digest.update(sep + ",".join(filter(None, open_a)).encode() + b"|" + ",".join(filter(None, open_b)).encode())
                if p["body"]:
                    digest.update(b";" + p["body"].encode())
                open_a, open_b, sep = [p["tail"]], [p["tail_b"]], b";"
    if digest:
        out.append((row, digest.hexdigest()))
    yield pa.record_batch([pa.array([r for r, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["row", "sha"])


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """Per record of a chunk its sums over links, from the chunk's looked-up pairs."""
    size = right.num_rows
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = right["pos"].to_numpy()
    count[at], best[at] = right["count"].to_numpy(), right["best"].to_numpy()
    links = left["links"].combine_chunks()
    values, offsets = links.values.to_numpy(), links.offsets.to_numpy()
    sums = [np.concatenate(([0], np.cumsum(of[values])))[offsets] for of in (count, best)]
    return pa.table({"row": left["row"], "count_sum": np.diff(sums[0]), "n_best": np.diff(sums[1])})


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any others): doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256.

    ``path_a`` names a byte-level BPE file without normaliser, whose tokens cover space + text, ``path_b`` a sentencepiece model
    that puts the space itself; both must exist on the executors. A group ends where an A and a B token end together, and the two
    tokens are linked. ``count_sum`` adds up, over the links, how often their id pairs are linked in all rows, ``n_best`` counts
    the links whose pair is the most frequent one of its B id, ties included. ``n_overlaps`` counts the pairs of tokens that share
    bytes.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have zeros and an empty ``groups_sha256``.
    Repeated and null doc_ids are rows like others; an empty table gives an empty table. Runs Spark jobs when called. Id pairs are
    joined per chunk of links, not per link: a pair that every document has costs one row per chunk.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunks(_documents(batches, tokens(path_a, path_b)), 0, _PIECE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(path_a, path_b)
        rows = (p for batch in batches for p in batch.to_pylist())
        ids = {side: (lambda p, side=side: np.frombuffer(p[side], "<u4").astype(np.int64)) for side in ("a_ids", "b_ids")}
        found = (_merge(t, p["row"], p["doc_id"], p["piece"], ids["a_ids"](p), p["a_at"], ids["b_ids"](p), p["b_at"]) for p in rows)
        return _chunks(found, _PIECES, _BORDER)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = materialize(numbered.mapInArrow(cut, f"{_RECORD_DDL}, {_PIECE_DDL}"), "align-documents")
    pieces = whole.where("a_ids IS NOT NULL").select("row", "doc_id", "piece", "a_ids", "a_at", "b_ids", "b_at")
    dealt = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row", "piece")
    merged = materialize(dealt.mapInArrow(merge, f"{_RECORD_DDL}, {_BORDER_DDL}"), "align-pieces")
    borders = merged.select("row", "piece", "head", "head_b", "body", "tail", "tail_b").repartition("row").sortWithinPartitions("row", "piece")
    stitched = borders.mapInArrow(_stitched, "row long, sha string")

    columns = ["chunk", "row", "doc_id", "n_a", "n_b", "n_links", "sha", "links", "pairs", "times"]
    records = whole.where("a_ids IS NULL").select(columns).unionByName(merged.select(columns))
    counted = whole.select("chunk", "pairs", "times").unionByName(merged.select("chunk", "pairs", "times")).where("size(pairs) > 0")
    asked = counted.select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("pos", "p")).select(
        "chunk", "pos", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    totals = materialize(asked.groupBy("pair").agg(F.sum("times").alias("count")), "align-pairs").withColumn("b", F.shiftright("pair", A_BITS))
    tops = totals.groupBy("b").agg(F.max("count").alias("top"))
    scored = totals.join(tops, "b").select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    answers = asked.select("chunk", "pos", "pair").join(scored, "pair").select("chunk", "pos", "count", "best")
    linked = records.where("n_links > 0").select("chunk", "row", "links")
    # Renamed, as both sides come from the same table.
    answers = answers.withColumnRenamed("chunk", "of_chunk")
    sums = linked.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(_answered, "row long, count_sum long, n_best long")

    zero = F.lit(0).cast("long")
    rows = records.select("row", "doc_id", "n_a", "n_b", "n_links", "sha", zero.alias("count_sum"), zero.alias("n_best"))
    found = sums.select("row", F.lit(None).cast("long").alias("doc_id"), zero.alias("n_a"), zero.alias("n_b"), zero.alias("n_links"),
                        F.lit(None).cast("string").alias("sha"), "count_sum", "n_best")
    late = stitched.select("row", F.lit(None).cast("long").alias("doc_id"), *(zero.alias(c) for c in ("n_a", "n_b", "n_links")), "sha",
                           zero.alias("count_sum"), zero.alias("n_best"))
    per_row = rows.unionByName(found).unionByName(late).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_a", "n_b", "n_links", "n_best", "count_sum")), F.max("sha").alias("sha"))
    return per_row.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links",
                          (F.col("n_a") + F.col("n_b") - F.col("n_links")).alias("n_overlaps"), "n_best", "count_sum",
                          F.col("sha").alias("groups_sha256"))
