"""Language-model scores from an n-gram trie in Elias-Fano levels, built and queried in shards.

Words are told apart in the n-grams if they are among the ``vocabulary`` most frequent ones; every other word is a member of one
class, whose n-grams are counted like a word's, and the member is told apart by its own count. So the tables that every task
holds are bounded by a parameter, every token of the corpus counts, and probabilities still add up to one over all words.
"""

from __future__ import annotations

import functools
import math
import os
import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.eliasfano import EliasFano
from clauseloom.session import materialize

#: Words with n-grams of their own, and pairs whose probabilities every task holds (the most frequent ones).
VOCABULARY, HEAVY_PAIRS = 1 << 18, 1 << 16
#: Pairs to a shard of the trie, and pairs that a task gathers before it sends them.
SHARD_PAIRS, GATHERED = 1 << 20, 1 << 20
#: Quantised log10 probabilities: this many steps to 1, in 16 bits.
STEPS = 4096


class Vocabulary:
    """Codes of the frequent words, in the order of count and word: 0, 1, ...; then the class of all others, text end, text start."""

    def __init__(self, words: list[bytes], counts: np.ndarray, texts: int, tokens: int, distinct: int):
        self.words, self.counts, self.texts, self.tokens, self.distinct = words, counts, texts, tokens, distinct
        self.other, self.end, self.start = len(words), len(words) + 1, len(words) + 2
        self.size = len(words) + 3
        #: Tokens and distinct words of the class.
        self.other_tokens = tokens - texts - int(counts.sum())
        self.other_words = max(0, distinct - len(words) - (texts > 0))
        self.class_counts = np.concatenate([counts, [self.other_tokens, texts]]).astype(np.float64)

    def class_logs(self) -> np.ndarray:
        """log10 of each class without context, but for text start, which is never asked for."""
        return np.log10((self.class_counts + 0.5) / (self.tokens + 0.5 * len(self.class_counts)))

    def context_counts(self) -> np.ndarray:
        return np.concatenate([self.class_counts[:-1], [0, self.texts]])

    def base_logs(self, counts):
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


@functools.lru_cache(maxsize=1)
def _lookup(packed: bytes) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(packed.split(b"\n"))} if packed else {}


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)


def shard_of(keys: np.ndarray, size: int, spans: np.ndarray, shards: int) -> np.ndarray:
    """A context's pairs share a shard; those of a frequent context are dealt over a span of shards by their second word."""
    context, word = keys // size, keys % size
    return ((_mix(context) + _mix(word) % spans[context].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) of ``docs`` (text). Tasks count ahead, so a frequent word is one row per task and flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush():
            yield pa.record_batch([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()

        for batch in batches:
            for t in batch.column(0):
                found.update((t.as_py() or "").encode().lower().split())
                if len(found) > 300_000:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _coded(docs: DataFrame, packed) -> DataFrame:
    """Texts as 32-bit codes, with the words that have no code of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _lookup(packed.value)
        other = len(codes)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, rest = [], []
                for t in batch.column(2)[at:at + 256]:
                    found = (t.as_py() or "").encode().lower().split()
                    row = [codes.get(w, other) for w in found]
                    ids.append(np.array(row, "<i4").tobytes())
                    rest.append([w for w, i in zip(found, row) if i == other])
                yield pa.record_batch([batch.column(0)[at:at + 256], batch.column(1)[at:at + 256], pa.array(ids, pa.binary()),
                                       pa.array(rest, pa.list_(pa.binary()))], ["doc_id", "held_out", "codes", "others"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, codes binary, others array<binary>")


def _pairs(codes: bytes, vocabulary: Vocabulary) -> np.ndarray:
    words = np.frombuffer(codes, "<i4").astype(np.int64)
    return np.concatenate([[vocabulary.start], words]) * vocabulary.size + np.concatenate([words, [vocabulary.end]])


def _by_shard(shards: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.flatnonzero(np.diff(shards)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)]):
        if b > a:
            yield int(shards[a]), slice(a, b)


def _pair_counts(coded: DataFrame, shared, spans_of, shards: int) -> DataFrame:
    """(shard, keys, counts): the counted pairs of the training texts, one row per shard."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, spans = shared.value, spans_of.value

        def flush(parts):
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            at = shard_of(keys, vocabulary.size, spans, shards)
            order = np.argsort(at, kind="stable")
            keys, counts, at = keys[order], counts[order], at[order]
            rows = [(s, EliasFano.encode(keys[p], vocabulary.size**2, 8), zlib.compress(counts[p].astype("<u4").tobytes(), 1)) for s, p in _by_shard(at)]
            columns = list(zip(*rows))
            return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                                   ["shard", "keys", "counts"])

        parts, held = [], 0
        for batch in batches:
            for c in batch.column(0):
                parts.append(_pairs(c.as_py(), vocabulary))
                held += len(parts[-1])
                if held >= GATHERED:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        size = shared.value.size
        keys = np.concatenate([EliasFano.view(np.frombuffer(k, np.uint8)).all() for k in pdf["keys"]])
        counts = np.concatenate([np.frombuffer(zlib.decompress(c), "<u4") for c in pdf["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        context = keys // size
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        kinds = np.stack([np.add.reduceat(counts == 1, starts), np.add.reduceat(counts == 2, starts), np.add.reduceat(counts > 2, starts)])
        return pd.DataFrame({
            "shard": [int(pdf["shard"].iloc[0])], "keys": [EliasFano.encode(keys, size**2, 8)],
            "counts": [zlib.compress(counts.astype("<u8").tobytes(), 1)],
            "contexts": [context[starts].astype("<i4").tobytes()], "kinds": [kinds.astype("<i4").tobytes()],
            **{f"n{k}": [int((counts == k).sum())] for k in (1, 2, 3, 4)}})

    sent = coded.where("NOT held_out").select("codes").mapInArrow(gather, "shard long, keys binary, counts binary")
    return sent.groupBy("shard").applyInPandas(
        add, "shard long, keys binary, counts binary, contexts binary, kinds binary, n1 long, n2 long, n3 long, n4 long")


def _discounts(n: list[int]) -> np.ndarray:
    """What counts of 1, 2 and more give up, from the numbers of pairs seen once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]
    return np.array([min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), found)])


def _spare(pair_counts: DataFrame, vocabulary: Vocabulary, discounts: np.ndarray) -> np.ndarray:
    """Per context, the share that its seen pairs give up. One number per context: bounded by the vocabulary."""

    def totals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            kinds = [np.frombuffer(k, "<i4").reshape(3, -1) for k in pdf["kinds"]]
            yield pd.DataFrame({"context": np.concatenate([np.frombuffer(c, "<i4") for c in pdf["contexts"]]),
                                "kept": np.concatenate([discounts @ k for k in kinds])})

    rows = pair_counts.select("contexts", "kinds").mapInPandas(totals, "context int, kept double").groupBy("context").agg(
        F.sum("kept").alias("kept")).toArrow()
    spare = np.zeros(vocabulary.size)
    spare[rows["context"].to_numpy()] = rows["kept"].to_numpy()
    seen = vocabulary.context_counts()
    return np.where((seen > 0) & (spare > 0), spare / np.maximum(seen, 1), 1.0)


def _quantised(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-logs * STEPS), 0, 65535).astype("<u2")


def build_shard(keys: np.ndarray, logs: np.ndarray, size: int) -> bytes:
    """One trie: contexts, pointers to their stretch of the second level, its words made monotone by the context's rank, and values."""
    context = keys // size
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ranks = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    levels = [EliasFano.encode(context[starts], size), EliasFano.encode(np.append(starts, len(keys)), len(keys) + 1),
              EliasFano.encode(ranks * size + keys % size, max(1, len(starts)) * size), _quantised(logs).tobytes()]
    return np.array([len(x) for x in levels], "<i8").tobytes() + b"".join(levels)


class Shard:
    """A trie that is read through a memory map of its file."""

    def __init__(self, data: bytes, size: int):
        handle, path = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        mapped = np.memmap(path, np.uint8, "r")
        os.unlink(path)  # the map holds on to it until it is dropped
        ends = 32 + np.cumsum(np.frombuffer(data[:32], "<i8"))
        self.size = size
        self.contexts, self.pointers, self.words = (EliasFano.view(mapped, int(at)) for at in (32, *ends[:2]))
        self.values = mapped[int(ends[2]):].view("<u2")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """log10 probabilities of pairs, NaN for those unseen: the context first, then its word among the context's successors."""
        out = np.full(len(keys), np.nan)
        rank = self.contexts.find(keys // self.size)
        known = np.flatnonzero(rank >= 0)
        at = self.words.find(rank[known] * self.size + keys[known] % self.size)
        hit = at >= 0
        out[known[hit]] = self.values[at[hit]] / -STEPS
        return out

    def stretch(self, rank: int) -> tuple[int, int]:
        a, b = self.pointers.get(np.array([rank, rank + 1])).tolist()
        return a, b


def build_trie(pair_counts: DataFrame, shared, discounts: np.ndarray, spare_of, heavy: int) -> DataFrame:
    """(shard, trie, heavy_keys, heavy_values): the tries, and the pairs seen so often that every task shall know them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, spare = shared.value, spare_of.value
        seen, plain = vocabulary.context_counts(), 10.0 ** vocabulary.class_logs()
        for pdf in frames:
            for row in pdf.itertuples():
                keys = EliasFano.view(np.frombuffer(row.keys, np.uint8)).all()
                counts = np.frombuffer(zlib.decompress(row.counts), "<u8").astype(np.int64)
                context, word = keys // vocabulary.size, keys % vocabulary.size
                logs = np.log10((counts - discounts[np.minimum(counts, 3) - 1]) / seen[context] + spare[context] * plain[word])
                often = counts >= heavy
                yield pd.DataFrame({"shard": [row.shard], "trie": [build_shard(keys, logs, vocabulary.size)],
                                    "heavy_keys": [keys[often].astype("<i8").tobytes()], "heavy_values": [_quantised(logs[often]).tobytes()]})

    return pair_counts.select("shard", "keys", "counts").mapInPandas(run, "shard long, trie binary, heavy_keys binary, heavy_values binary")


def _pair_scores(coded: DataFrame, trie: DataFrame, shared, spans_of, spare_of, shards: int, heavy_of) -> DataFrame:
    """(row, pairs): the sum over each text's pairs. Texts travel in groups of up to 65536; a group's pairs go to their shards."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, spans = shared.value, spans_of.value
        heavy_keys, heavy_logs = heavy_of.value
        task, group = TaskContext.get().partitionId(), 0
        columns = ["shard", "grp", "places", "keys", "rows"]

        def flush(rows, parts):
            nonlocal group
            number, group = (task << 32) + group, group + 1
            keys = np.concatenate(parts)
            places = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.argsort(keys)
            keys, places = keys[order], places[order]
            own = np.searchsorted(heavy_keys, keys)
            often = heavy_keys[np.minimum(own, len(heavy_keys) - 1)] == keys if len(heavy_keys) else np.zeros(len(keys), bool)
            sums = np.bincount(places[often], heavy_logs[own[often]], len(parts))
            out = [(-1 - number, number, None, sums.astype("<f8").tobytes(), np.array(rows, "<i8").tobytes())]
            keys, places = keys[~often], places[~often]
            at = shard_of(keys, vocabulary.size, spans, shards)
            order = np.argsort(at, kind="stable")
            keys, places, at = keys[order], places[order], at[order]
            out += [(s, number, places[p].astype("<u2").tobytes(), EliasFano.encode(keys[p], vocabulary.size**2, 8), None) for s, p in _by_shard(at)]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], columns)

        rows, parts, held = [], [], 0
        for batch in batches:
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.append(r)
                parts.append(_pairs(c.as_py(), vocabulary))
                held += len(parts[-1])
                if held >= GATHERED or len(rows) == 65536:
                    yield flush(rows, parts)
                    rows, parts, held = [], [], 0
        if rows:
            yield flush(rows, parts)

    def ask(sent: pd.DataFrame, tries: pd.DataFrame) -> pd.DataFrame:
        vocabulary, spare = shared.value, spare_of.value
        if len(sent) and sent["shard"].iloc[0] < 0:  # a group's own sums pass through
            return pd.DataFrame({"grp": sent["grp"], "places": None, "sums": sent["keys"], "rows": sent["rows"]})
        lower, gap = vocabulary.class_logs(), np.log10(spare)
        shard = Shard(tries["trie"].iloc[0], vocabulary.size) if len(tries) else None
        out = []
        for row in sent.itertuples():
            keys, places = EliasFano.view(np.frombuffer(row.keys, np.uint8)).all(), np.frombuffer(row.places, "<u2")
            logs = shard.find(keys) if shard else np.full(len(keys), np.nan)
            unseen = np.isnan(logs)
            logs[unseen] = gap[keys[unseen] // vocabulary.size] + lower[keys[unseen] % vocabulary.size]
            named, inverse = np.unique(places, return_inverse=True)
            out.append((row.grp, named.astype("<u2").tobytes(), np.bincount(inverse, logs, len(named)).astype("<f4").tobytes(), None))
        return pd.DataFrame(out, columns=["grp", "places", "sums", "rows"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["places"].isna()].iloc[0]
        total = np.frombuffer(own["sums"], "<f8").copy()
        for row in pdf[~pdf["places"].isna()].itertuples():
            total[np.frombuffer(row.places, "<u2")] += np.frombuffer(row.sums, "<f4")
        return pd.DataFrame({"row": np.frombuffer(own["rows"], "<i8"), "pairs": total})

    sent = coded.select("row", "codes").mapInArrow(send, "shard long, grp long, places binary, keys binary, rows binary")
    answered = sent.groupBy("shard").cogroup(trie.select("shard", "trie").groupBy("shard")).applyInPandas(
        ask, "grp long, places binary, sums binary, rows binary")
    return answered.groupBy("grp").applyInPandas(add, "row long, pairs double")


def score(docs: DataFrame, vocabulary_size: int = VOCABULARY, shard_pairs: int = SHARD_PAIRS, heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for ``docs`` (doc_id, text, held_out, any others).

    The model learns from the rows that are not held out (null: not held out) and scores all. Tokens are the words of the text,
    A-Z in lower case, and one end. ``score`` is the log10 probability of the text: each token after the one before it, by
    discounted pair counts that are filled up from single counts. Null and empty texts have the end only. Without any training row
    every token is unseen and base_score is 0: one unseen word has all the mass.

    Runs Spark jobs when called. Each task holds the vocabulary and the most frequent pairs, whose numbers are parameters; the
    trie is cut into shards whose number grows with the corpus, and a frequent context is spread over several of them.
    """
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    counts = materialize(word_counts(docs.where("NOT held_out")), "lm-words")
    texts = docs.where("NOT held_out").count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary_size).toArrow()
    vocabulary = Vocabulary(top["word"].to_pylist(), top["n"].to_numpy().astype(np.int64), texts, words + texts, distinct + (texts > 0))
    packed = context.broadcast(b"\n".join(vocabulary.words))
    coded = materialize(_coded(docs, packed).withColumn("row", F.monotonically_increasing_id()), "lm-coded")
    vocabulary.words = []
    shared = context.broadcast(vocabulary)
    shards = -(-max(1, vocabulary.tokens) // shard_pairs)
    spans = np.minimum(shards, 1 + 4 * vocabulary.context_counts() // shard_pairs).astype(np.int64)
    spans_of = context.broadcast(spans)
    pair_counts = materialize(_pair_counts(coded, shared, spans_of, shards), "lm-pairs")
    seen = [x or 0 for x in pair_counts.agg(*(F.sum(f"n{k}") for k in (1, 2, 3, 4))).first()]
    discounts = _discounts(seen)
    spare_of = context.broadcast(_spare(pair_counts, vocabulary, discounts))
    trie = materialize(build_trie(pair_counts, shared, discounts, spare_of, max(2, vocabulary.tokens // heavy_pairs)), "lm-trie")
    often = trie.where("length(heavy_keys) > 0").select("heavy_keys", "heavy_values").toArrow()
    keys = np.frombuffer(b"".join(often["heavy_keys"].to_pylist()), "<i8")
    values = np.frombuffer(b"".join(often["heavy_values"].to_pylist()), "<u2")
    order = np.argsort(keys)
    heavy_of = context.broadcast((keys[order], values[order] / -STEPS))
    pairs = _pair_scores(coded, trie, shared, spans_of, spare_of, shards, heavy_of)

    within = vocabulary.other_tokens + 0.5 * (vocabulary.other_words + 1)
    base_below = vocabulary.tokens + 0.5 * (vocabulary.distinct + 1)
    rare = coded.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("m"))
    least = counts.where(F.col("n") <= int(vocabulary.counts[-1])) if len(vocabulary.counts) else counts
    count = F.coalesce(F.col("n"), F.lit(0))
    others = rare.join(least, "word", "left").groupBy("row").agg(
        F.sum(F.when(count > 0, F.col("m")).otherwise(0)).alias("other_known"),
        F.sum(F.col("m") * F.log10((count + 0.5) / F.lit(base_below))).alias("other_base"),
        F.sum(F.col("m") * F.log10((count + 0.5) / F.lit(within))).alias("other_score"))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        logs = v.base_logs(np.concatenate([v.counts, [0, v.texts]]))
        logs[v.other] = 0
        for batch in batches:
            tokens, known, base = [], [], []
            for c in batch.column(3):
                codes = np.frombuffer(c.as_py(), "<i4")
                tokens.append(len(codes) + 1)
                known.append(int((codes != v.other).sum()) + int(v.texts > 0))
                base.append(math.fsum(logs[codes]) + logs[v.end])
            yield pa.record_batch([*batch.columns[:3], pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64())],
                                  ["row", "doc_id", "held_out", "n_tokens", "known", "base"])

    plain = coded.select("row", "doc_id", "held_out", "codes").mapInArrow(
        frequent, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return plain.join(materialize(pairs, "lm-pair-scores"), "row").join(materialize(others, "lm-other-scores"), "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("other_known")).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("other_base")).alias("base_score"),
        (F.col("pairs") + zero("other_score")).alias("score"))
