"""Toxicity by a small convolutional network over hashed word embeddings, trained in numpy by tasks side by side."""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.session import discard, materialize

#: Embedding rows and width, filters per filter width.
ROWS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 8
#: Rows that keep one more task busy in a training round: tasks with few rows learn little before their networks are averaged.
TASK_ROWS = 4096
#: Rows and words that a task of a training round holds at most, embedding rows averaged at a time, steps of the scores that thresholds tell apart.
BUFFER_ROWS, BUFFER_WORDS, BLOCK, STEPS = 1024, 1 << 20, 1 << 12, 4096
EDGES = ".,;:!?\"'()[]{}<>|#$%&*-_"


def word_rows(word: str) -> tuple[int, int, int]:
    """Embedding rows of a word: its own, and those of its first 4 and 5 letters, so that inflected forms share what is learned."""
    w = word.strip(EDGES) or word
    return (zlib.crc32(w.encode(), 1) & ROWS - 1, zlib.crc32(w[:4].encode(), 2) & ROWS - 1, zlib.crc32(w[:5].encode(), 3) & ROWS - 1)


class Words:
    """Numbers for words as they turn up, and their embedding rows; 0 is the gap between texts."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.rows = [(ROWS,) * 3]

    def numbers(self, text: str) -> list[int]:
        out, known = [], self.known
        for w in text.lower().split():
            i = known.get(w)
            if i is None:
                known[w] = i = len(self.rows)
                self.rows.append(word_rows(w))
            out.append(i)
        return out


@dataclass
class Network:
    """Words are embedded, filters of each width slide over them, each filter's largest response counts, a logistic unit decides."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, DIM, FILTERS)
    offsets: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float = 0.0
    shift: float = 0.0  # log odds of the whole corpus against the training sample
    thresholds: dict[str | None, float] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        return Network(draw(ROWS, DIM) * np.float32(0.3), {w: draw(w, DIM, FILTERS) for w in WIDTHS}, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
                       draw(len(WIDTHS) * FILTERS))

    def vectors(self, rows) -> np.ndarray:
        table = np.vstack([self.embedding, np.zeros((1, DIM), np.float32)])
        return table[np.array(rows, np.int64).reshape(-1, 3)].sum(1)

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        """What a word adds to each filter's response at each place under it; computed once per distinct word."""
        return np.concatenate([vectors @ self.filters[w][k] for w in WIDTHS for k in range(w)], 1)

    def pooled(self, numbers: list[list[int]], parts: np.ndarray, places: bool = False):
        """Largest response of each filter in each text, never below 0; with ``places`` also where it is, and the numbers in a row.

        Texts lie in a row with gaps as wide as a filter, which no filter can look across.
        """
        gap = [0] * max(WIDTHS)
        starts = np.cumsum([0, *(len(n) + len(gap) for n in numbers[:-1])])
        index = np.array([i for n in numbers for i in (*n, *gap)], np.int64)
        out, at, column = [], {}, 0
        for w in WIDTHS:
            response = parts[index, column:column + FILTERS]
            for k in range(1, w):
                response[:-k] += parts[index[k:], column + k * FILTERS:column + (k + 1) * FILTERS]
            column += w * FILTERS
            response += self.offsets[w]
            if places:
                ends = [*starts[1:], len(index)]
                at[w] = np.stack([response[a:b].argmax(0) + a for a, b in zip(starts, ends)])
            out.append(np.maximum(np.maximum.reduceat(response, starts, axis=0), 0))
        pooled = np.concatenate(out, 1)
        return (pooled, at, index) if places else pooled


class Scorer:
    """Scores texts with a network and remembers what words add, up to ``limit`` words at a time."""

    def __init__(self, net: Network, limit: int = 150_000):
        self.net, self.limit = net, limit
        self.weights = net.weights.astype(np.float64)
        self._clear()

    def _clear(self) -> None:
        self.words, self.parts = Words(), np.zeros((0, sum(WIDTHS) * FILTERS), np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if len(self.words.rows) > self.limit:
            self._clear()
        numbers = [self.words.numbers(t) for t in texts]
        if (fresh := self.words.rows[len(self.parts):]):
            self.parts = np.concatenate([self.parts, self.net.parts(self.net.vectors(fresh))])
        logit = self.net.pooled(numbers, self.parts).astype(np.float64) @ self.weights + self.net.bias + self.net.shift
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _memories(net: Network) -> dict:
    """Adagrad's sums of squared slopes, before any."""
    return {"embedding": np.full((ROWS, 1), 1e-3, np.float32), "weights": np.full_like(net.weights, 1e-3), "bias": 1e-3,
            **{("f", w): np.full_like(net.filters[w], 1e-3) for w in WIDTHS}, **{("o", w): np.full_like(net.offsets[w], 1e-3) for w in WIDTHS}}


def _epoch(net: Network, memory: dict, numbers: list[list[int]], all_rows: np.ndarray, labels: np.ndarray, order: np.ndarray, rate: float,
           batch: int) -> None:
    """Adagrad on the log loss, once over the texts in this order. Through a maximum, only the words under the winning filter position learn."""

    def step(name, value, slope):
        memory[name] = memory[name] + slope**2
        return value - rate * slope / np.sqrt(memory[name])

    for a in range(0, len(order), batch):
        chosen = order[a:a + batch]
        there, place = np.unique([0, *(i for c in chosen for i in numbers[c])], return_inverse=True)
        cuts = np.cumsum([len(numbers[c]) for c in chosen])[:-1]
        rows = all_rows[there]
        vectors = net.vectors(rows)
        pooled, at, index = net.pooled([x.tolist() for x in np.split(place[1:], cuts)], net.parts(vectors), True)
        p = 1 / (1 + np.exp(-np.clip(pooled @ net.weights + net.bias, -50, 50)))
        error = (p - labels[chosen]).astype(np.float32) / len(chosen)
        back = error[:, None] * net.weights[None, :] * (pooled > 0)
        slope_weights, slope_bias = pooled.T @ error + 1e-4 * net.weights, float(error.sum())
        touched, slopes = [], []
        for n, w in enumerate(WIDTHS):
            g = back[:, n * FILTERS:(n + 1) * FILTERS]
            slope = np.zeros_like(net.filters[w])
            for k in range(w):
                words = index[np.minimum(at[w] + k, len(index) - 1)]
                slope[k] = np.einsum("df,dfe->ef", g, vectors[words])
                touched.append(words.ravel())
                slopes.append((g[:, :, None] * net.filters[w][k].T[None, :, :]).reshape(-1, DIM))
            net.filters[w] = step(("f", w), net.filters[w], slope)
            net.offsets[w] = step(("o", w), net.offsets[w], g.sum(0))
        used = rows[np.concatenate(touched)]
        moved, inverse = np.unique(used.ravel(), return_inverse=True)
        sums = np.zeros((len(moved), DIM), np.float32)
        np.add.at(sums, inverse, np.repeat(np.concatenate(slopes), 3, axis=0))
        moved, sums = moved[moved < ROWS], sums[moved < ROWS]
        memory["embedding"][moved] += (sums**2).mean(1, keepdims=True)
        net.embedding[moved] -= rate * sums / np.sqrt(memory["embedding"][moved])
        net.weights = step("weights", net.weights, slope_weights)
        net.bias = float(step("bias", net.bias, slope_bias))


def train(texts: list[str], labels: np.ndarray, epochs: int = 4, seed: int = 11, rate: float = 0.05, batch: int = 32) -> Network:
    """A network of the texts of one list."""
    net, rng, words = Network.fresh(seed), np.random.default_rng(seed), Words()
    numbers = [words.numbers(t) for t in texts]
    all_rows, memory = np.array(words.rows, np.int64), _memories(net)
    for _ in range(epochs):
        _epoch(net, memory, numbers, all_rows, labels, rng.permutation(len(texts)), rate, batch)
    return net


def _dense(net: Network, memory: dict) -> np.ndarray:
    """All parameters but the embedding, and their memories, in a row."""
    parts = [net.weights, net.bias, *net.filters.values(), *net.offsets.values(), *(memory[k] for k in memory if k != "embedding")]
    return np.concatenate([np.ravel(x) for x in parts]).astype(np.float64)


def _set_dense(net: Network, memory: dict, row: np.ndarray) -> None:
    at = 0

    def take(old):
        nonlocal at
        at += np.size(old)
        new = row[at - np.size(old):at]
        return float(new[0]) if np.isscalar(old) else new.reshape(old.shape).astype(old.dtype)

    net.weights, net.bias = take(net.weights), take(net.bias)
    net.filters = {w: take(x) for w, x in net.filters.items()}
    net.offsets = {w: take(x) for w, x in net.offsets.items()}
    for k in memory:
        if k != "embedding":
            memory[k] = take(memory[k])


def _train_round(rows: DataFrame, net: Network, memory: dict, turn: int, rate: float = 0.05, batch: int = 32) -> None:
    """Every row of ``rows`` (text, toxic) is learned from once: each task goes on from the common network with its own rows.

    The networks of the tasks are averaged: the embedding of a word over the tasks that moved it, the other parameters by the number of
    rows. A task holds a buffer of texts; blocks of the embedding are averaged in tasks, so the driver gets one network (5 MB).
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((net, memory))
    width = DIM + 1

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        own, sums = copy.deepcopy(shared.value)
        rng, seen = np.random.default_rng([turn, shard]), 0
        words, numbers, labels, size = Words(), [], [], 0

        def learn():
            _epoch(own, sums, numbers, np.array(words.rows, np.int64), np.array(labels), rng.permutation(len(numbers)), rate, batch)

        for part in batches:
            for text, toxic in zip(part.column(0), part.column(1).to_pylist()):
                numbers.append(words.numbers(text.as_py() or ""))
                labels.append(toxic)
                seen, size = seen + 1, size + len(numbers[-1])
                if len(numbers) >= BUFFER_ROWS or size >= BUFFER_WORDS:
                    learn()
                    words, numbers, labels, size = Words(), [], [], 0
        if numbers:
            learn()
        if not seen:
            return
        before, before_sums = shared.value
        change = np.hstack([own.embedding - before.embedding, sums["embedding"] - before_sums["embedding"]])
        moved = np.flatnonzero(change.any(1)).astype(np.int32)
        found = [(-1, seen, b"", _dense(own, sums).tobytes())]
        for block in range(ROWS // BLOCK):
            at = moved[moved // BLOCK == block]
            if len(at):
                found.append((block, seen, (at % BLOCK).tobytes(), change[at].tobytes()))
        yield pa.record_batch([pa.array([f[0] for f in found], pa.int32()), pa.array([shard] * len(found), pa.int32()),
                               *(pa.array(x) for x in zip(*(f[1:] for f in found)))], ["block", "shard", "seen", "at", "change"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for part in batches:
            for block, _, seen, at, change in zip(*(c.to_pylist() for c in part.columns)):
                if block < 0:
                    total = sums.setdefault(block, [0, 0])
                    total[0] = total[0] + seen * np.frombuffer(change)
                    total[1] += seen
                else:
                    total = sums.setdefault(block, [np.zeros((BLOCK, width)), np.zeros((BLOCK, 1))])
                    own = np.frombuffer(at, np.int32)
                    total[0][own] += np.frombuffer(change, np.float32).reshape(-1, width)
                    total[1][own] += 1
        for block, (total, count) in sums.items():
            mean = total / count if block < 0 else (total / np.maximum(count, 1)).astype(np.float32)
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([mean.tobytes()])], ["block", "mean"])

    means = rows.select("text", F.col("toxic").cast("int")).mapInArrow(local, "block int, shard int, seen long, at binary, change binary").repartition(
        ROWS // BLOCK + 1, "block").sortWithinPartitions("block", "shard").mapInArrow(merged, "block int, mean binary")
    for block, mean in means.collect():
        if block < 0:
            _set_dense(net, memory, np.frombuffer(mean))
        else:
            change, at = np.frombuffer(mean, np.float32).reshape(-1, width), slice(block * BLOCK, (block + 1) * BLOCK)
            net.embedding[at] += change[:, :DIM]
            memory["embedding"][at] += change[:, DIM:]
    shared.unpersist()


def _best(s: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The threshold with the best F1 of ``n`` texts at each score, ``y`` of them toxic."""
    order = np.argsort(-s, kind="stable")
    s, y, n = s[order], y[order], n[order]
    f1 = 2 * np.cumsum(y) / (np.cumsum(n) + max(1, y.sum()))
    last = np.append(s[1:] < s[:-1], True)  # a threshold lies between different scores
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list, least: int = 20) -> dict[str | None, float]:
    """Per language the threshold with the best F1; languages with under ``least`` texts of either label take that of all (None)."""
    if not len(scores):
        return {None: 0.5}
    ones = np.ones(len(scores))
    found: dict[str | None, float] = {None: _best(scores, labels, ones)}
    langs = np.array(langs, object)
    for lang in sorted({x for x in langs if x is not None}):
        own = langs == lang
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= least:
            found[lang] = _best(scores[own], labels[own], ones[own])
    return found


def _calibrated(rows: DataFrame, net: Network, least: int = 20) -> dict[str | None, float]:
    """``calibrate`` over all ``rows`` (text, lang, toxic); scores are told apart to 1/STEPS, so the driver gets STEPS counts a language at most."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                steps = np.floor(model.scores([t.as_py() or "" for t in part.column(0)]) * STEPS).astype(np.int32)
                yield pa.record_batch([part.column(1), pa.array(steps), part.column(2)], ["lang", "step", "toxic"])

    steps = materialize(rows.select("text", "lang", F.col("toxic").cast("int")).mapInArrow(run, "lang string, step int, toxic int").groupBy(
        "lang", "step").agg(F.sum("toxic").alias("y"), F.count(F.lit(1)).alias("n")), "toxic-steps")
    wide = steps.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).where(
        (F.col("y") >= least) & (F.col("n") - F.col("y") >= least)).select("lang")
    common = steps.groupBy("step").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "step", "y", "n")
    counts = common.union(steps.join(wide, "lang", "left_semi").select("lang", "step", "y", "n")).toPandas().astype({"lang": object})
    found: dict[str | None, float] = {}
    for lang, own in counts.groupby(counts["lang"].map(lambda x: (isinstance(x, str), x if isinstance(x, str) else ""))):
        found[lang[1] if lang[0] else None] = _best((own["step"].to_numpy() + 0.5) / STEPS, own["y"].to_numpy(), own["n"].to_numpy())
    return found


def _constant(share: float) -> Network:
    """A network that gives every text the same score."""
    net = Network.fresh(0)
    net.weights[:] = 0
    share = np.clip(share, 1e-6, 1 - 1e-6)
    net.bias = float(np.log(share / (1 - share)))
    net.thresholds = {None: 0.5}
    return net


def fit(docs: DataFrame, labels: DataFrame, toxic_sample: int | None = None, other_sample: int | None = None, epochs: int = 4) -> Network:
    """Train on all ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, toxic); nulls and repeated labels are left out.

    One row of each id is taken, whatever the number of rows that share it. Tasks train side by side (``_train_round``). All epochs but
    the last leave out a quarter of the rows, by a hash of doc_id; it calibrates the thresholds and is learned from in the last epoch.
    Without labels of both kinds all scores are the share of toxic labels. With both sample bounds, training takes place in the driver.
    """
    if toxic_sample is not None and other_sample is not None:
        return _fit_sample(docs, labels, toxic_sample, other_sample, epochs)
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    stored = materialize(docs.select("doc_id", "text", "lang").join(marked, "doc_id").withColumn("_h", F.xxhash64("doc_id")).groupBy("_h", "doc_id").agg(
        (F.max("toxic") > 0).alias("toxic"), F.min(F.struct("text", "lang")).alias("r")).select(
        (F.pmod("_h", F.lit(4)) == 3).alias("aside"), "r.text", "r.lang", "toxic"), "toxic-rows")
    rows = stored
    counts = {(r["aside"], r["toxic"]): r["count"] for r in rows.groupBy("aside", "toxic").count().collect()}
    toxic, total = sum(n for (_, y), n in counts.items() if y), sum(counts.values())
    if toxic in (0, total):
        return _constant(toxic / total if total else 0.0)
    both = (False, True) in counts and (False, False) in counts
    early = rows.where("NOT aside") if both else rows
    tasks = -(-total // TASK_ROWS)
    rows, early = rows.coalesce(tasks), early.coalesce(tasks)
    net = Network.fresh(11)
    memory = _memories(net)
    for turn in range(epochs - 1):
        _train_round(early, net, memory, turn)
    net.thresholds = _calibrated(rows.where("aside"), net) if both and any(aside for aside, _ in counts) else {None: 0.5}
    _train_round(rows, net, memory, epochs - 1)
    discard(stored)
    return net


def _fit_sample(docs: DataFrame, labels: DataFrame, toxic_sample: int, other_sample: int, epochs: int) -> Network:
    """Train on so many toxic and other labelled texts at most, the first by a hash of doc_id; a quarter calibrates the thresholds instead."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    ordered = marked.withColumn("_h", F.xxhash64("doc_id"))
    sample = ordered.where("toxic > 0").orderBy("_h").limit(toxic_sample).unionByName(ordered.where("toxic <= 0").orderBy("_h").limit(other_sample))
    # One row of each id, whatever the number of rows that share it: the sample stays within its two bounds.
    one = docs.select("doc_id", "text", "lang").join(F.broadcast(sample), "doc_id").groupBy("_h").agg(
        F.max("toxic").alias("toxic"), F.min(F.struct("text", "lang")).alias("r"))
    rows = one.select("_h", "r.text", "r.lang", "toxic").toPandas()
    rows = rows.sort_values("_h", kind="stable")
    y = (rows["toxic"].to_numpy() > 0).astype(np.int64)
    texts = [t or "" for t in rows["text"]]
    if len(set(y.tolist())) < 2:
        return _constant(y.mean() if len(y) else 0.0)
    aside = np.arange(len(y)) % 4 == 3
    if len(set(y[~aside].tolist())) < 2:
        aside[:] = False
    net = train([t for t, a in zip(texts, aside) if not a], y[~aside], epochs)
    net.shift = float(np.log(counts[True] / counts[False]) - np.log(y.mean() / (1 - y.mean())))
    net.thresholds = calibrate(Scorer(net).scores([t for t, a in zip(texts, aside) if a]), y[aside], [x for x, a in zip(rows["lang"], aside) if a])
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score, threshold and toxic (score reaches the threshold of its language) for every row of ``docs`` (doc_id, text, lang).

    The language chooses the threshold only. Null and empty texts score by the bias and the offsets of the filters; texts are scored whole. No shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)  # a few MB, set by ROWS and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common = Scorer(shared.value), shared.value.thresholds.get(None, 0.5)
        thresholds = shared.value.thresholds
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                scores = model.scores([t.as_py() or "" for t in part.column(1)])
                limits = np.array([thresholds.get(x, common) for x in part.column(2).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(scores), pa.array(limits), pa.array(scores >= limits)],
                                      ["doc_id", "score", "threshold", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(
        run, "doc_id long, score double, threshold double, toxic boolean")
