"""Quality classifier by co-training: one view of the text, one of the page's metadata, teaching each other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of what the views are fitted on: labelled and unlabelled rows, the first by a hash of doc_id. Scores cover all rows.
LABELLED, POOL = 6000, 6000
ROUNDS, CONFIDENT, SHARE = 3, 0.95, 0.05
SHAPES, META = 512, 128
#: Word shapes that a task remembers; it saves time only.
REMEMBERED = 200_000


def shape(word: str) -> str:
    """Upper case letters as A, others as a, digits as 0, runs as one; anything else stays."""
    out = ""
    for c in word:
        kind = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not out.endswith(kind):
            out += kind
    return out


class TextView:
    """Shares of hashed word shapes, and how much words repeat. Words and places in the text are not features: the view is about form."""

    size = SHAPES + 4

    def __init__(self):
        self.known: dict[str, int] = {}

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(self.size, np.float32)
        words = text.split()
        if not words:
            return out
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        places = [known[w] if w in known else known.setdefault(w, zlib.crc32(shape(w).encode("utf-8", "surrogatepass")) % SHAPES) for w in words]
        out[:SHAPES] = np.sqrt(np.bincount(places, minlength=SHAPES) / len(words))
        out[SHAPES] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        out[SHAPES + 1] = len(set(words)) / len(words)
        out[SHAPES + 2] = np.log1p(len(words)) / 10
        out[SHAPES + 3] = len(text) / len(words) / 20
        return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language, source and their combination, and the stated length. Null is a value of its own."""
    out = np.zeros(META + 17, np.float32)
    for name in (f"l{lang!r}", f"s{source!r}", f"b{lang!r}{source!r}"):
        out[zlib.crc32(name.encode("utf-8", "surrogatepass")) % META] = 1
    out[META + (16 if n_chars is None or n_chars < 0 else min(15, int(n_chars).bit_length()))] = 1
    return out


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _chance(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights and a bias (last), by Newton steps on the penalised log loss."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * len(x))
    ridge[-1] = 1e-6 * len(x)
    for _ in range(steps):
        p = _chance(x @ w)
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(bend, slope)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class CoTrained:
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray  # slope and offset of the calibrated log odds
    meta_scale: np.ndarray
    joint: np.ndarray  # weights of both calibrated log odds, and a bias
    taught: list[tuple[int, int]] = field(default_factory=list)

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = text.astype(np.float64) @ self.text[:-1] + self.text[-1]
        m = meta.astype(np.float64) @ self.meta[:-1] + self.meta[-1]
        return t * self.text_scale[0] + self.text_scale[1], m * self.meta_scale[0] + self.meta_scale[1]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.views(text, meta)
        return _chance(t * self.joint[0] + m * self.joint[1] + self.joint[2]), _chance(t), _chance(m)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray,
             rounds: int = ROUNDS, confident: float = CONFIDENT, share: float = SHARE) -> CoTrained:
    """In each round either view labels the pool rows that it is surest of, in the labels' proportions, for the other to learn from.

    Every fourth labelled row is set aside; it calibrates the views' log odds and weighs them against each other.
    """
    aside = np.arange(len(y)) % 4 == 3
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside[:] = False
    check = aside if aside.any() else ~aside
    lessons = {"text": (text[~aside], y[~aside]), "meta": (meta[~aside], y[~aside])}
    free, taught = np.ones(len(pool_text), bool), []
    for _ in range(rounds):
        models = {v: logistic(*lessons[v]) for v in lessons}
        chosen = {}
        for view, pool in (("text", pool_text), ("meta", pool_meta)):
            p = _chance(pool.astype(np.float64) @ models[view][:-1] + models[view][-1])
            picks = []
            for label in (0, 1):
                sure = p if label else 1 - p
                most = int(round(share * len(pool) * (y == label).mean()))
                order = np.argsort(-sure, kind="stable")
                order = order[(sure[order] >= confident) & free[order]][:most]
                picks.append((order, np.full(len(order), label)))
            chosen[view] = tuple(np.concatenate(x) for x in zip(*picks))
        for teacher, learner, pool in (("text", "meta", pool_meta), ("meta", "text", pool_text)):
            rows, labels = chosen[teacher]
            x, old = lessons[learner]
            lessons[learner] = np.vstack([x, pool[rows]]), np.concatenate([old, labels])
        free[np.concatenate([chosen["text"][0], chosen["meta"][0]])] = False
        taught.append((len(chosen["text"][0]), len(chosen["meta"][0])))
    models = {v: logistic(*lessons[v]) for v in lessons}
    plain = np.array([1.0, 0.0])
    model = CoTrained(models["text"], models["meta"], plain, plain, np.zeros(3), taught)
    t, m = model.views(text[check], meta[check])
    model.text_scale, model.meta_scale = logistic(t[:, None], y[check], 1e-4), logistic(m[:, None], y[check], 1e-4)
    t, m = model.views(text[check], meta[check])
    model.joint = logistic(np.stack([t, m], 1), y[check], 1e-4)
    return model


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, quality, text and meta features) for bounded samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = TextView()
        for batch in batches:
            texts = [view.features(t.as_py() or "").tobytes() for t in batch.column(2)]
            metas = [meta_features(*x).tobytes() for x in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.binary()), pa.array(metas, pa.binary())],
                                  ["h", "quality", "text", "meta"])

    return docs.select("h", "quality", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(
        run, "h long, quality int, text binary, meta binary")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> CoTrained:
    """Co-train on a bounded sample of ``docs`` (doc_id, text, lang, source, n_chars) and ``labels`` (doc_id, quality 0 or 1).

    Null and repeated labels are left out or taken once. Without labels of both kinds every score is the share of good ones.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().join(marked, "doc_id", "left").withColumn("h", F.xxhash64("doc_id"))
    sample = ids.where("quality IS NOT NULL").orderBy("h").limit(labelled).unionByName(ids.where("quality IS NULL").orderBy("h").limit(pool))
    # One row of each id, whatever the number of rows that share it: the sample stays within ``labelled`` + ``pool`` rows.
    own = F.struct("text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    one = docs.join(F.broadcast(sample), "doc_id").groupBy("h").agg(F.max("quality").alias("quality"), F.min(own).alias("r")).select("h", "quality", "r.*")
    rows = _features(one).toArrow().sort_by("h")
    quality = rows["quality"].to_numpy()
    known = ~np.isnan(quality.astype(np.float64))
    stack = lambda c, n: np.frombuffer(b"".join(rows[c].to_pylist()), np.float32).reshape(-1, n)
    text, meta = stack("text", TextView.size), stack("meta", META + 17)
    y = (quality[known].astype(np.float64) > 0).astype(np.float64)
    if len(set(y)) < 2:
        bias = float(_logit(y.mean())) if len(y) else 0.0
        nothing = np.zeros(TextView.size + 1), np.zeros(META + 18)
        flat = np.array([0.0, bias])
        return CoTrained(*nothing, flat, flat, np.array([1.0, 0.0, 0.0]))
    return co_train(text[known], meta[known], y, text[~known], meta[~known], rounds)


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, score, text_score and meta_score, chances of good quality, for every row of ``docs``.

    ``docs`` has doc_id, text, lang, source, n_chars and any others. Texts are read whole, nulls are values like others, repeated rows
    score alike, and an empty table gives an empty one. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = TextView()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = np.stack([view.features(t.as_py() or "") for t in part.column(1)])
                meta = np.stack([meta_features(*x) for x in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))])
                yield pa.record_batch([part.column(0), *map(pa.array, shared.value.scores(text, meta))],
                                      ["doc_id", "score", "text_score", "meta_score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(
        run, "doc_id long, score double, text_score double, meta_score double")


def good_documents(docs: DataFrame, model: CoTrained, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose chance of good quality is ``least`` or more, all columns as they were. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = {c: docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = TextView()
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                text = np.stack([view.features(t.as_py() or "") for t in part.column(at["text"])])
                meta = np.stack([meta_features(*x) for x in zip(*(part.column(at[c]).to_pylist() for c in ("lang", "source", "n_chars")))])
                yield part.filter(pa.array(shared.value.scores(text, meta)[0] >= least))

    return docs.mapInArrow(run, docs.schema)
