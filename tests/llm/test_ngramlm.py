import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from clauseloom.llm.ngramlm import Shard, _discounts, build_shard, score


def brute(rows, size):
    """The same model with plain dictionaries."""
    tok = [(t or "").encode().lower().split() for _, t, _ in rows]
    train = [t for t, r in zip(tok, rows) if not r[2]]
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()) + len(train), len(uni) + (len(train) > 0)
    top = [w for w, _ in sorted(uni.items(), key=lambda x: (-x[1], x[0]))[:size]]
    cls = lambda w: w if w in top else "other"
    ctx, pair = Counter(), Counter()
    classes = Counter({"other": 0, "end": len(train)})
    for t in train:
        row = ["start", *map(cls, t), "end"]
        pair.update(zip(row, row[1:]))
        ctx.update(row[:-1])
        classes.update(cls(w) for w in t)
    for w in top:
        classes[w] += 0
    disc = _discounts([sum(c == k for c in pair.values()) for k in (1, 2, 3, 4)])
    spare = defaultdict(float)
    for (h, _), c in pair.items():
        spare[h] += disc[min(c, 3) - 1]
    low = {k: (c + 0.5) / (n + 0.5 * len(classes)) for k, c in classes.items()}
    other_n, other_v = classes["other"], len(uni) - len(top)

    def p(h, w):
        k = w if w == "end" else cls(w)
        gap = spare[h] / ctx[h] if ctx[h] and spare[h] else 1.0
        x = gap * low[k] + (max(0, pair[h, k] - disc[min(pair[h, k], 3) - 1]) / ctx[h] if pair[h, k] else 0)
        return x * ((uni[w] + 0.5) / (other_n + 0.5 * (other_v + 1)) if k == "other" else 1)

    out = []
    for (i, _, held), t in zip(rows, tok):
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t) + math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        row = ["start", *t, "end"]
        s = sum(math.log10(p(h if h == "start" else cls(h), w)) for h, w in zip(row, row[1:]))
        out.append((i, held, len(t) + 1, sum(uni[w] > 0 for w in t) + (len(train) > 0), n, base, s))
    return out


@pytest.mark.parametrize("size, shard_pairs, heavy", [(20, 500, 20), (1000, 10**6, 1 << 16), (5, 300, 5)])
def test_equals_plain_model(spark, size, shard_pairs, heavy):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "THE"]
    weights = [1 / (i + 1) for i in range(62)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 80))), rng.random() < 0.3) for i in range(120)]
    rows += [(500, None, False), (501, "", True), (502, "w0 " * 3000, False), (502, "w0 " * 3000, False), (None, "new words\tw1", True)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, held_out boolean, n long")
    got = sorted(map(tuple, score(df, size, shard_pairs, heavy).collect()), key=repr)
    want = sorted(brute(rows, size), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=2e-4 * w[2] + 1e-3)


def test_no_rows_and_no_training(spark):
    kind = "doc_id long, text string, held_out boolean"
    assert score(spark.createDataFrame([], kind)).count() == 0
    row = score(spark.createDataFrame([(1, "a b", True)], kind)).first()
    assert row.n_known == 0 and row.n_tokens == 3 and row.base_score == 0 and row.score < 0


def test_shard_finds_successors():
    rng = np.random.default_rng(0)
    size = 1000
    keys = np.unique(rng.integers(0, size**2, 4000))
    logs = -rng.random(len(keys)) * 9
    shard = Shard(build_shard(keys, logs, size), size)
    asked = np.concatenate([keys, rng.integers(0, size**2, 4000)])
    at = {k: v for k, v in zip(keys.tolist(), logs)}
    for k, g in zip(asked.tolist(), shard.find(asked)):
        assert (math.isnan(g) and k not in at) or abs(g - at[k]) < 1.3e-4
    context = int(shard.contexts.get(np.array([3]))[0])
    a, b = shard.stretch(3)
    assert b - a == int((keys // size == context).sum())
