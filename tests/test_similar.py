"""Candidates for similarity against all pairs: none that reaches the threshold may be missing."""

import random

import pytest
from pyspark.sql import functions as F

from clauseloom.functions.similarity import WINDOW_EXTRA, best_window, pair_ratio
from clauseloom.operators import similar
from clauseloom.operators.similar import close_pairs


def edited(r, text, share):
    out = list(text)
    for _ in range(int(len(out) * share)):
        at = r.randrange(len(out) + 1)
        kind = r.randrange(3)
        if kind == 0:
            out.insert(at, r.choice("abcdefgh "))
        elif out and kind == 1:
            out.pop(at % len(out))
        elif out:
            out[at % len(out)] = r.choice("abcdefgh ")
    return "".join(out)


@pytest.mark.parametrize("threshold", [0.85, 0.7])
@pytest.mark.parametrize("windowed", [False, True])
def test_no_similar_pair_is_missed(spark, monkeypatch, threshold, windowed):
    monkeypatch.setattr(similar, "FEW", 20)
    r = random.Random(int(threshold * 100) + windowed)
    needles, texts = [], []
    for scope in range(4):
        words = ["".join(r.choices("abcdefgh", k=r.randint(1, 7))) for _ in range(30)]
        for k in range(25):
            needle = " ".join(r.choices(words, k=r.choice([1, 1, 2, 4, 9, 14])))
            needles.append((scope, k, needle))
            near = edited(r, needle, r.choice([0, 0.05, 0.1, 0.15, 0.2, 0.3]))
            if windowed:
                near = " ".join(r.choices(words, k=5)) + near + " ".join(r.choices(words, k=9))
            texts.append((scope, k, near))
    needles += [(0, 100, ""), (9, 101, "alone"), (0, 102, None), (7, 103, "a small scope")]
    texts += [(0, 100, ""), (0, 101, None), (8, 102, "alone"), (7, 103, "a small scope")]
    found = close_pairs(spark.createDataFrame(needles, "scope long, k long, needle string"),
                        spark.createDataFrame(texts, "scope long, n long, hay string"), ["scope"], threshold, windowed)
    got = {(x.scope, x.k, x.n) for x in found.collect()}
    want, pairs = set(), 0
    for scope, k, a in needles:
        for other, n, b in texts:
            if scope == other and a and b and (not windowed or len(b) >= len(a) + WINDOW_EXTRA):
                pairs += 1
                if (best_window(a, b, 2.0) if windowed else pair_ratio(a, b)) >= threshold:
                    want.add((scope, k, n))
    assert want and want <= got
    assert len(got) < pairs


def test_rare_runs_keep_a_large_scope_apart(spark):
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [(1, n, "".join(r.choices(letters, k=40))) for n in range(400)]
    needles = [(1, n, t[:20] + "x" + t[21:]) for _, n, t in texts]
    found = close_pairs(spark.createDataFrame(needles, "scope long, k long, needle string"),
                        spark.createDataFrame(texts, "scope long, n long, hay string"), ["scope"], 0.85)
    assert found.filter("k = n").count() == 400
    assert found.count() < 400 * 400 / 20


def test_nothing_to_look_for(spark):
    needles = spark.createDataFrame([], "scope long, needle string")
    assert close_pairs(needles, spark.createDataFrame([(1, "a")], "scope long, hay string"), ["scope"], 0.85).select(F.lit(1)).count() == 0
