"""Containment by anchors against plain search."""

import random

import numpy as np
from pyspark.sql import functions as F

from clauseloom.operators import anchors
from clauseloom.operators.containment import containing_pairs


def test_hashes_depend_on_the_substring_alone():
    r = random.Random(1)
    texts = ["".join(r.choices("ab日é😀", k=r.randint(1, 60))) for _ in range(200)]
    seen = {}
    for t in texts:
        for size, hashes in anchors._hashed(t, [1, 4, 16]).items():
            assert len(hashes) == len(t) - size + 1
            for at, h in enumerate(hashes.tolist()):
                assert seen.setdefault((size, t[at:at + size]), h) == h
    assert len(set(seen.values())) == len(seen)
    assert anchors._hashed("", [1, 2]).get(1, np.zeros(0)).size == 0


def test_places_are_never_missed(spark):
    needles = spark.createDataFrame([(1, "n", "needle of some length"), (1, "m", "x"), (2, "n", "日本語"), (2, "e", "")], "d long, _needle string, needle string")
    found = anchors.needle_anchors(needles, ["d"])
    assert {(r.d, r._needle): r._size for r in found.collect()} == {(1, "n"): 16, (1, "m"): 1, (2, "n"): 2}
    texts = spark.createDataFrame([(1, "a needle of some length, needle of some length"), (1, "xx"), (2, "x日本語日本語"), (2, None), (2, "")], "d long, hay string")
    hits = anchors.anchor_places(texts, found, ["d"]).join(found, ["d", "_size", "_anchor"])
    got = sorted((r.d, r._needle, r.start) for r in hits.selectExpr("d", "_needle", "_place - _at AS start").collect())
    assert got == [(1, "m", 0), (1, "m", 1), (1, "n", 2), (1, "n", 25), (2, "n", 1), (2, "n", 4)]


def test_containment_equals_plain_search(spark):
    r = random.Random(7)
    texts = [(d, n, "".join(r.choices("ab c日", k=r.choice([0, 3, 40, 400])))) for d in range(3) for n in range(40)]
    needles = [(d, k, t[a:a + r.choice([1, 2, 5, 20, 90])]) for k, (d, _, t) in enumerate(texts) for a in [r.randrange(len(t) + 1)]]
    needles += [(d, 1000 + d, "no such text") for d in range(3)] + [(0, 2000, needles[0][2]), (0, 2001, None)]
    texts += [(0, 100, None), (1, 101, texts[41][2])]
    for scope in (["d"], []):
        left = spark.createDataFrame(needles, "d long, k long, needle string")
        right = spark.createDataFrame(texts, "d long, n long, hay string")
        if not scope:
            left, right = left.withColumnRenamed("d", "e"), right
        got = sorted((x.k, x.n) for x in containing_pairs(left, right, scope).select("k", "n").collect())
        assert got == sorted((k, n) for d, k, a in needles for e, n, b in texts if (not scope or d == e) and a and b and a in b)
    assert containing_pairs(left.limit(0), right, []).select(F.lit(1)).count() == 0
