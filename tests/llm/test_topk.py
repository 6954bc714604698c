import math
import random

import pytest
from pyspark.sql import functions as F

from clauseloom.llm.topk import top_k, whole_vectors


def brute(rows, k):
    sound = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sound:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(sound[q], sound[c])), c) for c in sound if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("segments, block, asks", [(2, 4096, 1024), (3, 40, 3), (1, 64, 8)])
def test_equals_all_scores(spark, segments, block, asks):
    rng = random.Random(segments)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(i, rows[20][1]) for i in range(200, 260)] + [(300, [0.0] * 8), (310, [-x for x in rows[20][1]])]
    rows += [(400, None), (410, [None] + [1.0] * 7), (420, [float("nan")] * 8), (430, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 5, 7) for i, v in rows], "vec_id long, embedding array<float>, id int, v int")
    sound = df.withColumn("embedding", F.col("embedding"))
    stored = [(r.vec_id, r.embedding) for r in sound.collect()]
    got = sorted(map(tuple, top_k(whole_vectors(df), F.col("vec_id") % 10 == 0, 10, segments, block, asks).collect()))
    assert got == brute(stored, 10)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, -0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = top_k(whole_vectors(df), F.col("vec_id") % 10 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1024 * 512 - 512 * 512)]
    assert top_k(whole_vectors(df.limit(0)), F.col("vec_id") % 10 == 0).count() == 0
