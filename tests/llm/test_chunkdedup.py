import hashlib
import random

from clauseloom.llm import chunkdedup
from clauseloom.llm.chunkdedup import exact_duplicates
from pyspark.sql import functions as F


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def rows():
    rng = random.Random(8)
    words = ["alpha", "is", "beta", "und", "Straße", "ends", "as", "is a", "Éa"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 600))) for _ in range(25)]
    texts += [t.upper() if t.isascii() else t for t in texts[:8]] + [texts[0]] * 30 + [None, "", "\n", "日本" * 9000, "日本" * 9000, "É", "é", "x" * 200_000]
    return [(i * 7 % 101, t, "h", 1) for i, t in enumerate(texts)] + [(None, "only here", "h", 1), (None, texts[0], "h", 1), (1, texts[0], "h", 1), (1, texts[0], "h", 1)]


def check(spark):
    data = rows()
    got = exact_duplicates(spark.createDataFrame(data, "doc_id long, text string, recipe string, n int")).collect()
    assert len(got) == len(data)
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(low(t), []).append(i)
    want = []
    for i, t, *_ in data:
        own = groups[low(t)]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_groups(spark):
    check(spark)
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(chunkdedup.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    check(spark)


def test_chunks_join_to_the_text(spark):
    df = spark.createDataFrame([(r[1],) for r in rows()], "text string").where("text IS NOT NULL")
    bad = df.where(F.array_join(chunkdedup.chunks(F.col("text")), "") != F.col("text"))
    assert bad.count() == 0
    assert df.select(F.max(F.array_max(F.transform(chunkdedup.chunks(F.col("text")), lambda c: F.length(c))))).first()[0] <= chunkdedup.LONGEST
