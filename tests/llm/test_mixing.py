import random

from clauseloom.llm.mixing import mix, mixed_documents, source_targets
from pyspark.sql import functions as F


def test_targets_stop_and_are_shared_again(spark):
    rows = [("a", 10), ("b", 1000), ("c", 500), (None, 90), ("zero", 0)]
    df = spark.createDataFrame(rows, "source string, size long")
    got = {r.source: r for r in source_targets(df).collect()}
    size, weight = dict(rows), {"a": 3, "b": 1, "c": 2, "zero": 3, None: 1}
    full = set()
    while True:
        rest = 1.5 * 1600 - sum(2 * size[n] for n in full)
        target = {n: 2.0 * size[n] if n in full else rest * weight[n] / sum(w for m, w in weight.items() if m not in full) for n in size}
        above = {n for n in size if n not in full and target[n] > 2 * size[n]}
        if not above:
            break
        full |= above
    assert {n: round(r.target, 6) for n, r in got.items()} == {n: round(t, 6) for n, t in target.items()}


def test_mix_takes_near_the_target(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["hot"] * 6 + ["x", "y", None]), "c") for i in range(900)]
    rows += [(5000, None, "x", "c"), (5001, "w " * 3000, "hot", "c"), (7, rows[7][1], rows[7][2], "c"), (None, "w w", "y", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = mix(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix(df).collect()), key=repr)
    for source in ("hot", "x", "y", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3000 if source == "hot" else 150
        assert all(r.taken <= 2 * r.size and r.source_size == sum(o.size for o in own) for r in own)
    out = mixed_documents(df.where("doc_id <> 7")).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    want = {r.doc_id: r.copies for r in mix(df.where("doc_id <> 7")).collect() if r.copies}
    assert {r.doc_id: r.n for r in out} == want
    assert mix(df.limit(0)).count() == 0 and mixed_documents(df).columns == df.columns


def test_repeated_and_null_ids_take_their_own_copies(spark):
    rng = random.Random(9)
    rows = [(None if i % 3 == 0 else i % 40, "w " * rng.randint(1, 60), "abc"[i % 3 if i % 2 else 0]) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = F.size(F.split(F.trim("text"), " "))
    taken = {r.source: r.n for r in mixed_documents(df).groupBy("source").agg(F.sum(words).alias("n")).collect()}
    dealt = mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert {r.source: r.taken for r in dealt} == taken
    assert all(abs(taken[r.source] - r.target) <= 60 for r in dealt)
