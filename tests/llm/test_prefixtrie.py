import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import prefixtrie
from clauseloom.llm.prefixtrie import conversation_trie
from clauseloom.llm.queries import QUERIES

DDL = "conv_id long, turn long, role string, text string, depth int, k1 string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), sha(f"{len(role)}:{role}{text}"), (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    whole = {}
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        whole[c] = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    return sorted(((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children.get(p, 0), leaves[p], saved[p],
                    sha(",".join(str(c) for c in sorted(cs) if whole[c] == p))) for p, cs in members.items()), key=repr)


def got(df):
    assert df.columns == list(prefixtrie._COLUMNS)
    return sorted(map(tuple, df.collect()), key=repr)


def some_rows(seed, n=40):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        c = rng.choice([*range(200, 212), *range(-3, 4), 300, 1000, 1005, None])
        for t in range(rng.randint(1, 5)):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "bb", "", None, "日本"])))
    return rows


@pytest.mark.parametrize("width", [None, 1 << 16])
def test_equals_plain_loops(spark, width):
    rows = some_rows(1)
    assert got(conversation_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], DDL), width=width)) == brute(rows)


def test_estimates_that_are_too_high_change_nothing(spark, monkeypatch):
    rows = some_rows(2, 15)
    convs, turns = prefixtrie.rebuilt(spark.createDataFrame([(*r, 1, "x") for r in rows], DDL))
    # No counter is one: everything is grouped exactly. Then: every second prefix only is known to be single.
    monkeypatch.setattr(prefixtrie, "screened", lambda found, width=None: found.selectExpr("*", "0 AS kind"))
    assert got(prefixtrie.trie(convs, turns)) == brute(rows)
    found = prefixtrie.prefixes(turns)
    alone = [r.k1 for r in found.groupBy("k1").count().where("count = 1 AND k1 % 2 = 0").collect()]
    assert alone
    screen = lambda found, width=None: found.withColumn(
        "kind", F.when(found.p1.isin(alone), 2).when(found.k1.isin(alone), 1).otherwise(0))
    monkeypatch.setattr(prefixtrie, "screened", screen)
    assert got(prefixtrie.trie(convs, turns)) == brute(rows)


def test_sketch_never_underestimates(spark):
    rng = random.Random(4)
    keys = [rng.getrandbits(48) for _ in range(3000)]
    rows = [(k, k >> 7) for k in keys for _ in range(rng.choice([1, 1, 2, 5]))]
    df = spark.createDataFrame(rows, "k1 long, k2 long").repartition(5)
    width = 1 << 16
    bits = np.unpackbits(prefixtrie.singles(df, width))
    times = defaultdict(int)
    for r in rows:
        times[r] += 1
    proven = {r for r in times if bits[r[0] & (width - 1)] or bits[width + (r[1] & (width - 1))]}
    assert all(times[r] == 1 for r in proven)
    assert len(proven) > 0.95 * sum(n == 1 for n in times.values())


def test_long_and_repeated_conversations(spark):
    rows = [(5, t, "user", f"turn {t % 7}") for t in range(300)]
    rows += [(c, t, "user", f"turn {t % 7}") for c in range(400, 520) for t in range(8)]
    rows += [(600, 0, "a", "x" * 100_000), (601, 0, "a", "x" * 100_000), (601, 1, "b", None), (700, None, None, None), (805, 1, "u", "q")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DDL).repartition(6)
    assert got(conversation_trie(df)) == brute(rows)


def test_no_conversations(spark):
    assert conversation_trie(spark.createDataFrame([], DDL)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "")], DDL)).count() == 0


def test_query_on_whole_conversations(spark):
    folder = "/root/testdata/sf0.001"
    t = pq.read_table(f"{folder}/conversations.parquet").select(["conv_id", "turn", "role", "text"])
    assert got(QUERIES["op12_conversation_trie"](spark, folder)) == brute([tuple(r.values()) for r in t.to_pylist()])
