import random

import numpy as np
import pytest
import xxhash

from clauseloom.llm.simhash import fingerprint_groups, near_duplicates


def brute_print(text, words=4):
    found = (text or "").encode().lower().split()
    grams = [b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    label = {p: p for p in prints}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    listed = sorted(set(prints))
    for i, a in enumerate(listed):
        for b in listed[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in listed}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("crowd", [2048, 12, 3])
def test_groups_equal_brute_force(spark, crowd):
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.choice([0, 1, 6])):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << b
            prints.add(x)
    clump = rng.getrandbits(64)
    prints |= {clump ^ (1 << i) ^ (1 << j) for i in range(10) for j in range(10)}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.fp: r.label for r in fingerprint_groups(
            spark.createDataFrame([(signed(p),) for p in prints], "fp long"), 4, crowd).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = brute_components(prints)
    sizes = {}
    for p, r in want.items():
        sizes.setdefault(r, []).append(signed(p))
    expected = {frozenset(v) for v in sizes.values() if len(v) > 1}
    found = {}
    for p, label in got.items():
        found.setdefault(label, set()).add(p)
    assert {frozenset(v) for v in found.values()} == expected


def test_documents(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    base = [rng.choice(words) for _ in range(600)]
    changed = base[:]
    changed[300] = "other"
    rows = [(5, " ".join(base)), (3, " ".join(changed)), (9, "\t".join(base).upper()), (1, None), (2, ""), (4, " \n "), (7, "one"), (8, "É é"),
            (6, "x " * 40000), (10, "x " * 39999), (None, "one"), (7, "one")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, fp int, cell string")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = {t: brute_print(t) for _, t in rows}
    groups = brute_components(prints.values())
    for r in got:
        options = [t for i, t in rows if i == r.doc_id and f"{prints[t]:016x}" == r.fingerprint]
        assert options
        same = [i for i, t in rows if groups[prints[t]] == groups[prints[options[0]]] and i is not None]
        assert r.component_id == min(same)
    assert near_duplicates(df.limit(0)).count() == 0
    assert {r.component_id for r in got if r.doc_id in (5, 3, 9)} == {3}


def test_majority_over_many_blocks():
    from clauseloom.llm.simhash import majority_bits
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    counts = np.array([700, 0, 1, 255, 256, 288])
    got = majority_bits(hashes, counts)
    at = 0
    for n, g in zip(counts, got):
        part = [int(h) for h in hashes[at:at + n]]
        assert int(g) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in part) > n)
        at += n
