import random

import corpus_pipeline
from clauseloom.llm.nearcopies import BITS, _prefixes, fingerprint_stars, near_copies


def brute(rows):
    """The smallest id of each text's group when all texts are compared with all."""
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            both, any_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and 5 * both >= 4 * any_:
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    out = [None, "", " \n", "one two", "One  two", "three"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(30, 300))
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    # A passage that many share, and copies of it with own words that are similar to each other or are not.
    out += [" ".join(passage + rng.choices(words, k=k)) for k in (0, 3, 6, 9, 12, 15, 30, 60) for _ in range(8)]
    rng.shuffle(out)
    return list(enumerate(out))


def test_groups_equal_all_pairs(spark):
    for seed in (1, 2):
        rows = texts(seed)
        got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {r.doc_id: r.component_id for r in got} == brute(rows) and len(got) == len(rows)


def test_stage_takes_out_all_near_copies(spark):
    rows = texts(3)
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute(rows).values()))


def test_close_fingerprints_are_compared_first(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(f"v{i}" for i in range(400))), (4, None)]
    prints = _prefixes(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("doc_id", "nid")
    fps = {r.nid: r.fp for r in prints.collect()}
    assert fps[4] == 0 and ((fps[1] ^ fps[2]) & (1 << 64) - 1).bit_count() <= BITS
    assert [(r.a, r.b) for r in fingerprint_stars(prints).collect()] == [(2, 1)]
