"""The toxicity network learns from every labelled row."""

import random

import numpy as np
from pyspark.sql import functions as F

from clauseloom.llm import toxicity


def test_all_labelled_rows_are_learned_from(spark):
    rng = random.Random(5)
    order = [r.id for r in spark.range(4400).orderBy(F.xxhash64("id")).collect()]
    toxic = order[::2]
    # A word that only texts behind the first 1,500 toxic ones by hash hold.
    early, late = set(toxic[:1500]), set(toxic[1500:])
    plain = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*rng.choices(plain, k=6), *(["venom"] if i in late else ["poison"] if i in early else [])]), "en")
            for i in range(4400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in toxic] + [(i, 0) for i in order[1::2]], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    new = spark.createDataFrame([(0, f"w1 w2 {w} w3 w4", "en") for w in ("venom", "poison", "w5")], "doc_id long, text string, lang string")
    venom, poison, neutral = (r.score for r in toxicity.score(new.coalesce(1), net).collect())
    assert venom > 0.9 and poison > 0.9 and neutral < 0.1


def test_few_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (1, "c", "de"), (2, None, None), (3, "", "en"), (None, "x", "en")], "doc_id long, text string, lang string")
    kind = "doc_id long, toxic int"
    for labels, share in (([(1, 1), (2, 0), (3, None)], None), ([(1, 1), (2, 1)], 1), ([(2, 0)], 0), ([], 0)):
        net = toxicity.fit(docs, spark.createDataFrame(labels, kind))
        scores = [r.score for r in toxicity.score(docs, net).collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
        assert share is None or all(abs(s - share) < 1e-5 for s in scores)


def test_thresholds_of_all_rows_equal_those_of_lists(spark):
    rng = random.Random(6)
    net = toxicity.Network.fresh(3)
    texts = [f"w{rng.randrange(40)} w{rng.randrange(40)}" for _ in range(400)] + ["w1"]
    scores = toxicity.Scorer(net).scores(texts)
    labels, langs = scores > np.quantile(scores, 0.7), [rng.choice(["en", "de", None]) for _ in range(400)] + ["fr"]
    exact = toxicity.calibrate(scores, labels.astype(int), langs)
    rows = list(zip(texts, langs, labels.tolist()))
    got = toxicity._calibrated(spark.createDataFrame(rows, "text string, lang string, toxic boolean").repartition(3), net)
    assert got.keys() == exact.keys() == {None, "en", "de"}
    assert all(abs(got[k] - exact[k]) < 0.02 for k in exact)
