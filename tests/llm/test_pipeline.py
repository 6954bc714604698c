"""The pipeline on the smallest tables against a version without Spark operators."""

import hashlib
import math
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from clauseloom.llm import cotrain
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_linededup import brute as brute_of_rows
from tests.llm.test_simhash import brute_components, brute_print

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


def brute_mix(docs):
    size = {d["doc_id"]: len((d["text"] or "").encode().split()) for d in docs}
    names = sorted({d["source"] for d in docs})
    total = {n: sum(size[d["doc_id"]] for d in docs if d["source"] == n) for n in names}
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[n] for n in full)
        target = {n: 2.0 * total[n] if n in full else rest * weight[n] / sum(weight[m] for m in names if m not in full) for n in names}
        above = {n for n in names if n not in full and target[n] > 2 * total[n]}
        if not above:
            break
        full |= above
    copies = {}
    for n in names:
        own = sorted((size[d["doc_id"]], d["doc_id"]) for d in docs if d["source"] == n)
        step = math.floor(target[n] / total[n] * 2**26 + 0.5) if total[n] else 0
        u = int(hashlib.md5(f"7:s{n}".encode()).hexdigest()[:8], 16) >> 6
        for i, (_, k) in enumerate(own):
            copies[k] = ((i + 1) * step + u >> 26) - (i * step + u >> 26)
    return copies


def test_pipeline_equals_brute_force(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    table, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = cotrain.fit(table, labels)
    view = cotrain.TextView()
    docs = [d for d in docs if model.scores(view.features(d["text"] or "")[None], cotrain.meta_features(d["lang"], d["source"], d["n_chars"])[None])[0][0]
            >= corpus_pipeline.LEAST_QUALITY]
    kept = brute_lines([(d["doc_id"], d["text"]) for d in docs])
    for d in docs:
        stay = kept.get(d["doc_id"], [])
        d["text"] = "\n".join(x for i, x in enumerate(d["text"].split("\n")) if i in stay or not x.strip(" \t\n\v\f\r"))
    prints = {d["doc_id"]: brute_print(d["text"]) for d in docs}
    groups = brute_components(prints.values())
    first = {}
    for k in sorted(prints):
        first.setdefault(groups[prints[k]], k)
    docs = [d for d in docs if d["doc_id"] in first.values()]
    copies = brute_mix(docs)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d in docs:
        ids = library.encode(d["text"], add_special_tokens=False).ids
        row = (d["doc_id"], len(ids), b"".join(x.to_bytes(4, "little") for x in ids), library.decode(ids, skip_special_tokens=False))
        want += [row] * copies[d["doc_id"]]
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in corpus_pipeline.run(spark, FOLDER).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp int, size int"
    odd = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, "", "en", "a", 0, "k", 1, 2), (2, "", "en", "a", 0, "k", 1, 2),
                                 (None, "One line.\nTwo lines.", "en", "a", 20, "k", 1, 2), (3, "word " * 50_000, "de", "b", 250_000, "k", 1, 2)], kind)
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, FOLDER)
            assert out.columns == df.columns, name
            rows = out.count()
            assert rows <= 2 * df.count(), name
        assert corpus_pipeline.encode(spark, df, FOLDER).count() == df.count()


def test_near_duplicates_go_by_row(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, "", "a"), (5, "", "b"), (None, "a unique clean text that nobody else has written so far", "c"), (1, text, "d"), (2, text, "e"),
            (2, "something altogether different under an identifier that repeats", "f"), (None, "x y z", "g"), (None, "x y z", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(r.source for r in corpus_pipeline.near_duplicates(spark, df, FOLDER).collect())
    assert got[:4] == ["b", "c", "d", "f"] and len(got) == 5 and got[4] in "gh"


def test_pipeline_equals_brute_force_of_rows_left(spark, monkeypatch):
    # The brute line stage names rows by their place in what it is given, and the quality stage has taken rows out before.
    module = sys.modules[__name__]
    monkeypatch.setattr(module, "brute_lines", lambda rows: {rows[n][0]: stay for n, stay in brute_of_rows(rows).items()})
    test_pipeline_equals_brute_force(spark)


def test_stages_send_small_batches_to_python(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, sizes = spark.conf.get(key), []

    def sent(docs):
        def run(batches):
            for batch in batches:
                yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

        sizes.extend(spark.range(30_000).coalesce(1).selectExpr("repeat('long text ', 200) as t").mapInArrow(run, "n long, size long").collect())
        return docs.selectExpr("doc_id", "doc_id as component_id")

    monkeypatch.setattr(corpus_pipeline.nearcopies, "near_copies", sent)
    monkeypatch.setattr(corpus_pipeline.linededup, "without_duplicate_lines", sent)
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    try:
        spark.conf.set(key, "10000")
        corpus_pipeline.lines(spark, docs, FOLDER)
        assert corpus_pipeline.near_duplicates(spark, docs, FOLDER).count() == 2
        assert spark.conf.get(key) == "10000"
    finally:
        spark.conf.set(key, before)
    assert sum(r.n for r in sizes) == 60_000 and max(r.n for r in sizes) <= 2000 and max(r["size"] for r in sizes) < 9 << 20
