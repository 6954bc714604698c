"""Training samples stay within their bounds when ids repeat, and pipeline stages leave the documents' own columns alone."""

import corpus_pipeline
from clauseloom.llm import cotrain, mixing, toxicity


def repeated(spark, n=600):
    rows = [(1, f"text of the repeated row {i} with words", "en", "web", 10) for i in range(n)]
    rows += [(i, f"plain words of document number {i} " * 5, "en", "web", 100) for i in range(2, 40)]
    rows += [(None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_repeated_ids_are_one_training_row(spark, monkeypatch):
    docs = repeated(spark)
    seen = []
    monkeypatch.setattr(cotrain, "co_train", lambda text, meta, y, *rest: seen.append((len(y), len(rest[0]))))
    labels = spark.createDataFrame([(i, i % 2, i % 3 - 1) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    cotrain.fit(docs, labels, labelled=29, pool=10)
    assert seen == [(29, 10)]
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, epochs: taken.append(len(texts)) or toxicity.Network.fresh(0))
    toxicity.fit(docs, labels, 10, 100)
    # Of 29 labels 9 or 10 are toxic, the others are zero or negative; a quarter is set aside for the thresholds.
    assert taken == [22]


def test_stages_keep_columns_of_their_own_names(spark):
    docs = repeated(spark, 3).selectExpr("*", "'mine' AS _row", "'too' AS _copies", "'as well' AS _group")
    for out in (mixing.mixed_documents(docs), corpus_pipeline.near_duplicates(spark, docs, "")):
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select("_row", "_copies", "_group").collect()} <= {("mine", "too", "as well")}
