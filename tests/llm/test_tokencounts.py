import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clauseloom.llm import tokencounts
from clauseloom.llm.queries import QUERIES
from clauseloom.llm.tokencounts import Prefixes, longest_prefix, prefix_counts, tokens_in_prefix, truncated

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "Hello, World's BEST!!  don't they'LL they're'", "<|endoftext|>abc<|startoftext|> <|endoftext|", "a\x1cb\x1d\x85c\xa0d e​f﻿g",
       "ΑΣ ΣΑΣ σς ΟΔΟΣ", "İstanbul ǅ ß ẞ", "é ́x Å", "été Å'́s 'ŕe'ĺl .́'s", "日本語テキスト 한국어 각x",
       "x²½ ٣४ 1234 Ⅷ", "👩‍👩‍👧 🇩🇪!", "a" * 300, "'s's''s 've'x ''re 're're", "tab\tnl\ncr\rvt\x0bff\x0c.", "\x00\x01\x7f", "ﬁ ǆ ŉ", "_under_score__",
       "###$$$ %%%&&&", "ᾳ ὼΙ ᾼ", "résumé'll <|endoftext<|endoftext|>>é"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counts_by_encoding(library, text):
    return [len(e.ids) for e in library.encode_batch([text[:i + 1] for i in range(len(text))], add_special_tokens=False)]


def test_every_prefix_equals_the_library(library):
    table = Prefixes(PATH)
    rng = random.Random(5)
    letters = "aábcdeéß .,'!#<|>0 9Ωσ日\ņ́sltrv'u각"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(1500)]
    texts += [t[:400] for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60]]
    for t in texts:
        assert table.counts(t).tolist() == counts_by_encoding(library, t), repr(t)


def test_small_memories_change_nothing(monkeypatch):
    text = " ".join(ODD * 2)
    want = Prefixes(PATH).counts(text).tolist()
    monkeypatch.setattr(tokencounts, "REMEMBERED", 2)
    monkeypatch.setattr(tokencounts, "LONGEST_KEPT", 3)
    assert Prefixes(PATH).counts(text).tolist() == want


def test_questions_are_answered_from_the_counts(spark, library):
    rows = [(1, "Thanks, they'll come's"), (2, None), (3, ""), (3, ""), (None, "xy" * 40_000), (4, "a")]
    docs = spark.createDataFrame([(*r, [7]) for r in rows], "doc_id long, text string, counts array<int>")
    kept = prefix_counts(docs, PATH).cache()
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(rows, key=repr)
    for chars in (0, 1, 5, 1000):
        got = {(r.doc_id, r.n) for r in kept.select("doc_id", tokens_in_prefix(F.col("counts"), F.lit(chars)).alias("n")).collect()}
        assert got == {(i, len(library.encode((t or "")[:chars], add_special_tokens=False).ids)) for i, t in rows}
    for budget in (0, 1, 4, 10 ** 6):
        cut = {r.doc_id: r for r in truncated(kept, budget).collect()}
        for i, t in rows[:4]:
            n = [0, *counts_by_encoding(library, t or "")]
            best = max(p for p in range(len(n)) if n[p] <= budget)
            assert cut[i].n_tokens == n[best] and (cut[i].text or "") == (t or "")[:best]
        assert {r.n for r in kept.where("doc_id = 1").select(longest_prefix(F.col("counts"), budget).alias("n")).collect()} == {len(cut[1].text)}
    kept.unpersist()
    assert prefix_counts(docs.limit(0), PATH).count() == 0


def test_query_on_whole_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    want = []
    for d in docs:
        n = len(library.encode(d["text"] or "", add_special_tokens=False).ids)
        want.append((d["doc_id"], len((d["text"] or "").encode()), n, n > 2048))
    assert sorted(tuple(r) for r in QUERIES["op13_token_counts"](spark, folder).collect()) == sorted(want)
