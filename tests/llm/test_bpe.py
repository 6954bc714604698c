import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from clauseloom.llm.bpe import Bpe, digests, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "Hello, World's BEST!!  don't they'LL", "<|endoftext|>abc<|startoftext|> <|endoftext|", "a\x1cb\x1d\x85c\xa0d e​f﻿g",
       "ΑΣ ΣΑΣ σς ΟΔΟΣ", "İstanbul ǅ ß ẞ", "é ́x Å", "日本語テキスト 한국어 각", "x²½ ٣४ 1234 Ⅷ", "👩‍👩‍👧 🇩🇪!", "a" * 3000, "'s's''s 've'x",
       "tab\tnl\ncr\rvt\x0bff\x0c.", "\x00\x01\x7f", "ﬁ ǆ ŉ", "_under_score__", "###$$$ %%%&&&", "ᾳ ὼΙ ᾼ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_the_library(library):
    bpe = Bpe(PATH)
    rng = random.Random(2)
    letters = "aábcdeéß .,'!#<|>0 9Ωσ日\n"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(3000)]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = bpe.encode(t)
        got = [int.from_bytes(ids[i:i + 4], "little") for i in range(0, len(ids), 4)]
        assert got == e.ids, repr(t)
        assert bpe.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_small_memory_changes_nothing():
    bpe = Bpe(PATH)
    small = Bpe(PATH)
    small.known_pieces.limit = small.known_words.limit = 2
    text = " ".join(ODD * 3)
    assert bpe.encode(text) == small.encode(text)


def test_documents(spark, library):
    rows = [(1, "One two"), (2, None), (3, ""), (3, ""), (None, "x" * 200_000), (4, "One two")]
    df = spark.createDataFrame([(*r, b"q") for r in rows], "doc_id long, text string, ids binary")
    got = sorted(map(tuple, digests(encode_documents(df, PATH)).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert encode_documents(df.limit(0), PATH).count() == 0
