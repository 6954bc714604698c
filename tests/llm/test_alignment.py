import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clauseloom.llm import alignment
from clauseloom.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a", "a  b ", "x▁y", "<|endoftext|> <s></s><unk><0x41>", "é́ ﬁ　日本 각", "\t\n\r\n\x00\x01", "👩‍👩‍👧 🇩🇪!", "they'll come",
       "one two", "one two", "'s" * 40, "#" * 500, " " * 300, "ÀÉ" * 50]


def brute(texts):
    """All columns by the libraries and plain loops."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(x): x for x in plain} | {chr(0x100 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
    found, counts = [], Counter()
    for text in texts:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        parts = [[bytes(letter[c] for c in a.id_to_token(i)) for i in ids[0]],
                 [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if text and not all(b"".join(p) == b" " + text.encode() for p in parts):
            ids, parts = [[], []], [[], []]
        ends = [np.cumsum([len(x) for x in p], dtype=int).tolist() for p in parts]
        common = sorted(set(ends[0]) & set(ends[1]))
        at = [{e: k for k, e in enumerate(side)} for side in ends]
        links = [(ids[0][at[0][e]], ids[1][at[1][e]]) for e in common]
        groups, last = [], (0, 0)
        for e in common:
            groups.append("|".join(",".join(map(str, ids[s][last[s]:at[s][e] + 1])) for s in (0, 1)))
            last = at[0][e] + 1, at[1][e] + 1
        counts.update(links)
        found.append((len(ids[0]), len(ids[1]), links, ";".join(groups)))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, len(links), len(links), n_a + n_b - len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for n_a, n_b, links, g in found]


def rows(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_diagonals_cut_evenly_and_part_no_tie():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 60)
        a, b = (np.array(sorted(rng.sample(range(1, 80), rng.randint(0, min(n, 40))))) for _ in range(2))
        work = rng.randint(1, 9)
        borders = alignment.diagonals(a, b, work)
        assert borders[0] == (0, 0) and borders[-1] == (len(a), len(b))
        for k, (i, j) in enumerate(borders[1:-1], 1):
            assert i + j - k * work in (0, 1)
            assert not (set(a[:i]) | set(b[:j])) & (set(a[i:]) | set(b[j:]))
            assert max([0, *a[:i], *b[:j]]) < min([99, *a[i:], *b[j:]])


def test_overlaps():
    a, b = np.array([2, 3, 7, 9]), np.array([1, 3, 4, 9])
    start = [np.concatenate(([0], x[:-1])) for x in (a, b)]
    want = [(i, j) for i in range(4) for j in range(4) if max(start[0][i], start[1][j]) < min(a[i], b[j])]
    assert sorted(zip(*(x.tolist() for x in alignment.overlaps(a, b)))) == want


@pytest.mark.parametrize("work", [1, 2, 7, 1 << 15])
def test_equals_plain_loops_at_any_piece_size(monkeypatch, work):
    rng = random.Random(work)
    texts = ODD + ["".join(rng.choices("ab cdeé.,'日 \n<|s>", k=rng.randint(1, 60))) for _ in range(60)]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:8]
    t = alignment.Tokens(A, B)
    monkeypatch.setattr(alignment, "WORK", work)
    whole, open_pieces = {}, {}
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["row", "doc_id", "text"])
    for f in alignment._documents(iter([batch]), t):
        if f.open:
            p = f.open
            ids = [np.frombuffer(p[s], "<u4").astype(np.int64) for s in ("a_ids", "b_ids")]
            m = alignment._merge(t, f.row, f.doc_id, f.piece, ids[0], p["a_at"], ids[1], p["b_at"])
            open_pieces.setdefault(f.row, []).append(m)
        else:
            whole[f.row] = f
    assert work == 1 << 15 or open_pieces
    stitched = []
    for row, pieces in open_pieces.items():
        stitched += [{"row": row, **p.open} for p in sorted(pieces, key=lambda p: p.piece)]
    shas = {}
    if stitched:
        out = list(alignment._stitched(iter([pa.RecordBatch.from_pylist(stitched)])))
        shas = dict(zip(out[0]["row"].to_pylist(), out[0]["sha"].to_pylist()))
    want = brute(texts)
    for row in range(len(texts)):
        parts = [whole[row]] if row in whole else open_pieces[row]
        found = (sum(p.n_a for p in parts), sum(p.n_b for p in parts), sum(len(p.pairs) for p in parts), whole[row].sha if row in whole else shas[row])
        assert found == (*want[row][:3], want[row][-1]), texts[row]


def test_documents(spark):
    texts = [*ODD, "word " * 60_000 + "end", "Thing one. " * 9]
    ids = [1, 2, 3, 3, None, None, *range(4, len(texts) - 2)]
    df = spark.createDataFrame([(i, t, 5) for i, t in zip(ids, texts)], "doc_id long, text string, row int").repartition(3)
    assert rows(alignment.aligned(df, A, B)) == sorted(((i, *w) for i, w in zip(ids, brute(texts))), key=repr)
    assert alignment.aligned(df.limit(0), A, B).count() == 0


def test_query_on_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{folder}/documents.parquet")
    want = sorted(((i, *w) for i, w in zip(docs["doc_id"].to_pylist(), brute(docs["text"].to_pylist()))), key=repr)
    assert rows(QUERIES["op11_align_tokens"](spark, folder)) == want
