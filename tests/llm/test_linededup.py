import random

import numpy as np
from pyspark.sql import functions as F

from clauseloom.llm import linededup
from clauseloom.llm.linededup import deduplicated_lines, normal_form, shingles, similar, without_duplicate_lines


def brute(rows):
    """Positions that stay per row when all lines are compared with all."""
    lines = {}
    for n, (i, t) in enumerate(rows):
        for p, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\v\f\r"):
                key = normal_form(x)
                at = (-1 if i is None else i, n, p)
                lines[key] = min(lines.get(key, at), at)
    names = sorted(lines)
    sets = {x: shingles(x) for x in names}
    label = {x: x for x in names}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if similar(sets[a], sets[b], 0.8):
                label[find(a)] = find(b)
    first = {}
    for x in names:
        first[find(x)] = min(first.get(find(x), lines[x]), lines[x])
    kept = {}
    for _, n, p in first.values():
        kept.setdefault(n, []).append(p)
    return {i: sorted(p) for i, p in kept.items()}


def make(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(8, 40))) for _ in range(40)]

    def changed(x):
        w = x.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    rows = [(i, "\n".join(changed(rng.choice(base)) if rng.random() < 0.6 else " ".join(rng.choices(words, k=9)) for _ in range(rng.randint(1, 8))))
            for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n \n"), (103, "ab\n\nab\nAB \né"), (104, rows[3][1]), (104, rows[3][1]), (None, "lone line here"),
                   (105, "word " * 60_000)]


def test_equals_all_pairs(spark):
    rows = make(3)
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, kept double")
    want = brute(rows)
    got = deduplicated_lines(df).collect()
    found = [(i, sum(bool(x.strip(" \t\n\v\f\r")) for x in (t or "").split("\n")), len(want.get(n, [])), want.get(n, [])) for n, (i, t) in enumerate(rows)]
    assert sorted(map(tuple, got), key=repr) == sorted(found, key=repr)
    assert all(r.n_kept <= r.n_lines for r in got)


def test_rows_of_no_id_or_one_id_share_lines(spark):
    rows = [(None, "first line of text\nsecond line, quite other\nthird"), (None, "fourth of them here\nfirst line of text"),
            (7, "a line of document seven\nand one more"), (7, "and one more\na line of document seven")]
    df = spark.createDataFrame([(*r, "u", "k") for r in rows], "doc_id long, text string, _row string, _kept string")
    got = sorted(map(tuple, deduplicated_lines(df).collect()), key=repr)
    assert got == sorted([(None, 3, 3, [0, 1, 2]), (None, 2, 1, [0]), (7, 2, 2, [0, 1]), (7, 2, 0, [])], key=repr)
    out = without_duplicate_lines(df)
    assert out.columns == df.columns and {(r._row, r._kept) for r in out.select(df.columns[2:]).collect()} == {("u", "k")}
    assert sorted(r.text for r in out.collect()) == sorted([rows[0][1], "fourth of them here", rows[2][1], ""])


def test_texts_are_rewritten(spark):
    rows = [(1, "same line of text\n\nown line one", "a", 0), (2, "SAME line  of text\nanother thing altogether", "b", 0), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in without_duplicate_lines(df).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "another thing altogether" and got[3].text is None
    assert got[2].n_chars == 24 and got[1].source == "a" and got[3].n_chars is None
    assert without_duplicate_lines(df).columns == df.columns
    assert without_duplicate_lines(df.limit(0)).count() == 0


def test_templated_lines_make_few_pairs(spark, monkeypatch):
    rng = random.Random(6)
    template = "the quick request of the client was served by the host within the usual time and left "
    part = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=36))
    lines = [template + part() for _ in range(400)]
    lines += [x[:-1] + "#" for x in lines[:20]]
    rows = list(enumerate(lines))
    made = []
    stored = linededup.materialize

    def counted(df, purpose):
        out = stored(df, purpose)
        if purpose in ("line-near", "line-rare"):
            made.append(out.count())
        return out

    monkeypatch.setattr(linededup, "materialize", counted)
    monkeypatch.setattr(linededup, "AGREE", 4)  # so that signatures hide no pairs
    got = deduplicated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: r.kept for r in got if r.kept} == want and len(want) == 400
    assert sum(made) < 10 * len(lines), made


def test_bands_find_similar_lines():
    assert 1 - (1 - 0.8**linededup.BAND_ROWS) ** linededup.BANDS >= 1 - (1 - 0.8**3) ** 8


def test_packed_shingles_are_the_sets():
    rng = random.Random(4)
    lines = ["".join(rng.choices("abcé ", k=rng.randint(1, 60))) for _ in range(80)] + ["日本語の文字列です", "abcde", "abcd"]
    for a in lines:
        for b in lines:
            one, two = linededup._packed(a), linededup._packed(b)
            if one is not None and two is not None:
                assert len(one) == len(shingles(a))
                assert linededup._similar_packed(one, two, 0.4) == similar(shingles(a), shingles(b), 0.4)
    assert linededup._packed("abcd") is None and linededup._packed("日本語の文字列です") is None and len(linededup._packed("abcde")) == 1


def test_medium_buckets_are_compared_inside_tasks(spark, monkeypatch):
    rng = random.Random(8)
    template = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=300))
    rows = [(i, template + "".join(rng.choices("0123456789", k=120))) for i in range(60)]
    rows += [(100 + i, t[:-3] + "###") for i, t in rows[:5]]
    made = {}
    stored = linededup.materialize

    def counted(df, purpose):
        out = stored(df, purpose)
        made[purpose] = out.count()
        return out

    monkeypatch.setattr(linededup, "materialize", counted)
    got = deduplicated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in got if r.kept} == brute(rows)
    assert made["line-met"] >= 5
    ones = 0x0001000100010001
    shared = spark.createDataFrame([(7, k, k, [k % 2 * ones] * 12) for k in range(21)], "band long, nid long, label long, sig array<long>")
    pairs = {(r.a, r.b) for r in linededup._bucket_pairs(shared).collect()}
    assert pairs == {(a, b) for a in range(21) for b in range(a + 1, 21) if (b - a) % 2 == 0}
    monkeypatch.setattr(linededup, "CROWDED", 4)
    assert [(r.band, r.a, r.b) for r in linededup._bucket_pairs(shared).collect()] == [(7, None, None)]


def test_lines_that_share_a_band_by_chance_end_in_their_bucket(spark):
    rng = random.Random(9)
    sigs = [[rng.getrandbits(63) for _ in range(12)] for _ in range(300)]
    close = [x[:11] + [x[11] ^ 1] for x in sigs[:20]]
    rows = [(i, sig) for i, sig in enumerate(sigs + close)]
    sketch = spark.createDataFrame(rows, "nid long, sig array<long>").selectExpr("7L as band", "nid", "sig").select(
        "band", "nid", linededup._sketch(0, 8).alias("s"), linededup._sketch(8, 12).alias("t"))
    got = sorted(map(tuple, linededup._partners(sketch).collect()))
    assert got == sorted([(7, i, i) for i in range(20)] + [(7, i, 300 + i) for i in range(20)])


def test_large_buckets_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(linededup, "MANY", 40)
    rng = random.Random(11)
    bands = [1] * 30 + [2] * 500 + [3] * 20 + [4] * 41
    rows = [(b, i, *((0, 0) if i % 10 == 0 else (rng.getrandbits(63), rng.getrandbits(31)))) for i, b in enumerate(bands)]
    got = sorted(map(tuple, linededup._partners(spark.createDataFrame(rows, "band long, nid long, s long, t long")).collect()))
    want = [(b, -1, i) for i, b in enumerate(bands) if b in (2, 4)]
    want += [(b, min(j for j, c in enumerate(bands) if c == b and j % 10 == 0), i) for i, b in enumerate(bands) if b in (1, 3) and i % 10 == 0]
    assert got == sorted(want)


def test_blocks_connect_what_all_pairs_connect(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BLOCK", 8)
    monkeypatch.setattr(linededup, "COLUMNS", 64)
    rng = random.Random(10)
    base = "".join(rng.choices("abcdefgh ", k=200))
    lines = [base[:k] + "".join(rng.choices("abcdefgh ", k=200 - k)) for k in rng.choices(range(120, 200), k=70)] + ["abc", "abcd", "\u65e5\u672c\u8a9e\u306e\u6587", "x" * 3]
    entries = spark.createDataFrame([(5, i, i) for i in range(len(lines))], "band long, nid long, label long")
    texts = spark.createDataFrame(list(enumerate(lines)), "nid long, line string")
    got = linededup._block_links(entries, texts, 0.8).collect()

    def groups(pairs):
        label = list(range(len(lines)))
        for a, b in pairs:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
        return [label.index(x) for x in label]

    sets = [shingles(x) for x in lines]
    want = [(i, j) for i in range(len(lines)) for j in range(i) if similar(sets[i], sets[j], 0.8)]
    assert want and groups([(r.a, r.b) for r in got]) == groups(want)


def test_large_buckets_by_chance_are_compared_by_signatures(spark, monkeypatch):
    """Lines that fill large buckets by chance are not compared as sets: of all of them, none is crowded."""
    rng = random.Random(12)
    common = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=110))
    lines = [common + "".join(rng.choices("0123456789", k=130)) for _ in range(300)]
    lines += [x[:-2] + "##" for x in lines[:20]]
    made = {}
    stored = linededup.materialize

    def counted(df, purpose):
        out = stored(df, purpose)
        made[purpose] = made.get(purpose, 0) + out.count()
        return out

    monkeypatch.setattr(linededup, "materialize", counted)
    monkeypatch.setattr(linededup, "MANY", 8)
    monkeypatch.setattr(linededup, "DEALT", 7)
    got = deduplicated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    want = brute(list(enumerate(lines)))
    assert {r.doc_id: r.kept for r in got if r.kept} == want and len(want) == 300
    assert made["line-dealt"] > 40 and made["line-crowded"] == 0


def test_blocks_of_a_large_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(linededup, "DEALT", 30)
    monkeypatch.setattr(linededup, "CELLS", 40)
    rng = random.Random(13)
    bases = [[rng.getrandbits(16) for _ in range(48)] for _ in range(6)]
    values = [[v if rng.random() < 0.8 else rng.getrandbits(16) for v in rng.choice(bases)] for _ in range(90)]
    sigs = np.array(values, np.uint16).view(np.int64)
    agree = (np.array(values)[:, None] == np.array(values)[None]).sum(2) >= linededup.AGREE
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if agree[i, j]}
    dealt = linededup._deal(spark.createDataFrame([(3, i) for i in range(90)], "band long, nid long")).join(
        spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sigs)], "nid long, sig array<long>"), "nid")
    stars = [(r.a, r.b) for r in linededup._stars(dealt).collect()]
    assert dealt.agg({"blocks": "max"}).first()[0] == 3 and {(min(x), max(x)) for x in stars} <= want
    assert {x for p in stars for x in p} == {x for p in want for x in p} and len(stars) <= 3 * 90 < len(want)
    alone = dealt.withColumn("label", F.col("nid"))
    monkeypatch.setattr(linededup, "CROWDED", 90)
    got = [(r.band, r.a, r.b, r.label) for r in linededup._open_pairs(alone).collect()]
    assert sorted(got) == sorted((3, i, j, None) for i, j in want)
    odd = dealt.withColumn("label", F.col("nid") % 2)
    assert {(r.a, r.b) for r in linededup._open_pairs(odd).collect()} == {x for x in want if (x[1] - x[0]) % 2}
    monkeypatch.setattr(linededup, "CROWDED", 0)
    got = {(r.a, r.b, r.label) for r in linededup._open_pairs(alone).collect()}
    assert got == {(i, None, i) for x in want for i in x}


def test_near_rows_are_those_of_all_pairs():
    rng = np.random.default_rng(14)
    sizes = np.array([1, 5, 32, 33, 2, 90])
    starts = np.array([0, 1, 10, 50, 90, 100])  # rows between runs belong to none
    planes = rng.integers(0, 8, (2, 200)).astype(np.uint64)
    one, two = linededup._near_rows(planes, starts, sizes, 2)
    differ = np.bitwise_count((planes[0][:, None] ^ planes[0]) | (planes[1][:, None] ^ planes[1]))
    want = {(i, j) for s, n in zip(starts, sizes) for i in range(s, s + n) for j in range(i + 1, s + n) if differ[i, j] <= 2}
    assert set(zip(one.tolist(), two.tolist())) == want and len(one) == len(want)


def test_a_task_gives_a_line_again_only_at_a_smaller_place(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "One line\none  LINE") for i in (5, 3, 9, None, 1, None)], "doc_id long, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        assert [(r.doc_id, r.row, r.pos) for r in linededup._document_lines(docs).collect()] == [(5, 0, 0), (3, 1, 0), (None, 3, 0)]
        monkeypatch.setattr(linededup, "REMEMBERED", 0)
        assert [r.doc_id for r in linededup._document_lines(docs).collect()] == [5, 3, 9, None, 1, None]
    finally:
        spark.conf.set(key, before)


def test_members_are_the_lines_among_partners(spark):
    lines = spark.createDataFrame([(i << 33 | j, i, j, [i]) for i in range(3) for j in range(40)], "nid long, row long, pos int, sig array<long>")
    partners = spark.createDataFrame([(7, n) for n in (3, 3, 1 << 33 | 5, 2 << 33 | 39, 99)], "band long, nid long")
    assert sorted((r.nid, r.row, r.pos, r.sig) for r in linededup._members(lines, partners).collect()) == [
        (3, 0, 3, [0]), (1 << 33 | 5, 1, 5, [1]), (2 << 33 | 39, 2, 39, [2])]


def test_normal_form_is_lower_case_with_single_spaces():
    lines = ["Plain Line", " lead", "trail ", "two  spaces", "tab\there", "nb\u00a0space", "", "\u2003", "a\x1cb", "\u0130\u03a3", "\u200b x", "\x85"]
    assert [normal_form(x) for x in lines] == [" ".join(x.lower().split()) for x in lines]


def test_texts_are_found_by_place(spark):
    docs = spark.createDataFrame([(i, f"Line {i}\n\n  Other  {i} ") for i in range(50)], "doc_id long, text string").coalesce(1)
    wanted = spark.createDataFrame([(9, 3, 0), (8, 3, 2), (7, 49, 2)], "nid long, row long, pos int")
    assert sorted(map(tuple, linededup._texts(docs, wanted).collect())) == [(7, "other 49"), (8, "other 3"), (9, "line 3")]
