"""Matching strategies and title search against plain Python on small random corpora."""

import random
from difflib import SequenceMatcher


from pyspark.sql import functions as F

from clauseloom.functions.similarity import best_window
from clauseloom.operators import evidence as ev
from clauseloom.operators import slicing

WORDS = ["alpha", "beta", "gamma", "delta", "supply", "within", "thirty", "days", "must", "report", "figure"]
BLOCKS = ("doc_id long, block_idx int, type string, text string, list_items array<string>, image_caption array<string>, "
          "table_caption array<string>, table_body string, img_path string, page_idx int, bbox array<double>")


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def block(d, i, kind, text=None, items=None, page=0, bbox="own", path=None):
    box = [1.0, float(10 * i), 90.0, float(10 * i + 8)] if bbox == "own" else bbox
    return (d, i, kind, text, items, None, None, None, path, page, box)


def corpus(seed=3):
    r = random.Random(seed)
    blocks, clauses = [], []
    for d in range(4):
        for i in range(12):
            if i % 4 == 3:
                blocks.append(block(d, i, "list", items=[sentence(r, 3), sentence(r, 4)], page=i // 4))
            else:
                blocks.append(block(d, i, "text", f"({i}) " + sentence(r, 8), page=i // 4))
        for m in range(14):
            src = r.choice([b for b in blocks if b[0] == d and b[2] == "text"])[3].split(" ", 1)[1]
            w = src.split()
            kind = m % 5
            text = {0: src, 1: src.replace("a", "", 1) + "s", 2: " ".join(w[2:6]), 3: " ".join(sorted(set(w))),
                    4: sentence(r, 9)}[kind]
            clauses.append((d, "n0", f"c{d}-{m:02d}", text))
    clauses.append((0, "n0", "empty", "!!!"))
    return blocks, clauses


def norm(s):
    import re
    s = re.sub(r"^\(\s*[0-9]+\s*\)", "", s)
    s = re.sub(r"^[0-9]+\s*[.)]", "", s)
    s = re.sub(r"^[a-zA-Z]\s*[).]", "", s)
    return re.sub(r"[^\w]", "", s).lower()


def plain(clause, blocks):
    import re
    c = norm(clause)
    usable = [(o, b) for o, b in enumerate(blocks) if b[2] in ("text", "list")]
    texts = {o: norm(b[3]) if b[2] == "text" else "".join(map(norm, b[4])) for o, b in usable}
    for o, b in usable:
        if (b[2] == "text" and texts[o] == c) or (b[2] == "list" and c in map(norm, b[4])):
            return "exact", [o]
    best = max(((SequenceMatcher(None, c, texts[o]).ratio(), -o) for o, b in usable if b[2] == "text"), default=(0, 0))
    if best[0] >= 0.85:
        return "similarity", [-best[1]]
    whole, spans = "", []
    for o, _ in usable:
        spans.append((len(whole), len(whole) + len(texts[o]), o))
        whole += texts[o]
    at = whole.find(c)
    if at >= 0:
        hit = [o for a, e, o in spans if not (e <= at or a >= at + len(c))]
        if hit:
            return "substring", hit
    words = {w for w in re.findall(r"\w+", clause) if len(w) > 1}
    if words:
        scores = []
        for o, b in usable:
            body = b[3] if b[2] == "text" else "".join(b[4])
            scores.append((len(words & {w for w in re.findall(r"\w+", body) if len(w) > 1}) / len(words), -o))
        score, o = max(scores)
        if score >= 0.70:
            return "keyword", [-o]
    return None


def nodes_for(spark, blocks):
    rows = [(d, "n0", [(b[9], *b[10]) for b in blocks if b[0] == d]) for d in sorted({b[0] for b in blocks})]
    return spark.createDataFrame(rows, "doc_id long, node_id string, positions array<struct<page_idx:int,x0:double,y0:double,x1:double,y1:double>>")


def test_cascade_equals_plain_search(spark):
    blocks, clauses = corpus()
    bdf = spark.createDataFrame(blocks, BLOCKS)
    cdf = spark.createDataFrame(clauses, "doc_id long, node_id string, matrix_id string, original_text string")
    of_nodes = ev.node_blocks(nodes_for(spark, blocks), bdf)
    got = {r["matrix_id"]: (r["strategy"], [p["y0"] for p in r["positions"]]) for r in ev.locate_text(cdf, of_nodes, rows=5).collect()}
    want = {}
    for d, _, m, text in clauses:
        mine = [b for b in blocks if b[0] == d]
        hit = plain(text, mine)
        if hit:
            want[m] = (hit[0], [mine[o][10][1] for o in hit[1]])
    assert {s for s, _ in want.values()} == {"exact", "similarity", "substring", "keyword"}
    assert got == want


def test_substring_over_small_pieces(spark):
    blocks, clauses = corpus(9)
    bdf = spark.createDataFrame(blocks, BLOCKS)
    cdf = spark.createDataFrame(clauses, "doc_id long, node_id string, matrix_id string, original_text string")
    prepared = ev.prepare_blocks(ev.node_blocks(nodes_for(spark, blocks), bdf))
    from clauseloom.functions.text import normalize_evidence
    c = cdf.withColumn("norm", normalize_evidence("original_text"))
    def run(piece, small):
        return sorted((r["matrix_id"], str(r["positions"])) for r in ev.match_substring(c, prepared, piece, 4, small).collect())
    assert run(1 << 20, 0) == run(17, 0) == run(17, 1 << 20) == run(17, 3000)
    assert run(17, 0)


def test_repeated_and_shifted_positions(spark):
    bdf = spark.createDataFrame([block(1, 0, "text", "a", bbox=[0.95, 0.0, 5.0, 5.0]), block(1, 1, "text", "b", bbox=[1.04, 0.0, 5.0, 5.0])], BLOCKS)
    nodes = spark.createDataFrame([(1, "n", [(0, 1.0, 0.0, 5.0, 5.0), (0, 1.0, 0.0, 5.0, 5.0), (0, 1.3, 0.0, 5.0, 5.0)])],
                                  "doc_id long, node_id string, positions array<struct<page_idx:int,x0:double,y0:double,x1:double,y1:double>>")
    got = sorted((r["ord"], r["text"]) for r in ev.node_blocks(nodes, bdf).collect())
    assert got == [(0, "a"), (1, "a")]


def title_norm(s):
    import re
    s = re.sub(r"[^0-9a-z]+", "", re.sub(r"\s+", "", s.lower()))
    return re.sub(r"^[0-9]+", "", s)


def holds(title, body, thr):
    t, b = title_norm(title), title_norm(body)
    return bool(t and b) and (t in b or best_window(t, b) >= thr)


def plain_robust(title, blocks, first, last):
    def search(a, b, thr):
        return next((x[1] for x in blocks if a <= x[9] <= b and x[3] and holds(title, x[3], thr)), None)
    hit = search(first, last, 0.85)
    if hit is not None:
        return 1, hit
    light = "".join(title.lower().split())
    for x in blocks:
        body = "".join(x[3].lower().split())
        if first <= x[9] <= last and x[2] == "header" and (light in body or body in light):
            return 2, x[1]
    for step, slack, thr in ((3, 2, 0.85), (4, 2, 0.70), (5, 5, 0.85)):
        hit = search(max(0, first - slack), last + slack, thr)
        if hit is not None:
            return step, hit
    return None


def titled(seed=4):
    r = random.Random(seed)
    blocks, titles = [], []
    for d in range(3):
        names = []
        for i in range(40):
            name = sentence(r, r.choice([2, 3, 7]))
            kind = "header" if i % 3 == 0 else "text"
            text = f"{i}. {name}" if kind == "header" else sentence(r, 6)
            if i % 13 == 0:
                text = f"{i}.{i}"
            blocks.append(block(d, i, kind, text, page=i // 4))
            names.append((name, i))
        for k, (name, i) in enumerate(names[::3]):
            cut = {0: name, 1: name[:-1] + "q", 2: name.replace("e", "o"), 3: f"{i * 1}.{i * 1}"}[k % 4]
            page = max(0, i // 4 + r.choice([0, 0, 2, 4, 9]) * r.choice([-1, 1]))
            titles.append((d, k, cut, page, page + r.randrange(2)))
    return blocks, titles


def test_robust_search_equals_plain_steps(spark):
    blocks, titles = titled()
    bdf = spark.createDataFrame(blocks, BLOCKS)
    tdf = spark.createDataFrame(titles, "doc_id long, node_idx long, title string, first_page int, last_page int")
    got = {(r["doc_id"], r["node_idx"]): (r["step"], r["found"]) for r in
           slicing.find_title_robust(tdf, bdf, ["doc_id", "node_idx"]).collect() if r["found"] is not None}
    want = {}
    for d, k, title, a, b in titles:
        hit = plain_robust(title, [x for x in blocks if x[0] == d], a, b)
        if hit:
            want[(d, k)] = hit
    assert len({s for s, _ in want.values()}) >= 3
    assert got == want


def test_search_anywhere_equals_plain_search(spark):
    blocks, titles = titled(8)
    bdf = spark.createDataFrame(blocks, BLOCKS)
    tdf = spark.createDataFrame([t[:3] for t in titles], "doc_id long, node_idx long, title string")
    got = {(r["doc_id"], r["node_idx"]): r["found"] for r in slicing.find_title_anywhere(tdf, bdf, ["doc_id", "node_idx"]).collect()}
    want = {}
    for d, k, title, _, _ in titles:
        hit = next((x[1] for x in blocks if x[0] == d and holds(title, x[3], 0.85)), None)
        if hit is not None:
            want[(d, k)] = hit
    assert got == want


def test_fill_node_text(spark):
    blocks = [block(1, 0, "header", "1 Scope", page=0), block(1, 1, "text", "first part", page=0), block(1, 2, "text", "more", page=1, bbox=[1.0]),
              block(1, 3, "header", "2 Delivery dates", page=1), block(1, 4, "list", items=["a", "b"], page=2),
              block(2, 0, "text", "loose", page=0), block(2, 1, "text", "end", page=1)]
    nodes = [(1, 0, None, 1, "Scope", 1, 1), (1, 1, None, 1, "Delivery dates", 2, 2), (2, 0, None, 1, "Missing title", 1, 1),
             (2, 1, None, 1, "Nothing", 0, 0)]
    ndf = spark.createDataFrame(nodes, "doc_id long, node_idx long, parent_idx long, level int, title string, start_index int, end_index int")
    out = {(r["doc_id"], r["node_idx"]): r for r in slicing.fill_node_text(ndf, spark.createDataFrame(blocks, BLOCKS)).collect()}
    assert out[(1, 0)]["original_text"] == "first part\n\nmore"
    assert [p["y0"] for p in out[(1, 0)]["positions"]] == [0.0, 10.0]
    assert out[(1, 1)]["original_text"] == "a\nb" and out[(1, 1)]["step"] == 1
    # No boundary found: the range runs to the last page, and the whole range is the text.
    assert out[(2, 0)]["original_text"] == "loose\n\nend" and out[(2, 0)]["step"] is None


def test_positions_between_derives_the_searched_blocks_once(spark, monkeypatch):
    blocks = spark.createDataFrame([(1, i, "text", t, 0, [1.0, 2.0, 3.0, 4.0]) for i, t in enumerate(["Alpha part", "body", "Beta part", "end"])],
                                   "doc_id long, block_idx int, type string, text string, page_idx int, bbox array<double>")
    for c, kind in (("list_items", "array<string>"), ("image_caption", "array<string>"), ("table_caption", "array<string>"), ("table_body", "string")):
        blocks = blocks.withColumn(c, F.lit(None).cast(kind))
    titles = spark.createDataFrame([(1, 0, "Alpha part", "Beta part", 0, 0)], "doc_id long, node_idx int, title string, end_title string, first_page int, last_page int")
    calls, derive = [], slicing.searchable
    monkeypatch.setattr(slicing, "searchable", lambda df: calls.append(1) or derive(df))
    rows = slicing.positions_between(titles, blocks, ["doc_id", "node_idx"]).collect()
    assert len(rows) == 1 and len(rows[0].positions) == 2
    assert len(calls) == 1
