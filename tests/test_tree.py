"""Trees, contents pages and Markdown against plain loops, with chunks of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from clauseloom.functions.text import token_count
from clauseloom.operators import markdown, toc, tree
from clauseloom.operators.scan import dense_chunk
from clauseloom.operators.stack import above


def random_tree(r, n):
    levels = [1]
    for _ in range(n - 1):
        levels.append(r.randrange(1, min(levels[-1] + 1, 5) + 1))
    return levels


def stack_parents(levels):
    out, stack = [], []
    for i, lv in enumerate(levels):
        while stack and levels[stack[-1]] >= lv:
            stack.pop()
        out.append(stack[-1] if stack else None)
        stack.append(i)
    return out


def descendants(levels, i):
    j = i + 1
    while j < len(levels) and levels[j] > levels[i]:
        j += 1
    return range(i + 1, j)


def loop_thinning(levels, texts, limit):
    size = [sum(len(texts[j].split()) for j in [i, *descendants(levels, i)]) for i in range(len(levels))]
    texts, gone = list(texts), set()
    for i in range(len(levels) - 1, -1, -1):
        if i in gone or size[i] >= limit:
            continue
        for j in descendants(levels, i):
            if j not in gone:
                if texts[j].strip():
                    texts[i] = texts[i] + "\n\n" + texts[j] if texts[i] else texts[j]
                gone.add(j)
    return {i: texts[i] for i in range(len(levels)) if i not in gone}


def forest(seed, docs=3, n=25):
    r = random.Random(seed)
    return {d: (lv := random_tree(r, n), [" ".join(["w"] * r.randrange(1, 6)) + f" t{i}" for i in range(len(lv))]) for d in range(docs)}


def frame(spark, trees):
    rows = [(d, i, lv, f"T{i}", texts[i], p, 1 + i // 2, 3 + i // 2) for d, (levels, texts) in trees.items()
            for i, (lv, p) in enumerate(zip(levels, stack_parents(levels)))]
    return spark.createDataFrame(rows, "doc_id long, node_idx long, level int, title string, text string, parent_idx long, "
                                 "start_index int, end_index int").withColumn("token_count", token_count("text"))


def test_parents_subtrees_and_thinning(spark):
    trees = forest(2)
    df = frame(spark, trees)
    found = tree.parents_by_level(df.drop("parent_idx"), rows=4).collect()
    assert {(r["doc_id"], r["node_idx"]): r["parent_idx"] for r in found} == {
        (d, i): p for d, (lv, _) in trees.items() for i, p in enumerate(stack_parents(lv))}
    sums = tree.subtree_tokens(df, rows=4).collect()
    assert {(r["doc_id"], r["node_idx"]): r["subtree_tokens"] for r in sums} == {
        (d, i): sum(len(tx[j].split()) for j in [i, *descendants(lv, i)]) for d, (lv, tx) in trees.items() for i in range(len(lv))}
    thin = tree.thin_tree(df, 12, rows=4).collect()
    assert {(r["doc_id"], r["node_idx"]): r["text"] for r in thin} == {
        (d, i): t for d, (lv, tx) in trees.items() for i, t in loop_thinning(lv, tx, 12).items()}


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_nearest_rows_of_a_smaller_level(spark, rows):
    r = random.Random(rows)
    levels = {d: [r.choice([1, 2, 2, 3, 5, 9, None]) for _ in range(r.randrange(1, 60))] for d in range(5)}
    df = spark.createDataFrame([(d, i, lv, f"v{i}") for d, ls in levels.items() for i, lv in enumerate(ls)], "d long, i long, lv int, _v string")
    for later in (False, True):
        for equal in (False, True):
            got = {(x["d"], x["i"]): x["near"] for x in above(df, ["d"], "i", "lv", F.col("_v"), "near", dense_chunk("i", rows), later, equal).collect()}
            for d, ls in levels.items():
                for i, lv in enumerate(ls):
                    side = range(i + 1, len(ls)) if later else range(i - 1, -1, -1)
                    assert got[d, i] == next((f"v{j}" for j in side if (ls[j] or 1) < (lv or 1) + equal), None)
    got = {(x["d"], x["i"]): x["up"] for x in above(df, ["d"], "i", "lv", F.col("i"), "up", dense_chunk("i", rows), whole=True).collect()}
    for d, ls in levels.items():
        stack = []
        for i, lv in enumerate(ls):
            stack = [j for j in stack if (ls[j] or 1) < (lv or 1)]
            assert got[d, i] == stack
            stack.append(i)


def test_leaf_boundary_and_fill_range(spark):
    trees = forest(7)
    df = frame(spark, trees)
    ranges = {(r["doc_id"], r["node_idx"]): r["fill_end"] for r in tree.fill_ranges(df, rows=3).collect()}
    leaves = {(r["doc_id"], r["node_idx"]) for r in tree.with_is_leaf(df, rows=3).filter("is_leaf").collect()}
    for d, (lv, _) in trees.items():
        parents = stack_parents(lv)
        for i in range(len(lv)):
            kids = [j for j in range(len(lv)) if parents[j] == i]
            later = [j for j in range(i + 1, len(lv)) if parents[j] == parents[i]]
            end = 1 + kids[0] // 2 if kids else 1 + later[0] // 2 if later else 3 + i // 2
            assert ranges[(d, i)] == max(end, 1 + i // 2)
            assert ((d, i) in leaves) == (not kids)


def test_structure_parents(spark):
    codes = ["1", "1.1", "1.1.1", "2.1", "1.1", "1.1.2", None, "3", "3.1"]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(codes)], "doc_id long, item_idx long, structure string")
    got = [r["parent_idx"] for r in tree.parents_by_structure(df, rows=2).orderBy("item_idx").collect()]
    assert got == [None, 0, 1, None, 0, 4, None, None, 7]


def test_page_ranges_keep_reversed_ones(spark):
    df = spark.createDataFrame([(1, 0, 5, "no"), (1, 1, 5, "yes"), (1, 2, 9, "no")], "doc_id long, item_idx long, physical_index int, appear_start string")
    got = [(r["start_index"], r["end_index"]) for r in tree.page_ranges(df, F.lit(20), rows=1).orderBy("item_idx").collect()]
    assert got == [(5, 4), (5, 9), (9, 20)]


def test_offset_tie_takes_first_seen(spark):
    page = spark.createDataFrame([(1, i, f"t{i}", str(10)) for i in range(4)], "doc_id long, item_idx long, title string, page string")
    phys = spark.createDataFrame([(1, i, f"t{i}", 10 + d) for i, d in enumerate([2, 3, 3, 2])], "doc_id long, item_idx long, title string, physical_index int")
    assert toc.page_offset(page, phys).collect()[0]["page_offset"] == 2


def plain_groups(tokens, limit, overlap):
    import math
    total = sum(tokens)
    if total <= limit:
        return [list(range(1, len(tokens) + 1))]
    target = math.ceil((total / math.ceil(total / limit) + limit) / 2)
    groups, now, count = [], [], 0
    for i, n in enumerate(tokens):
        if count + n > target:
            groups.append(now)
            back = max(i - overlap, 0)
            now, count = list(range(back + 1, i + 1)), sum(tokens[back:i])
        now.append(i + 1)
        count += n
    return [g for g in groups + [now] if g]


def test_group_pages(spark):
    r = random.Random(1)
    docs = {d: [r.randrange(1, 60) for _ in range(r.randrange(1, 40))] for d in range(6)}
    docs[6] = [500, 10, 10]
    docs[7] = [r.choice([0, 0, 7, 30, 150]) for _ in range(700)]
    df = spark.createDataFrame([(d, i + 1, n) for d, t in docs.items() for i, n in enumerate(t)], "doc_id long, page_no int, token_count long")
    for overlap in (0, 1, 2):
        got = {}
        for row in toc.group_pages(df, 100, overlap).collect():
            got.setdefault(row["doc_id"], {}).setdefault(row["group_no"], []).append(row["page_no"])
        assert {d: [sorted(g[k]) for k in sorted(g)] for d, g in got.items()} == {d: plain_groups(t, 100, overlap) for d, t in docs.items()}


def test_toc_pages_first_run_only(spark):
    hits = {1: [2, 3, 6], 2: [25], 3: [20, 21, 22], 4: []}
    df = spark.createDataFrame([(d, p, p in h) for d, h in hits.items() for p in range(1, 30)], "doc_id long, page_no int, is_toc boolean")
    got = sorted((r["doc_id"], r["page_no"]) for r in toc.toc_pages(df, 20).collect())
    assert got == [(1, 2), (1, 3), (3, 20), (3, 21), (3, 22)]


def test_strategy_ladder(spark):
    def doc(d, shift):
        names = ["Opening words", "Delivery dates", "Payment terms", "Closing remarks"]
        text = "\n".join(f"{i + 1} {n} ........ {i + 1}" for i, n in enumerate(names))
        return [(d, 1, text)] + [(d, 2 + i, f"{n}\nbody of section") for i, n in enumerate(names)] if not shift else [
            (d, i + 1, f"{n}\nbody of section") for i, n in enumerate(names)]
    pages = spark.createDataFrame(doc(1, False) + doc(2, True) + [(3, 1, "no structure here")], "doc_id long, page_no int, text string")
    blocks = spark.createDataFrame([(2, i, "header", n, i) for i, n in enumerate(["Opening words", "Delivery dates", "Payment terms", "Closing remarks"])],
                                   "doc_id long, block_idx int, type string, text string, page_idx int")
    rows = toc.resolve_toc(pages, blocks, 20).collect()
    got = {d: sorted((r["strategy"], r["title"], r["physical_index"]) for r in rows if r["doc_id"] == d) for d in (1, 2, 3)}
    assert [s for s, _, _ in got[1]] == ["page_numbers"] * 4 and ("page_numbers", "Payment terms", 4) in got[1]
    assert [s for s, _, _ in got[2]] == ["headers"] * 4 and ("headers", "Payment terms", 3) in got[2]
    assert [s for s, _, _ in got[3]] == ["failed"]


def test_markdown_headings(spark):
    text = "# A\nbody\n```\n# not this\n```\n  # indented\n## B  \nmore\n\n# C"
    lines = spark.createDataFrame([(1, i + 1, line) for i, line in enumerate(text.split("\n"))], "doc_id long, line_num long, line string")
    got = [(r["line_num"], r["level"], r["title"]) for r in markdown.headers(lines, rows=2).orderBy("line_num").collect()]
    assert got == [(1, 1, "A"), (7, 2, "B"), (10, 1, "C")]
    body = {r["line_num"]: r["text"] for r in markdown.section_text(lines, rows=2).collect()}
    assert body[7] == "## B  \nmore" and body[1].endswith("# indented")


def plain_split(node, items, texts, level, limit):
    """(path, title, start, end) of all that a node is split into, and its new end, by recursion."""
    path, title, start, end, narrower = node
    if end - start <= limit or not narrower:
        return [], end
    found = [i for i in items if start <= i[1] <= end and (level is None or i[2] == len(path))]
    if found and found[0][0].strip() == title.strip():
        found = found[1:]
    out = []
    for n, (name, page, _) in enumerate(found):
        stop = end if n + 1 == len(found) else found[n + 1][1] - (found[n + 1][0] in texts[found[n + 1][1]][:len(found[n + 1][0]) + 2])
        below, cut = plain_split(([*path, n + 1], name, page, stop, stop - page < end - start), items, texts, level, limit)
        out += [(tuple([*path, n + 1]), name, page, cut), *below]
    return out, found[0][1] if found else end


@pytest.mark.parametrize("level", [None, 3])
def test_large_nodes_are_split_to_the_end(spark, level):
    r = random.Random(level)
    docs = {}
    for d in range(6):
        last, items = r.randrange(6, 40), []
        for n in range(r.randrange(0, 12)):
            items.append((f"Heading number {chr(97 + n) * 4}", r.randrange(1, last + 1), r.randrange(1, 4)))
        items.sort(key=lambda i: i[1])
        texts = {p: "\n".join([i[0] for i in items if i[1] == p and r.random() < 0.5] + ["plain words of the page here"] + [i[0] for i in items if i[1] == p])
                 for p in range(1, last + 1)}
        docs[d] = last, items, texts
    pages = spark.createDataFrame([(d, p, t, 100) for d, (_, _, texts) in docs.items() for p, t in texts.items()], "doc_id long, page_no int, text string, token_count long")
    nodes = spark.createDataFrame([(d, 0, items[0][0] if d % 2 and items else "Whole", 1, last) for d, (last, items, _) in docs.items()],
                                  "doc_id long, node_idx long, title string, start_index int, end_index int")
    rows = [(d, n, t, None, p, lv) for d, (_, items, _) in docs.items() for n, (t, p, lv) in enumerate(items)]
    items = spark.createDataFrame(rows, "doc_id long, item_idx long, title string, structure string, physical_index int, level int")
    got = toc.split_large_nodes(nodes, pages, items if level else items.drop("level"), max_pages=3, max_tokens=1, rows=2).collect()
    for d, (last, its, texts) in docs.items():
        plain = {p: t.replace(" ", "").replace("\n", "") for p, t in texts.items()}
        name = its[0][0] if d % 2 and its else "Whole"
        flat = [(t.replace(" ", ""), p, lv) for t, p, lv in its]
        want, end = plain_split(([0], name.replace(" ", ""), 1, last, True), flat, plain, level, 3)
        mine = [x for x in got if x["doc_id"] == d]
        assert sorted((tuple(x["path"]), x["title"].replace(" ", ""), x["start_index"], x["end_index"]) for x in mine) == sorted(want)
        assert {x["node_end"] for x in mine if len(x["path"]) == 2} == ({end} if want else set())
