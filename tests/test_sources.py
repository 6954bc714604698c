"""Readers, stored tables and exports on files."""

import hashlib
import json

from pyspark.sql import functions as F

from clauseloom import session
from clauseloom.operators import tasks
from clauseloom.sources import readers, tables


def test_read_blocks_keeps_list_order(spark, tmp_path):
    items = [{"type": "text", "text": f"t{i}", "page_idx": i // 2, "bbox": [1, 2, 3, 4.5]} for i in range(5)] + [{"type": "list", "list_items": ["a", "b"]}]
    (tmp_path / "doc_a.json").write_text(json.dumps(items, indent=1))
    (tmp_path / "doc_b.json").write_text("[{broken")
    rows = readers.read_blocks(spark, str(tmp_path)).orderBy("block_idx").collect()
    assert [r["doc_id"] for r in rows] == ["doc_a"] * 6
    assert [r["text"] for r in rows] == ["t0", "t1", "t2", "t3", "t4", None]
    assert rows[0]["bbox"] == [1.0, 2.0, 3.0, 4.5] and rows[5]["list_items"] == ["a", "b"] and rows[5]["page_idx"] is None


def test_span_scores(spark, tmp_path):
    detail = {"pdf_info": [{"para_blocks": [{"lines": [{"spans": [{"score": 0.5}, {}, {"score": 1.0}]}]}], "discarded_blocks": [{"lines": [{"spans": [{"score": 0}]}]}]}]}
    (tmp_path / "d.json").write_text(json.dumps(detail))
    assert sorted(r["score"] for r in readers.read_span_scores(spark, str(tmp_path)).collect()) == [0.5, 1.0]


def test_scan_files_takes_pdf_only(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    rows = readers.scan_files(spark, str(tmp_path)).collect()
    assert [(r["file_name"], r["size"], r["sha256"]) for r in rows] == [("a.PDF", 3, hashlib.sha256(b"one").hexdigest())]


def test_tree_json_round_trip(spark):
    rows = [(1, 0, 1, "r", 1), (1, 1, 2, "a", 1), (1, 2, 3, 'deep "x"', 2), (1, 3, 2, "b", 3), (1, 4, 1, "s", 4), (2, 0, 1, "only", 1)]
    nodes = spark.createDataFrame(rows, "doc_id long, node_idx long, level int, title string, start_index int")
    trees = tables.tree_json(nodes, rows=2)
    parsed = {r["doc_id"]: json.loads(r["json"]) for r in trees.collect()}
    assert parsed[1]["structure"][0]["nodes"][0]["nodes"][0]["title"] == 'deep "x"'
    back = readers.nodes_from_tree_json(trees).orderBy("doc_id", "path").collect()
    assert [(r["doc_id"], r["level"], r["title"], r["start_index"]) for r in back] == [(d, lv, t, s) for d, _, lv, t, s in rows]
    assert readers.nodes_from_tree_json(spark.createDataFrame([(1, "{oops")], "doc_id long, json string")).count() == 0


def test_tree_of_five_hundred_levels(spark):
    nodes = spark.createDataFrame([(1, i, i + 1, f"n{i}") for i in range(500)] + [(1, 500, 2, "last")],
                                  "doc_id long, node_idx long, level int, title string")
    back = readers.nodes_from_tree_json(tables.tree_json(nodes), rows=100).orderBy("path").collect()
    assert [(r["level"], r["title"]) for r in back] == [(i + 1, f"n{i}") for i in range(500)] + [(2, "last")]
    assert back[499]["path"] == [0] * 500 and back[500]["path"] == [0, 1]


def test_tree_json_of_any_shape(spark):
    def node(title, *nodes, **more):
        return {"title": title, **more, **({"nodes": list(nodes)} if nodes else {})}
    trees = {
        1: {"doc": "x", "structure": [node("a", node("b", positions=[[1, 2.5], [3, 4]]), node("c", node("d"))), node("e", start_index=3)], "more": [1, {"nodes": [node("no")]}]},
        2: {"nodes": [node("no")], "other": {"structure": [node("no")]}},
        3: {"structure": [node("f", summary='brackets "nodes": [{ in } a ] text \\ é\n', meta={"k": {"nodes": [node("no")]}}), {}]},
        4: {"structure": []}, 5: [], 6: {"structure": "text"}}
    texts = {i: json.dumps(t, indent=i % 3 or None, ensure_ascii=i % 2 == 0) for i, t in trees.items()}
    bad = ['{"structure": [{"title": "x"}', '{"structure": [{"title": "x"}]}}', '{"structure": [{"title": x}]}', '{"structure": [{"title": "x"} {"title": "y"}]}x',
           '{"structure": [{"title": "x"]}}', '{"structure": [{"title": "x}]}', "", None, '{"structure": [{"title": "x"}] oops}', '{"structure":[{}]}{}']
    rows = [*texts.items(), *((100 + i, b) for i, b in enumerate(bad)), (1, texts[4]), (None, texts[3])]
    got = readers.nodes_from_tree_json(spark.createDataFrame(rows, "doc_id long, json string"), rows=7).collect()
    want = []
    for i, text in rows:
        if i is not None and i >= 100:
            continue

        def walk(nodes, path):
            for k, n in enumerate(nodes):
                want.append((i, [*path, k], n.get("title"), n.get("start_index"), n.get("summary"), n.get("positions")))
                walk(n.get("nodes", []), [*path, k])

        tree = json.loads(text)
        found = tree.get("structure") if isinstance(tree, dict) else None
        walk(found if isinstance(found, list) else [], [])
    assert sorted(((r["doc_id"], r["path"], r["title"], r["start_index"], r["summary"], r["positions"]) for r in got), key=repr) == sorted(want, key=repr)


def test_store_append_read_and_delete(spark, tmp_path):
    base, target = str(tmp_path / "store"), str(tmp_path / "next")
    for name in tables.TABLES:
        tables.append_rows(spark.createDataFrame([("t1", name), ("t2", name)], "task_id string, v string"), f"{base}/{name}")
    tables.append_rows(spark.createDataFrame([("t1", "again")], "task_id string, v string"), f"{base}/clauses")
    assert sorted(r["v"] for r in tables.read_task(spark, f"{base}/clauses", "t1").collect()) == ["again", "clauses"]
    out = tables.delete_tasks(spark, base, spark.createDataFrame([("t1",)], "task_id string"), target)
    assert [r["task_id"] for n in tables.TABLES for r in spark.read.parquet(out[n]).collect()] == ["t2"] * 4


def test_delete_rewrites_touched_buckets_only(spark, tmp_path):
    base = str(tmp_path / "store")
    rows = [(f"t{i}", f"v{i}-{k}") for i in range(40) for k in range(3)]
    for name in tables.TABLES:
        tables.append_rows(spark.createDataFrame(rows, "task_id string, v string"), f"{base}/{name}")
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("part-*.parquet")}
    gone = ["t3", "t8", "no such task"]
    touched = tables.delete_tasks_in_place(spark, base, spark.createDataFrame([(g,) for g in gone], "task_id string"))
    assert 1 <= len(touched) <= 3
    for name in tables.TABLES:
        left = sorted(r["v"] for r in spark.read.parquet(f"{base}/{name}").collect())
        assert left == sorted(v for t, v in rows if t not in gone)
        assert tables.read_task(spark, f"{base}/{name}", "t3").count() == 0 and tables.read_task(spark, f"{base}/{name}", "t4").count() == 3
    for path, time in files.items():
        if int(path.parent.name.split("=")[1]) not in touched:
            assert path.exists() and path.stat().st_mtime_ns == time
    assert tables.delete_tasks_in_place(spark, base, spark.createDataFrame([], "task_id string")) == []


def test_matrix_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "1", 'A "q"', "", "c1", "x,\ny", "3", "penalty", "s")],
                               "doc_id long, node_idx long, label string, title string, summary string, clause_id string, clause_text string, page string, clause_type string, structured string")
    tables.write_matrix(df, str(tmp_path / "m"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "m")).collect()
    assert back[0]["条款内容"] == "x,\ny" and back[0]["章节标题"] == 'A "q"'
    assert spark.range(1).select(tables.matrix_name(F.lit("My.PDF")).alias("n")).collect()[0]["n"] == "My_需求矩阵"


def test_reuse_prefers_newest_completed(spark):
    rows = [("a", "h", "completed", "2024-01-01", "2024-01-02"), ("b", "h", "completed", "2024-01-01", "2024-01-05"),
            ("c", "h", "failed", "2024-02-01", None), ("d", "g", "failed", "2024-01-01", None), ("e", "g", "running", "2024-01-03", None)]
    df = spark.createDataFrame(rows, "task_id string, file_hash string, status string, created_at string, completed_at string")
    df = df.withColumn("created_at", F.to_timestamp("created_at")).withColumn("completed_at", F.to_timestamp("completed_at"))
    assert {r["file_hash"]: (r["task_id"], r["decision"]) for r in tasks.reusable_task(df).collect()} == {"h": ("b", "reuse"), "g": ("e", "wait")}


def test_delete_stores_nothing_apart_and_survives_a_full_map(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "store")
    rows = [(f"t{i}", f"v{i}") for i in range(200)] + [(None, "none")]
    tables.append_rows(spark.createDataFrame(rows, "task_id string, v string"), f"{base}/clauses")
    before = sum(map(len, session._stored.values()))
    gone = {f"t{i}" for i in range(0, 200, 3)}
    monkeypatch.setattr(tables, "MAP_BITS", 1 << 5)  # nearly every bit is set: the join decides
    tables.delete_tasks_in_place(spark, base, spark.createDataFrame([(g,) for g in gone], "task_id string"), ("clauses",))
    assert sorted(r["v"] for r in spark.read.parquet(f"{base}/clauses").collect()) == sorted(v for t, v in rows if t not in gone)
    assert sum(map(len, session._stored.values())) == before
    assert not list((tmp_path / "store" / "clauses").glob("_delete*"))
