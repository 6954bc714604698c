"""Readers, stored-table rows and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.operators import clauses as cl
from clauseloom.operators import tree
from clauseloom.plans.catalog import query
from clauseloom.plans.tasks_queries import sections
from clauseloom.session import shared_dir
from clauseloom.sources import readers, tables


def _block_json(t):
    """Layout blocks packed into one JSON list per document (40 blocks each)."""
    item = F.struct("block_idx", F.struct("type", "text", "list_items", "image_caption", "table_caption", "table_body",
                                          "img_path", "page_idx", "bbox").alias("b"))
    packed = t.layout.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return packed.select("doc_id", F.to_json(F.transform("l", lambda s: s["b"])).alias("json"))


@query("s1_read_blocks", """
    SELECT doc_id, block_idx::BIGINT AS block_idx, type, text, array_to_string(list_items, '|') AS items,
           page_idx::BIGINT AS page_idx, len(bbox)::BIGINT AS n_box, img_path FROM layout""", "layout")
def _(t):
    return readers.blocks_from_json(_block_json(t)).select(
        "doc_id", F.col("block_idx").cast("long").alias("block_idx"), "type", "text",
        F.array_join("list_items", "|").alias("items"), F.col("page_idx").cast("long").alias("page_idx"),
        F.when(F.col("bbox").isNotNull(), F.size("bbox")).cast("long").alias("n_box"), "img_path")


def _span_docs(t):
    """Parse detail with one score per order line, missing for untaxed lines."""
    span = F.struct(F.when(F.col("l_tax") > 0, 1 - F.col("l_discount")).alias("score"))
    info = F.struct(F.array(F.struct(F.array(F.struct(F.array(F.struct(F.array(span, span).alias("spans"))).alias("lines"))
                                             ).alias("para_blocks"))).alias("pdf_info"))
    return t.read("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.to_json(info).alias("json"))


@query("s2_span_scores", """
    SELECT l_orderkey AS doc_id, 0::BIGINT AS page, round(1 - l_discount, 6) AS score FROM lineitem, range(2)
    WHERE l_tax > 0""")
def _(t):
    return readers.span_scores_from_json(_span_docs(t)).select(
        "doc_id", F.col("page").cast("long").alias("page"), F.round("score", 6).alias("score"))


@query("a3_parse_confidence", """
    SELECT l_orderkey AS doc_id, round(coalesce(avg(CASE WHEN l_tax > 0 THEN 1 - l_discount END), 0), 6) AS confidence,
           2 * count(CASE WHEN l_tax > 0 THEN 1 END) AS spans FROM lineitem GROUP BY 1""")
def _(t):
    from clauseloom.operators.quality import parse_confidence
    docs = t.read("lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
    out = parse_confidence(docs, readers.span_scores_from_json(_span_docs(t)))
    return out.select("doc_id", F.round("confidence", 6).alias("confidence"), "spans")


@query("s3_read_tree", """
    SELECT doc_id, level::BIGINT AS level, node_id, title, start_index::BIGINT AS start_index FROM nodes
    """, "nodes")
def _(t):
    stored = tables.tree_json(t.nodes)
    return readers.nodes_from_tree_json(stored).select(
        "doc_id", F.col("level").cast("long").alias("level"), "node_id", "title",
        F.col("start_index").cast("long").alias("start_index"))


@query("s4_markdown_lines", """
    SELECT doc_id, i AS line_num, l[i] AS line FROM (
      SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def _(t):
    return readers.markdown_lines(t.read("documents").select("doc_id", "text"))


@query("s5_file_hashes", """
    SELECT doc_id, length(text)::BIGINT AS size, sha256(text) AS sha256 FROM documents
    WHERE lower('doc_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.txt' END) LIKE '%.pdf'""")
def _(t):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".txt"))
    return t.read("documents").filter(F.lower(name).endswith(".pdf")).select(
        "doc_id", F.length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))


@query("s6_task_store", "SELECT status, count(*) AS n, round(sum(file_size), 2)::BIGINT AS bytes FROM tasks GROUP BY 1", "tasks")
def _(t):
    path = shared_dir(t.spark, "task-store")
    tables.append_rows(t.tasks, path)
    return t.spark.read.parquet(path).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))


@query("s7_section_rows", """
    SELECT doc_id, node_id, title, CASE WHEN has_pos THEN start_index - 1 END::BIGINT AS first_page FROM nodes""", "nodes")
def _(t):
    path = shared_dir(t.spark, "section-store")
    tables.append_sections(t.nodes.withColumn("task_id", F.col("doc_id").cast("string")), path)
    rows = t.spark.read.parquet(path)
    page = F.get_json_object("positions_json", "$[0][0]").cast("double").cast("long")
    return rows.select("doc_id", "node_id", "title", page.alias("first_page"))


@query("s8_clause_rows", """
    SELECT matrix_id, coalesce(type, 'requirement') AS type, CASE WHEN has_pos THEN pos_page END::BIGINT AS first_page
    FROM clauses""", "clauses")
def _(t):
    path = shared_dir(t.spark, "clause-store")
    tables.append_clauses(t.clauses, path)
    rows = t.spark.read.parquet(path)
    page = F.get_json_object("positions_json", "$[0][0]").cast("double").cast("long")
    return rows.select("matrix_id", "type", page.alias("first_page"))


@query("s9_delete_tasks", """
    SELECT matrix_id, task_id FROM clauses WHERE task_id NOT IN (SELECT task_id FROM tasks WHERE status = 'failed')""",
       "clauses tasks")
def _(t):
    base = shared_dir(t.spark, "delete-store")
    tables.append_clauses(t.clauses, f"{base}/clauses")
    # Deletion reads no more of the tasks than this.
    tables.append_rows(t.tasks.select("task_id", "status"), f"{base}/tasks")
    failed = t.spark.read.parquet(f"{base}/tasks").filter(F.col("status") == "failed").select("task_id")
    tables.delete_tasks_in_place(t.spark, base, failed, ("clauses",))
    return t.spark.read.parquet(f"{base}/clauses").select("matrix_id", "task_id")


@query("s10_clause_matrix", """
    SELECT n.doc_id, n.node_idx::BIGINT AS node_idx, n.structure AS label, n.title, coalesce(c.seq::VARCHAR, '') AS clause_id,
           coalesce(left(c.original_text, 100), '') AS clause_text, coalesce(c.start_index::VARCHAR, '') AS page,
           CASE WHEN c.seq IS NULL THEN '' ELSE trim(CASE WHEN seq % 2 = 0 THEN 'actor ' ELSE '' END || 'ships') END AS structured
    FROM nodes n LEFT JOIN node_clauses c USING (doc_id, node_id)""", "nodes node_clauses")
def _(t):
    c = t.node_clauses.select(
        "doc_id", "node_id", F.col("seq").cast("string").alias("matrix_id"), "original_text",
        F.col("start_index").alias("page_number"), F.lit("requirement").alias("type"),
        F.when(F.col("seq") % 2 == 0, "actor").otherwise("").alias("actor"), F.lit("ships").alias("action"),
        F.lit(None).cast("string").alias("object"))
    return cl.clause_matrix(tree.hierarchy_labels(t.nodes), c).select(
        "doc_id", "node_idx", "label", "title", "clause_id", "clause_text", "page", "structured")


@query("s11_tree_json", """
    SELECT doc_id, count(*) AS nodes, sum(length(title))::BIGINT AS title_chars FROM nodes GROUP BY 1""", "nodes")
def _(t):
    rows = readers.nodes_from_tree_json(tables.tree_json(t.nodes))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.length("title")).alias("title_chars"))
