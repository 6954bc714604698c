"""Section trees, tables of contents, Markdown structure and clause numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import text as tx
from clauseloom.operators import clauses as cl
from clauseloom.operators import markdown, quality, toc, tree
from clauseloom.plans import corpora
from clauseloom.plans.catalog import query


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


@query("f4_project_tree", "SELECT title, doc_id, node_idx::BIGINT AS node_idx FROM nodes", "nodes")
def _(t):
    return tree.project_tree(t.nodes, drop=["positions", "summary", "original_text", "structure", "level", "parent_idx",
                                            "node_id", "start_index", "end_index"], first=["title"])


@query("f5_over_token_limit", f"SELECT doc_id, page_no, token_count::BIGINT AS token_count FROM page_texts WHERE token_count > 300",
       "page_texts")
def _(t):
    return tree.over_token_limit(t.page_texts, 300).select("doc_id", *_long("page_no"), "token_count")


@query("f6_valid_toc", "SELECT doc_id, item_idx::BIGINT AS item_idx FROM toc WHERE physical_index IS NOT NULL", "toc")
def _(t):
    return toc.valid_toc(t.toc).select("doc_id", "item_idx")


@query("f7_truncate_physical_index", """
    SELECT doc_id, item_idx::BIGINT AS item_idx, CASE WHEN physical_index <= 40 + doc_id + 2 - 1 THEN physical_index END::BIGINT
      AS physical_index FROM toc""", "toc")
def _(t):
    pages = t.read("region").select(F.col("r_regionkey").cast("long").alias("doc_id"), (F.col("r_regionkey") + 40).alias("pages"))
    return toc.truncate_physical_index(t.toc, pages, start_index=2).select("doc_id", "item_idx", *_long("physical_index"))


@query("f8_is_visual", """
    SELECT matrix_id FROM clauses WHERE coalesce(image_caption, '') <> '' OR coalesce(table_caption, '') <> ''""", "clauses")
def _(t):
    return t.clauses.filter(cl.is_visual()).select("matrix_id")


@query("f9_leaves", """
    SELECT doc_id, node_idx::BIGINT AS node_idx FROM nodes n WHERE NOT EXISTS
      (SELECT 1 FROM nodes c WHERE c.doc_id = n.doc_id AND c.parent_idx = n.node_idx)""", "nodes")
def _(t):
    return tree.with_is_leaf(t.nodes).filter("is_leaf").select("doc_id", "node_idx")


@query("j1_toc_page_pairs", """
    SELECT a.doc_id, a.title, a.page::BIGINT AS page, b.physical_index::BIGINT AS physical_index
    FROM toc a JOIN toc b ON a.doc_id = b.doc_id AND a.title = b.title WHERE b.physical_index >= 10""", "toc")
def _(t):
    return toc.toc_page_pairs(t.toc.drop("physical_index"), t.toc.drop("page"), 10).select(
        "doc_id", "title", *_long("page", "physical_index"))


@query("j3_node_pages", """
    SELECT n.doc_id, node_idx::BIGINT AS node_idx, p.page_no::BIGINT AS page_no, p.token_count::BIGINT AS token_count
    FROM nodes n JOIN page_texts p ON n.doc_id = p.doc_id AND p.page_no BETWEEN start_index AND end_index""", "nodes page_texts")
def _(t):
    return tree_pages(t).select("doc_id", "node_idx", *_long("page_no", "token_count"))


def tree_pages(t):
    return toc.node_pages(t.nodes.select("doc_id", "node_idx", "title", "start_index", "end_index"), t.page_texts)


@query("j4_bracket_gaps", """
    SELECT doc_id, item_idx::BIGINT AS item_idx,
      coalesce(last_value(physical_index IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prev_index,
      coalesce(first_value(physical_index IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1)::BIGINT AS next_index
    FROM toc WINDOW w AS (PARTITION BY doc_id ORDER BY item_idx)
    QUALIFY physical_index IS NULL""", "toc")
def _(t):
    out = toc.bracket_gaps(t.toc, F.lit(0), F.lit(-1))
    return out.filter(F.col("physical_index").isNull()).select("doc_id", "item_idx", *_long("prev_index", "next_index"))


@query("j5_parents_by_level", """
    SELECT doc_id, node_idx::BIGINT AS node_idx, parent_idx::BIGINT AS parent_idx FROM nodes""", "nodes")
def _(t):
    return tree.parents_by_level(t.nodes.drop("parent_idx")).select("doc_id", "node_idx", "parent_idx")


@query("j6_parents_by_structure", """
    SELECT doc_id, node_idx::BIGINT AS item_idx, parent_idx::BIGINT AS parent_idx FROM nodes""", "nodes")
def _(t):
    return tree.parents_by_structure(t.toc).select("doc_id", "item_idx", "parent_idx")


@query("j10_attach_clauses", """
    SELECT doc_id, node_id, node_idx::BIGINT AS node_idx, seq::BIGINT AS seq, title FROM nodes JOIN
    (SELECT doc_id, node_id, seq FROM node_clauses) USING (doc_id, node_id)""", "nodes node_clauses")
def _(t):
    return t.node_clauses.select("doc_id", "node_id", "seq").join(t.nodes, ["doc_id", "node_id"]).select(
        "doc_id", "node_id", "node_idx", "seq", "title")


@query("j11_sections_without_clauses", """
    SELECT doc_id, node_id, title FROM nodes n WHERE NOT EXISTS
    (SELECT 1 FROM node_clauses c WHERE c.doc_id = n.doc_id AND c.node_id = n.node_id)""", "nodes node_clauses")
def _(t):
    return quality.sections_without_clauses(t.nodes, t.node_clauses).select("doc_id", "node_id", "title")


@query("a1_page_offset", """
    WITH d AS (SELECT doc_id, physical_index - page AS diff, count(*) AS n, min(item_idx) AS seen FROM toc
               WHERE physical_index IS NOT NULL GROUP BY 1, 2)
    SELECT doc_id, arg_max(diff, (n, -seen))::BIGINT AS page_offset FROM d GROUP BY 1""", "toc")
def _(t):
    return toc.page_offset(t.toc.drop("physical_index"), t.toc.drop("page"), 1).select("doc_id", *_long("page_offset"))


@query("t8_apply_offset", """
    WITH d AS (SELECT doc_id, physical_index - page AS diff, count(*) AS n, min(item_idx) AS seen FROM toc
               WHERE physical_index IS NOT NULL GROUP BY 1, 2), o AS (SELECT doc_id, arg_max(diff, (n, -seen)) AS o FROM d GROUP BY 1)
    SELECT doc_id, item_idx::BIGINT AS item_idx, CASE WHEN item_idx % 11 = 0 THEN NULL ELSE page + o END::BIGINT AS physical_index
    FROM toc LEFT JOIN o USING (doc_id)""", "toc")
def _(t):
    offsets = toc.page_offset(t.toc.drop("physical_index"), t.toc.drop("page"), 1)
    items = t.toc.withColumn("page", F.when(F.col("item_idx") % 11 != 0, F.col("page"))).withColumn(
        "physical_index", F.lit(None).cast("int"))
    return toc.apply_offset(items, offsets).select("doc_id", "item_idx", *_long("physical_index"))


@query("a9_subtree_clause_counts", """
    WITH c AS (SELECT doc_id, node_idx, count(*) AS n FROM node_clauses GROUP BY 1, 2)
    SELECT n.doc_id, n.node_idx::BIGINT AS node_idx, coalesce(sum(c.n), 0)::BIGINT AS clause_count FROM nodes n
    LEFT JOIN c ON c.doc_id = n.doc_id AND (c.node_idx = n.node_idx OR n.level = 1 OR (n.level = 2 AND c.node_idx > n.node_idx
      AND c.node_idx < coalesce((SELECT min(m.node_idx) FROM nodes m WHERE m.doc_id = n.doc_id AND m.level = 2
      AND m.node_idx > n.node_idx), 1000000000)))
    GROUP BY 1, 2""", "nodes node_clauses")
def _(t):
    return tree.subtree_clause_counts(t.nodes, t.node_clauses.select("doc_id", "node_id")).select(
        "doc_id", "node_idx", *_long("clause_count"))


@query("a4_a5_leaf_rates", """
    WITH l AS (SELECT n.doc_id, n.has_pos, EXISTS (SELECT 1 FROM node_clauses c WHERE c.doc_id = n.doc_id AND c.node_idx = n.node_idx) AS hit
      FROM nodes n WHERE level = 3)
    SELECT doc_id, count(*) AS leaves, round(avg(hit::INT), 6) AS leaf_with_clause_rate, round(avg(has_pos::INT), 6) AS section_bbox_rate
    FROM l GROUP BY 1""", "nodes node_clauses")
def _(t):
    out = quality.leaf_rates(tree.with_is_leaf(t.nodes), t.node_clauses)
    return out.select("doc_id", "leaves", F.round("leaf_with_clause_rate", 6).alias("leaf_with_clause_rate"),
                      F.round("section_bbox_rate", 6).alias("section_bbox_rate"))


@query("a6_clause_bbox_rate", """
    SELECT doc_id, count(*) AS clauses, round(avg(has_pos::INT), 6) AS clause_bbox_rate FROM node_clauses GROUP BY 1""", "node_clauses")
def _(t):
    out = quality.clause_bbox_rate(t.node_clauses, ["doc_id"])
    return out.select("doc_id", "clauses", F.round("clause_bbox_rate", 6).alias("clause_bbox_rate"))


@query("a7_quality_report", """
    WITH l AS (SELECT n.doc_id, count(*) AS leaves, avg(EXISTS (SELECT 1 FROM node_clauses c WHERE c.doc_id = n.doc_id
        AND c.node_idx = n.node_idx)::INT) AS a, avg(has_pos::INT) AS b FROM nodes n WHERE level = 3 GROUP BY 1),
    c AS (SELECT doc_id, count(*) AS clauses, avg(has_pos::INT) AS r FROM node_clauses GROUP BY 1),
    f AS (SELECT doc_id, avg((coalesce(original_text, '') <> '')::INT) AS f FROM nodes GROUP BY 1),
    s AS (SELECT l_orderkey % 5 AS doc_id, avg(1 - l_discount) AS m, count(*) AS spans FROM lineitem WHERE l_tax > 0 GROUP BY 1)
    SELECT doc_id, round(m, 6) AS confidence, spans, clauses, leaves, round(a, 6) AS leaf_with_clause_rate,
      round(b, 6) AS section_bbox_rate, round(r, 6) AS clause_bbox_rate, round(f, 6) AS fill_rate
    FROM f JOIN c USING (doc_id) JOIN l USING (doc_id) JOIN s USING (doc_id)""", "nodes node_clauses")
def _(t):
    scores = t.read("lineitem").filter(F.col("l_tax") > 0).select((F.col("l_orderkey") % 5).alias("doc_id"),
                                                                  (1 - F.col("l_discount")).alias("score"))
    out = quality.quality_report(tree.with_is_leaf(t.nodes), t.node_clauses, scores)
    rates = ["confidence", "leaf_with_clause_rate", "section_bbox_rate", "clause_bbox_rate", "fill_rate"]
    return out.select("doc_id", "spans", "clauses", "leaves", *[F.round(r, 6).alias(r) for r in rates])


@query("a8_top_sections", """
    SELECT section_id, section_title, count(*) AS clauses FROM clauses GROUP BY 1, 2 ORDER BY clauses DESC, section_id LIMIT 5""", "clauses")
def _(t):
    return quality.top_sections(t.clauses)


@query("a10_subtree_tokens", """
    WITH RECURSIVE k AS (SELECT doc_id, node_idx, parent_idx, length(title) AS n FROM nodes),
    up AS (SELECT doc_id, node_idx, node_idx AS a, n FROM k UNION ALL
      SELECT u.doc_id, u.node_idx, k.parent_idx, u.n FROM up u JOIN k ON k.doc_id = u.doc_id AND k.node_idx = u.a
      WHERE k.parent_idx IS NOT NULL)
    SELECT doc_id, a::BIGINT AS node_idx, sum(n)::BIGINT AS subtree_tokens FROM up GROUP BY 1, 2""", "nodes")
def _(t):
    sized = t.nodes.withColumn("token_count", F.length("title").cast("long"))
    return tree.subtree_tokens(sized).select("doc_id", "node_idx", "subtree_tokens")


@query("a11_location_stats", """
    SELECT doc_id, count(*) AS total, count(*) FILTER (image_caption IS NOT NULL OR table_caption IS NOT NULL) AS visual,
      count(*) FILTER (has_pos) AS located, round(100.0 * count(*) FILTER (has_pos) / count(*), 6) AS rate,
      (100.0 * count(*) FILTER (has_pos) / count(*) < 95)::BIGINT AS low FROM node_clauses GROUP BY 1""", "node_clauses")
def _(t):
    out = quality.location_stats(t.node_clauses, ["doc_id"])
    return out.select("doc_id", "total", "visual", "located", F.round("rate", 6).alias("rate"), *_long("low"))


@query("a12_fill_rate", """
    SELECT doc_id, count(*) AS nodes, round(avg((coalesce(original_text, '') <> '')::INT), 6) AS fill_rate FROM nodes GROUP BY 1""", "nodes")
def _(t):
    return quality.fill_rate(t.nodes).select("doc_id", "nodes", F.round("fill_rate", 6).alias("fill_rate"))


@query("a14_large_nodes", """
    SELECT n.doc_id, node_idx::BIGINT AS node_idx, sum(token_count)::BIGINT AS tokens, (end_index - start_index)::BIGINT AS span
    FROM nodes n JOIN page_texts p ON n.doc_id = p.doc_id AND p.page_no BETWEEN start_index AND end_index
    WHERE end_index - start_index > 5 GROUP BY ALL HAVING sum(token_count) >= 100""", "nodes page_texts")
def _(t):
    out = toc.large_nodes(t.nodes, t.page_texts, max_pages=5, max_tokens=100)
    return out.select("doc_id", "node_idx", *_long("tokens"), (F.col("end_index") - F.col("start_index")).cast("long").alias("span"))


@query("a19_clauses_per_node", "SELECT doc_id, node_id, count(*) AS clauses FROM node_clauses GROUP BY 1, 2", "node_clauses")
def _(t):
    return quality.clauses_per_node(t.node_clauses)


@query("w1_page_ranges", """
    SELECT doc_id, item_idx::BIGINT AS item_idx, physical_index::BIGINT AS start_index,
      CASE WHEN lead(item_idx) OVER w IS NULL THEN 500 WHEN lead(appear_start) OVER w = 'yes' THEN lead(physical_index) OVER w - 1
        ELSE lead(physical_index) OVER w END::BIGINT AS end_index
    FROM toc WINDOW w AS (PARTITION BY doc_id ORDER BY item_idx)""", "toc")
def _(t):
    return tree.page_ranges(t.toc, F.lit(500)).select("doc_id", "item_idx", *_long("start_index", "end_index"))


@query("w3_boundary_titles", """
    SELECT doc_id, node_idx::BIGINT AS node_idx, lead(title) OVER (PARTITION BY doc_id ORDER BY node_idx) AS end_title FROM nodes""", "nodes")
def _(t):
    return tree.boundary_titles(t.nodes).select("doc_id", "node_idx", "end_title")


@query("w4_fill_ranges", """
    SELECT n.doc_id, n.node_idx::BIGINT AS node_idx, n.start_index::BIGINT AS fill_start, greatest(n.start_index, coalesce(
      (SELECT arg_min(c.start_index, c.node_idx) FROM nodes c WHERE c.doc_id = n.doc_id AND c.parent_idx = n.node_idx),
      lead(n.start_index) OVER (PARTITION BY n.doc_id, coalesce(n.parent_idx, -1) ORDER BY n.node_idx), n.end_index))::BIGINT AS fill_end
    FROM nodes n""", "nodes")
def _(t):
    return tree.fill_ranges(t.nodes).select("doc_id", "node_idx", *_long("fill_start", "fill_end"))


@query("w5_node_ids", "SELECT doc_id, node_idx::BIGINT AS node_idx, printf('%04d', node_idx) AS node_id FROM nodes", "nodes")
def _(t):
    return tree.assign_node_ids(t.nodes.drop("node_id")).select("doc_id", "node_idx", "node_id")


@query("w6_number_clauses", """
    SELECT doc_id, seq::BIGINT AS seq, printf('%s-CLS-%03d', node_id, row_number() OVER (PARTITION BY doc_id, node_id
      ORDER BY (image_caption IS NOT NULL OR table_caption IS NOT NULL), seq)) AS matrix_id FROM node_clauses""", "node_clauses")
def _(t):
    rows = t.node_clauses.withColumn("is_visual", cl.is_visual())
    out = cl.number_clauses(rows, ["doc_id", "node_id"], "node_id", ["is_visual", "seq"],
                            F.col("is_visual").cast("long") * (1 << 40) + F.col("seq"))
    return out.select("doc_id", "seq", "matrix_id")


@query("w13_hierarchy_labels", "SELECT doc_id, node_idx::BIGINT AS node_idx, structure AS label FROM nodes", "nodes")
def _(t):
    return tree.hierarchy_labels(t.nodes).select("doc_id", "node_idx", "label")


@query("u1_add_preface", """
    SELECT doc_id, item_idx::BIGINT AS item_idx, title, physical_index::BIGINT AS physical_index FROM toc UNION ALL
    SELECT doc_id, -1, 'Preface', 1 FROM toc WHERE item_idx = 0 AND physical_index > 1""", "toc")
def _(t):
    return tree.add_preface(t.toc).select("doc_id", "item_idx", "title", *_long("physical_index"))


@query("u2_keyword_overlap", r"""
    WITH k AS (SELECT doc_id, block_idx, list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: length(w) > 1)) AS w,
      text FROM blocks), p AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY block_idx) AS o FROM k)
    SELECT doc_id, block_idx, round(len(list_intersect(w, o)) / len(w), 6) AS share FROM p WHERE o IS NOT NULL AND len(w) > 0""", "blocks")
def _(t):
    from clauseloom.operators.scan import Run, dense_chunk, scan
    words = t.blocks.select("doc_id", "block_idx", tx.keywords("text").alias("w"))
    nxt = scan(words, ["doc_id"], ["block_idx"], [Run("o", "lead", F.col("w"))], dense_chunk("block_idx"))
    return nxt.filter(F.col("o").isNotNull() & (F.size("w") > 0)).select(
        "doc_id", *_long("block_idx"), F.round(tx.keyword_overlap(F.col("w"), F.col("o")), 6).alias("share"))


@query("u3_merge_clauses", """
    SELECT matrix_id, (image_caption IS NOT NULL OR table_caption IS NOT NULL)::BIGINT AS is_visual FROM clauses""", "clauses")
def _(t):
    merged = cl.merge_clauses(t.clauses.filter(~cl.is_visual()), t.clauses.filter(cl.is_visual()))
    return merged.select("matrix_id", F.col("is_visual").cast("int").cast("long").alias("is_visual"))


@query("u5_extend_toc", """
    SELECT doc_id, item_idx::BIGINT AS item_idx, CASE WHEN item_idx % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS group_no FROM toc""", "toc")
def _(t):
    out = toc.extend_toc([t.toc.filter(F.col("item_idx") % 2 == 0), t.toc.filter(F.col("item_idx") % 2 == 1)])
    return out.select("doc_id", "item_idx", *_long("group_no"))


HEADERS_SQL = rf"""
  h AS (SELECT *, {corpora.strip('line')} AS s FROM markdown_lines),
  g AS (SELECT *, sum(CASE WHEN s LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_num) AS fences FROM h),
  heads2 AS (SELECT doc_id, line_num, length(regexp_extract(line, '^(#{{1,6}})', 1)) AS level,
      {corpora.strip("regexp_extract(s, '^#{1,6}" + chr(92) + "s+(.+)$', 1)")} AS title
    FROM g WHERE fences % 2 = 0 AND s NOT LIKE '```%' AND regexp_matches(s, '^#{{1,6}}\s+.+$') AND line LIKE '#%')"""


@query("t1_markdown_headers", f"WITH {HEADERS_SQL} SELECT doc_id, line_num, level::BIGINT AS level, title FROM heads2", "markdown_lines")
def _(t):
    return markdown.headers(t.markdown_lines).select("doc_id", "line_num", *_long("level"), "title")


@query("w2_section_text", f"""
    WITH {HEADERS_SQL}, r AS (SELECT *, lead(line_num) OVER (PARTITION BY doc_id ORDER BY line_num) AS nxt FROM heads2)
    SELECT r.doc_id, r.line_num, {corpora.strip("string_agg(l.line, chr(10) ORDER BY l.line_num)")} AS text
    FROM r JOIN markdown_lines l ON l.doc_id = r.doc_id AND l.line_num >= r.line_num AND (nxt IS NULL OR l.line_num < nxt)
    GROUP BY 1, 2""", "markdown_lines")
def _(t):
    return markdown.section_text(t.markdown_lines).select("doc_id", "line_num", "text")


TREE_SQL = f"""
    {HEADERS_SQL}, r AS (SELECT *, lead(line_num) OVER (PARTITION BY doc_id ORDER BY line_num) AS nxt,
      row_number() OVER (PARTITION BY doc_id ORDER BY line_num) - 1 AS node_idx FROM heads2),
    x AS (SELECT r.doc_id, r.node_idx, r.level, r.title, {corpora.strip("string_agg(l.line, chr(10) ORDER BY l.line_num)")} AS text
    FROM r JOIN markdown_lines l ON l.doc_id = r.doc_id AND l.line_num >= r.line_num AND (nxt IS NULL OR l.line_num < nxt) GROUP BY ALL)"""


@query("t2_markdown_tree", f"""
    WITH {TREE_SQL} SELECT doc_id, node_idx, printf('%04d', node_idx + 1) AS node_id, title, level::BIGINT AS level, {corpora.tokens('text')}::BIGINT AS token_count,
      (SELECT max(y.node_idx) FROM x y WHERE y.doc_id = x.doc_id AND y.node_idx < x.node_idx AND y.level < x.level) AS parent_idx
    FROM x""", "markdown_lines")
def _(t):
    return markdown.markdown_tree(t.markdown_lines).select("doc_id", "node_idx", "node_id", "title", *_long("level"), "token_count", "parent_idx")


@query("t3_thin_tree", f"""
    WITH {TREE_SQL}, k AS (SELECT *, {corpora.tokens('text')} AS n,
      coalesce((SELECT min(y.node_idx) FROM x y WHERE y.doc_id = x.doc_id AND y.node_idx > x.node_idx AND y.level <= x.level), 1000000) AS stop FROM x),
    s AS (SELECT k.*, (SELECT sum(y.n) FROM k y WHERE y.doc_id = k.doc_id AND y.node_idx >= k.node_idx AND y.node_idx < k.stop) AS total FROM k),
    v AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s a WHERE a.doc_id = s.doc_id AND a.node_idx < s.node_idx AND a.stop > s.node_idx AND a.total < 120))
    SELECT v.doc_id, v.node_idx, (SELECT string_agg(s.text, chr(10) || chr(10) ORDER BY s.node_idx) FROM s WHERE s.doc_id = v.doc_id
      AND s.node_idx >= v.node_idx AND s.node_idx < CASE WHEN v.total < 120 THEN v.stop ELSE v.node_idx + 1 END) AS text FROM v""", "markdown_lines")
def _(t):
    base = markdown.markdown_nodes(t.markdown_lines)
    return tree.thin_tree(base, 120).select("doc_id", "node_idx", "text")


@query("t4_flatten_tree", """
    SELECT n.doc_id, n.node_idx::BIGINT AS node_idx, concat_ws('/', g.title, p.title, n.title) AS path, (n.level < 3)::BIGINT AS has_children
    FROM nodes n LEFT JOIN nodes p ON p.doc_id = n.doc_id AND p.node_idx = n.parent_idx
    LEFT JOIN nodes g ON g.doc_id = n.doc_id AND g.node_idx = p.parent_idx""", "nodes")
def _(t):
    return tree.flatten_tree(t.nodes).select("doc_id", "node_idx", "path", F.col("has_children").cast("int").cast("long").alias("has_children"))


@query("t5_leaf_nodes", """
    SELECT n.doc_id, n.node_idx::BIGINT AS node_idx, concat_ws('/', g.title, p.title, n.title) AS path
    FROM nodes n JOIN nodes p ON p.doc_id = n.doc_id AND p.node_idx = n.parent_idx
    JOIN nodes g ON g.doc_id = n.doc_id AND g.node_idx = p.parent_idx""", "nodes")
def _(t):
    return tree.leaf_nodes(t.nodes).select("doc_id", "node_idx", "path")


@query("t6_parse_physical_index", """
    SELECT doc_id, item_idx::BIGINT AS item_idx, CASE WHEN item_idx % 4 = 3 THEN NULL ELSE physical_index END::BIGINT AS parsed FROM toc""", "toc")
def _(t):
    p, n = F.col("physical_index").cast("string"), F.col("item_idx") % 4
    raw = (F.when(n == 0, F.concat(F.lit("<physical_index_"), p, F.lit(">"))).when(n == 1, F.concat(F.lit("physical_index_"), p))
           .when(n == 2, p).otherwise(F.concat(p, F.lit("x"))))
    return t.toc.select("doc_id", "item_idx", tx.parse_physical_index(raw).cast("long").alias("parsed"))


@query("t7_parse_page", """
    SELECT doc_id, item_idx::BIGINT AS item_idx, CASE WHEN item_idx % 3 <> 0 THEN page END::BIGINT AS parsed FROM toc""", "toc")
def _(t):
    raw = F.when(F.col("item_idx") % 3 == 0, F.concat(F.lit("p. "), F.col("page").cast("string"))).otherwise(
        F.concat(F.lit(" "), F.col("page").cast("string")))
    return t.toc.select("doc_id", "item_idx", tx.parse_page(raw).cast("long").alias("parsed"))


@query("t11_normalize_leaders", r"""
    SELECT doc_id, item_idx::BIGINT AS item_idx, structure || ' ' || title || CASE WHEN item_idx % 3 = 0 THEN '....' ELSE ': ' END || page AS line FROM toc""", "toc")
def _(t):
    n = F.col("item_idx") % 3
    dots = F.when(n == 0, "....").when(n == 1, ".......").otherwise(". . . . . . .")
    line = F.concat("structure", F.lit(" "), "title", dots, F.col("page").cast("string"))
    return t.toc.select("doc_id", "item_idx", tx.normalize_leaders(line).alias("line"))


@query("t20_labelled_pages", """
    SELECT doc_id, page_no::BIGINT AS page_no, '<physical_index_' || page_no || '>' || chr(10) || text || chr(10) || '<physical_index_' || page_no || '>' || chr(10) AS labelled
    FROM page_texts""", "page_texts")
def _(t):
    return t.page_texts.select("doc_id", *_long("page_no"), toc.labelled_page(F.col("page_no"), F.col("text")).alias("labelled"))


@query("t20_page_range_text", """
    SELECT doc_id, string_agg('========== 第' || page_no || '页 ==========' || chr(10) || text || chr(10) || '========== 第' || page_no || '页结束 ==========',
      chr(10) || chr(10) ORDER BY page_no) AS text FROM page_texts WHERE page_no BETWEEN 1 AND 3 GROUP BY 1""", "page_texts")
def _(t):
    return toc.marked_range_text(t.page_texts, 0, 3).select("doc_id", "text")


@query("t21_node_page_text", """
    SELECT n.doc_id, node_idx::BIGINT AS node_idx, string_agg(text, '' ORDER BY page_no) AS text
    FROM nodes n JOIN page_texts p ON n.doc_id = p.doc_id AND p.page_no BETWEEN start_index AND end_index GROUP BY 1, 2""", "nodes page_texts")
def _(t):
    return toc.node_page_text(t.nodes, t.page_texts).select("doc_id", "node_idx", "text")


@query("t22_page_tags", """
    SELECT doc_id, page_no::BIGINT AS page_no, page_no::BIGINT AS first_tag, (page_no + 1)::BIGINT AS last_tag, 'z' || text AS rest FROM page_texts""", "page_texts")
def _(t):
    n = F.col("page_no").cast("string")
    tagged = F.concat(F.lit("<start_index_"), n, F.lit("> and <start_index_"), (F.col("page_no") + 1).cast("string"), F.lit(">"))
    body = F.concat(F.lit("z<physical_index_"), n, F.lit(">"), "text", F.lit("\n<physical_index_"), n, F.lit(">"), "text")
    return t.page_texts.select("doc_id", *_long("page_no"), tx.first_tag(tagged).cast("long").alias("first_tag"),
                               tx.last_tag(tagged).cast("long").alias("last_tag"), tx.drop_first_tagged(body).alias("rest"))


@query("t23_summaries", f"""
    SELECT doc_id, CASE WHEN {corpora.tokens('text')} < 200 THEN text ELSE text[1:500] || '...' END AS summary FROM documents""")
def _(t):
    return t.read("documents").select("doc_id", tx.extractive_summary("text", tx.token_count("text")).alias("summary"))


@query("t24_default_root", """
    SELECT doc_id, 'Full Document' AS title, 1::BIGINT AS start_index, 999::BIGINT AS end_index FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM nodes)""", "nodes")
def _(t):
    return tree.default_root(t.read("documents"), t.nodes).select("doc_id", "title", *_long("start_index", "end_index"))


@query("q2_toc_checks", """
    WITH n AS (SELECT *, 70 AS pages FROM nodes),
    pg AS (SELECT DISTINCT doc_id, unnest(range(greatest(start_index, 1), least(end_index, pages) + 1)) AS p FROM n WHERE level = 2),
    o AS (SELECT doc_id, count(*) FILTER (start_index < b) AS n_over, count(*) FILTER (start_index > b + 1) AS gaps FROM
      (SELECT *, lag(end_index) OVER (PARTITION BY doc_id ORDER BY start_index, node_idx) AS b FROM n WHERE level = 2) GROUP BY 1)
    SELECT doc_id, max(level)::BIGINT AS depth, sum(CASE WHEN start_index >= 1 AND end_index >= start_index AND end_index <= pages THEN 0 ELSE 1 END)::BIGINT AS illegal_ranges,
      max(n_over) AS n_overlaps, max(gaps) AS gaps, round(max(c) / 70.0, 6)::DOUBLE AS coverage
    FROM n JOIN o USING (doc_id) JOIN (SELECT doc_id, count(*) AS c FROM pg GROUP BY 1) USING (doc_id) GROUP BY doc_id""", "nodes")
def _(t):
    pages = t.read("region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit(70).alias("pages"))
    out = tree.toc_checks(t.nodes, pages, level=2)
    return out.select("doc_id", *_long("depth"), "illegal_ranges", F.col("overlaps").alias("n_overlaps"), "gaps", F.round("coverage", 6).alias("coverage"))
