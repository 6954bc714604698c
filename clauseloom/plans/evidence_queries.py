"""Evidence binding, matching strategies, title search, text fill, clause rules and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import similarity as sim
from clauseloom.functions import text as tx
from clauseloom.operators import clauses as cl
from clauseloom.operators import evidence as ev
from clauseloom.operators import quality, slicing, toc, tree
from clauseloom.operators.containment import passage_binding
from clauseloom.plans import corpora
from clauseloom.plans.catalog import query
from clauseloom.sources.adapters import one_position

BINDING = f"""d AS (SELECT doc_id, {corpora.evidence('text')} AS hay FROM documents),
    b AS (SELECT item_id, {corpora.evidence('text')} AS needle FROM benchmark),
    hit AS (SELECT doc_id, item_id FROM d JOIN b ON contains(hay, needle) WHERE needle <> '')"""


@query("a6_passage_binding", f"""
    WITH {BINDING} SELECT b.item_id, count(doc_id) AS documents, (count(doc_id) > 0)::BIGINT AS bound,
      min(doc_id) AS first_doc FROM b LEFT JOIN hit USING (item_id) GROUP BY 1""")
def _(t):
    hits = passage_binding(t.spread("documents"), t.read("benchmark"))
    per = hits.groupBy("item_id").agg(F.count("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))
    return t.read("benchmark").select("item_id").join(per, "item_id", "left").select(
        "item_id", F.coalesce("documents", F.lit(0)).alias("documents"),
        F.col("documents").isNotNull().cast("int").cast("long").alias("bound"), "first_doc")


@query("a6_binding_rate", f"""
    WITH {BINDING} SELECT count(*) AS passages, count(h) AS bound, round(count(h) / count(*), 6)::DOUBLE AS binding_rate,
      max((SELECT count(*) FROM hit)) AS pairs FROM b LEFT JOIN (SELECT DISTINCT item_id, 1 AS h FROM hit) USING (item_id)""")
def _(t):
    per = passage_binding(t.spread("documents"), t.read("benchmark")).groupBy("item_id").agg(F.count("doc_id").alias("n"))
    all_items = t.read("benchmark").select("item_id").join(per, "item_id", "left")
    return all_items.agg(F.count(F.lit(1)).alias("passages"), F.count("n").alias("bound"),
                         F.round(F.count("n") / F.count(F.lit(1)), 6).alias("binding_rate"), F.sum("n").alias("pairs"))


@query("j2_node_blocks", """
    SELECT doc_id, node_id, ord::BIGINT AS ord, type FROM evidence_blocks""", "evidence_blocks")
def _(t):
    return ev.node_blocks(t.page_nodes, t.layout).select("doc_id", "node_id", F.col("ord").cast("long").alias("ord"), "type")


def _prepared(t):
    return (t.page_clauses.select("doc_id", "node_id", "matrix_id", tx.normalize_evidence("original_text").alias("norm"),
                                  tx.keywords("original_text").alias("words")),
            ev.prepare_blocks(ev.node_blocks(t.page_nodes, t.layout)))


def _first(df):
    p = F.col("positions")[0]
    return df.select("doc_id", "matrix_id", p["page_idx"].cast("long").alias("page"), p["y0"].alias("y0"))


@query("e2_match_exact", f"""
    WITH f AS (SELECT doc_id, node_id, n, min(ord) AS ord FROM (
      SELECT doc_id, node_id, ord, norm AS n FROM evidence_blocks WHERE type = 'text' UNION ALL
      SELECT doc_id, node_id, ord, {corpora.evidence('list_items[1]')} FROM evidence_blocks WHERE type = 'list' UNION ALL
      SELECT doc_id, node_id, ord, {corpora.evidence('list_items[2]')} FROM evidence_blocks WHERE type = 'list') GROUP BY 1, 2, 3)
    SELECT c.doc_id, matrix_id, b.page_idx::BIGINT AS page, b.y0::DOUBLE AS y0 FROM page_clauses c
    JOIN f ON f.doc_id = c.doc_id AND f.node_id = c.node_id AND f.n = c.norm
    JOIN evidence_blocks b ON b.doc_id = f.doc_id AND b.node_id = f.node_id AND b.ord = f.ord""", "evidence_blocks page_clauses")
def _(t):
    return _first(ev.match_exact(*_prepared(t)))


@query("e3_match_substring", """
    WITH b AS (SELECT *, coalesce(sum(length(norm)) OVER (PARTITION BY doc_id, node_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
      FROM evidence_blocks WHERE type IN ('text', 'list')),
    n AS (SELECT doc_id, node_id, string_agg(norm, '' ORDER BY ord) AS whole FROM b GROUP BY 1, 2),
    h AS (SELECT c.doc_id, c.node_id, c.matrix_id, instr(whole, norm) - 1 AS p, length(norm) AS len FROM page_clauses c JOIN n USING (doc_id, node_id)
      WHERE norm <> '' AND contains(whole, norm))
    SELECT h.doc_id, matrix_id, count(*) AS n, min(b.y0)::DOUBLE AS y0 FROM h JOIN b ON b.doc_id = h.doc_id AND b.node_id = h.node_id
      AND NOT (b.o + length(b.norm) <= p OR b.o >= p + len) GROUP BY 1, 2""", "evidence_blocks page_clauses")
def _(t):
    out = ev.match_substring(*_prepared(t))
    return out.select("doc_id", "matrix_id", F.size("positions").cast("long").alias("n"), F.col("positions")[0]["y0"].alias("y0"))


@query("e5_match_keywords", """
    WITH s AS (SELECT c.doc_id, c.matrix_id, b.ord, b.page_idx, b.y0, len(list_intersect(c.words, b.words)) / len(c.words) AS score
      FROM page_clauses c JOIN evidence_blocks b USING (doc_id, node_id) WHERE type IN ('text', 'list') AND len(c.words) > 0)
    SELECT doc_id, matrix_id, page_idx::BIGINT AS page, y0::DOUBLE AS y0 FROM s WHERE score >= 0.7
    QUALIFY row_number() OVER (PARTITION BY matrix_id ORDER BY score DESC, ord) = 1""", "evidence_blocks page_clauses")
def _(t):
    return _first(ev.match_keywords(*_prepared(t)))


@query("e4_match_similarity")
def _(t):
    return _first(ev.match_similarity(*_prepared(t)))


@query("e6_locate_text")
def _(t):
    out = ev.locate_text(t.page_clauses, ev.node_blocks(t.page_nodes, t.layout))
    return out.select("doc_id", "matrix_id", "strategy", F.size("positions").cast("long").alias("n"))


VISUAL_SQL = """
    WITH i AS (SELECT doc_id, img_path, arg_min(page_idx, block_idx) AS p, arg_min(len(bbox), block_idx) AS n, arg_min(coalesce(page_idx, -1), block_idx) AS q,
        arg_min(coalesce(len(bbox), 0), block_idx) AS m, arg_min(coalesce(bbox[2], -1), block_idx) AS y FROM layout WHERE img_path <> '' GROUP BY 1, 2),
    own AS (SELECT doc_id, node_id, min(ord) AS o, arg_min(y0, ord) AS y0, count(*) AS cnt FROM evidence_blocks GROUP BY 1, 2),
    tb AS (SELECT doc_id, node_id, arg_min(y0, ord) AS y0 FROM evidence_blocks WHERE type = 'table' GROUP BY 1, 2),
    v AS (SELECT *, o_orderkey % 6 = 4 AS wants FROM page_clauses WHERE o_orderkey % 6 IN (3, 4))
    SELECT v.doc_id, v.matrix_id,
      CASE WHEN m = 4 AND q >= 0 THEN 'image' WHEN wants AND tb.y0 IS NOT NULL THEN 'table' WHEN own.y0 IS NOT NULL THEN 'node' END AS strategy,
      CASE WHEN m = 4 AND q >= 0 THEN y WHEN wants AND tb.y0 IS NOT NULL THEN tb.y0 ELSE own.y0 END::DOUBLE AS y0
    FROM v LEFT JOIN i ON i.doc_id = v.doc_id AND i.img_path = v.img_path LEFT JOIN tb ON tb.doc_id = v.doc_id AND tb.node_id = v.node_id
    LEFT JOIN own ON own.doc_id = v.doc_id AND own.node_id = v.node_id"""


@query("e8_locate_visual", VISUAL_SQL, "evidence_blocks page_clauses")
def _(t):
    out = ev.locate_visual(t.page_clauses.filter(cl.is_visual()), t.page_nodes, t.layout, ev.node_blocks(t.page_nodes, t.layout))
    return out.select("doc_id", "matrix_id", "strategy", F.try_element_at("positions", F.lit(1))["y0"].alias("y0"))


@query("j8_locate_by_img_path", """
    WITH i AS (SELECT doc_id, img_path, arg_min(coalesce(page_idx, -1), block_idx) AS q, arg_min(coalesce(len(bbox), 0), block_idx) AS m,
      arg_min(coalesce(bbox[2], -1), block_idx) AS y FROM layout WHERE img_path <> '' GROUP BY 1, 2)
    SELECT c.doc_id, c.matrix_id, CASE WHEN m = 4 AND q >= 0 THEN y END::DOUBLE AS y0 FROM page_clauses c LEFT JOIN i USING (doc_id, img_path)""",
       "layout page_clauses")
def _(t):
    out = ev.locate_by_img_path(t.page_clauses, t.layout)
    return out.select("doc_id", "matrix_id", F.col("_img")[0]["y0"].alias("y0"))


@query("j9_locate_first_table", """
    SELECT doc_id, node_id, arg_min(y0, ord)::DOUBLE AS y0 FROM evidence_blocks WHERE type = 'table' GROUP BY 1, 2""", "evidence_blocks")
def _(t):
    out = ev.locate_first_table(ev.node_blocks(t.page_nodes, t.layout))
    return out.select("doc_id", "node_id", F.col("_table")[0]["y0"].alias("y0"))


@query("e9_locate_clauses")
def _(t):
    out = ev.locate_clauses(t.page_clauses, t.page_nodes, t.layout)
    stats = quality.location_stats(out, ["doc_id"])
    return stats.select("doc_id", "total", "visual", "text", "located", "failed", F.round("rate", 6).alias("rate"), "low")


# -- titles and sections --------------------------------------------------------------------------

def _titles(t):
    return t.header_nodes.select("doc_id", "node_idx", "title", (F.col("start_index") - 1).alias("first_page"),
                                 F.col("end_index").alias("last_page"))


@query("x3_ratio")
def _(t):
    c, b = _prepared(t)
    texts = b.filter(F.col("type") == "text").select("doc_id", "node_id", F.col("norm").alias("body"), "ord")
    first = texts.groupBy("doc_id", "node_id").agg(F.min_by("body", "ord").alias("body"))
    return c.join(first, ["doc_id", "node_id"]).select("doc_id", "matrix_id", F.round(sim.ratio(F.col("norm"), F.col("body")), 6).alias("score"))


def _title_pairs(t):
    """Titles of the header nodes beside every block with text on their start page."""
    wanted = t.header_nodes.select("doc_id", "node_idx", tx.normalize_title("title").alias("w"), (F.col("start_index") - 1).alias("page_key"))
    return wanted.join(slicing.searchable(t.layout), ["doc_id", "page_key"])


@query("x4_window_ratio")
def _(t):
    return _title_pairs(t).select("doc_id", "node_idx", "block_idx",
                                  F.round(sim.window_ratio(F.col("w"), F.col("norm")), 6).alias("score"))


@query("x5_title_contained")
def _(t):
    return _title_pairs(t).select("doc_id", "node_idx", "block_idx",
                                  sim.title_contained(F.col("w"), F.col("norm")).cast("int").alias("hit"))


@query("x6_find_title")
def _(t):
    return slicing.find_title(_titles(t), t.layout, ["doc_id", "node_idx"])


@query("x7_find_title_robust")
def _(t):
    off = _titles(t).withColumn("first_page", F.greatest(F.col("first_page") - F.col("node_idx") % 3, F.lit(0))).withColumn(
        "last_page", F.col("first_page"))
    return slicing.find_title_robust(off, t.layout, ["doc_id", "node_idx"])


@query("x6_find_title_anywhere")
def _(t):
    return slicing.find_title_anywhere(t.header_nodes.select("doc_id", "node_idx", "title"), t.layout, ["doc_id", "node_idx"])


@query("x8_resolve_end")
def _(t):
    starts = slicing.find_title(_titles(t), t.layout, ["doc_id", "node_idx"]).withColumnRenamed("found", "start_idx")
    spans = tree.boundary_titles(t.header_nodes).select("doc_id", "node_idx", "end_title").join(
        _titles(t).drop("title"), ["doc_id", "node_idx"]).join(starts, ["doc_id", "node_idx"])
    return slicing.resolve_end(spans, t.layout, ["doc_id", "node_idx"]).select("doc_id", "node_idx", "start_idx", "end_idx")


@query("x13_positions_between")
def _(t):
    spans = tree.boundary_titles(t.header_nodes).select("doc_id", "node_idx", "end_title").join(_titles(t), ["doc_id", "node_idx"])
    out = slicing.positions_between(spans, t.layout, ["doc_id", "node_idx"])
    return out.select("doc_id", "node_idx", F.size("positions").alias("n"))


@query("x15_fill_node_text")
def _(t):
    out = slicing.fill_node_text(t.header_nodes, t.layout)
    return out.select("doc_id", "node_idx", "title", "original_text", F.size("positions").alias("n"), "step")


@query("q4_alignment_checks")
def _(t):
    return slicing.alignment_checks(slicing.fill_node_text(t.header_nodes, t.layout))


# -- clause rules ---------------------------------------------------------------------------------

TEST_CUES = [("prohibition", r"(^|[^\p{L}])(not|nicht|pas|no)([^\p{L}]|$)", 1),
             ("deadline", r"(^|[^\p{L}])(by|bis|pour|por)([^\p{L}]|$)", 2),
             ("obligation", r"(^|[^\p{L}])(that|und|les|que)([^\p{L}]|$)", 3)]


@query("c1_extract_clauses", r"""
    SELECT doc_id, i - 1 AS item_ord, s AS sentence, CASE WHEN regexp_matches(s, '(^|[^\p{L}])(not|nicht|pas|no)([^\p{L}]|$)') THEN 'prohibition'
      WHEN regexp_matches(s, '(^|[^\p{L}])(by|bis|pour|por)([^\p{L}]|$)') THEN 'deadline' ELSE 'obligation' END AS type
    FROM (SELECT doc_id, i, """ + corpora.strip("l[i]") + r""" AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT doc_id, string_split(regexp_replace(text, '([.!?;])\s+|\n+', '\1' || chr(10), 'g'), chr(10)) AS l FROM documents)))
    WHERE s <> '' AND regexp_matches(s, '(^|[^\p{L}])(not|nicht|pas|no|by|bis|pour|por|that|und|les|que)([^\p{L}]|$)')""")
def _(t):
    sections = t.spread("documents").select("doc_id", F.col("text").alias("original_text"))
    return cl.extract_clauses(sections, TEST_CUES).select("doc_id", F.col("item_ord").cast("long").alias("item_ord"), "sentence", "type")


@query("c2_extractable", "SELECT doc_id, node_id FROM nodes WHERE level = 3 AND original_text <> ''", "nodes")
def _(t):
    return cl.extractable(tree.with_is_leaf(t.nodes)).select("doc_id", "node_id")


def _answers(t):
    """Model answers built from order lines: fenced, bare with text around, with a trailing comma, or broken."""
    k = F.col("l_partkey")
    item = F.concat(F.lit('{"original_text": "part '), k.cast("string"), F.lit('", "actor": None, "type": '),
                    F.when(k % 3 == 0, '"penalty"').otherwise("None"), F.lit(', "page_number": '), F.col("l_linenumber").cast("string"), F.lit("}"))
    body = (F.when(k % 4 == 0, F.concat(F.lit("```json\n["), item, F.lit(", "), item, F.lit("]\n```")))
            .when(k % 4 == 1, F.concat(F.lit("["), item, F.lit("]")))
            .when(k % 4 == 2, F.concat(F.lit("[\n"), item, F.lit(",]"))).otherwise(F.concat(F.lit("["), item)))
    return t.spread("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"),
                                     "l_extendedprice", body.alias("response"))


@query("c3_repair_json", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice, (l_partkey % 4 <> 3)::BIGINT AS ok FROM lineitem""")
def _(t):
    rows = _answers(t)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
                       tx.repair_json("response").isNotNull().cast("int").cast("long").alias("ok"))


@query("c4_responses_to_clauses", """
    SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS ordinal, l_suppkey, 'part ' || l_partkey AS original_text,
      CASE WHEN l_partkey % 3 = 0 THEN 'penalty' ELSE 'requirement' END AS type, 'n1' AS section_id, l_linenumber::BIGINT AS page_number, 'a.jpg' AS img_path
    FROM lineitem, range(2) r(i) WHERE l_partkey % 4 <> 3 AND (l_partkey % 4 = 0 OR i = 0)""")
def _(t):
    rows = _answers(t).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ordinal"), "l_suppkey",
                              tx.repair_json("response").alias("response"), F.lit("n1").alias("node_id"), F.lit("Title").alias("title"),
                              F.lit(1).alias("start_index"), F.lit("a.jpg").alias("img_path"))
    return cl.responses_to_clauses(rows, extra=["l_suppkey"]).select(
        "doc_id", "ordinal", "l_suppkey", "original_text", "type", "section_id", F.col("page_number").cast("long").alias("page_number"), "img_path")


@query("c5_stamp_clauses", """
    SELECT matrix_id, coalesce(CASE WHEN page_number <> 3 THEN section_id END, 'UNKNOWN') AS section_id, 'T' AS section_title,
      CASE WHEN page_number % 2 = 0 THEN 9 ELSE page_number END::BIGINT AS page_number FROM clauses""", "clauses")
def _(t):
    rows = t.clauses.withColumn("node_id", F.when(F.col("page_number") != 3, F.col("section_id"))).withColumn("title", F.lit("T")).withColumn(
        "start_index", F.lit(9)).withColumn("page_number", F.when(F.col("page_number") % 2 == 0, F.lit(0)).otherwise(F.col("page_number")))
    return cl.stamp_clauses(rows).select("matrix_id", "section_id", "section_title", F.col("page_number").cast("long").alias("page_number"))


@query("c6_final_matrix", f"""
    SELECT matrix_id, section_id, {corpora.strip('original_text')} AS original_text FROM clauses ORDER BY section_id, matrix_id""", "clauses")
def _(t):
    return cl.final_matrix(t.clauses).select("matrix_id", "section_id", "original_text")


@query("c7_validate_clauses", """
    SELECT matrix_id, unnest(list_filter([CASE WHEN type IS NULL THEN 'type_missing' END, CASE WHEN actor = '' THEN 'actor_missing' END,
      CASE WHEN NOT has_pos THEN 'positions_missing' END, CASE WHEN has_pos AND pos_page > 4 THEN 'page_out_of_range' END,
      CASE WHEN type = 'obligation' AND action IS NULL THEN 'obligation_incomplete' END], lambda r: r IS NOT NULL)) AS rule FROM clauses""", "clauses")
def _(t):
    return cl.validate_clauses(t.clauses.withColumn("last_page", F.lit(4))).select("matrix_id", "rule")


@query("c8_clause_labels", """
    SELECT matrix_id, CASE type WHEN 'obligation' THEN '义务' WHEN 'requirement' THEN '需求' WHEN 'prohibition' THEN '禁止' WHEN 'deliverable' THEN '交付物'
      WHEN 'deadline' THEN '截止时间' WHEN 'penalty' THEN '惩罚' WHEN 'definition' THEN '定义' ELSE '未分类' END AS type_label,
      concat_ws(' ', nullif(actor, ''), nullif(action, ''), nullif(object, '')) AS structured_info FROM clauses""", "clauses")
def _(t):
    return cl.clause_labels(t.clauses).select("matrix_id", "type_label", "structured_info")


@query("q5_evaluate", """
    WITH g AS (SELECT doc_id, quality = 1 AS g FROM labels), p AS (SELECT doc_id, doc_id % 3 AS m, n_chars FROM documents),
    j AS (SELECT coalesce(g, false) AS g, coalesce(m <> 0, false) AS p, CASE WHEN g AND m <> 0 THEN CASE WHEN m = 1 THEN 1.0 ELSE 1.0 / 3 END END AS iou
      FROM g FULL JOIN p USING (doc_id))
    SELECT count(*) FILTER (g) AS expected, count(*) FILTER (p) AS predicted, count(iou) AS bound, count(*) FILTER (iou < 0.5) AS drifted,
      round(avg(iou), 6)::DOUBLE AS mean_iou, round(count(iou) / count(*) FILTER (g), 6)::DOUBLE AS binding_rate,
      round(count(*) FILTER (iou < 0.5) / count(iou), 6)::DOUBLE AS drift_rate FROM j""")
def _(t):
    empty = F.array().cast("array<struct<page_idx:int,x0:double,y0:double,x1:double,y1:double>>")
    gold = t.read("labels").select("doc_id", F.lit("c").alias("clause_key"), F.when(F.col("quality") == 1, one_position(
        F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))).otherwise(empty).alias("positions"))
    shift = F.when(F.col("doc_id") % 3 == 2, 5.0).otherwise(0.0)
    pred = t.read("documents").select("doc_id", F.lit("c").alias("clause_key"), F.when(F.col("doc_id") % 3 != 0, one_position(
        F.lit(0), shift, F.lit(0.0), shift + 10, F.lit(10.0))).otherwise(empty).alias("positions"))
    out = quality.evaluate(gold, pred)
    return out.select("expected", "predicted", "bound", "drifted", *[F.round(c, 6).alias(c) for c in ("mean_iou", "binding_rate", "drift_rate")])
