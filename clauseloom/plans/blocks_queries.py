"""Block filters, text assembly, coordinates and page metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import geometry as geo
from clauseloom.functions import text as tx
from clauseloom.functions.html import table_text
from clauseloom.operators import blocks as ops
from clauseloom.operators import quality
from clauseloom.plans import corpora
from clauseloom.plans.catalog import query


@query("f1_blocks_on_page", "SELECT doc_id, block_idx, text FROM blocks WHERE page_idx = 1", "blocks")
def _(t):
    return ops.blocks_on_page(t.blocks, 1).select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "text")


@query("f2_blocks_in_range", """
    SELECT doc_id, block_idx::BIGINT AS block_idx FROM layout WHERE coalesce(page_idx, -1) BETWEEN -1 AND 2""", "layout")
def _(t):
    return ops.blocks_in_range(t.layout, -1, 2).select("doc_id", F.col("block_idx").cast("long").alias("block_idx"))


BLOCK_TEXT = """CASE WHEN type = 'list' THEN array_to_string(list_items, ' ')
    WHEN type = 'image' THEN coalesce(array_to_string(image_caption, ' '), '')
    WHEN type = 'table' THEN coalesce(array_to_string(table_caption, ' '), '') ELSE text END"""


@query("f3_block_text", f"SELECT doc_id, block_idx::BIGINT AS block_idx, {BLOCK_TEXT} AS body FROM layout", "layout")
def _(t):
    return t.layout.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), ops.block_text().alias("body"))


@query("f10_valid_bbox", """
    SELECT doc_id, block_idx::BIGINT AS block_idx FROM layout WHERE len(bbox) = 4 AND page_idx IS NOT NULL""", "layout")
def _(t):
    return t.layout.filter(ops.valid_bbox()).select("doc_id", F.col("block_idx").cast("long").alias("block_idx"))


@query("a2_type_counts", """
    SELECT doc_id, count(*) FILTER (type = 'text') AS text, count(*) FILTER (type = 'list') AS list,
      count(*) FILTER (type = 'image') AS image, count(*) FILTER (type = 'table') AS "table",
      count(*) FILTER (type NOT IN ('text', 'list', 'image', 'table')) AS other FROM layout GROUP BY 1""", "layout")
def _(t):
    return ops.type_counts(t.layout)


@query("a15_last_page", "SELECT doc_id, max(page_idx)::BIGINT AS last_page FROM layout GROUP BY 1", "layout")
def _(t):
    return ops.last_page(t.layout).select("doc_id", F.col("last_page").cast("long").alias("last_page"))


@query("a16_page_heights", """
    WITH d AS (SELECT doc_id, avg(height) AS a, max(height) FILTER (page_idx = 1) AS h1,
               max(height) FILTER (page_idx = 0) AS h0 FROM page_dims GROUP BY 1)
    SELECT doc_id, round(coalesce(a, 842), 6) AS avg_height, coalesce(h1, h0, 842.0)::DOUBLE AS page_height
    FROM documents LEFT JOIN d USING (doc_id)""", "page_dims")
def _(t):
    out = ops.page_heights(t.read("documents"), t.page_dims, 1)
    return out.select("doc_id", F.round("avg_height", 6).alias("avg_height"), "page_height")


@query("j7_page_dims", """
    SELECT doc_id, block_idx, coalesce(width, 595)::DOUBLE AS width, coalesce(height, 842)::DOUBLE AS height
    FROM blocks LEFT JOIN page_dims USING (doc_id, page_idx)""", "blocks page_dims")
def _(t):
    return ops.with_page_dims(t.blocks, t.page_dims).select(
        "doc_id", F.col("block_idx").cast("long").alias("block_idx"), "width", "height")


@query("g1_to_points", """
    SELECT doc_id, block_idx, round(x0 / 1000 * 612, 6) AS px0, round(y0 / 1000 * 792, 6) AS py0,
           round(x1 / 1000 * 612, 6) AS px1, round(y1 / 1000 * 792, 6) AS py1 FROM blocks""", "blocks")
def _(t):
    p = geo.to_points(ops.position_struct(F.col("page_idx"), F.col("bbox")), F.lit(612.0), F.lit(792.0))
    rows = t.blocks.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), p.alias("p"))
    return rows.select("doc_id", "block_idx", *[F.round(f"p.{c}", 6).alias(f"p{c}") for c in ("x0", "y0", "x1", "y1")])


@query("g2_convert_positions", """
    SELECT n.doc_id, n.node_idx::BIGINT AS node_idx, CASE WHEN has_pos THEN round(100 / 1000.0 * coalesce(d.width, 595), 6) END AS x0,
           CASE WHEN has_pos THEN round(130 / 1000.0 * coalesce(d.height, 842), 6) END AS y1
    FROM nodes n LEFT JOIN page_dims d ON d.doc_id = n.doc_id AND d.page_idx = n.start_index - 1""", "nodes page_dims")
def _(t):
    out = ops.convert_positions(t.nodes.select("doc_id", "node_idx", "positions"), t.page_dims, ["node_idx"])
    first = F.try_element_at("positions", F.lit(1))
    return out.select("doc_id", "node_idx", F.round(first["x0"], 6).alias("x0"), F.round(first["y1"], 6).alias("y1"))


@query("g3_flip_bbox", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      CASE WHEN l_tax > 0 THEN round_even(l_discount * 50, 0)::BIGINT ELSE 0 END AS x0,
      CASE WHEN l_tax > 0 THEN round_even(842.5 - (l_quantity + 1), 0)::BIGINT ELSE 0 END AS y0,
      CASE WHEN l_tax > 0 THEN round_even(842.5 - l_quantity, 0)::BIGINT ELSE 0 END AS y1 FROM lineitem""")
def _(t):
    box = F.when(F.col("l_tax") > 0, F.array(F.col("l_discount") * 50, F.col("l_quantity"), F.lit(9.0), F.col("l_quantity") + 1)
                 ).otherwise(F.array(F.lit(1.0)))
    flipped = geo.flip_bbox(box, F.lit(842.5))
    return t.read("lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice",
        flipped[0].alias("x0"), flipped[1].alias("y0"), flipped[3].alias("y1"))


@query("g4_page_size_name", """
    SELECT doc_id, page_idx, CASE WHEN abs(width - 595) < 5 AND abs(height - 842) < 5 THEN 'A4'
      WHEN abs(width - 842) < 5 AND abs(height - 1191) < 5 THEN 'A3' WHEN abs(width - 612) < 5 AND abs(height - 792) < 5 THEN 'Letter'
      WHEN abs(width - 612) < 5 AND abs(height - 1008) < 5 THEN 'Legal' ELSE 'Custom' END AS name FROM page_dims""", "page_dims")
def _(t):
    return t.page_dims.select("doc_id", F.col("page_idx").cast("long").alias("page_idx"),
                              geo.page_size_name(F.col("width"), F.col("height")).alias("name"))


@query("g5_scale_boxes", """
    SELECT matrix_id, pos_page::BIGINT AS page_idx, 15.0::DOUBLE AS x0, round(q * 15, 6) AS y0, round((q + 500) * 1.5, 6) AS x1
    FROM clauses WHERE has_pos""", "clauses")
def _(t):
    rows = t.clauses.select("matrix_id", F.explode(geo.scale_boxes(F.col("positions"), 1.5)).alias("p"))
    return rows.select("matrix_id", F.col("p.page_idx").cast("long").alias("page_idx"), F.round("p.x0", 6).alias("x0"),
                       F.round("p.y0", 6).alias("y0"), F.round("p.x1", 6).alias("x1"))


PART = r"""CASE type WHEN 'text' THEN nullif(text, '') WHEN 'header' THEN '# ' || nullif(text, '')
    WHEN 'list' THEN array_to_string(list_items, chr(10))
    WHEN 'image' THEN '![' || CASE WHEN len(image_caption) > 0 THEN array_to_string(image_caption, ' ')
      ELSE 'p' || (o_custkey % 50) || '.jpg' END || '](' || img_path || ')'
    WHEN 'table' THEN '[Table' || coalesce(': ' || img_path, '') || ']'
      || CASE WHEN len(table_caption) > 0 THEN ' ' || table_caption[1] ELSE '' END || chr(10)
      || CASE WHEN table_body IS NOT NULL THEN o_custkey || ' | ' || o_orderstatus || chr(10) || o_orderpriority END END"""


@query("x10_assemble_text", f"""
    SELECT doc_id, page_idx::BIGINT AS page_idx, string_agg(part, chr(10) || chr(10) ORDER BY block_idx) AS original_text
    FROM (SELECT *, {PART} AS part FROM layout) WHERE part IS NOT NULL GROUP BY 1, 2""", "layout")
def _(t):
    return ops.assemble_text(t.layout, ["doc_id", "page_idx"]).select(
        "doc_id", F.col("page_idx").cast("long").alias("page_idx"), "original_text")


@query("x11_page_range_text", f"""
    SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY block_idx) AS original_text
    FROM (SELECT *, {PART} AS part FROM layout) WHERE part IS NOT NULL AND page_idx BETWEEN 1 AND 2 GROUP BY 1""", "layout")
def _(t):
    return ops.assemble_text(ops.blocks_in_range(t.layout, 1, 2), ["doc_id"])


SPANS = """s AS (SELECT doc_id, block_idx AS start_idx, page_idx AS first_page, least(page_idx + 1, 4) AS last_page,
    coalesce(lead(block_idx) OVER (PARTITION BY doc_id ORDER BY block_idx), 1000) AS end_idx
    FROM layout WHERE type = 'header')"""


def header_spans(t):
    from clauseloom.operators.scan import Run, dense_chunk, scan
    heads = t.layout.filter(F.col("type") == "header").select("doc_id", "block_idx", "page_idx")
    ahead = scan(heads, ["doc_id"], ["block_idx"], [Run("nxt", "lead", F.col("block_idx"))], dense_chunk("block_idx"))
    return ahead.select("doc_id", F.col("block_idx").alias("start_idx"), F.col("page_idx").alias("first_page"),
                        F.when(F.col("page_idx").isNotNull(), F.least(F.col("page_idx") + 1, F.lit(4))).alias("last_page"),
                        F.coalesce("nxt", F.lit(1000)).alias("end_idx"))


@query("x9_slice_between", f"""
    WITH {SPANS} SELECT l.doc_id, s.start_idx::BIGINT AS start_idx, l.block_idx::BIGINT AS block_idx FROM layout l JOIN s
    ON l.doc_id = s.doc_id AND l.block_idx > s.start_idx AND l.block_idx < s.end_idx
    AND (s.first_page IS NULL OR coalesce(l.page_idx, -1) BETWEEN s.first_page AND s.last_page)""", "layout")
def _(t):
    return ops.slice_blocks(t.layout, header_spans(t), ["doc_id", "start_idx"]).select(
        "doc_id", F.col("start_idx").cast("long").alias("start_idx"), F.col("block_idx").cast("long").alias("block_idx"))


@query("x12_positions", """
    SELECT doc_id, page_idx::BIGINT AS page_idx, count(*) AS n, round(sum(bbox[2]), 6)::DOUBLE AS y, arg_min(bbox[2], block_idx)::DOUBLE AS first_y
    FROM layout WHERE len(bbox) = 4 AND page_idx IS NOT NULL GROUP BY 1, 2""", "layout")
def _(t):
    out = ops.positions_of(t.layout, ["doc_id", "page_idx"])
    return out.select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), F.size("positions").cast("long").alias("n"),
                      F.aggregate("positions", F.lit(0.0), lambda a, p: a + p["y0"]).alias("y"), F.col("positions")[0]["y0"].alias("first_y"))


@query("x14_table_text", """
    SELECT doc_id, block_idx::BIGINT AS block_idx, o_custkey || ' | ' || o_orderstatus || chr(10) || o_orderpriority AS body
    FROM layout WHERE table_body IS NOT NULL""", "layout")
def _(t):
    return t.layout.filter(F.col("table_body").isNotNull()).select(
        "doc_id", F.col("block_idx").cast("long").alias("block_idx"), table_text(F.col("table_body")).alias("body"))


@query("x16_image_refs", """
    SELECT doc_id, block_idx::BIGINT AS block_idx, CASE WHEN len(image_caption) > 0 THEN array_to_string(image_caption, ' ')
      ELSE 'p' || (o_custkey % 50) || '.jpg' END AS alt, img_path FROM layout WHERE type = 'image'""", "layout")
def _(t):
    parts = t.layout.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), ops.block_part().alias("part"))
    return parts.select("doc_id", "block_idx", F.explode(tx.image_refs("part")).alias("r")).select(
        "doc_id", "block_idx", "r.alt", "r.img_path")


@query("x17_image_count", """
    SELECT doc_id, count(*) FILTER (type = 'image') AS images FROM layout GROUP BY 1""", "layout")
def _(t):
    return ops.assemble_text(t.layout, ["doc_id"]).select("doc_id", tx.image_count("original_text").cast("long").alias("images"))


@query("e7_block_position", """
    SELECT doc_id, block_idx::BIGINT AS block_idx, coalesce(page_idx, 0)::BIGINT AS page,
           CASE WHEN len(bbox) = 4 THEN bbox[2] ELSE 0 END::DOUBLE AS y0 FROM layout""", "layout")
def _(t):
    p = t.layout.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), ops.block_position().alias("p"))
    return p.select("doc_id", "block_idx", F.col("p.page_idx").cast("long").alias("page"), F.col("p.y0").alias("y0"))


@query("q3_parse_checks", """
    WITH p AS (SELECT doc_id, page_idx, count(*) AS n FROM layout WHERE page_idx >= 0 GROUP BY 1, 2),
    d AS (SELECT doc_id, max(page_idx) + 1 AS pages, count(*) AS used, sum(n) AS b FROM p GROUP BY 1)
    SELECT doc_id, pages::BIGINT AS pages, (pages - used)::BIGINT AS empty_pages, round(b / pages, 6)::DOUBLE AS blocks_per_page,
           (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id AND n > b / pages * 1.5) AS abnormal_pages FROM d""", "layout")
def _(t):
    return quality.parse_checks(t.layout).select("doc_id", "pages", "empty_pages", F.round("blocks_per_page", 6).alias("blocks_per_page"),
                                                 "abnormal_pages")


@query("q4_box_checks", """
    SELECT doc_id, count(*) AS positions, count(*) FILTER (x1 > coalesce(width, 595) OR y1 > coalesce(height, 842)) AS out_of_bounds,
           0::BIGINT AS inverted FROM blocks LEFT JOIN page_dims USING (doc_id, page_idx) GROUP BY 1""", "blocks page_dims")
def _(t):
    rows = ops.with_page_dims(t.blocks, t.page_dims).select(
        "doc_id", ops.position_struct(F.col("page_idx"), F.col("bbox")).alias("position"), "width", "height")
    return quality.box_checks(rows)


@query("a20_highlights_by_page", """
    SELECT matrix_id, (pos_page + 1)::BIGINT AS page_num, 1::BIGINT AS n, round(q * 10, 6) AS y0 FROM clauses WHERE has_pos""", "clauses")
def _(t):
    out = ops.highlights_by_page(t.clauses, ["matrix_id"])
    return out.select("matrix_id", F.col("page_num").cast("long").alias("page_num"), F.size("boxes").cast("long").alias("n"),
                      F.round(F.col("boxes")[0]["y0"], 6).alias("y0"))


@query("q1_quality_band", """
    SELECT l_orderkey AS doc_id, CASE WHEN r >= 0.9 THEN 'excellent' WHEN r >= 0.7 THEN 'good' WHEN r >= 0.5 THEN 'medium' ELSE 'poor' END AS band
    FROM (SELECT l_orderkey, round(avg(l_discount) * 10, 6) AS r FROM lineitem GROUP BY 1)""")
def _(t):
    r = t.read("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.round(F.avg("l_discount") * 10, 6).alias("r"))
    from clauseloom.functions.labels import quality_band
    return r.select("doc_id", quality_band(F.col("r")).alias("band"))


@query("x1_normalize_title", f"""
    SELECT doc_id, block_idx, {corpora.title('text')} AS full_form, {corpora.title_light('text')} AS light_form FROM blocks""", "blocks")
def _(t):
    return t.blocks.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"),
                           tx.normalize_title("text").alias("full_form"), tx.normalize_title_light("text").alias("light_form"))


@query("x2_normalize_title_light", f"""
    SELECT conv_id, turn, {corpora.title_light('text')} AS light_form FROM conversations""")
def _(t):
    return t.read("conversations").select("conv_id", "turn", tx.normalize_title_light("text").alias("light_form"))


@query("e1_normalize_evidence", f"SELECT doc_id, block_idx, {corpora.evidence('text')} AS body FROM blocks", "blocks")
def _(t):
    return t.blocks.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), tx.normalize_evidence("text").alias("body"))


@query("scalar_token_count", f"SELECT doc_id, {corpora.tokens('text')}::BIGINT AS tokens FROM documents")
def _(t):
    return t.read("documents").select("doc_id", tx.token_count("text").alias("tokens"))


@query("scalar_unescape_title", r"""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice,
           CASE WHEN l_partkey % 2 = 0 THEN '第' || l_partkey || '章 "x"' ELSE 'plain \u00 ' || l_partkey END AS title FROM lineitem""")
def _(t):
    escaped = F.concat(F.lit("\\u7b2c"), F.col("l_partkey").cast("string"), F.lit('\\u7ae0 "x"'))
    raw = F.when(F.col("l_partkey") % 2 == 0, escaped).otherwise(
        F.concat(F.lit("plain \\u00 "), F.col("l_partkey").cast("string")))
    return t.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"),
                                     "l_extendedprice", tx.unescape_title(raw).alias("title"))
