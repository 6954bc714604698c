"""Contents pages: detection, items, placing, checking, repair, strategies, page groups, large nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.operators import toc
from clauseloom.plans.catalog import query


def _counts(t):
    return t.toc_doc_pages.groupBy("doc_id").agg(F.max("page_no").alias("pages"))


def _placed(t, off: bool = False):
    """Items with their true index; with ``off`` every tenth one page too far."""
    shift = F.when(F.col("item_idx") % 10 == 4, 1).otherwise(0) if off else F.lit(0)
    return t.toc_entries.select("doc_id", "item_idx", "structure", "title",
                                (F.col("toc_size") + F.col("page") + shift).cast("int").alias("physical_index"))


def _toc_last(t):
    return t.toc_entries.groupBy("doc_id").agg(F.max("toc_size").alias("toc_last"))


@query("t10_is_toc_page", r"""
    SELECT doc_id, page_no::BIGINT AS page_no, (len(regexp_extract_all(text, '(?m) \.{8} \d+$')) >= 3)::BIGINT AS is_toc FROM toc_doc_pages""", "toc_doc_pages")
def _(t):
    return t.toc_doc_pages.select("doc_id", F.col("page_no").cast("long").alias("page_no"),
                                  toc.is_toc_page("text").cast("int").cast("long").alias("is_toc"))


@query("w12_toc_pages", r"""
    WITH f AS (SELECT doc_id, page_no, len(regexp_extract_all(text, '(?m) \.{8} \d+$')) >= 3 AS hit FROM toc_doc_pages),
    g AS (SELECT *, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS island FROM f WHERE hit)
    SELECT doc_id, page_no::BIGINT AS page_no FROM g QUALIFY island = min(island) OVER (PARTITION BY doc_id)""", "toc_doc_pages")
def _(t):
    flags = t.toc_doc_pages.select("doc_id", "page_no", toc.is_toc_page("text").alias("is_toc"))
    return toc.toc_pages(flags).select("doc_id", F.col("page_no").cast("long").alias("page_no"))


@query("t12_toc_items", "SELECT doc_id, item_idx, structure, title, page::BIGINT AS page FROM toc_entries", "toc_entries")
def _(t):
    listed = t.toc_doc_pages.join(_toc_last(t), "doc_id").filter(F.col("page_no") <= F.col("toc_last"))
    return toc.toc_items(listed).select("doc_id", "item_idx", "structure", "title", F.col("page").cast("long").alias("page"))


@query("t13_toc_physical_index", """
    SELECT doc_id, item_idx, (toc_size + page)::BIGINT AS physical_index FROM toc_entries""", "toc_entries")
def _(t):
    out = toc.toc_physical_index(t.toc_entries.select("doc_id", "item_idx", "title"), t.toc_doc_pages, _toc_last(t), None)
    return out.select("doc_id", "item_idx", F.col("physical_index").cast("long").alias("physical_index"))


@query("t14_title_on_page", """
    SELECT doc_id, item_idx, (item_idx % 10 <> 4)::BIGINT AS appears FROM toc_entries""", "toc_entries")
def _(t):
    return toc.title_on_page(_placed(t, True), t.toc_doc_pages).select(
        "doc_id", "item_idx", F.col("appears").cast("int").cast("long").alias("appears"))


@query("t15_title_starts_page", """
    SELECT doc_id, item_idx, CASE WHEN item_idx % 3 = 0 THEN 'yes' ELSE 'no' END AS appear_start FROM toc_entries""", "toc_entries")
def _(t):
    return toc.title_starts_page(_placed(t), t.toc_doc_pages).select("doc_id", "item_idx", "appear_start")


@query("a13_toc_accuracy", """
    SELECT doc_id, count(*) AS checked, count(*) FILTER (item_idx % 10 <> 4) AS correct,
           round(count(*) FILTER (item_idx % 10 <> 4) / count(*), 6)::DOUBLE AS accuracy FROM toc_entries GROUP BY 1""", "toc_entries")
def _(t):
    out = toc.toc_accuracy(toc.title_on_page(_placed(t, True), t.toc_doc_pages), _counts(t))
    return out.select("doc_id", "checked", "correct", F.round("accuracy", 6).alias("accuracy"))


@query("t16_repair_toc", """
    SELECT doc_id, item_idx, (toc_size + page)::BIGINT AS physical_index FROM toc_entries""", "toc_entries")
def _(t):
    checked = toc.title_on_page(_placed(t, True), t.toc_doc_pages)
    return toc.repair_toc(checked, t.toc_doc_pages, _counts(t)).select(
        "doc_id", "item_idx", F.col("physical_index").cast("long").alias("physical_index"))


@query("t17_resolve_toc", """
    SELECT doc_id, item_idx, title, (toc_size + page)::BIGINT AS physical_index, 'page_numbers' AS strategy FROM toc_entries""", "toc_entries")
def _(t):
    blocks = t.toc_doc_pages.select("doc_id", F.explode(F.array(F.lit(0))).alias("block_idx"), F.lit("text").alias("type"), "text",
                                    (F.col("page_no") - 1).alias("page_idx"))
    out = toc.resolve_toc(t.toc_doc_pages, blocks, 400, min_lines=1)
    return out.select("doc_id", "item_idx", "title", F.col("physical_index").cast("long").alias("physical_index"), "strategy")


@query("t18_headers_to_toc", """
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1 AS item_idx, text AS title, (page_idx + 1)::BIGINT AS physical_index
    FROM layout WHERE type = 'header' AND page_idx IS NOT NULL""", "layout")
def _(t):
    return toc.headers_to_toc(t.layout).select("doc_id", "item_idx", "title", F.col("physical_index").cast("long").alias("physical_index"))


@query("t19_split_large_nodes", """
    WITH items AS (SELECT *, toc_size + page AS p, max(toc_size + page) OVER (PARTITION BY doc_id) AS last_page FROM toc_entries),
    tops AS (
      SELECT doc_id, item_idx, title, p AS a, coalesce(lead(p) OVER w - 1, last_page) AS b, row_number() OVER w AS no,
             min(p) OVER (PARTITION BY doc_id) AS node_end
      FROM items WHERE item_idx % 12 = 0 AND last_page > 2 WINDOW w AS (PARTITION BY doc_id ORDER BY item_idx)),
    subs AS (
      SELECT t.doc_id, t.no, i.title, i.p AS a, row_number() OVER w AS sub, min(i.p) OVER (PARTITION BY t.doc_id, t.no) AS node_end,
        coalesce(lead(i.p) OVER w - CASE WHEN lead(i.item_idx) OVER w % 3 = 0 THEN 1 ELSE 0 END, t.b) AS b
      FROM tops t JOIN items i ON i.doc_id = t.doc_id AND i.item_idx % 12 <> 0 AND i.p BETWEEN t.a AND t.b WHERE t.b - t.a > 1
      WINDOW w AS (PARTITION BY t.doc_id, t.no ORDER BY i.item_idx))
    SELECT doc_id, '0/' || no AS path, no AS child_no, title, a::BIGINT AS start_index,
      coalesce((SELECT min(s.node_end) FROM subs s WHERE s.doc_id = t.doc_id AND s.no = t.no), b)::BIGINT AS end_index, node_end::BIGINT AS node_end
    FROM tops t UNION ALL
    SELECT doc_id, '0/' || no || '/' || sub, sub, title, a::BIGINT, b::BIGINT, node_end::BIGINT FROM subs""", "toc_entries")
def _(t):
    """Whole documents split into sections at every twelfth item, and sections of over two pages into their other items."""
    nodes = _counts(t).select("doc_id", F.lit(0).cast("long").alias("node_idx"), F.lit("Whole").alias("title"), F.lit(1).alias("start_index"),
                              F.col("pages").alias("end_index"))
    items = _placed(t).withColumn("level", F.when(F.col("item_idx") % 12 == 0, 1).otherwise(2))
    out = toc.split_large_nodes(nodes, t.toc_doc_pages, items, max_pages=1, max_tokens=5)
    return out.select("doc_id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "child_no", "title",
                      *[F.col(c).cast("long").alias(c) for c in ("start_index", "end_index", "node_end")])


@query("t9_group_pages", """
    WITH RECURSIVE p AS (
      SELECT doc_id, page_no::BIGINT AS page_no, token_count, row_number() OVER w AS n, sum(token_count) OVER w AS upto,
             sum(token_count) OVER (PARTITION BY doc_id) AS total FROM page_texts WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)),
    big AS (SELECT *, ceil((total / ceil(total / 600) + 600) / 2) AS target FROM p WHERE total > 600),
    after AS (
      SELECT a.doc_id, a.n, min(b.n) AS next FROM big a LEFT JOIN big c ON c.doc_id = a.doc_id AND c.n = a.n - 1
      JOIN big b ON b.doc_id = a.doc_id AND b.n > a.n AND b.upto > a.target + coalesce(c.upto - c.token_count, 0) GROUP BY 1, 2),
    starts AS (
      SELECT doc_id, n, 0::BIGINT AS group_no FROM big WHERE n = 1 UNION ALL
      SELECT s.doc_id, a.next, s.group_no + 1 FROM starts s JOIN after a ON a.doc_id = s.doc_id AND a.n = s.n),
    ranges AS (SELECT *, lead(n) OVER (PARTITION BY doc_id ORDER BY n) AS stop FROM starts)
    SELECT doc_id, 0::BIGINT AS group_no, page_no FROM p WHERE total <= 600 UNION ALL
    SELECT big.doc_id, group_no, page_no FROM big JOIN ranges r ON r.doc_id = big.doc_id
      AND big.n >= r.n - CASE WHEN group_no > 0 THEN 1 ELSE 0 END AND big.n < coalesce(r.stop, big.n + 1)""", "page_texts")
def _(t):
    return toc.group_pages(t.page_texts, max_tokens=600)
