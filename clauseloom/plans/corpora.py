"""SQL forms of the derived corpora, for checking the queries against another engine."""

from __future__ import annotations

import re

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_WS}+|{_WS}+$', '', 'g')"


def tokens(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '{TOKEN}'))"


def title_light(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '{_WS}+', '', 'g')"


def title(expr: str) -> str:
    out = f"regexp_replace({title_light(expr)}, '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}§]+', '', 'g')"
    for pattern in (r"^(第?[0-9一二三四五六七八九十]+[章节条款\.]*)", r"^[（(]?[一二三四五六七八九十0-9]+[）)]?",
                    r"^[0-9]+[\.、]"):
        out = f"regexp_replace({out}, '{pattern}', '')"
    return out


def evidence(expr: str) -> str:
    out = expr
    for pattern in (r"^[\(（]\s*[0-9一二三四五六七八九十百千万零壹贰叁肆伍陆柒捌玖拾佰仟萬零]+\s*[\)）]",
                    r"^[0-9一二三四五六七八九十百千万零壹贰叁肆伍陆柒捌玖拾佰仟萬零]+\s*[.、。）\)]",
                    r"^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]",
                    r"^[a-zA-Z]\s*[\)）.]"):
        out = f"regexp_replace({out}, '{pattern}', '')"
    return rf"lower(regexp_replace({out}, '[^\p{{L}}\p{{N}}_]', '', 'g'))"


CORPORA: dict[str, tuple[str, str]] = {
    "blocks": ("", """
        SELECT doc_id, i AS block_idx, 'text' AS type, l[i + 1] AS text, i // 10 AS page_idx,
               100.0::DOUBLE AS x0, (50 + 90 * (i % 10))::DOUBLE AS y0, 900.0::DOUBLE AS x1,
               (130 + 90 * (i % 10))::DOUBLE AS y1
        FROM (SELECT doc_id, l, unnest(range(len(l))) AS i
              FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""),
    "layout": ("", """
        SELECT o_orderkey // 40 AS doc_id, o_orderkey % 40 AS block_idx, type,
          CASE WHEN type IN ('text', 'header', 'equation')
               THEN o_orderpriority || ' ' || o_orderstatus || ' ' || o_custkey END AS text,
          CASE WHEN type = 'list' THEN [o_orderpriority, 'customer ' || o_custkey] END AS list_items,
          CASE WHEN type = 'image' THEN CASE WHEN g % 4 = 0 THEN ['Figure ' || o_custkey, o_orderstatus] ELSE [] END
               END AS image_caption,
          CASE WHEN type = 'table' THEN CASE WHEN g % 3 = 0 THEN ['Table ' || o_orderkey] ELSE [] END
               END AS table_caption,
          CASE WHEN type = 'table' AND g % 5 <> 0
               THEN '<table><tr><td> ' || o_custkey || ' </td><th>' || o_orderstatus
                    || '</th><td></td></tr><tr><td> </td></tr><tr><td>' || o_orderpriority || '</td></tr></table>'
               END AS table_body,
          o_custkey, o_orderstatus, o_orderpriority,
          CASE WHEN type = 'image' THEN 'images/p' || (o_custkey % 50) || '.jpg'
               WHEN type = 'table' AND g % 2 = 0 THEN 'images/t' || o_custkey || '.jpg' END AS img_path,
          CASE WHEN o_orderkey % 23 <> 0 THEN (o_orderkey % 40) // 8 END AS page_idx,
          CASE WHEN o_orderkey % 29 = 0 THEN [1.0, 2.0, 3.0]
               WHEN o_orderkey % 31 <> 0 THEN [100.0, 50.0 + 100 * ((o_orderkey % 40) % 8), 900.0,
                                               130.0 + 100 * ((o_orderkey % 40) % 8)] END AS bbox
        FROM (SELECT *, ['text', 'header', 'list', 'image', 'table', 'equation'][o_orderkey % 6 + 1] AS type,
                     o_orderkey // 6 AS g FROM orders)"""),
    "page_texts": ("blocks", f"""
        SELECT *, {tokens('text')} AS token_count FROM (
          SELECT doc_id, page_idx + 1 AS page_no, string_agg(text, chr(10) ORDER BY block_idx) AS text
          FROM blocks GROUP BY ALL)"""),
    "page_dims": ("blocks", """
        SELECT doc_id, unnest(range(last_page)) AS page_idx, [595.0, 842.0, 612.0, 612.0, 500.0][doc_id % 5 + 1] AS width,
               [842.0, 1191.0, 792.0, 1008.0, 500.0][doc_id % 5 + 1] AS height
        FROM (SELECT doc_id, max(page_idx) AS last_page FROM blocks GROUP BY 1)"""),
    "nodes": ("", """
        SELECT doc_id, node_idx, printf('%04d', node_idx) AS node_id,
          CASE level WHEN 2 THEN 0 WHEN 3 THEN max(CASE WHEN c = 0 THEN node_idx END) OVER (PARTITION BY doc_id, k) END
            AS parent_idx,
          level, structure, title, node_idx // 5 + 1 AS start_index,
          node_idx // 5 + 1 + CASE level WHEN 1 THEN 60 WHEN 2 THEN 10 ELSE 1 END AS end_index,
          original_text, coalesce(bal > 1000, false) AS has_pos
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, c) - 1 AS node_idx FROM (
          WITH nat AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
          SELECT r_regionkey AS doc_id, 0 AS k, 0 AS c, 1 AS level, '1' AS structure, r_name AS title,
                 NULL AS original_text, NULL AS bal FROM region
          UNION ALL SELECT n_regionkey, k, 0, 2, '1.' || k, n_name, NULL, NULL FROM nat
          UNION ALL SELECT n_regionkey, k, c, 3, '1.' || k || '.' || c, c_name,
                 CASE WHEN c_acctbal >= 0 THEN c_mktsegment || ' ' || c_name ELSE '' END, c_acctbal
          FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS c FROM customer)
          JOIN nat ON c_nationkey = n_nationkey))"""),
    "toc": ("nodes", """
        SELECT doc_id, node_idx AS item_idx, structure, title, node_idx // 5 + 1 AS page,
               CASE WHEN node_idx % 7 <> 6 THEN node_idx // 5 + 1 + doc_id + 1 END AS physical_index,
               CASE WHEN node_idx % 3 = 0 THEN 'yes' ELSE 'no' END AS appear_start
        FROM nodes"""),
    "node_clauses": ("nodes", """
        SELECT doc_id, node_idx, node_id, title AS section_title, start_index, o_orderkey AS seq,
               CASE WHEN o_orderkey % 9 = 0 THEN 'Figure' END AS image_caption,
               CASE WHEN o_orderkey % 10 = 0 THEN 'Table' END AS table_caption, o_orderkey % 5 <> 0 AS has_pos,
               o_orderkey % 7 AS pos_page, 'Order ' || o_orderkey AS original_text
        FROM orders JOIN nodes ON title = printf('Customer#%09d', o_custkey - o_custkey % 2) AND level = 3"""),
    "markdown_lines": ("", """
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn, i) AS line_num, l[i] AS line
        FROM (SELECT doc_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (
          SELECT conv_id AS doc_id, turn, string_split(CASE role
            WHEN 'user' THEN repeat('#', (turn % 4 + 1)::INT) || ' ' || replace(text, chr(10), ' ')
            WHEN 'system' THEN '```' || chr(10) || '# ' || text || chr(10) || '```' ELSE text END, chr(10)) AS l
          FROM conversations))"""),
    "tasks": ("", """
        SELECT o_orderkey::VARCHAR AS task_id, 'doc_' || o_custkey || '.pdf' AS file_name,
          floor(o_totalprice)::BIGINT AS file_size, sha256(o_custkey::VARCHAR) AS file_hash, status,
          CASE WHEN status = 'completed' THEN 100.0 ELSE o_orderkey % 100 END::DOUBLE AS progress,
          CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS current_message,
          CASE WHEN status = 'failed' THEN 'stopped at ' || o_orderpriority END AS error_message,
          o_orderdate AS created_at,
          CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 1 HOUR END AS started_at,
          CASE WHEN status = 'completed' THEN shipped END AS completed_at,
          epoch_us(CASE WHEN status = 'completed' THEN shipped END)::DOUBLE / 1e6
            - epoch_us(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 1 HOUR END)::DOUBLE / 1e6
            AS elapsed_seconds
        FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status
              FROM orders)
        LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""),
    "clauses": ("", """
        SELECT l_orderkey::VARCHAR AS task_id, printf('%06d-CLS-%03d', l_orderkey, seq) AS matrix_id,
          printf('%06d', l_orderkey) AS section_id, 'Order ' || l_orderkey AS section_title, l_linenumber AS page_number,
          CASE WHEN l_partkey % 8 <> 7 THEN ['obligation', 'requirement', 'prohibition', 'deliverable', 'deadline',
            'penalty', 'definition'][l_partkey % 8 + 1] END AS type,
          CASE WHEN l_suppkey % 5 <> 0 THEN 'supplier ' || l_suppkey ELSE '' END AS actor,
          CASE WHEN l_returnflag <> 'N' THEN 'return ' || l_returnflag END AS action,
          'part ' || l_partkey AS object, CASE WHEN l_linestatus = 'O' THEN 'when open' END AS condition,
          strftime(l_shipdate, '%Y-%m-%d') AS deadline, l_quantity::INT || ' units' AS metric,
          '  The supplier delivers ' || l_quantity::INT || ' of part ' || l_partkey || ' by '
            || strftime(l_shipdate, '%Y-%m-%d') || '. ' AS original_text,
          CASE WHEN l_partkey % 11 = 0 THEN 'Figure' END AS image_caption,
          CASE WHEN l_partkey % 13 = 0 THEN 'Table' END AS table_caption,
          CASE WHEN l_partkey % 11 = 0 THEN 'images/p' || (l_partkey % 50) || '.jpg' END AS img_path,
          l_discount <> 0 AS has_pos, l_linenumber - 1 AS pos_page, l_quantity AS q
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq
              FROM lineitem)"""),
    "evidence_blocks": ("layout", rf"""
        SELECT doc_id, printf('%04d', page_idx) AS node_id, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY block_idx) - 1 AS ord,
          type, list_items, page_idx, bbox[2] AS y0,
          CASE WHEN type = 'text' THEN {evidence('text')} ELSE {evidence('list_items[1]')} || {evidence('list_items[2]')} END AS norm,
          list_distinct(list_filter(regexp_extract_all(CASE WHEN type = 'text' THEN text ELSE list_items[1] || list_items[2] END, '[\p{{L}}\p{{N}}_]+'),
            lambda w: length(w) > 1)) AS words
        FROM layout WHERE len(bbox) = 4 AND page_idx IS NOT NULL"""),
    "page_clauses": ("", rf"""
        SELECT *, {evidence('original_text')} AS norm, list_distinct(list_filter(regexp_extract_all(original_text, '[\p{{L}}\p{{N}}_]+'),
            lambda w: length(w) > 1)) AS words FROM (
        SELECT o_orderkey // 40 AS doc_id, printf('%04d', (o_orderkey % 40) // 8) AS node_id, printf('%08d', o_orderkey) AS matrix_id,
          o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '(1) ' || whole WHEN 1 THEN whole[1:4] || 'x' || whole[5:]
            WHEN 2 THEN whole[2:9] WHEN 3 THEN o_custkey || ' customer ' || o_orderpriority ELSE 'nothing of this kind' END AS original_text,
          CASE WHEN o_orderkey % 6 = 3 THEN 'images/p' || (o_custkey % 50) || '.jpg' END AS img_path
        FROM (SELECT *, o_orderpriority || ' ' || o_orderstatus || ' ' || o_custkey AS whole FROM orders))"""),
    "toc_entries": ("", """
        SELECT c_nationkey::BIGINT AS doc_id, c - 1 AS item_idx, '1.' || c AS structure, c_name AS title, (c - 1) // 3 + 1 AS page,
               (c - 1) // 30 + 1 AS toc_page, ceil(n / 30)::INT AS toc_size, c_mktsegment
        FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS c, count(*) OVER (PARTITION BY c_nationkey) AS n
              FROM customer)"""),
    "toc_doc_pages": ("toc_entries", f"""
        SELECT *, {tokens('text')} AS token_count FROM (SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY item_idx) AS text FROM (
          SELECT doc_id, toc_page AS page_no, item_idx, structure || ' ' || title || ' ........ ' || page AS line FROM toc_entries UNION ALL
          SELECT doc_id, toc_size + page, item_idx, title || chr(10) || 'sells ' || c_mktsegment FROM toc_entries) GROUP BY 1, 2)"""),
    "task_logs": ("", """
        SELECT event_id AS id, user_id::VARCHAR AS task_id,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS log_level,
               least(value / 5, 100.0) AS progress, event_type AS message, ts AS created_at FROM events"""),
}


def with_corpora(sql: str, names: list[str]) -> str:
    """``sql`` with the named corpora, and those they build on, in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        needs, _ = CORPORA[name]
        for other in needs.split():
            visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({CORPORA[n][1].strip()})" for n in order)
    body = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if own:
        return f"WITH {own.group(1) or ''}{ctes},\n{body[own.end():]}"
    return f"WITH {ctes}\n{body}"
