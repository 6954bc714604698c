"""Task lifecycle, listings, search, progress and statistics over the order, line and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import labels
from clauseloom.operators import tasks as ops
from clauseloom.plans.catalog import query
from clauseloom.sources.adapters import Tables


def flat_clauses(t: Tables):
    """Stored form of the clauses: an id and the positions as JSON (some unreadable)."""
    pos = F.transform("positions", lambda p: F.array(p["page_idx"].cast("double"), p["x0"], p["y0"], p["x1"], p["y1"]))
    bad = F.length("original_text") % 7 == 0
    return t.clauses.select("*", F.col("matrix_id").alias("id"),
                            F.when(bad, F.lit("[[1, 2")).otherwise(F.to_json(pos)).alias("positions_json"))


def sections(t: Tables):
    """A section per distinct (order, line number), its priority missing for returned lines."""
    return t.read("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("task_id"),
                                      F.col("l_linenumber").cast("long").alias("id")).agg(
        F.min(F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("long"))).alias("priority"))


SECTIONS_SQL = """SELECT l_orderkey::VARCHAR AS task_id, l_linenumber::BIGINT AS id,
    min(CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT END) AS priority FROM lineitem GROUP BY 1, 2"""


def updates(t: Tables):
    """Events as task updates."""
    kind = F.col("event_type")
    return t.read("events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("task_id"), F.col("ts").alias("at"),
        F.when(kind == "click", "running").when(kind == "purchase", "completed").when(kind == "error", "failed"
                                                                                      ).alias("status"),
        F.when(kind != "view", F.col("value")).alias("progress"),
        F.when(kind != "signup", F.concat(kind, F.lit(" "), F.col("event_id").cast("string"))).otherwise("").alias("message"),
        F.when((kind == "error") & (F.col("event_id") % 2 == 0), "broken").alias("error"),
        F.when(F.col("event_id") % 97 == 0, F.col("value")).alias("elapsed_seconds"))


UPDATES = """u AS (SELECT event_id AS id, user_id::VARCHAR AS task_id, ts AS moment,
    CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
    CASE WHEN event_type <> 'view' THEN value END AS progress,
    CASE WHEN event_type <> 'signup' THEN event_type || ' ' || event_id ELSE '' END AS message,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'broken' END AS error,
    CASE WHEN event_id % 97 = 0 THEN value END AS elapsed_seconds FROM events)"""


@query("o1_sort_clauses", "SELECT section_id, matrix_id FROM clauses ORDER BY section_id, matrix_id", "clauses")
def _(t):
    from clauseloom.operators.clauses import sort_clauses
    return sort_clauses(t.clauses).select("section_id", "matrix_id")


@query("o2_list_tasks", """
    SELECT task_id, status, created_at::VARCHAR AS created_at FROM tasks WHERE status = 'completed'
    ORDER BY tasks.created_at DESC, task_id LIMIT 50 OFFSET 25""", "tasks")
def _(t):
    return ops.list_tasks(t.tasks, "completed", 50, 25).select(
        "task_id", "status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("o3_task_logs", """
    SELECT id, message, round(progress, 6) AS progress FROM task_logs WHERE task_id = '42' ORDER BY created_at, id""",
       "task_logs")
def _(t):
    return ops.task_logs(t.task_logs, "42").select("id", "message", F.round("progress", 6).alias("progress"))


@query("o4_task_sections", f"""
    SELECT id, priority, row_number() OVER (ORDER BY priority NULLS FIRST, id) AS pos
    FROM ({SECTIONS_SQL}) WHERE task_id = '77'""")
def _(t):
    from pyspark.sql import Window
    rows = ops.task_sections(sections(t), "77").withColumn("task", F.lit("77"))
    return rows.select("id", "priority", F.row_number().over(
        Window.partitionBy("task").orderBy(F.asc_nulls_first("priority"), "id")).cast("long").alias("pos"))


@query("o5_task_clauses", """
    SELECT matrix_id, page_number::BIGINT AS page_number, type FROM clauses WHERE task_id = '77'""", "clauses")
def _(t):
    return ops.task_clauses(flat_clauses(t), "77").select(
        "matrix_id", F.col("page_number").cast("long").alias("page_number"), "type")


@query("o6_clauses_flat", """
    SELECT matrix_id, section_id AS node_id, section_title, page_number::BIGINT AS page_number,
           CASE WHEN has_pos AND length(original_text) % 7 <> 0 THEN 1 ELSE 0 END AS n_positions,
           CASE WHEN has_pos AND length(original_text) % 7 <> 0 THEN round(q * 10, 6) END AS y0
    FROM clauses""", "clauses")
def _(t):
    return ops.clauses_flat(flat_clauses(t)).select(
        "matrix_id", "node_id", "section_title", F.col("page_number").cast("long").alias("page_number"),
        F.size("positions").cast("long").alias("n_positions"),
        F.round(F.try_element_at("positions", F.lit(1))["y0"], 6).alias("y0"))


@query("o7_search_clauses", """
    SELECT matrix_id, left(original_text, 200) AS original_text FROM clauses
    WHERE original_text ILIKE '%DELIVERS 1_ of%7%' """, "clauses")
def _(t):
    return ops.search_clauses(flat_clauses(t), "DELIVERS 1_ of%7", limit=None).select("matrix_id", "original_text")


@query("o8_get_task", "SELECT task_id, status, file_hash FROM tasks WHERE task_id = '123'", "tasks")
def _(t):
    return ops.get_task(t.tasks, "123").select("task_id", "status", "file_hash")


@query("a17_task_stats", f"""
    SELECT task_id, coalesce(s, 0) AS total_sections, coalesce(c, 0) AS total_clauses FROM tasks
    LEFT JOIN (SELECT task_id, count(*) AS s FROM ({SECTIONS_SQL}) GROUP BY 1) USING (task_id)
    LEFT JOIN (SELECT task_id, count(*) AS c FROM clauses GROUP BY 1) USING (task_id)""", "tasks clauses")
def _(t):
    return ops.task_stats(t.tasks, sections(t), t.clauses).select("task_id", "total_sections", "total_clauses")


@query("a18_latency_quantiles", """
    SELECT round(quantile_cont(elapsed_seconds, 0.5), 6) AS p50, round(quantile_cont(elapsed_seconds, 0.95), 6) AS p95,
           count(elapsed_seconds) AS n FROM tasks""", "tasks")
def _(t):
    return ops.latency_quantiles(t.tasks).select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")


@query("w7_monotonic_progress", """
    SELECT id, task_id, round(greatest(max(progress) OVER (PARTITION BY task_id ORDER BY created_at, id
           ROWS UNBOUNDED PRECEDING), 0), 6) AS progress FROM task_logs""", "task_logs")
def _(t):
    return ops.monotonic_progress(t.log_chunks, "cut").select("id", "task_id", F.round("progress", 6).alias("progress"))


CHANGES_SQL = """
    SELECT id, task_id, progress FROM (
      SELECT *, lag(progress) OVER w AS before, row_number() OVER w AS n FROM (
        SELECT id, task_id, created_at, round(greatest(max(progress) OVER (PARTITION BY task_id ORDER BY created_at, id
          ROWS UNBOUNDED PRECEDING), 0), 6) AS progress FROM task_logs)
      WINDOW w AS (PARTITION BY task_id ORDER BY created_at, id))
    WHERE n = 1 OR progress IS DISTINCT FROM before"""


@query("w8_progress_changes", CHANGES_SQL, "task_logs")
def _(t):
    high = ops.monotonic_progress(t.log_chunks, "cut").withColumn("progress", F.round("progress", 6))
    return ops.progress_changes(high, "cut").select("id", "task_id", "progress")


@query("w9_recent_logs", """
    SELECT id, task_id FROM task_logs
    QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, id DESC) <= 50""", "task_logs")
def _(t):
    return ops.recent_logs(t.task_logs).select("id", "task_id")


REUSE_SQL = """
    SELECT file_hash, task_id, status,
           CASE status WHEN 'completed' THEN 'reuse' WHEN 'running' THEN 'wait' ELSE 'create' END AS decision
    FROM tasks QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY (status = 'completed') DESC,
        CASE WHEN status = 'completed' THEN completed_at ELSE created_at END DESC NULLS LAST, task_id DESC) = 1"""


@query("w10_reusable_task", REUSE_SQL, "tasks")
def _(t):
    return ops.reusable_task(t.tasks)


@query("k1_new_tasks", """
    SELECT 'doc_' || doc_id || '.pdf' AS file_name, length(text)::BIGINT AS file_size, sha256(text) AS file_hash,
           'pending' AS status, 0.0::DOUBLE AS progress FROM documents""")
def _(t):
    files = t.read("documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"),
                                       F.length("text").alias("size"), F.sha2("text", 256).alias("sha256"))
    return ops.new_tasks(files).select("file_name", "file_size", "file_hash", "status", "progress")


@query("k2_fold_updates", f"""
    WITH {UPDATES},
    f AS (SELECT task_id, arg_max(status, (moment, id)) FILTER (status <> '') AS status,
      arg_max(progress, (moment, id)) FILTER (progress IS NOT NULL) AS progress,
      arg_max(message, (moment, id)) FILTER (message <> '') AS message,
      arg_max(error, (moment, id)) FILTER (error <> '') AS error,
      arg_max(elapsed_seconds, (moment, id)) FILTER (elapsed_seconds <> 0) AS given,
      min(moment) FILTER (status = 'running') AS s, max(moment) FILTER (status IN ('completed', 'failed')) AS c
      FROM u GROUP BY 1)
    SELECT task_id, status, round(progress, 6) AS progress, message, error, epoch_us(s) AS started_us,
           epoch_us(c) AS completed_us,
           round(coalesce(given, CASE WHEN s <= c THEN (epoch_us(c) - epoch_us(s)) / 1e6 END), 6) AS elapsed_seconds
    FROM f""")
def _(t):
    return ops.fold_updates(updates(t)).select(
        "task_id", "status", F.round("progress", 6).alias("progress"), "message", "error",
        ops.micros("started_at").alias("started_us"), ops.micros("completed_at").alias("completed_us"),
        F.round("elapsed_seconds", 6).alias("elapsed_seconds"))


@query("k3_apply_updates", f"""
    WITH {UPDATES},
    f AS (SELECT task_id, arg_max(status, (moment, id)) FILTER (status <> '') AS status,
      arg_max(progress, (moment, id)) FILTER (progress IS NOT NULL) AS progress FROM u GROUP BY 1)
    SELECT task_id, coalesce(f.status, tasks.status) AS status, round(coalesce(f.progress, tasks.progress), 6) AS progress,
           file_hash FROM tasks LEFT JOIN f USING (task_id)""", "tasks")
def _(t):
    folded = ops.fold_updates(updates(t)).select("task_id", "status", "progress", F.col("message").alias("not_a_field"))
    return ops.apply_updates(t.tasks, folded).select("task_id", "status", F.round("progress", 6).alias("progress"), "file_hash")


@query("k4_task_state", """
    SELECT task_id, status, coalesce(current_message, '') AS message, error_message AS error,
           epoch_us(coalesce(completed_at, started_at, created_at)) AS updated_us,
           round(coalesce(elapsed_seconds, 0), 6) AS elapsed_seconds FROM tasks""", "tasks")
def _(t):
    return ops.task_state(t.tasks).select("task_id", "status", "message", "error",
                                          ops.micros("updated_at").alias("updated_us"),
                                          F.round("elapsed_seconds", 6).alias("elapsed_seconds"))


@query("k5_log_level", f"""
    WITH {UPDATES} SELECT id, task_id, message, CASE WHEN error <> '' THEN 'error' WHEN status = 'failed' THEN 'warning'
      ELSE 'info' END AS log_level FROM u WHERE message <> ''""")
def _(t):
    return ops.log_rows(updates(t)).select("id", "task_id", "message", "log_level")


@query("k6_format_elapsed", """
    SELECT id, CASE WHEN coalesce(s, 0) = 0 THEN '-' WHEN s < 60 THEN floor(s + 0.5)::BIGINT || '秒'
      ELSE floor(s / 60)::BIGINT || '分' || floor(s - floor(s / 60) * 60 + 0.5)::BIGINT || '秒' END AS label
    FROM (SELECT event_id AS id, CASE WHEN event_type <> 'view' THEN value END AS s FROM events)""")
def _(t):
    return t.read("events").select(F.col("event_id").alias("id"), labels.format_elapsed(
        F.when(F.col("event_type") != "view", F.col("value"))).alias("label"))


@query("r4_parse_progress", r"""
    SELECT id, pct, CASE WHEN regexp_matches(line, 'Batch\s+(\d+)/(\d+):\s+(\d+)\s+pages/(\d+)\s+pages')
        THEN 'processing batch ' || regexp_extract(line, 'Batch\s+(\d+)/', 1) || '/'
             || regexp_extract(line, 'Batch\s+\d+/(\d+)', 1) || ' (' || regexp_extract(line, ':\s+(\d+) pages', 1) || ' pages)'
      WHEN line LIKE '%DocAnalysis init%' THEN 'loading analysis model'
      WHEN regexp_matches(line, '(\d+)%\|') THEN 'progress: ' || regexp_extract(line, '(\d+)%\|', 1) || '%' END AS message
    FROM (SELECT event_id AS id, CASE event_type
        WHEN 'view' THEN 'Layout Predict: ' || p || '%|###' WHEN 'click' THEN 'Batch 1/' || p || ': ' || user_id || ' pages/300 pages'
        WHEN 'error' THEN 'MFR Predict ' || p || '%|' WHEN 'purchase' THEN 'Table-ocr det' ELSE 'DocAnalysis init, OCR-rec Predict' END AS line,
      CASE event_type WHEN 'view' THEN CASE WHEN p = 100 THEN 20 ELSE 15 END WHEN 'click' THEN 0
        WHEN 'error' THEN CASE WHEN p = 100 THEN 40 ELSE 35 END WHEN 'purchase' THEN 43 ELSE 48 END AS pct
      FROM (SELECT *, least(floor(value / 4), 100)::BIGINT AS p FROM events))""")
def _(t):
    p = F.least(F.floor(F.col("value") / 4), F.lit(100)).cast("string")
    kind = F.col("event_type")
    line = (F.when(kind == "view", F.concat(F.lit("Layout Predict: "), p, F.lit("%|###")))
            .when(kind == "click", F.concat(F.lit("Batch 1/"), p, F.lit(": "), F.col("user_id").cast("string"),
                                            F.lit(" pages/300 pages")))
            .when(kind == "error", F.concat(F.lit("MFR Predict "), p, F.lit("%|")))
            .when(kind == "purchase", "Table-ocr det").otherwise("DocAnalysis init, OCR-rec Predict"))
    lines = t.read("events").select(F.col("event_id").alias("id"), line.alias("line"))
    return lines.select("id", labels.parser_progress(F.col("line")).cast("long").alias("pct"),
                        labels.parser_message(F.col("line")).alias("message"))


def files(t: Tables):
    """Customers as incoming files; the hash is that of the tasks built from their orders."""
    return t.read("customer").select(F.concat(F.lit("doc_"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("file_name"),
                                     F.lit(1).alias("size"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"))


@query("w10_ingest_decision", f"""
    WITH r AS ({REUSE_SQL})
    SELECT 'doc_' || c_custkey || '.pdf' AS file_name, coalesce(decision, 'create') AS decision, r.task_id
    FROM customer LEFT JOIN r ON file_hash = sha256(c_custkey::VARCHAR)""", "tasks")
def _(t):
    return ops.decide_ingest(files(t), t.tasks).select("file_name", "decision", "task_id")
