"""The streams, run over the event table to its end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.plans.catalog import query
from clauseloom.plans.tasks_queries import CHANGES_SQL
from clauseloom.session import shared_dir
from clauseloom.streaming import progress as st


def table_stream(t, name: str):
    """A table as a stream, in one batch, as its files are in no order; as a pattern, its path may be a file or a folder of files."""
    return t.spark.readStream.schema(t.read(name).schema).parquet(f"{t.folder}/{{{name}.parquet}}")


def event_stream(t):
    """The event table as a stream of log entries."""
    return table_stream(t, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("task_id"),
        F.least(F.col("value") / 5, F.lit(100.0)).alias("progress"), F.col("event_type").alias("message"),
        F.col("ts").cast("timestamp").alias("created_at"))


def _run(t, stream, name: str, mode: str = "append"):
    out = shared_dir(t.spark, name)
    st.run_to_table(stream, f"{out}/data", f"{out}/checkpoint", mode)
    return t.spark.read.parquet(f"{out}/data")


@query("r1_stream_progress", """
    SELECT id, task_id, round(greatest(max(progress) OVER (PARTITION BY task_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING), 0), 6)
      AS progress FROM task_logs""", "task_logs")
def _(t):
    return _run(t, st.stream_progress(event_stream(t), None), "r1").select("id", "task_id", F.round("progress", 6).alias("progress"))


@query("r2_stream_changes", """
    WITH c AS (SELECT id, task_id, created_at, message, round(progress, 6) AS p FROM task_logs),
    e AS (SELECT task_id, min((created_at, id)) AS stop FROM c WHERE id % 211 = 0 GROUP BY 1)
    SELECT id, task_id, p AS progress FROM (
      SELECT c.*, lag(p) OVER (PARTITION BY task_id ORDER BY created_at, id) AS before, stop FROM c LEFT JOIN e USING (task_id))
    WHERE (before IS NULL OR p <> before) AND (stop IS NULL OR (created_at, id) <= stop)""", "task_logs")
def _(t):
    rows = event_stream(t).withColumn("progress", F.round("progress", 6)).withColumn(
        "status", F.when(F.col("id") % 211 == 0, "completed").otherwise("running"))
    return _run(t, st.stream_changes(rows, None), "r2").select("id", "task_id", "progress")


@query("r3_stream_recent_logs", """
    SELECT id, task_id, message FROM task_logs QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, id DESC) <= 50""", "task_logs")
def _(t):
    return st.latest(_run(t, st.stream_recent_logs(event_stream(t), idle_seconds=None), "r3", "update")).select("id", "task_id", "message")


@query("r5_stream_ingest", """
    WITH f AS (SELECT doc_id, sha256(text) AS h FROM documents), old AS (SELECT DISTINCT h FROM f WHERE doc_id % 4 = 0)
    SELECT h AS file_hash, min('doc_' || doc_id || '.pdf') AS file_name FROM f WHERE h NOT IN (SELECT h FROM old) GROUP BY 1""")
def _(t):
    out = shared_dir(t.spark, "r5")
    docs = t.read("documents")
    done = docs.filter(F.col("doc_id") % 4 == 0).select(
        F.concat(F.lit("task"), F.col("doc_id").cast("string")).alias("task_id"), F.concat(F.lit("old_"), F.col("doc_id").cast("string")).alias("file_name"),
        F.length("text").cast("long").alias("file_size"), F.sha2("text", 256).alias("file_hash"),
        F.when(F.col("doc_id") % 8 == 0, "completed").otherwise("running").alias("status"), F.lit(100.0).alias("progress"),
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("completed_at"))
    st.store_tasks(done, f"{out}/tasks", -1)
    files = table_stream(t, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"), F.length("text").alias("size"),
        F.sha2("text", 256).alias("sha256"))
    st.stream_ingest(files, f"{out}/tasks", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/tasks").filter(F.col("batch_id") >= 0).select("file_hash", "file_name")
