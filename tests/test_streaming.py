"""Streams over several micro-batches give what the batch operators give."""

import datetime as dt
import random

from pyspark.sql import functions as F

from clauseloom.operators import tasks
from clauseloom.operators.scan import with_adaptive_chunk
from clauseloom.streaming import progress as st

SCHEMA = "task_id string, id long, created_at timestamp, progress double, message string, status string"


def entries(n=120):
    r = random.Random(6)
    t0 = dt.datetime(2024, 1, 1)
    return [(r.choice(["hot", "hot", "a", "b"]), i, t0 + dt.timedelta(seconds=i), float(r.randrange(0, 40) + i // 4), f"m{i}", "running") for i in range(n)]


def as_stream(spark, folder, rows, parts=4):
    size = len(rows) // parts
    for k in range(parts):
        part = rows[k * size:(k + 1) * size if k < parts - 1 else len(rows)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        import time
        time.sleep(1.1)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_clamp_equals_batch(spark, tmp_path):
    rows = entries()
    stream = as_stream(spark, str(tmp_path / "in"), rows)
    st.run_to_table(st.stream_progress(stream, None), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["id"]: r["progress"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    cut = with_adaptive_chunk(spark.createDataFrame(rows, SCHEMA), ["task_id"], tasks.micros("created_at"), "cut", 10)
    assert got == {r["id"]: r["progress"] for r in tasks.monotonic_progress(cut, "cut").collect()}


def test_changes_stop_at_the_end(spark, tmp_path):
    rows = [(t, i, c, float(i // 3), m, "completed" if i == 70 else "running") for t, i, c, _, m, _ in entries() for t in ["x"]]
    stream = as_stream(spark, str(tmp_path / "in"), rows)
    st.run_to_table(st.stream_changes(stream, None), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [i for i in range(71) if i % 3 == 0]


def test_recent_logs_equal_batch(spark, tmp_path):
    rows = entries()
    stream = as_stream(spark, str(tmp_path / "in"), rows)
    st.run_to_table(st.stream_recent_logs(stream, 7, None), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    out = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r["task_id"], r["id"], r["message"]) for r in st.latest(out).collect())
    want = tasks.recent_logs(spark.createDataFrame(rows, SCHEMA), 7).collect()
    assert got == sorted((r["task_id"], r["id"], r["message"]) for r in want)


def test_replayed_ingest_batch_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "tasks")
    old = spark.createDataFrame([("t0", "h0", "completed")], "task_id string, file_hash string, status string").withColumn(
        "created_at", F.current_timestamp()).withColumn("completed_at", F.current_timestamp())
    old = old.unionByName(old.withColumn("file_hash", F.lit("77ff")).withColumn("task_id", F.lit("t7")))
    st.store_tasks(old, store, -1)
    files = spark.createDataFrame([("a.pdf", 1, "h0"), ("b.pdf", 2, "h1"), ("c.pdf", 2, "h1")], "file_name string, size long, sha256 string")
    read = st.known_tasks(files, store)
    assert [r["task_id"] for r in read.collect()] == ["t0"]
    assert "PartitionFilters: [prefix" in read._jdf.queryExecution().toString().replace("isnotnull(prefix#", "[prefix")
    run = st.ingest_batch(store)
    run(files, 0)
    run(files, 0)
    rows = spark.read.option("mergeSchema", True).parquet(store).filter("batch_id >= 0").collect()
    assert [(r["file_hash"], r["file_name"], r["status"]) for r in rows] == [("h1", "b.pdf", "pending")]


def test_tables_in_several_files_are_streamed_whole(spark, tmp_path):
    """A table may be a folder of files, in which no file has the table's name."""
    from clauseloom.plans import load_catalog
    source = "/root/testdata/sf0.001"
    for name in ("documents", "events"):
        spark.read.parquet(f"{source}/{name}.parquet").repartition(11).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("r1_stream_progress", "r5_stream_ingest"):
        run = load_catalog()[name].run
        got, want = (sorted(map(tuple, run(spark, folder).collect())) for folder in (str(tmp_path), source))
        assert got == want and got
