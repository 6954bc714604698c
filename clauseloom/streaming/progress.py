"""Progress as streams: monotonic clamp, change feed, rolling log, incremental ingest.

Rows are log entries (task_id, id, created_at, progress, ...). State is one
small record per task; the size of a micro-batch is set on the source
(``maxFilesPerTrigger``), and rows inside a batch are ordered by time and id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType

from clauseloom.operators.tasks import decide_ingest, new_tasks

# How long a feed stays open, and how many entries the rolling log keeps.
FEED_SECONDS = 600
RECENT = 50
#: How long a silent task's state is kept.
IDLE_SECONDS = 86_400

_OUT = "task_id string, id long, created_at timestamp, progress double, message string"


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["created_at", "id"], kind="stable")


def _freed(state: GroupState) -> bool:
    """Whether the call is a timer's: the task has been silent so long that its state goes."""
    if state.hasTimedOut:
        state.remove()
        return True
    return False


def _clamp(seconds: int | None):
    def clamp(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _freed(state):
            return
        rows = _ordered(frames)
        high = state.get[0] if state.exists else 0.0
        known = rows["progress"].fillna(-np.inf).to_numpy(dtype="float64")
        rows["progress"] = np.maximum(np.maximum.accumulate(known), high)
        state.update((float(rows["progress"].iloc[-1]),))
        if seconds:
            state.setTimeoutDuration(seconds * 1000)
        yield rows[["task_id", "id", "created_at", "progress", "message"]]

    return clamp


def _timeout(seconds: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if seconds else GroupStateTimeout.NoTimeout


def stream_progress(logs: DataFrame, idle_seconds: int | None = IDLE_SECONDS) -> DataFrame:
    """Every entry with its progress clamped to the task's high-water mark.

    The mark is forgotten once a task has had no entry for ``idle_seconds``. A run that shall end with its input (``availableNow``)
    passes ``None``: a timer keeps it alive.
    """
    narrow = logs.select("task_id", "id", F.col("created_at").cast("timestamp").alias("created_at"), "progress", "message")
    return narrow.groupBy("task_id").applyInPandasWithState(_clamp(idle_seconds), _OUT, "high double", "append", _timeout(idle_seconds))


def _feed(seconds: int | None):
    def changes(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if seconds else 0
        if state.hasTimedOut:
            last, done, opened = state.get
            if now >= opened + 2 * seconds * 1000:
                state.remove()
            else:  # the feed closes; the mark that it is closed lives as long again, so late rows don't reopen it
                state.update((last, True, opened))
                state.setTimeoutDuration(max(1, opened + 2 * seconds * 1000 - now))
            return
        seen = state.exists
        last, done, opened = state.get if seen else (None, False, now)
        if not done:
            rows = _ordered(frames)
            ends = rows["status"].isin(["completed", "failed"]).to_numpy()
            if ends.any():
                rows, done = rows.iloc[:int(np.argmax(ends)) + 1], True
            before = rows["progress"].shift(1)
            same = rows["progress"].eq(before) | (rows["progress"].isna() & before.isna())
            first = rows["progress"].iloc[0]
            unknown = last is None or np.isnan(last)
            same.iloc[0] = seen and ((unknown and pd.isna(first)) or (not unknown and first == last))
            last = float(rows["progress"].iloc[-1])
            yield rows.loc[~same, ["task_id", "id", "created_at", "progress", "message"]]
        state.update((last, done, opened))
        if seconds:  # a timer lapses with every call, so what is left of it is set again
            state.setTimeoutDuration(max(1, opened + (2 if done else 1) * seconds * 1000 - now))

    return changes


def stream_changes(logs: DataFrame, seconds: int | None = FEED_SECONDS) -> DataFrame:
    """Entries whose progress changed, up to the task's end.

    A feed closes ``seconds`` after its first entry or with the task's end, and is
    remembered as closed until twice that time: entries meanwhile are dropped.
    Then a processing-time timer removes its state. A run that shall end
    with its input (``availableNow``) passes ``None``: a timer keeps it alive.
    """
    status = F.col("status") if "status" in logs.columns else F.lit(None).cast("string")
    narrow = logs.select("task_id", "id", F.col("created_at").cast("timestamp").alias("created_at"), "progress", "message",
                         status.alias("status"))
    return narrow.groupBy("task_id").applyInPandasWithState(_feed(seconds), _OUT, "last double, done boolean, opened long", "append",
                                                            GroupStateTimeout.ProcessingTimeTimeout if seconds
                                                            else GroupStateTimeout.NoTimeout)


def _recent(n: int, seconds: int | None = None):
    def keep(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _freed(state):
            return
        rows = _ordered(frames).tail(n)
        if state.exists:
            times, ids, progress, messages = state.get
            old = pd.DataFrame({"created_at": pd.to_datetime(pd.Series(times, dtype="int64"), unit="us", utc=True), "id": ids,
                                "progress": progress, "message": messages})
            old["created_at"] = old["created_at"].dt.tz_localize(None)
            new = rows.assign(created_at=pd.to_datetime(rows["created_at"]).dt.tz_localize(None))
            rows = pd.concat([old, new[["created_at", "id", "progress", "message"]]], ignore_index=True).sort_values(
                ["created_at", "id"], kind="stable").tail(n)
        micros = pd.to_datetime(rows["created_at"]).astype("datetime64[us]").astype("int64")
        state.update((micros.tolist(), rows["id"].astype("int64").tolist(), rows["progress"].astype("float64").tolist(),
                      rows["message"].tolist()))
        if seconds:
            state.setTimeoutDuration(seconds * 1000)
        yield rows.assign(task_id=key[0])[["task_id", "id", "created_at", "progress", "message"]]

    return keep


def stream_recent_logs(logs: DataFrame, n: int = RECENT, idle_seconds: int | None = IDLE_SECONDS) -> DataFrame:
    """The current last ``n`` entries of each task touched by a micro-batch (update mode).

    They are forgotten once a task has had no entry for ``idle_seconds``; ``None`` as in ``stream_progress``.
    """
    narrow = logs.select("task_id", "id", F.col("created_at").cast("timestamp").alias("created_at"), "progress", "message")
    return narrow.groupBy("task_id").applyInPandasWithState(
        _recent(n, idle_seconds), _OUT, "times array<long>, ids array<long>, progress array<double>, messages array<string>", "update",
        _timeout(idle_seconds))


def latest(updates: DataFrame) -> DataFrame:
    """Of what ``run_to_table`` has written in update mode the rows of each task's last batch."""
    last = updates.groupBy("task_id").agg(F.max("batch_id").alias("batch_id"))
    return updates.join(last, ["task_id", "batch_id"])


def hash_prefix(file_hash: str | Column) -> Column:
    """Folder of a content hash: its first two digits."""
    return F.lower(F.substring(F.col(file_hash) if isinstance(file_hash, str) else file_hash, 1, 2)).alias("prefix")


def store_tasks(tasks: DataFrame, store: str, batch_id: int) -> None:
    """Write task rows foldered by hash prefix and batch; a batch that is written again replaces its own folders."""
    (tasks.withColumn("prefix", hash_prefix("file_hash")).withColumn("batch_id", F.lit(batch_id)).hint("rebalance", "prefix")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch_id").parquet(store))


def known_tasks(files: DataFrame, store: str) -> DataFrame:
    """The stored tasks in the folders of the files' hashes; other folders are not read."""
    prefixes = [r[0] for r in files.select(hash_prefix("sha256")).distinct().collect()]
    # A store names its folders by text; without a schema, digits would be read as numbers.
    spark = files.sparkSession
    schema = spark.read.option("mergeSchema", "true").parquet(store).schema
    for field in schema.fields:
        if field.name == "prefix":
            field.dataType = StringType()
    return spark.read.schema(schema).parquet(store).filter(F.col("prefix").isin(prefixes))


def ingest_batch(store: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: create one task per new content hash.

    Hashes of completed or running tasks are skipped, equal files of a batch
    make one task. The store is foldered by hash prefix, and a batch reads the
    folders of its own hashes only (256 at most). Within them it owns folders
    that a retry overwrites, so a batch that is replayed after a failure changes
    nothing.
    """

    def run(files: DataFrame, batch_id: int) -> None:
        known = known_tasks(files, store).filter(F.coalesce(F.col("batch_id"), F.lit(-1)) != batch_id)
        todo = decide_ingest(files, known).filter(F.col("decision") == "create")
        one = todo.groupBy("sha256").agg(F.min(F.struct("file_name", "size")).alias("f")).select("sha256", "f.file_name", "f.size")
        store_tasks(new_tasks(one).withColumn("completed_at", F.lit(None).cast("timestamp")), store, batch_id)

    return run


def stream_ingest(files: DataFrame, store: str, checkpoint: str):
    """Start the ingest of a stream of scanned files into the task store."""
    return (files.writeStream.foreachBatch(ingest_batch(store)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all input available now into Parquet and wait for it."""
    if mode == "append":
        query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    else:
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
                 .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch_id={i}"))
                 .trigger(availableNow=True).start())
    query.awaitTermination()
