"""Task, log and clause queries: listing, search, reuse by content hash, folding of status updates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.operators.scan import Run, scan, with_range_chunk
from clauseloom.schemas import POSITIONS_DDL, TASK_FIELDS, UNKNOWN_NODE


def micros(col: str | Column) -> Column:
    """Microseconds since the epoch, whatever timestamp type the column has."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


# -- creation and updates -------------------------------------------------------------------------

def new_tasks(files: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Pending tasks at progress 0 for scanned files (file_name, size, sha256)."""
    return files.select(
        F.sha2(F.concat_ws("/", "file_name", "sha256"), 256).substr(1, 32).alias("task_id"), "file_name",
        F.col("size").cast("long").alias("file_size"), F.col("sha256").alias("file_hash"),
        F.lit("pending").alias("status"), F.lit(0.0).alias("progress"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"))


def fold_updates(updates: DataFrame) -> DataFrame:
    """One row per task from its updates (task_id, id, at, status, progress, message, error, elapsed_seconds).

    Later non-empty values win; the first ``running`` starts the task, the last
    ``completed``/``failed`` ends it. One map-side combined aggregate, no window.
    """
    when = F.struct("at", "id")

    def latest(col: str, known: Column) -> Column:
        return F.max_by(col, F.when(known, when)).alias(col)

    def filled(col: str) -> Column:
        return F.col(col).isNotNull() & (F.col(col) != "")

    done = F.col("status").isin("completed", "failed")
    folded = updates.groupBy("task_id").agg(
        latest("status", filled("status")), latest("progress", F.col("progress").isNotNull()),
        latest("message", filled("message")), latest("error", filled("error")),
        F.max_by("elapsed_seconds", F.when(F.coalesce("elapsed_seconds", F.lit(0.0)) != 0, when)).alias("_given"),
        F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"),
        F.max(F.when(done, F.col("at"))).alias("completed_at"))
    worked = F.when(F.col("started_at") <= F.col("completed_at"), seconds_between("started_at", "completed_at"))
    return folded.withColumn("elapsed_seconds", F.coalesce("_given", worked)).drop("_given")


def apply_updates(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite task attributes with the non-null values of ``updates``; unknown columns are ignored."""
    known = [c for c in updates.columns if c in TASK_FIELDS and c in tasks.columns]
    new = updates.select("task_id", *[F.col(c).alias(f"_new_{c}") for c in known])
    joined = tasks.join(new, "task_id", "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in known else F.col(c) for c in tasks.columns])


def task_state(tasks: DataFrame) -> DataFrame:
    """State view with the derived ``updated_at`` and defaults for message and elapsed time."""
    return tasks.select(
        "task_id", "status", "progress", F.coalesce("current_message", F.lit("")).alias("message"),
        F.col("error_message").alias("error"), "created_at",
        F.coalesce("completed_at", "started_at", "created_at").alias("updated_at"),
        F.col("started_at").alias("start_time"), F.coalesce("elapsed_seconds", F.lit(0.0)).alias("elapsed_seconds"))


def log_rows(updates: DataFrame) -> DataFrame:
    """Log entries of the updates that carry a message, with their level."""
    level = (F.when(F.coalesce("error", F.lit("")) != "", "error").when(F.col("status") == "failed", "warning")
             .otherwise("info"))
    return (updates.filter(F.coalesce("message", F.lit("")) != "")
            .select("id", "task_id", level.alias("log_level"), "progress", "message", F.col("at").alias("created_at")))


# -- reuse by content hash ------------------------------------------------------------------------

def reusable_task(tasks: DataFrame) -> DataFrame:
    """Per file hash the task to reuse and the decision: reuse, wait or create.

    The newest completed task wins, otherwise the newest task of any state. The
    preference is one sortable struct, so a hot hash is combined before the shuffle.
    """
    done = F.col("status") == "completed"
    when = F.coalesce(micros(F.when(done, F.col("completed_at")).otherwise(F.col("created_at"))),
                      F.lit(-(1 << 62)))
    best = F.max_by(F.struct("task_id", "status"), F.struct(done.alias("d"), when.alias("w"), F.col("task_id").alias("t")))
    picked = tasks.filter(F.coalesce("file_hash", F.lit("")) != "").groupBy("file_hash").agg(best.alias("b"))
    status = F.col("b.status")
    return picked.select(
        "file_hash", F.col("b.task_id").alias("task_id"), status.alias("status"),
        F.when(status == "completed", "reuse").when(status == "running", "wait").otherwise("create").alias("decision"))


def decide_ingest(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Files with the decision their hash gets from the existing tasks; new content is created."""
    known = reusable_task(tasks).select(F.col("file_hash").alias("sha256"), "task_id", "decision")
    return files.join(known, "sha256", "left").withColumn("decision", F.coalesce("decision", F.lit("create")))


# -- progress -------------------------------------------------------------------------------------

def monotonic_progress(logs: DataFrame, chunk: Column | str, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Progress that never falls below its running maximum (0 at the start) within a task."""
    clamped = scan(logs, ["task_id"], order, [Run("_high", "max", F.col("progress"))], chunk)
    return clamped.withColumn("progress", F.greatest(F.col("_high"), F.lit(0.0))).drop("_high")


def progress_changes(logs: DataFrame, chunk: Column | str, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Only the entries whose progress differs from the entry before."""
    marked = scan(logs, ["task_id"], order, [Run("_before", "lag", F.col("progress")),
                                            Run("_first", "lag", F.lit(True))], chunk)
    return marked.filter(F.col("_first").isNull() | ~F.col("progress").eqNullSafe(F.col("_before"))
                         ).drop("_before", "_first")


def recent_logs(logs: DataFrame, n: int = 50) -> DataFrame:
    """The latest ``n`` entries of each task; the rank filter is applied before and after the shuffle."""
    newest = Window.partitionBy("task_id").orderBy(F.desc("created_at"), F.desc("id"))
    return logs.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


# -- listings -------------------------------------------------------------------------------------

def list_tasks(tasks: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest tasks first, one page of at most 100."""
    rows = tasks.filter(F.col("status") == status) if status else tasks
    return rows.orderBy(F.desc("created_at"), "task_id").offset(offset).limit(min(max(limit, 1), 100))


def get_task(tasks: DataFrame, task_id: str) -> DataFrame:
    return tasks.filter(F.col("task_id") == task_id)


def task_logs(logs: DataFrame, task_id: str | None = None) -> DataFrame:
    """Log entries, oldest first."""
    rows = logs if task_id is None else logs.filter(F.col("task_id") == task_id)
    return rows.orderBy("created_at", "id")


def task_sections(sections: DataFrame, task_id: str | None = None) -> DataFrame:
    """Sections by priority, missing priorities first."""
    rows = sections if task_id is None else sections.filter(F.col("task_id") == task_id)
    return rows.orderBy(F.asc_nulls_first("priority"), "id")


def task_clauses(clauses: DataFrame, task_id: str | None = None) -> DataFrame:
    """Clauses by page, then by insertion."""
    rows = clauses if task_id is None else clauses.filter(F.col("task_id") == task_id)
    return rows.orderBy(F.asc_nulls_first("page_number"), "id")


def clauses_flat(clauses: DataFrame) -> DataFrame:
    """Clauses with decoded positions and defaults; unreadable positions give an empty list."""
    raw = F.from_json("positions_json", "array<array<double>>")
    decoded = F.when(F.try_parse_json("positions_json").isNotNull(), raw)
    full = F.transform(F.filter(F.coalesce(decoded, F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 5),
                       lambda p: F.struct(p[0].cast("int").alias("page_idx"), p[1].alias("x0"), p[2].alias("y0"),
                                          p[3].alias("x1"), p[4].alias("y1")))
    return clauses.select(
        "id", "task_id", "matrix_id", F.coalesce("section_id", F.lit(UNKNOWN_NODE)).alias("node_id"),
        F.coalesce("section_title", F.lit("")).alias("section_title"),
        F.coalesce("page_number", F.lit(0)).alias("page_number"), "type", "actor", "action", "object", "condition",
        "deadline", "metric", "original_text", "image_caption", "table_caption",
        full.cast(POSITIONS_DDL).alias("positions"))


def search_clauses(clauses: DataFrame, keyword: str, task_id: str | None = None, limit: int | None = 50) -> DataFrame:
    """Case-insensitive substring search; ``%`` and ``_`` in the keyword are wildcards, a backslash is itself; text cut to 200."""
    escaped = keyword.replace("\\", "\\\\")
    rows = clauses.filter(F.col("original_text").ilike(f"%{escaped}%"))
    if task_id is not None:
        rows = rows.filter(F.col("task_id") == task_id)
    rows = rows.withColumn("original_text", F.substring("original_text", 1, 200)).orderBy("page_number", "id")
    return rows if limit is None else rows.limit(limit)


def task_stats(tasks: DataFrame, sections: DataFrame, clauses: DataFrame) -> DataFrame:
    """Section and clause totals per task."""
    per_sections = sections.groupBy("task_id").agg(F.count(F.lit(1)).alias("total_sections"))
    per_clauses = clauses.groupBy("task_id").agg(F.count(F.lit(1)).alias("total_clauses"))
    return (tasks.drop("total_sections", "total_clauses").join(per_sections, "task_id", "left")
            .join(per_clauses, "task_id", "left").fillna(0, ["total_sections", "total_clauses"]))


def latency_quantiles(tasks: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Exact interpolated quantiles of the elapsed seconds, in one row.

    Equal values are counted first and dealt into ranges of values. One count per
    range tells which ranges hold the wanted ranks; running sums are made inside
    these few only. Neither one task nor one aggregation buffer holds all values.
    """
    counts = (tasks.filter(F.col("elapsed_seconds").isNotNull())
              .groupBy(F.col("elapsed_seconds").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    dealt = with_range_chunk(counts, [], ["v"], "_range", "quantiles")
    # One number per range, as many as the session has shuffle partitions.
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.sum("c").alias("n")).collect())
    total = sum(n for _, n in sizes)
    ranks = sorted({rank for q in quantiles for rank in (math.floor((total - 1) * q), math.ceil((total - 1) * q))}) if total else []
    holds, before = {}, 0
    for number, n in sizes:
        holds |= {rank: (number, before) for rank in ranks if before <= rank < before + n}
        before += n
    wanted = dealt.filter(F.col("_range").isin(sorted({number for number, _ in holds.values()})))
    inside = Window.partitionBy("_range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = wanted.withColumn("_upto", F.sum("c").over(inside))
    picks = [F.min(F.when((F.col("_range") == number) & (F.col("_upto") > rank - offset), F.col("v"))).alias(f"r{rank}")
             for rank, (number, offset) in holds.items()]
    found = ranked.agg(*(picks or [F.max("v")]))
    out = []
    for q in quantiles:
        place = (total - 1) * q
        low, high = ((F.col(f"r{rank}") if total else F.lit(None).cast("double")) for rank in (math.floor(place), math.ceil(place)))
        out.append((low + (high - low) * F.lit(place - math.floor(place))).alias(f"p{round(q * 100)}"))
    return found.select(*out, F.lit(total).cast("long").alias("n"))
