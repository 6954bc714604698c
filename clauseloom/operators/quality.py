"""Quality and evaluation metrics per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.geometry import box_iou
from clauseloom.operators.clauses import is_visual

# Fixed value: location rates below this percentage are reported as low.
LOW_RATE = 95.0


def _has(col: str) -> Column:
    return F.coalesce(F.size(col), F.lit(0)) > 0


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def parse_confidence(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean span score and number of spans; documents without scores get 0."""
    per = scores.groupBy("doc_id").agg(F.avg("score").alias("confidence"), F.count("score").alias("spans"))
    return docs.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("spans", F.lit(0)).alias("spans"))


def leaf_rates(nodes: DataFrame, clauses: DataFrame) -> DataFrame:
    """Per document: leaves, leaves with a clause, leaves with positions, and both rates. ``nodes`` need ``is_leaf``."""
    per_node = clauses.groupBy("doc_id", "node_id").agg(F.count(F.lit(1)).alias("_n"))
    leaves = nodes.filter("is_leaf").join(per_node, ["doc_id", "node_id"], "left")
    got = leaves.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("leaves"), F.count_if(F.coalesce("_n", F.lit(0)) > 0).alias("leaves_with_clause"),
        F.count_if(_has("positions")).alias("leaves_with_positions"))
    return got.select("*", _rate(F.col("leaves_with_clause"), F.col("leaves")).alias("leaf_with_clause_rate"),
                      _rate(F.col("leaves_with_positions"), F.col("leaves")).alias("section_bbox_rate"))


def clause_bbox_rate(clauses: DataFrame, keys: list[str]) -> DataFrame:
    """Clauses with evidence over clauses: the evidence binding rate."""
    return clauses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clauses"), F.count_if(_has("positions")).alias("clauses_with_positions")).withColumn(
        "clause_bbox_rate", _rate(F.col("clauses_with_positions"), F.col("clauses")))


def fill_rate(nodes: DataFrame) -> DataFrame:
    """Nodes with text over nodes."""
    return nodes.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.coalesce("original_text", F.lit("")) != "").alias("filled")
    ).withColumn("fill_rate", _rate(F.col("filled"), F.col("nodes")))


def quality_report(nodes: DataFrame, clauses: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per document that has both a tree and clauses; no other document gets a report."""
    leaf = leaf_rates(nodes, clauses)
    bound = clause_bbox_rate(clauses, ["doc_id"])
    text = fill_rate(nodes)
    docs = nodes.select("doc_id").distinct()
    return (parse_confidence(docs, scores).join(text, "doc_id").join(bound, "doc_id").join(leaf, "doc_id", "left")
            .fillna(0, ["leaves", "leaves_with_clause", "leaves_with_positions"])
            .fillna(0.0, ["leaf_with_clause_rate", "section_bbox_rate"]))


def top_sections(clauses: DataFrame, n: int = 5) -> DataFrame:
    """Sections with the most clauses; equal counts by section id."""
    return (clauses.groupBy("section_id", "section_title").agg(F.count(F.lit(1)).alias("clauses"))
            .orderBy(F.desc("clauses"), "section_id", "section_title").limit(n))


def clauses_per_node(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("doc_id", "node_id").agg(F.count(F.lit(1)).alias("clauses"))


def location_stats(clauses: DataFrame, keys: list[str]) -> DataFrame:
    """How many clauses, visual and text, were located, and whether the rate is low."""
    rate = _rate(F.col("located") * 100.0, F.col("total"))
    return clauses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_visual()).alias("visual"), F.count_if(~is_visual()).alias("text"),
        F.count_if(_has("positions")).alias("located"), F.count_if(~_has("positions")).alias("failed")
    ).withColumn("rate", rate).withColumn("low", (F.col("rate") < LOW_RATE).cast("int"))


def parse_checks(blocks: DataFrame) -> DataFrame:
    """Blocks per page, empty pages and pages far above the mean, per document.

    Empty pages are counted as pages minus pages with blocks; no page list is spread out.
    """
    per_page = blocks.filter(F.col("page_idx") >= 0).groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n"))
    per_doc = per_page.groupBy("doc_id").agg(
        (F.max("page_idx") + 1).cast("long").alias("pages"), F.count(F.lit(1)).alias("pages_with_blocks"),
        F.sum("n").alias("blocks"))
    mean = F.col("blocks") / F.col("pages")
    busy = (per_page.join(per_doc.select("doc_id", (mean * 1.5).alias("_limit")), "doc_id")
            .groupBy("doc_id").agg(F.count_if(F.col("n") > F.col("_limit")).alias("abnormal_pages")))
    return per_doc.join(busy, "doc_id").select(
        "doc_id", "pages", (F.col("pages") - F.col("pages_with_blocks")).alias("empty_pages"), "abnormal_pages",
        mean.alias("blocks_per_page"))


def box_checks(rows: DataFrame) -> DataFrame:
    """Positions outside their page, per document; rows are (doc_id, position, width, height)."""
    p = F.col("position")
    out = (p["x0"] < 0) | (p["y0"] < 0) | (p["x1"] > F.col("width")) | (p["y1"] > F.col("height"))
    inverted = (p["x1"] < p["x0"]) | (p["y1"] < p["y0"])
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("positions"), F.count_if(out).alias("out_of_bounds"),
                                      F.count_if(inverted).alias("inverted"))


def evaluate(gold: DataFrame, pred: DataFrame, iou: float = 0.5) -> DataFrame:
    """Binding and drift against gold rows (doc_id, clause_key, positions).

    A pair is bound when both sides have positions and drifted when the best
    overlap of any predicted with any gold box stays below ``iou``.
    """
    g = gold.select("doc_id", "clause_key", F.col("positions").alias("_g"))
    p = pred.select("doc_id", "clause_key", F.col("positions").alias("_p"))
    both = g.join(p, ["doc_id", "clause_key"], "full_outer")
    has_g, has_p = F.coalesce(F.size("_g"), F.lit(0)) > 0, F.coalesce(F.size("_p"), F.lit(0)) > 0
    best = F.aggregate("_p", F.lit(0.0), lambda acc, a: F.greatest(
        acc, F.aggregate("_g", F.lit(0.0), lambda acc2, b: F.greatest(acc2, box_iou(a, b)))))
    marked = both.select(has_g.alias("g"), has_p.alias("p"), F.when(has_g & has_p, best).alias("iou"))
    bound = F.count_if(F.col("g") & F.col("p"))
    return marked.agg(
        F.count_if("g").alias("expected"), F.count_if("p").alias("predicted"), bound.alias("bound"),
        F.count_if(F.col("iou") < iou).alias("drifted"), F.avg("iou").alias("mean_iou")).select(
        "*", _rate(F.col("bound"), F.col("expected")).alias("binding_rate"),
        _rate(F.col("drifted"), F.col("bound")).alias("drift_rate"))


def sections_without_clauses(nodes: DataFrame, clauses: DataFrame) -> DataFrame:
    return nodes.join(clauses.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")


def tasks_without_file(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks whose file is not among the scanned files."""
    return tasks.join(files.select("file_name"), "file_name", "left_anti")
