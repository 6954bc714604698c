"""Markdown texts as lines: headings, section text, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as tx
from clauseloom.operators.scan import Run, dense_chunk, ordered_concat, ordinal, scan
from clauseloom.operators.tree import parents_by_level, thin_tree
from clauseloom.session import materialize

# Heading and fence patterns.
HEADING = r"^(#{1,6})\s+(.+)$"
FENCE = "```"
LEVELS = 6


def marked_lines(lines: DataFrame, rows: int | None = None) -> DataFrame:
    """Lines with ``is_head``, ``level`` and ``title``: headings outside fences that start in the first column."""
    s = lines.withColumn("_s", tx.strip("line"))
    fenced = scan(s.withColumn("_fence", F.col("_s").startswith(FENCE)), ["doc_id"], ["line_num"],
                  [Run("_fences", "sum", F.col("_fence").cast("long"))], dense_chunk("line_num", rows))
    head = (~F.col("_fence") & (F.col("_fences") % 2 == 0) & F.col("_s").rlike(HEADING) & F.col("line").startswith("#"))
    return (fenced.withColumn("is_head", head)
            .withColumn("level", F.when(head, F.length(F.regexp_extract("line", "^(#{1,6})", 1))))
            .withColumn("title", F.when(head, tx.strip(F.regexp_extract("_s", HEADING, 2))))
            .drop("_s", "_fence", "_fences"))


def headers(lines: DataFrame, rows: int | None = None) -> DataFrame:
    return marked_lines(lines, rows).filter("is_head").drop("is_head", "line")


def section_text(lines: DataFrame, rows: int | None = None) -> DataFrame:
    """Each heading with the stripped text from its own line up to the next heading."""
    marked = marked_lines(lines, rows)
    owned = scan(marked, ["doc_id"], ["line_num"], [Run("_head", "last", F.when(F.col("is_head"), F.col("line_num")))],
                 dense_chunk("line_num", rows)).filter(F.col("_head").isNotNull())
    owned = materialize(owned, "markdown-sections")
    texts = ordered_concat(owned, ["doc_id", "_head"], ["line_num"], F.col("line"), "\n", "_t", dense_chunk("line_num", rows))
    heads = owned.filter("is_head").select("doc_id", "line_num", "level", "title")
    return heads.join(texts.withColumnRenamed("_head", "line_num"), ["doc_id", "line_num"]).withColumn(
        "text", tx.strip("_t")).drop("_t")


def markdown_nodes(lines: DataFrame, rows: int | None = None) -> DataFrame:
    """Sections as preorder nodes with their token counts."""
    numbered = ordinal(section_text(lines, rows), ["doc_id"], ["line_num"], "_n", dense_chunk("line_num", rows))
    nodes = numbered.withColumn("node_idx", F.col("_n") - 1).drop("_n").withColumn("token_count", tx.token_count("text"))
    return materialize(nodes, "markdown-nodes")


def markdown_tree(lines: DataFrame, min_tokens: int | None = None, summaries: bool = False, keep_text: bool = True,
                  rows: int | None = None) -> DataFrame:
    """Tree of a Markdown text; with ``min_tokens`` small subtrees are folded first. Node ids count from 1."""
    nodes = markdown_nodes(lines, rows)
    if min_tokens is not None:
        thin = thin_tree(nodes, min_tokens, rows)
        again = ordinal(thin, ["doc_id"], ["node_idx"], "_n", dense_chunk("node_idx", rows))
        nodes = again.withColumn("node_idx", F.col("_n") - 1).drop("_n")
    out = parents_by_level(nodes, rows=rows).withColumn(
        "node_id", F.format_string("%04d", F.col("node_idx") + 1))
    if summaries:
        out = out.withColumn("summary", tx.extractive_summary("text", F.col("token_count")))
    return out if keep_text else out.drop("text")
