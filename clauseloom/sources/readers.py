"""Readers: layout blocks, span scores, stored trees, Markdown and file scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.operators.scan import Run, dense_chunk, ordered_concat, ordinal, scan
from clauseloom.operators.stack import above
from clauseloom.schemas import BLOCK_ITEM_DDL, PARSE_DETAIL_DDL
from clauseloom.session import materialize

#: JSON tokens: the opening of a list named nodes or structure, a string, a bracket, what stands in between, a quote without its pair.
JSON_TOKEN = r'(?s)"(?:nodes|structure)"\s*:\s*\[|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]]|[^"{}\[\]]+|"'
#: Open brackets down to a list of nodes, and down to a node, by their kinds.
LIST_CHAIN, NODE_CHAIN = r"^\{S(?:\{N)*$", r"^\{S(?:\{N)*\{$"


def _doc_key() -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)


def blocks_from_json(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """Blocks in list order from one JSON array per document; missing keys are null, unreadable JSON gives none."""
    items = F.when(F.try_parse_json(json_col).isNotNull(), F.from_json(json_col, BLOCK_ITEM_DDL))
    return docs.select("doc_id", F.posexplode(items).alias("block_idx", "b")).select("doc_id", "block_idx", "b.*")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One block list per file; the whole file is one cell, so list order is kept."""
    files = spark.read.text(path, wholetext=True).select(_doc_key().alias("doc_id"), F.col("value").alias("json"))
    return blocks_from_json(files)


def span_scores_from_json(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """Scores of the spans under ``para_blocks.lines``; spans without a score are skipped."""
    detail = docs.select("doc_id", F.from_json(json_col, PARSE_DETAIL_DDL).alias("d"))
    pages = detail.select("doc_id", F.posexplode("d.pdf_info").alias("page", "p"))
    return (pages.select("doc_id", "page", F.explode("p.para_blocks").alias("b"))
            .select("doc_id", "page", F.explode("b.lines").alias("l"))
            .select("doc_id", "page", F.explode("l.spans").alias("s"))
            .select("doc_id", "page", F.col("s.score").alias("score")).filter(F.col("score").isNotNull()))


def read_span_scores(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(_doc_key().alias("doc_id"), F.col("value").alias("json"))
    return span_scores_from_json(files)


def _bracket_tokens(docs: DataFrame, json_col: str, rows: int | None) -> DataFrame:
    """The JSON texts as tokens (_doc, doc_id, pos, t, kind), one row each, with their bracket depth.

    ``kind`` is the bracket, ``S`` or ``N`` for the bracket that opens a list named structure or nodes, null for text in between.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("_doc"), "doc_id", F.col(json_col).alias("_json"))
    parts = numbered.select("_doc", "doc_id", F.posexplode(F.regexp_extract_all("_json", F.lit(JSON_TOKEN), F.lit(0))).alias("pos", "t"))
    kind = (F.when(F.col("t").isin("{", "}", "[", "]"), F.col("t"))
            .when(F.col("t").rlike(r'(?s)^"structure".*\[$'), "S").when(F.col("t").rlike(r'(?s)^"nodes".*\[$'), "N"))
    step = F.when(F.col("kind").isin("{", "[", "S", "N"), 1).when(F.col("kind").isNotNull(), -1).otherwise(0).cast("long")
    stored = materialize(parts.withColumn("kind", kind), "tree-tokens")
    return scan(stored, ["_doc"], ["pos"], [Run("depth", "sum", step)], dense_chunk("pos", rows))


def nodes_from_tree_json(docs: DataFrame, json_col: str = "json", rows: int | None = None) -> DataFrame:
    """Adjacency rows of stored tree JSON (``structure`` list of nodes with nested ``nodes``), of any depth; bad JSON gives none.

    The text is read as a stream of brackets: depths are prefix sums, the brackets open at each one come from ``stack.above``, and a
    bracket that stands in a chain of node lists up to the root opens a node. Each token then goes to its innermost node, whose own
    JSON, without its children, is put together and parsed. ``path`` holds the sibling positions from the root; sorting by it gives
    preorder. A text whose lists of nodes hold anything but objects counts as bad. Rows of ``docs`` are read one by one, also where a doc_id repeats.
    """
    tokens = materialize(_bracket_tokens(docs, json_col, rows), "tree-depths")
    opens = F.col("kind").isin("{", "[", "S", "N")
    # A closing bracket ranks right below the one that it closes, so that this one is the nearest of a smaller rank.
    ranked = tokens.filter("kind IS NOT NULL").withColumn("_rank", F.when(opens, 2 * F.col("depth")).otherwise(2 * F.col("depth") + 3))
    chained = above(ranked, ["_doc"], "pos", "_rank", F.col("kind"), "_up", dense_chunk("pos", rows), whole=True)
    chain = F.array_join("_up", "")
    last = F.try_element_at("_up", F.lit(-1))
    fits = F.coalesce(F.when(opens, F.lit(True)).when(F.col("kind") == "}", last == "{").otherwise(last.isin("[", "S", "N")), F.lit(False))
    # The innermost open bracket behind each one; L stands for a list of nodes.
    inner = F.when(opens, F.concat("_up", F.array("kind"))).otherwise(F.slice("_up", F.lit(1), F.greatest(F.size("_up") - 1, F.lit(0))))
    within = F.when(F.array_join(inner, "").rlike(LIST_CHAIN), "L").otherwise(F.coalesce(F.try_element_at(inner, F.lit(-1)), F.lit("")))
    brackets = chained.select(
        "_doc", "pos", F.when((F.col("kind") == "{") & chain.rlike(LIST_CHAIN), 1).when(
            (F.col("kind") == "}") & chain.rlike(NODE_CHAIN), -1).otherwise(0).cast("long").alias("step"),
        within.alias("within"), fits.alias("fits"))
    line = materialize(tokens.join(brackets, ["_doc", "pos"], "left"), "tree-line")
    seen = scan(line, ["_doc"], ["pos"], [Run("level", "sum", F.coalesce("step", F.lit(0)).cast("long")), Run("inner", "last", F.col("within"))],
                dense_chunk("pos", rows))
    owned = scan(seen, ["_doc", "level"], ["pos"], [Run("node", "last", F.when(F.col("step") == 1, F.col("pos")))], dense_chunk("pos", rows))
    owned = materialize(owned, "tree-owned")
    # Between the nodes of a list stand commas only; they belong to no node.
    between = F.col("kind").isNull() & F.coalesce(F.col("inner") == "L", F.lit(False))
    outside = F.col("kind").isNull() & (F.coalesce("inner", F.lit("")) == "")
    stray = (~F.coalesce("fits", F.lit(True)) | (F.col("depth") < 0) | (between & ~F.trim(F.regexp_replace("t", r"\s", "")).isin("", ","))
             | (outside & ~F.regexp_replace("t", r"\s", "").isin("")) | (F.col("t") == '"'))
    broken = owned.groupBy("_doc").agg(F.max(stray).alias("stray"), F.max_by("depth", "pos").alias("end"),
                                       F.count_if((F.col("kind") == "{") & (F.col("depth") == 1)).alias("roots"))
    broken = broken.filter("stray OR end <> 0 OR roots <> 1").select("_doc")
    # What belongs to no node is the text of the root, which is checked as well.
    own = owned.filter(~between & ~outside & ((F.col("step") != -1) | F.col("step").isNull())).withColumn("node", F.coalesce("node", F.lit(-1)))
    texts = ordered_concat(own, ["_doc", "node"], ["pos"], F.col("t"), "", "_json", dense_chunk("pos", rows)).withColumn(
        "_json", F.when(F.col("node") < 0, F.col("_json")).otherwise(F.concat("_json", F.lit("}"))))
    texts = materialize(texts.join(broken, "_doc", "left_anti"), "tree-texts")
    unread = texts.filter(F.try_parse_json("_json").isNull()).select("_doc").distinct()
    good = texts.join(unread, "_doc", "left_anti")
    heads = owned.filter("step = 1").select("_doc", "doc_id", F.col("pos").alias("node"), F.col("level").cast("int").alias("level"))
    tree = above(heads, ["_doc"], "node", "level", F.col("node"), "_parent", dense_chunk("node", rows))
    numbered = ordinal(tree.withColumn("_parent", F.coalesce("_parent", F.lit(-1))), ["_doc", "_parent"], ["node"], "_n", dense_chunk("node", rows))
    numbered = numbered.withColumn("_place", (F.col("_n") - 1).cast("int"))
    placed = above(numbered, ["_doc"], "node", "level", F.col("_place"), "_places", dense_chunk("node", rows), whole=True)
    fields = F.from_json("_json", "node_id string, title string, start_index int, end_index int, summary string, original_text string, "
                                  "positions array<array<double>>")
    return (placed.withColumn("path", F.concat("_places", F.array("_place"))).join(good, ["_doc", "node"])
            .select("doc_id", "path", "level", fields.alias("f")).select("doc_id", "path", "level", "f.*"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(_doc_key().alias("doc_id"), F.col("value").alias("text"))


def markdown_lines(docs: DataFrame) -> DataFrame:
    """Lines of whole Markdown texts, numbered from 1."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_i", "line")).select(
        "doc_id", (F.col("_i") + 1).cast("long").alias("line_num"), "line")


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and content hash of the PDF files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.lower("path").endswith(".pdf")).select(
        "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"),
        F.substring_index("path", "/", -1).alias("file_name"))
