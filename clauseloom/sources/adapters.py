"""Corpora derived from the star-schema and text tables, in the layouts of ``schemas``.

All of them are lazy, keep every row of their inputs and hold no window over a
whole document: ordinals come from arithmetic or from ``operators.scan``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.operators.scan import Run, dense_chunk, ordinal, scan, with_adaptive_chunk
from clauseloom.schemas import POSITIONS_DDL
from clauseloom.session import materialize

LINES_PER_PAGE = 10
BLOCKS_PER_DOC = 40
BLOCKS_PER_PAGE = 8
LAYOUT_TYPES = ["text", "header", "list", "image", "table", "equation"]
LINEITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                  "l_returnflag", "l_linestatus", "l_shipdate"]


def _bbox(x0, y0, x1, y1) -> Column:
    return F.array(*[F.lit(v).cast("double") if not isinstance(v, Column) else v.cast("double")
                     for v in (x0, y0, x1, y1)])


def one_position(page: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(F.struct(page.cast("int").alias("page_idx"), x0.cast("double").alias("x0"),
                            y0.cast("double").alias("y0"), x1.cast("double").alias("x1"),
                            y1.cast("double").alias("y1")))


def stored(build):
    """A corpus that many operators read several times: built once per run, then read as a table."""
    name = build.__name__
    prop = cached_property(lambda self: materialize(build(self), name))
    prop.attrname, prop.__doc__ = name, build.__doc__
    return prop


class Tables:
    """The input tables of one folder, each read once, and the corpora built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows cost much to process, over all cores when its scan has fewer pieces than cores.

        Large tables have many pieces and are read as they are, without a shuffle; only their number is asked for.
        """
        df = self.read(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    # -- layout blocks ---------------------------------------------------------------------------

    @cached_property
    def blocks(self) -> DataFrame:
        """One text block per line of a document, ten lines to a page."""
        lines = self.spread("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "text"))
        row = F.col("block_idx") % LINES_PER_PAGE
        return lines.select(
            "doc_id", "block_idx", F.lit("text").alias("type"), "text",
            F.lit(None).cast("array<string>").alias("list_items"),
            F.lit(None).cast("array<string>").alias("image_caption"),
            F.lit(None).cast("array<string>").alias("table_caption"),
            F.lit(None).cast("string").alias("table_body"), F.lit(None).cast("string").alias("img_path"),
            F.floor(F.col("block_idx") / LINES_PER_PAGE).cast("int").alias("page_idx"),
            _bbox(100, 50 + 90 * row, 900, 130 + 90 * row).alias("bbox"))

    @cached_property
    def layout(self) -> DataFrame:
        """Blocks of every type, with missing pages and malformed boxes, one per order."""
        k = F.col("o_orderkey")
        idx = (k % BLOCKS_PER_DOC).cast("int")
        kind = F.element_at(F.array(*[F.lit(t) for t in LAYOUT_TYPES]), (k % 6 + 1).cast("int"))
        group = F.floor(k / 6)
        row = idx % BLOCKS_PER_PAGE
        cust = F.col("o_custkey").cast("string")
        no_strings = F.array().cast("array<string>")
        return self.spread("orders").select(
            F.floor(k / BLOCKS_PER_DOC).cast("long").alias("doc_id"), idx.alias("block_idx"), kind.alias("type"),
            F.when(kind.isin("text", "header", "equation"),
                   F.concat_ws(" ", "o_orderpriority", "o_orderstatus", cust)).alias("text"),
            F.when(kind == "list", F.array(F.col("o_orderpriority"), F.concat(F.lit("customer "), cust))
                   ).alias("list_items"),
            F.when(kind == "image", F.when(group % 4 == 0, F.array(F.concat(F.lit("Figure "), cust),
                                                                     F.col("o_orderstatus"))).otherwise(no_strings)
                   ).alias("image_caption"),
            F.when(kind == "table", F.when(group % 3 == 0, F.array(F.concat(F.lit("Table "), k.cast("string")))
                                           ).otherwise(no_strings)).alias("table_caption"),
            F.when((kind == "table") & (group % 5 != 0), F.concat(
                F.lit("<table><tr><td> "), cust, F.lit(" </td><th>"), F.col("o_orderstatus"),
                F.lit("</th><td></td></tr><tr><td> </td></tr><tr><td>"), F.col("o_orderpriority"),
                F.lit("</td></tr></table>"))).alias("table_body"),
            F.when(kind == "image", F.concat(F.lit("images/p"), (F.col("o_custkey") % 50).cast("string"), F.lit(".jpg")))
            .when((kind == "table") & (group % 2 == 0),
                  F.concat(F.lit("images/t"), cust, F.lit(".jpg"))).alias("img_path"),
            F.when(k % 23 != 0, F.floor(idx / BLOCKS_PER_PAGE)).cast("int").alias("page_idx"),
            F.when(k % 29 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
            .when(k % 31 != 0, _bbox(100, 50 + 100 * row, 900, 130 + 100 * row)).alias("bbox"))

    @cached_property
    def page_texts(self) -> DataFrame:
        """Document pages of ten lines: (doc_id, page_no from 1, text, token_count)."""
        from clauseloom.functions.text import token_count
        pages = (self.blocks.groupBy("doc_id", (F.col("page_idx") + 1).alias("page_no"))
                 .agg(F.array_sort(F.collect_list(F.struct("block_idx", "text"))).alias("rows")))
        text = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
        return pages.select("doc_id", "page_no", text.alias("text")).withColumn("token_count", token_count("text"))

    @cached_property
    def page_dims(self) -> DataFrame:
        """Page sizes by document number; the last page of each document is left out."""
        sizes = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h"))
                          for w, h in ((595, 842), (842, 1191), (612, 792), (612, 1008), (500, 500))])
        last = self.blocks.groupBy("doc_id").agg(F.max("page_idx").alias("last_page"))
        size = F.element_at(sizes, (F.col("doc_id") % 5 + 1).cast("int"))
        return (last.filter(F.col("last_page") > 0)
                .select("doc_id", size.alias("s"), F.explode(F.sequence(F.lit(0), F.col("last_page") - 1)).alias("page_idx"))
                .select("doc_id", "page_idx", F.col("s.w").alias("width"), F.col("s.h").alias("height")))

    # -- trees -----------------------------------------------------------------------------------

    @cached_property
    def _nations(self) -> DataFrame:
        """Nations (25 rows) with their rank in the region, their size and their preorder index."""
        sizes = self.read("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("size"))
        rank = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
        before = F.sum(F.coalesce("size", F.lit(0)) + 1).over(rank.rowsBetween(Window.unboundedPreceding, -1))
        return (self.read("nation").join(sizes, "n_nationkey", "left")
                .select("n_nationkey", "n_name", F.col("n_regionkey").cast("long").alias("doc_id"),
                        F.row_number().over(rank).cast("string").alias("k"), (F.coalesce(before, F.lit(0)) + 1).alias("at")))

    @stored
    def nodes(self) -> DataFrame:
        """Three-level trees: a region with its nations and their customers, in preorder."""
        customers = ordinal(self.read("customer"), ["c_nationkey"], ["c_custkey"], "c", dense_chunk("c_custkey"))
        none = {"original_text": F.lit(None).cast("string"), "bal": F.lit(None).cast("double")}

        def level(n: int, idx: Column, parent: Column, code: Column, title: str, **extra) -> list[Column]:
            cols = {"node_idx": idx.cast("long"), "parent_idx": parent.cast("long"), "level": F.lit(n), "structure": code,
                    "title": F.col(title), **none, **extra}
            return ["doc_id", *[v.alias(k) for k, v in cols.items()]]

        regions = self.read("region").withColumn("doc_id", F.col("r_regionkey").cast("long")).select(
            *level(1, F.lit(0), F.lit(None), F.lit("1"), "r_name"))
        nations = self._nations.select(*level(2, F.col("at"), F.lit(0), F.concat(F.lit("1."), "k"), "n_name"))
        leaves = customers.join(self._nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
            *level(3, F.col("at") + F.col("c"), F.col("at"), F.concat_ws(".", F.lit("1"), "k", F.col("c").cast("string")),
                   "c_name", bal=F.col("c_acctbal"), original_text=F.when(
                       F.col("c_acctbal") >= 0, F.concat_ws(" ", "c_mktsegment", "c_name")).otherwise("")))
        start = (F.floor(F.col("node_idx") / 5) + 1).cast("int")
        return regions.unionByName(nations).unionByName(leaves).select(
            "doc_id", "node_idx", F.format_string("%04d", "node_idx").alias("node_id"), "parent_idx", "level", "structure",
            "title", start.alias("start_index"),
            (start + F.when(F.col("level") == 1, 60).when(F.col("level") == 2, 10).otherwise(1)).alias("end_index"),
            F.lit(None).cast("string").alias("summary"), "original_text",
            F.when(F.col("bal") > 1000, one_position(start - 1, F.lit(100.0), F.lit(50.0), F.lit(900.0), F.lit(130.0)))
            .otherwise(F.array().cast(POSITIONS_DDL)).alias("positions"))

    @cached_property
    def toc(self) -> DataFrame:
        """Table-of-contents items of the trees: printed page, physical index (every 7th missing), page start flag."""
        n = F.col("node_idx")
        printed = (F.floor(n / 5) + 1).cast("int")
        return self.nodes.select(
            "doc_id", n.alias("item_idx"), "structure", "title", printed.alias("page"),
            F.when(n % 7 != 6, printed + F.col("doc_id").cast("int") + 1).alias("physical_index"),
            F.when(n % 3 == 0, "yes").otherwise("no").alias("appear_start"))

    # -- Markdown --------------------------------------------------------------------------------

    @cached_property
    def markdown_lines(self) -> DataFrame:
        """Lines of one Markdown text per conversation: user turns are headings, system turns are fenced."""
        turns = self.read("conversations")
        head = F.concat(F.repeat(F.lit("#"), (F.col("turn") % 4 + 1).cast("int")), F.lit(" "),
                        F.replace("text", F.lit("\n"), F.lit(" ")))
        body = (F.when(F.col("role") == "user", head)
                .when(F.col("role") == "system", F.concat(F.lit("```\n# "), F.col("text"), F.lit("\n```")))
                .otherwise(F.col("text")))
        split = turns.select(F.col("conv_id").alias("doc_id"), "turn", F.split(body, "\n").alias("rows"))
        placed = scan(split, ["doc_id"], ["turn"],
                      [Run("before", "sum", F.size("rows").cast("long"), inclusive=False)], dense_chunk("turn"))
        return (placed.select("doc_id", "before", F.posexplode("rows").alias("p", "line"))
                .select("doc_id", (F.col("before") + F.col("p") + 1).alias("line_num"), "line"))

    # -- tasks and clauses -----------------------------------------------------------------------

    @cached_property
    def tasks(self) -> DataFrame:
        """One task per order; an order's last shipping date is the completion time."""
        shipped = self.read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.max("l_shipdate").alias("shipped"))
        status = (F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running")
                  .otherwise("failed"))
        done = F.when(status == "completed", F.col("shipped"))
        started = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("interval 1 hour"))
        seconds = ((F.unix_micros(done.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / F.lit(1e6))
        return (self.read("orders").join(shipped, "o_orderkey", "left").select(
            F.col("o_orderkey").cast("string").alias("task_id"),
            F.concat(F.lit("doc_"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("file_name"),
            F.floor("o_totalprice").cast("long").alias("file_size"),
            F.sha2(F.col("o_custkey").cast("string"), 256).alias("file_hash"), status.alias("status"),
            F.when(status == "completed", 100.0).otherwise(F.col("o_orderkey") % 100).cast("double").alias("progress"),
            F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("current_message"),
            F.when(status == "failed", F.concat(F.lit("stopped at "), F.col("o_orderpriority"))).alias("error_message"),
            F.lit(0).cast("long").alias("total_sections"), F.lit(0).cast("long").alias("total_clauses"),
            F.lit(None).cast("string").alias("document_tree_json"),
            F.lit(None).cast("string").alias("quality_report_json"),
            F.col("o_orderdate").alias("created_at"), started.alias("started_at"), done.alias("completed_at"),
            seconds.alias("elapsed_seconds")))

    @cached_property
    def clauses(self) -> DataFrame:
        """One clause per order line, numbered inside its section (the order)."""
        lines = self.read("lineitem")
        # Equal order and line numbers occur, so the order runs over every column.
        cut = with_adaptive_chunk(lines, ["l_orderkey"], F.col("l_linenumber"), "cut")
        rows = ordinal(cut, ["l_orderkey"], LINEITEM_ORDER, "seq", "cut")
        q, ln = F.col("l_quantity"), F.col("l_linenumber")
        kinds = F.array(*[F.lit(t) for t in ("obligation", "requirement", "prohibition", "deliverable", "deadline",
                                             "penalty", "definition")])
        kind = F.when(F.col("l_partkey") % 8 != 7, F.element_at(kinds, (F.col("l_partkey") % 8 + 1).cast("int")))
        return rows.select(
            F.col("l_orderkey").cast("string").alias("task_id"),
            F.format_string("%06d-CLS-%03d", "l_orderkey", "seq").alias("matrix_id"),
            F.format_string("%06d", "l_orderkey").alias("section_id"),
            F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("section_title"),
            ln.cast("int").alias("page_number"), kind.alias("type"),
            F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"))
                   ).otherwise("").alias("actor"),
            F.when(F.col("l_returnflag") != "N", F.concat(F.lit("return "), F.col("l_returnflag"))).alias("action"),
            F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("object"),
            F.when(F.col("l_linestatus") == "O", "when open").alias("condition"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("deadline"),
            F.concat(q.cast("int").cast("string"), F.lit(" units")).alias("metric"),
            F.concat(F.lit("  The supplier delivers "), q.cast("int").cast("string"), F.lit(" of part "),
                     F.col("l_partkey").cast("string"), F.lit(" by "), F.date_format("l_shipdate", "yyyy-MM-dd"),
                     F.lit(". ")).alias("original_text"),
            F.when(F.col("l_partkey") % 11 == 0, "Figure").alias("image_caption"),
            F.when(F.col("l_partkey") % 13 == 0, "Table").alias("table_caption"),
            F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("images/p"), (F.col("l_partkey") % 50).cast("string"),
                                                          F.lit(".jpg"))).alias("img_path"),
            F.when(F.col("l_discount") != 0, one_position(ln - 1, F.lit(10.0), q * 10, q + 500, q * 10 + 40)
                   ).alias("positions"))

    @cached_property
    def task_logs(self) -> DataFrame:
        """Event rows as task log entries."""
        return self.read("events").select(
            F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("task_id"),
            F.when(F.col("event_type") == "error", "error").otherwise("info").alias("log_level"),
            F.least(F.col("value") / 5, F.lit(100.0)).alias("progress"), F.col("event_type").alias("message"),
            F.col("ts").alias("created_at"))

    @cached_property
    def log_chunks(self) -> DataFrame:
        """Log entries with a chunk number along time, for scans per task."""
        return with_adaptive_chunk(self.task_logs, ["task_id"], F.unix_micros(F.col("created_at").cast("timestamp")), "cut")

    @cached_property
    def node_clauses(self) -> DataFrame:
        """One clause per order, attached to the tree node of an even-numbered customer."""
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        rows = self.read("orders").select(
            F.format_string("Customer#%09d", cust - cust % 2).alias("title"), k.alias("seq"),
            F.when(k % 9 == 0, "Figure").alias("image_caption"), F.when(k % 10 == 0, "Table").alias("table_caption"),
            F.when(k % 5 != 0, one_position(k % 7, F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)))
            .otherwise(F.array().cast(POSITIONS_DDL)).alias("positions"),
            F.concat(F.lit("Order "), k.cast("string")).alias("original_text"))
        place = self.nodes.filter(F.col("level") == 3).select("doc_id", "node_idx", "node_id", "title", "start_index")
        return rows.join(place, "title").withColumnRenamed("title", "section_title")

    # -- evidence --------------------------------------------------------------------------------

    @stored
    def page_nodes(self) -> DataFrame:
        """Every page of the layout as a node whose positions are those of its valid blocks."""
        from clauseloom.operators.blocks import positions_of
        return positions_of(self.layout, ["doc_id", "page_idx"]).select(
            "doc_id", F.format_string("%04d", "page_idx").alias("node_id"), "positions")

    @cached_property
    def page_clauses(self) -> DataFrame:
        """A clause per order on its page: quoted, misspelt, shortened, reordered or foreign text; some are visual."""
        k = F.col("o_orderkey")
        cust = F.col("o_custkey").cast("string")
        idx = k % BLOCKS_PER_DOC
        whole = F.concat_ws(" ", "o_orderpriority", "o_orderstatus", cust)
        text = (F.when(k % 5 == 0, F.concat(F.lit("(1) "), whole))
                .when(k % 5 == 1, F.concat(F.substring(whole, 1, 4), F.lit("x"), F.substr(whole, F.lit(5))))
                .when(k % 5 == 2, F.substring(whole, 2, 8))
                .when(k % 5 == 3, F.concat_ws(" ", cust, F.lit("customer"), "o_orderpriority"))
                .otherwise("nothing of this kind"))
        image = F.when(k % 6 == 3, F.concat(F.lit("images/p"), (F.col("o_custkey") % 50).cast("string"), F.lit(".jpg")))
        return self.read("orders").select(
            F.floor(k / BLOCKS_PER_DOC).cast("long").alias("doc_id"),
            F.format_string("%04d", F.floor(idx / BLOCKS_PER_PAGE)).alias("node_id"),
            F.format_string("%08d", k).alias("matrix_id"), text.alias("original_text"),
            F.when(k % 6 == 3, "Figure").alias("image_caption"), F.when(k % 6 == 4, "Table").alias("table_caption"),
            image.alias("img_path"))

    @stored
    def header_nodes(self) -> DataFrame:
        """The header blocks of the layout as a flat tree with page ranges."""
        from clauseloom.operators.toc import headers_to_toc
        from clauseloom.operators.tree import page_ranges
        items = headers_to_toc(self.layout).withColumn("appear_start", F.lit("no"))
        ranged = page_ranges(items, F.lit(BLOCKS_PER_DOC // BLOCKS_PER_PAGE))
        return ranged.select("doc_id", F.col("item_idx").alias("node_idx"), F.lit(None).cast("long").alias("parent_idx"),
                             F.lit(1).alias("level"), "structure", "title", "start_index", "end_index")

    # -- contents pages --------------------------------------------------------------------------

    @stored
    def toc_entries(self) -> DataFrame:
        """Customers of a nation as sections: three to a body page, thirty to a contents page."""
        customers = ordinal(self.read("customer"), ["c_nationkey"], ["c_custkey"], "c", dense_chunk("c_custkey"))
        sizes = self.read("customer").groupBy("c_nationkey").agg(F.ceil(F.count(F.lit(1)) / 30).cast("int").alias("toc_size"))
        place = F.col("c") - 1
        return customers.join(sizes, "c_nationkey").select(
            F.col("c_nationkey").cast("long").alias("doc_id"), place.alias("item_idx"),
            F.concat(F.lit("1."), F.col("c").cast("string")).alias("structure"), F.col("c_name").alias("title"),
            (F.floor(place / 3) + 1).cast("int").alias("page"), (F.floor(place / 30) + 1).cast("int").alias("toc_page"),
            "toc_size", "c_mktsegment")

    @stored
    def toc_doc_pages(self) -> DataFrame:
        """Contents pages with dot leaders followed by the body pages of each nation's document."""
        line = F.concat("structure", F.lit(" "), "title", F.lit(" ........ "), F.col("page").cast("string"))
        listed = self.toc_entries.select("doc_id", F.col("toc_page").alias("page_no"), "item_idx", line.alias("line"))
        body = self.toc_entries.select("doc_id", (F.col("toc_size") + F.col("page")).alias("page_no"), "item_idx",
                                       F.concat("title", F.lit("\nsells "), "c_mktsegment").alias("line"))
        rows = listed.unionByName(body).groupBy("doc_id", "page_no").agg(
            F.array_sort(F.collect_list(F.struct("item_idx", "line"))).alias("l"))
        from clauseloom.functions.text import token_count
        return rows.select("doc_id", "page_no", F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("text")
                           ).withColumn("token_count", token_count("text"))
