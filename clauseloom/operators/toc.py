"""Tables of contents: detection, items, printed-to-physical pages, checks, repair and page groups."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import text as tx
from clauseloom.functions.similarity import TITLE_THRESHOLD, title_contained
from clauseloom.operators.scan import Run, dense_chunk, ordered_concat, ordinal, scan, with_range_chunk
from clauseloom.operators.slicing import first_holding
from clauseloom.session import materialize

# Line patterns of contents pages, page marks, and the size limits.
LEADER_LINE = r"(?m)(\.{3,}|(\. ){3,}|[ ]{3,}|\t+)\s*\d+\s*$"
ITEM_LINE = r"^\s*(?:(\d+(?:\.\d+)*)\.?\s+)?(\S.*?)\s*(?:: |\.{3,}|(?:\. ){3,}|[ ]{3,}|\t+)\s*(\d+)?\s*$"
PLAIN_ITEM_LINE = r"^\s*(\d+(?:\.\d+)*)\.?\s+(\S.*?)\s*$"
NUMBERED = r"^\s*(\d+(?:\.\d+)*)\.?\s+(\S.*)$"
PAGE_BEGIN, PAGE_END = "========== 第%d页 ==========\n", "\n========== 第%d页结束 =========="
GROUP_TOKENS = 20000
MAX_PAGES, MAX_TOKENS = 10, 8000
ACCEPT, REPAIR = 1.0, 0.6
TITLE_SLACK = 10


# -- items and offsets ----------------------------------------------------------------------------

def valid_toc(toc: DataFrame) -> DataFrame:
    return toc.filter(F.col("physical_index").isNotNull())


def truncate_physical_index(toc: DataFrame, page_counts: DataFrame, start_index: int = 1) -> DataFrame:
    """Null out indexes beyond the last page (pages + start - 1)."""
    limit = page_counts.select("doc_id", (F.col("pages") + start_index - 1).alias("_max"))
    return (toc.join(limit, "doc_id", "left")
            .withColumn("physical_index", F.when(~(F.col("physical_index") > F.col("_max")) | F.col("_max").isNull(),
                                                 F.col("physical_index"))).drop("_max"))


def toc_page_pairs(toc_page: DataFrame, toc_physical: DataFrame, start_page: int = 1) -> DataFrame:
    """Printed pages beside physical indexes of equal titles, at or after ``start_page``."""
    phys = (toc_physical.filter(F.col("physical_index") >= start_page)
            .select("doc_id", "title", F.col("physical_index"), F.col("item_idx").alias("phys_idx")))
    page = toc_page.select("doc_id", "title", "page", F.col("item_idx").alias("page_item_idx"))
    return phys.join(page, ["doc_id", "title"])


def page_offset(toc_page: DataFrame, toc_physical: DataFrame, start_page: int = 1) -> DataFrame:
    """Most frequent physical minus printed page per document, the first seen wins a tie; none gives null.

    Equal titles are counted per value before the join, so a title repeated very
    often meets as its distinct values and counts, not as pairs.
    """
    phys = (toc_physical.filter(F.col("physical_index") >= start_page).groupBy("doc_id", "title", "physical_index")
            .agg(F.count(F.lit(1)).alias("_pn"), F.min("item_idx").alias("_pi")))
    page = (toc_page.withColumn("page", tx.parse_page("page")).filter(F.col("page").isNotNull())
            .groupBy("doc_id", "title", "page").agg(F.count(F.lit(1)).alias("_gn"), F.min("item_idx").alias("_gi")))
    diffs = (phys.join(page, ["doc_id", "title"])
             .groupBy("doc_id", (F.col("physical_index") - F.col("page")).alias("diff"))
             .agg(F.sum(F.col("_pn") * F.col("_gn")).alias("n"), F.min(F.struct("_pi", "_gi")).alias("seen")))
    best = F.max_by("diff", F.struct(F.col("n"), -F.col("seen._pi"), -F.col("seen._gi")))
    docs = toc_page.select("doc_id").distinct()
    return docs.join(diffs.groupBy("doc_id").agg(best.alias("page_offset")), "doc_id", "left")


def apply_offset(toc: DataFrame, offsets: DataFrame) -> DataFrame:
    """Physical index as printed page plus offset; without an offset null, without a printed page unchanged."""
    page = tx.parse_page("page")
    known = F.when(F.col("page_offset").isNull() & F.col("page").isNotNull(), F.lit(None).cast("int")).when(
        page.isNotNull(), page + F.col("page_offset")).otherwise(F.col("physical_index"))
    return toc.join(offsets, "doc_id", "left").withColumn("physical_index", known.cast("int")).drop("page_offset")


def extend_toc(parts: Iterable[DataFrame]) -> DataFrame:
    """Items of successive page groups one after another, with the group's number."""
    return reduce(lambda a, b: a.unionByName(b), [p.withColumn("group_no", F.lit(i)) for i, p in enumerate(parts)])


def bracket_gaps(toc: DataFrame, before: Column, after: Column, trusted: Column | None = None, rows: int | None = None
                 ) -> DataFrame:
    """``prev_index``/``next_index``: nearest known index before and after each item; ``trusted`` masks wrong ones."""
    known = F.when(trusted, F.col("physical_index")) if trusted is not None else F.col("physical_index")
    found = scan(toc, ["doc_id"], ["item_idx"], [Run("_prev", "last", known, inclusive=False),
                                                Run("_next", "first", known, inclusive=False)],
                 dense_chunk("item_idx", rows))
    return (found.withColumn("prev_index", F.coalesce("_prev", before)).withColumn("next_index", F.coalesce("_next", after))
            .drop("_prev", "_next"))


# -- pages ----------------------------------------------------------------------------------------

def node_pages(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes beside each page they span: the range is spread up to the document's last page, then an equi join."""
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("_last"))
    spread = (nodes.join(last, "doc_id").withColumn("_end", F.least("end_index", "_last"))
              .filter(F.col("_end") >= F.col("start_index"))
              .withColumn("page_no", F.explode(F.sequence("start_index", "_end"))).drop("_end", "_last"))
    return spread.join(pages, ["doc_id", "page_no"])


def span_tokens(nodes: DataFrame, pages: DataFrame, rows: int | None = None) -> DataFrame:
    """Tokens on the pages of each node: the running sum at its end minus that before its start, no page list."""
    starts = nodes.select("doc_id", F.col("start_index").alias("at"), F.lit(-1).alias("side"))
    ends = nodes.select("doc_id", F.col("end_index").alias("at"), F.lit(1).alias("side"))
    marks = starts.unionByName(ends).distinct().withColumn("token_count", F.lit(0).cast("long"))
    line = marks.unionByName(pages.select("doc_id", F.col("page_no").alias("at"), F.lit(0).alias("side"),
                                          F.col("token_count").cast("long")))
    summed = scan(line, ["doc_id"], ["at", "side"], [Run("upto", "sum", F.col("token_count"))], dense_chunk("at", rows))
    before = summed.filter(F.col("side") == -1).select("doc_id", F.col("at").alias("start_index"), F.col("upto").alias("_a"))
    after = summed.filter(F.col("side") == 1).select("doc_id", F.col("at").alias("end_index"), F.col("upto").alias("_b"))
    return (nodes.join(before, ["doc_id", "start_index"]).join(after, ["doc_id", "end_index"])
            .withColumn("tokens", F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).drop("_a", "_b"))


def large_nodes(nodes: DataFrame, pages: DataFrame, max_pages: int = MAX_PAGES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Nodes over more than ``max_pages`` pages with at least ``max_tokens`` tokens."""
    wide = nodes.filter(F.col("end_index") - F.col("start_index") > max_pages)
    return span_tokens(wide, pages).filter(F.col("tokens") >= max_tokens)


def node_page_text(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Concatenated page texts of each node."""
    spans = node_pages(nodes.select("doc_id", "node_idx", "start_index", "end_index"), pages)
    return ordered_concat(spans, ["doc_id", "node_idx"], ["page_no"], F.col("text"), "", "text", dense_chunk("page_no"))


def labelled_page(page_no: Column, text: Column) -> Column:
    """Page text between two page tags."""
    tag = F.concat(F.lit("<physical_index_"), page_no.cast("string"), F.lit(">\n"))
    return F.concat(tag, text, F.lit("\n"), tag)


def marked_range_text(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Text of a page range with page marks; the range is clamped to the document."""
    inside = pages.filter(F.col("page_no").between(max(1, first), last))
    marked = F.concat(F.format_string(PAGE_BEGIN, "page_no"), F.col("text"), F.format_string(PAGE_END, "page_no"))
    return ordered_concat(inside, ["doc_id"], ["page_no"], marked, "\n\n", "text", dense_chunk("page_no"))


def _next_starts(pages: DataFrame, overlap: int) -> DataFrame:
    """(doc_id, n, next): the page at which the next group begins, were page ``n`` the first new page of a group.

    A group that begins at n holds the overlap before it and ends before the first later page that takes it above the target. With
    running token sums that page is the number of pages whose sum is within a limit, plus one: pages and limits are put on one line
    and the pages before each limit are counted.
    """
    seeds = pages.select("doc_id", (F.col("n") + overlap).alias("n"), (F.col("upto") - F.col("token_count")).alias("_base"))
    limit = F.coalesce("_base", F.lit(0)) + F.col("target")
    limits = pages.join(seeds, ["doc_id", "n"], "left").select(
        "doc_id", limit.alias("at"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("one"), "n", "n_pages")
    marks = pages.select("doc_id", F.col("upto").alias("at"), F.lit(0).alias("side"), F.lit(1).cast("long").alias("one"), "n", "n_pages")
    line = with_range_chunk(marks.unionByName(limits), ["doc_id"], ["at", "side", "n"], "_chunk", "group-line")
    counted = scan(line, ["doc_id"], ["at", "side", "n"], [Run("_within", "sum", F.col("one"))], "_chunk")
    return (counted.filter("side = 1").withColumn("next", F.greatest("n", "_within") + 1)
            .filter(F.col("next") <= F.col("n_pages")).select("doc_id", "n", "next"))


def _reached(jumps: DataFrame, first: DataFrame, purpose: str) -> DataFrame:
    """(doc_id, n, group_no): the pages reached from ``first`` (doc_id, n) along ``jumps`` (doc_id, n, next), and in how many steps.

    Each round joins the pages reached with jumps of the length gone so far, then the jumps with themselves, which doubles them.
    """
    reached = materialize(first.select("doc_id", "n", F.lit(0).cast("long").alias("group_no")), purpose)
    jumps = materialize(jumps, purpose)
    length = 1
    while True:
        ahead = materialize(reached.join(jumps, ["doc_id", "n"]).select(
            "doc_id", F.col("next").alias("n"), (F.col("group_no") + length).alias("group_no")), purpose)
        if ahead.isEmpty():
            return reached
        reached = reached.unionByName(ahead)
        onward = jumps.select("doc_id", F.col("n").alias("next"), F.col("next").alias("_then"))
        jumps = materialize(jumps.join(onward, ["doc_id", "next"]).select("doc_id", "n", F.col("_then").alias("next")), purpose)
        length *= 2


def group_pages(pages: DataFrame, max_tokens: int = GROUP_TOKENS, overlap: int = 1) -> DataFrame:
    """Page groups within a token budget, each seeded with the last page(s) of the one before.

    Documents within the budget are one group. For the others, the page that would begin the next group is found for every page at
    once, and the pages that do begin one by doubling these pointers from the first page. No document passes through one task. A
    missing token count is zero. Runs Spark jobs when called.
    """
    rows = pages.select("doc_id", F.col("page_no").cast("long"), F.coalesce("token_count", F.lit(0)).cast("long").alias("token_count"))
    totals = rows.groupBy("doc_id").agg(F.sum("token_count").alias("_total"), F.count(F.lit(1)).alias("n_pages"))
    sized = rows.join(totals, "doc_id")
    small = sized.filter(F.col("_total") <= max_tokens).select("doc_id", F.lit(0).cast("long").alias("group_no"), "page_no")
    parts = F.ceil(F.col("_total") / max_tokens)
    target = F.ceil((F.col("_total") / parts + max_tokens) / 2).cast("long")
    big = sized.filter(F.col("_total") > max_tokens).withColumn("target", target).drop("_total")
    big = with_range_chunk(big, ["doc_id"], ["page_no"], "_chunk", "group-pages")
    summed = materialize(scan(big, ["doc_id"], ["page_no"], [
        Run("upto", "sum", F.col("token_count")), Run("n", "sum", F.lit(1).cast("long"))], "_chunk"), "group-sums")
    starts = _reached(_next_starts(summed, overlap), summed.filter("n = 1"), "group-starts")
    own = scan(summed.join(starts, ["doc_id", "n"], "left"), ["doc_id"], ["page_no"],
               [Run("_group", "last", F.col("group_no"))], "_chunk").select("doc_id", F.col("_group").alias("group_no"), "page_no")
    grouped = small.unionByName(own)
    if overlap:
        again = starts.filter("group_no > 0").select(
            "doc_id", "group_no", F.explode(F.sequence(F.greatest(F.col("n") - overlap, F.lit(1)), F.col("n") - 1)).alias("n"))
        grouped = grouped.unionByName(again.join(summed.select("doc_id", "n", "page_no"), ["doc_id", "n"]).select("doc_id", "group_no", "page_no"))
    return grouped


# -- detection ------------------------------------------------------------------------------------

def is_toc_page(text: Column | str, k: int = 3) -> Column:
    """At least ``k`` lines end in a leader or wide gap and a number."""
    return F.regexp_count(text, F.lit(LEADER_LINE)) >= k


def toc_pages(flags: DataFrame, n: int = 20, after: DataFrame | None = None) -> DataFrame:
    """First run of consecutive contents pages that starts within the first ``n`` pages; it may run past them.

    ``flags`` are (doc_id, page_no from 1, is_toc) and, where a page needs less
    to continue a run than to start one, ``continues``; ``after`` (doc_id, page_no)
    restarts the search behind a page. Two aggregates instead of a window: the
    first hit, then the first miss behind it.
    """
    rows = flags if "continues" in flags.columns else flags.withColumn("continues", F.col("is_toc"))
    rows = rows.withColumn("continues", F.col("continues") | F.col("is_toc"))
    if after is not None:
        rows = rows.join(after.select("doc_id", F.col("page_no").alias("_after")), "doc_id").filter(
            F.col("page_no") > F.col("_after")).drop("_after")
    first = rows.filter("is_toc").groupBy("doc_id").agg(F.min("page_no").alias("_first")).filter(F.col("_first") <= n)
    miss = (rows.filter(~F.col("continues")).join(first, "doc_id").filter(F.col("page_no") > F.col("_first"))
            .groupBy("doc_id").agg(F.min("page_no").alias("_miss")))
    span = first.join(miss, "doc_id", "left")
    return (rows.filter("continues").join(span, "doc_id")
            .filter((F.col("page_no") >= F.col("_first")) & (F.col("_miss").isNull() | (F.col("page_no") < F.col("_miss"))))
            .select("doc_id", "page_no"))


def toc_items(pages: DataFrame, rows: int | None = None) -> DataFrame:
    """Items (structure, title, printed page) of the lines of contents pages, numbered per document."""
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "_raw"))
    line = tx.normalize_leaders("_raw")
    parsed = lines.select(
        "doc_id", "page_no", "line_no", line.alias("_line")).filter(
        F.col("_line").rlike(ITEM_LINE) | F.col("_line").rlike(PLAIN_ITEM_LINE))
    led = F.col("_line").rlike(ITEM_LINE)

    def part(g_led: int, g_plain: int | None) -> Column:
        plain = F.regexp_extract("_line", PLAIN_ITEM_LINE, g_plain) if g_plain else F.lit("")
        return F.nullif(F.when(led, F.regexp_extract("_line", ITEM_LINE, g_led)).otherwise(plain), F.lit(""))

    items = parsed.select("doc_id", "page_no", "line_no", part(1, 1).alias("structure"), tx.strip(part(2, 2)).alias("title"),
                          part(3, None).try_cast("int").alias("page"))
    numbered = ordinal(items, ["doc_id"], ["page_no", "line_no"], "_n", dense_chunk("page_no", rows))
    return numbered.select("doc_id", (F.col("_n") - 1).alias("item_idx"), "structure", "title", "page")


def has_page_numbers(items: DataFrame) -> DataFrame:
    """Whether most items of a document carry a printed page."""
    return items.groupBy("doc_id").agg((F.count("page") * 2 > F.count(F.lit(1))).alias("has_pages"))


def headers_to_toc(blocks: DataFrame, rows: int | None = None) -> DataFrame:
    """Header blocks and numbered lines as items; the code comes from the numbering, the index from the page."""
    text = tx.strip(F.coalesce("text", F.lit("")))
    heads = (blocks.withColumn("_t", text).filter((F.col("_t") != "") & F.col("page_idx").isNotNull())
             .filter((F.col("type") == "header") | ((F.col("type") == "text") & F.col("_t").rlike(NUMBERED))))
    numbered = F.col("_t").rlike(NUMBERED)
    items = heads.select("doc_id", "block_idx", F.nullif(F.regexp_extract("_t", NUMBERED, 1), F.lit("")).alias("structure"),
                         F.when(numbered, F.regexp_extract("_t", NUMBERED, 2)).otherwise(F.col("_t")).alias("title"),
                         (F.col("page_idx") + 1).cast("int").alias("physical_index"))
    out = ordinal(items, ["doc_id"], ["block_idx"], "_n", dense_chunk("block_idx", rows))
    return out.withColumn("item_idx", F.col("_n") - 1).drop("_n")


# -- titles on pages ------------------------------------------------------------------------------

def normalized_pages(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_no", tx.normalize_title("text").alias("_page"))


def title_on_page(items: DataFrame, pages: DataFrame, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """``appears``: the title stands on the page of its physical index; no index means no."""
    p = normalized_pages(pages).withColumnRenamed("page_no", "physical_index")
    joined = items.join(p, ["doc_id", "physical_index"], "left").withColumn("_title", tx.normalize_title("title"))
    hit = title_contained(F.col("_title"), F.coalesce("_page", F.lit("")), threshold)
    return joined.withColumn("appears", F.coalesce(hit, F.lit(False))).drop("_page", "_title")


def title_starts_page(items: DataFrame, pages: DataFrame, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """``appear_start``: yes when the title stands at the head of its page."""
    p = normalized_pages(pages).withColumnRenamed("page_no", "physical_index")
    joined = items.drop("appear_start").join(p, ["doc_id", "physical_index"], "left").withColumn(
        "_title", tx.normalize_title("title"))
    head = F.substring(F.coalesce("_page", F.lit("")), F.lit(1), F.length("_title") + TITLE_SLACK)
    hit = F.coalesce(title_contained(F.col("_title"), head, threshold), F.lit(False))
    return joined.withColumn("appear_start", F.when(hit, "yes").otherwise("no")).drop("_page", "_title")


def _first_page_with(items: DataFrame, pages: DataFrame, first: Column, last: Column, keys: list[str],
                     threshold: float) -> DataFrame:
    """First page in each item's own range that holds its title: (keys, found)."""
    spread = (items.withColumn("_a", first.cast("int")).withColumn("_b", last.cast("int")).filter(F.col("_b") >= F.col("_a"))
              .select(*keys, tx.normalize_title("title").alias("_title"),
                      F.explode(F.sequence("_a", "_b")).alias("page_no")))
    hits = spread.join(normalized_pages(pages), ["doc_id", "page_no"]).filter(
        title_contained(F.col("_title"), F.col("_page"), threshold))
    return hits.groupBy(*keys).agg(F.min("page_no").alias("found"))


def toc_physical_index(items: DataFrame, pages: DataFrame, toc_last: DataFrame, n: int | None = 20,
                       threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """Physical index of each title: its first page among the ``n`` pages behind the contents pages, among all behind them for None.

    Titles meet the pages that may hold them, not every page of the range. Runs Spark jobs when called.
    """
    last = toc_last.select("doc_id", "toc_last")
    behind = pages.join(last, "doc_id").filter(F.col("page_no") > F.col("toc_last"))
    if n is not None:
        behind = behind.filter(F.col("page_no") <= F.col("toc_last") + n)
    body = normalized_pages(behind).select("doc_id", F.col("page_no").cast("int").alias("block_idx"), F.col("_page").alias("norm"))
    placed = items.drop("physical_index").join(last, "doc_id", "left_semi")
    found = first_holding(placed.select("doc_id", "item_idx", "title"), body, ["doc_id", "item_idx"], threshold)
    return placed.join(found.withColumnRenamed("found", "physical_index"), ["doc_id", "item_idx"], "left")


def toc_accuracy(checked: DataFrame, page_counts: DataFrame, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Share of items found on their page; 0 when the last known index lies in the first half or nothing was checked."""
    known = checked.filter(F.col("physical_index").isNotNull())
    last = known.groupBy("doc_id").agg(F.max_by("physical_index", "item_idx").alias("_last"))
    rows = known
    if sample is not None:
        pick = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.lit(seed), F.col("item_idx")), "item_idx")
        rows = known.withColumn("_r", F.row_number().over(pick)).filter(F.col("_r") <= sample)
    rate = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("checked"), F.count_if("appears").alias("correct"))
    got = page_counts.select("doc_id", "pages").join(last, "doc_id", "left").join(rate, "doc_id", "left")
    usable = (F.col("_last") >= F.col("pages") / 2) & (F.coalesce("checked", F.lit(0)) > 0)
    return got.select("doc_id", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("correct", F.lit(0)).alias("correct"),
                      F.when(usable, F.col("correct") / F.col("checked")).otherwise(0.0).alias("accuracy"))


def repair_toc(checked: DataFrame, pages: DataFrame, page_counts: DataFrame, start_index: int = 1,
               threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """Move wrong items to the first page between their correct neighbours that holds the title.

    The test is the same in every attempt and the neighbours only move closer,
    so further attempts cannot find more: one round is the whole repair.
    """
    wrong = F.col("physical_index").isNotNull() & ~F.col("appears")
    counted = checked.join(page_counts.select("doc_id", "pages"), "doc_id")
    around = bracket_gaps(counted, F.lit(start_index - 1), F.col("pages") + start_index - 1, ~wrong)
    first = F.greatest(F.col("prev_index"), F.lit(start_index))
    last = F.least(F.col("next_index"), F.col("pages") + start_index - 1)
    found = _first_page_with(around.filter(wrong), pages, first, last, ["doc_id", "item_idx"], threshold)
    fixed = checked.join(found, ["doc_id", "item_idx"], "left")
    return (fixed.withColumn("repaired", F.col("found").isNotNull())
            .withColumn("physical_index", F.coalesce("found", "physical_index"))
            .withColumn("appears", F.col("appears") | F.col("repaired")).drop("found"))


def resolve_toc(pages: DataFrame, blocks: DataFrame, check_pages: int = 20, min_lines: int = 3,
                threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """Items with physical indexes by the first strategy that holds for a document.

    Printed pages plus offset, then titles searched in the body, then headers of
    the body; a strategy is accepted when all its items check, repaired above
    60 %, otherwise the next one is tried. Contents without page numbers go to
    the headers directly. Documents that fail keep one row without a title.
    """
    counts = materialize(pages.groupBy("doc_id").agg(F.max("page_no").alias("pages")), "toc-counts")
    # The last page of a long list is often short: one line is enough to continue a run.
    flags = pages.select("doc_id", "page_no", is_toc_page("text", min_lines).alias("is_toc"), is_toc_page("text", 1).alias("continues"))
    found = materialize(toc_pages(flags, check_pages), "toc-pages")
    toc_last = found.groupBy("doc_id").agg(F.max("page_no").alias("toc_last"))
    items = materialize(toc_items(pages.join(found, ["doc_id", "page_no"], "left_semi")), "toc-items")
    numbered = has_page_numbers(items).filter("has_pages").select("doc_id")
    items = items.join(numbered, "doc_id", "left_semi")

    # The first page anywhere behind the contents is the first of the nearest ones too, if it is one of them.
    anywhere = materialize(toc_physical_index(items, pages, toc_last, None, threshold), "toc-anywhere")
    close = F.when(F.col("physical_index") <= F.col("toc_last") + check_pages, F.col("physical_index"))
    near = materialize(anywhere.join(toc_last, "doc_id").withColumn("physical_index", close).drop("toc_last"), "toc-near")

    def by_offset() -> DataFrame:
        return apply_offset(near, page_offset(items, near, 1))

    def by_title() -> DataFrame:
        return anywhere

    cols = ["doc_id", "item_idx", "structure", "title", "physical_index"]
    done, open_docs = None, counts.select("doc_id")
    for name, candidate in (("page_numbers", by_offset), ("titles", by_title), ("headers", lambda: headers_to_toc(blocks))):
        rows = valid_toc(candidate().select(*cols).join(open_docs, "doc_id", "left_semi"))
        rows = materialize(valid_toc(truncate_physical_index(rows, counts)), f"toc-{name}")
        checked = materialize(title_on_page(rows, pages, threshold), f"toc-{name}-checked")
        rate = materialize(toc_accuracy(checked, counts).select("doc_id", "accuracy"), f"toc-{name}-rate")
        graded = checked.join(rate, "doc_id")
        ok = graded.filter(F.col("accuracy") >= ACCEPT).withColumn("repaired", F.lit(False))
        fix = repair_toc(graded.filter((F.col("accuracy") > REPAIR) & (F.col("accuracy") < ACCEPT)), pages, counts,
                         threshold=threshold)
        got = materialize(ok.unionByName(fix).withColumn("strategy", F.lit(name)), f"toc-{name}-done")
        done = got if done is None else done.unionByName(got)
        solved = rate.filter(F.col("accuracy") > REPAIR)
        open_docs = materialize(open_docs.join(solved, "doc_id", "left_anti"), f"toc-{name}-open")
    failed = open_docs.withColumn("strategy", F.lit("failed"))
    return done.unionByName(failed, allowMissingColumns=True)


def _children(nodes: DataFrame, pages: DataFrame, items: DataFrame, max_pages: int, max_tokens: int, rows: int | None) -> DataFrame:
    """Children of those of ``nodes`` (doc_id, path, title, start_index, end_index) that are large, from the items on their pages."""
    large = large_nodes(nodes, pages, max_pages, max_tokens).select(
        "doc_id", F.col("path").alias("_in"), F.col("title").alias("_own"), F.col("start_index").alias("_from"), F.col("end_index").alias("_to"))
    spread = large.withColumn("physical_index", F.explode(F.sequence("_from", "_to")))
    if "level" in items.columns:
        spread = spread.withColumn("level", F.size("_in"))
    hits = spread.join(items, [c for c in ("doc_id", "physical_index", "level") if c in spread.columns])
    ranked = ordinal(hits, ["doc_id", "_in"], ["item_idx"], "_n", dense_chunk("item_idx", rows))
    same = (F.col("_n") == 1) & (tx.strip("title") == tx.strip("_own"))
    kept = materialize(ranked.filter(~F.coalesce(same, F.lit(False))), "split-items")
    ahead = scan(kept, ["doc_id", "_in"], ["item_idx"], [
        Run("_next", "lead", F.struct(F.col("physical_index").alias("p"), (F.col("appear_start") == "yes").alias("starts"))),
        Run("child_no", "sum", F.lit(1).cast("long"))], dense_chunk("item_idx", rows))
    ends = kept.groupBy("doc_id", "_in").agg(F.min_by("physical_index", "item_idx").alias("node_end"))
    end = F.coalesce(F.when(F.col("_next.starts"), F.col("_next.p") - 1).otherwise(F.col("_next.p")), F.col("_to"))
    return ahead.join(ends, ["doc_id", "_in"]).select(
        "doc_id", "_in", F.concat("_in", F.array("child_no")).alias("path"), "child_no", "title", "structure",
        F.col("physical_index").alias("start_index"), end.alias("end_index"), "node_end", (F.col("_to") - F.col("_from")).alias("_span"))


def split_large_nodes(nodes: DataFrame, pages: DataFrame, items: DataFrame, max_pages: int = MAX_PAGES, max_tokens: int = MAX_TOKENS,
                      rows: int | None = None) -> DataFrame:
    """Children of the large nodes from the items on their pages, again and again until no node made is large or gains children.

    Returns (doc_id, node_idx, path, child_no, title, structure, start_index, end_index, node_end). ``path`` has the node's index and
    the child numbers below it. A first child with the title of its node is dropped. A child ends where the next one starts, or one
    page before if that one's title starts its page, the last one with its node. A node that gets children ends where the first one
    starts: for the nodes given that is ``node_end``, for children it is their ``end_index``. Where ``items`` have a ``level``, a node
    takes items of the level below its own only, and the nodes given are of level 0. A child over all pages of its node is not split again, so ranges
    shrink and the rounds end. A round joins the children of the round before, and nothing else.
    """
    found = items.select("doc_id", "item_idx", "title", "structure", "physical_index", *(["level"] if "level" in items.columns else []))
    found = materialize(title_starts_page(valid_toc(found), pages), "split-titles")
    frontier = nodes.select("doc_id", F.array(F.col("node_idx").cast("long")).alias("path"), "title", "start_index", "end_index")
    rounds = []
    while True:
        made = materialize(_children(frontier, pages, found, max_pages, max_tokens, rows), "split-round")
        rounds.append(made)
        if made.isEmpty():
            break
        frontier = made.filter(F.col("end_index") - F.col("start_index") < F.col("_span")).select(
            "doc_id", "path", "title", "start_index", "end_index")
    every = reduce(lambda a, b: a.unionByName(b), rounds)
    cut = every.groupBy("doc_id", F.col("_in").alias("path")).agg(F.first("node_end").alias("_end"))
    return every.join(cut, ["doc_id", "path"], "left").select(
        "doc_id", F.element_at("path", 1).alias("node_idx"), "path", "child_no", "title", "structure", "start_index",
        F.coalesce("_end", "end_index").alias("end_index"), "node_end")
