"""Layout blocks: page filters, text of a block, assembly of section text, boxes and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.geometry import A4_HEIGHT, A4_WIDTH, to_points
from clauseloom.functions.html import table_text
from clauseloom.operators.scan import dense_chunk, ordered_concat
from clauseloom.schemas import POSITIONS_DDL

# Fixed value: the mark that opens a table in assembled text.
TABLE_MARK = "[Table"
BLOCK_KEYS = ("text", "list", "image", "table")


def blocks_on_page(blocks: DataFrame, page: int) -> DataFrame:
    return blocks.filter(F.col("page_idx") == page)


def blocks_in_range(blocks: DataFrame, first: int | Column, last: int | Column) -> DataFrame:
    """Blocks of an inclusive page range; a missing page counts as -1."""
    return blocks.filter(F.coalesce("page_idx", F.lit(-1)).between(first, last))


def block_text(kind: Column | str = "type") -> Column:
    """Matchable text of a block: its text, list items or captions."""
    k = F.col(kind) if isinstance(kind, str) else kind

    def joined(col: str) -> Column:
        return F.coalesce(F.array_join(col, " "), F.lit(""))

    return (F.when(k == "list", joined("list_items")).when(k == "image", joined("image_caption"))
            .when(k == "table", joined("table_caption")).otherwise(F.coalesce("text", F.lit(""))))


def valid_bbox() -> Column:
    """Four numbers and a page."""
    return F.coalesce((F.size("bbox") == 4) & F.col("page_idx").isNotNull(), F.lit(False))


def position_struct(page: Column, bbox: Column) -> Column:
    return F.struct(page.cast("int").alias("page_idx"), bbox[0].alias("x0"), bbox[1].alias("y0"), bbox[2].alias("x1"),
                    bbox[3].alias("y1"))


def block_position() -> Column:
    """Position of a block; a missing page is 0 and a malformed box is zeros."""
    zeros = F.array(*[F.lit(0.0)] * 4)
    return position_struct(F.coalesce("page_idx", F.lit(0)), F.when(F.size("bbox") == 4, F.col("bbox")).otherwise(zeros))


def type_counts(blocks: DataFrame) -> DataFrame:
    """Blocks per document and type; every other type, headers included, counts as other."""
    kind = F.coalesce("type", F.lit("other"))
    return blocks.groupBy("doc_id").agg(
        *[F.count_if(kind == k).alias(k) for k in BLOCK_KEYS], F.count_if(~kind.isin(*BLOCK_KEYS)).alias("other"))


def last_page(blocks: DataFrame) -> DataFrame:
    """Highest page per document, null when no block has a page."""
    highest = F.max(F.coalesce("page_idx", F.lit(-1)))
    return blocks.groupBy("doc_id").agg(F.when(highest >= 0, highest).alias("last_page"))


# -- text assembly --------------------------------------------------------------------------------

def block_part() -> Column:
    """What a block adds to the assembled text; null when it adds nothing."""
    path = F.coalesce("img_path", F.lit(""))

    def filled(col: str) -> Column:
        return F.coalesce(F.size(col), F.lit(0)) > 0

    text = F.nullif(F.col("text"), F.lit(""))
    image_alt = F.when(filled("image_caption"), F.array_join("image_caption", " ")).otherwise(
        F.substring_index(path, "/", -1))
    image = F.when(path != "", F.concat(F.lit("!["), image_alt, F.lit("]("), path, F.lit(")")))
    mark = F.concat(F.lit(TABLE_MARK), F.when(path != "", F.concat(F.lit(": "), path)).otherwise(""), F.lit("]"))
    caption = F.when(filled("table_caption"), F.concat(F.lit(" "), F.array_join("table_caption", " "))).otherwise("")
    body = F.nullif(table_text(F.col("table_body")), F.lit(""))
    return (F.when(F.col("type") == "text", text)
            .when(F.col("type") == "header", F.concat(F.lit("# "), text))
            .when(F.col("type") == "list", F.when(filled("list_items"), F.array_join("list_items", "\n")))
            .when(F.col("type") == "image", image)
            .when(F.col("type") == "table", F.concat(mark, caption, F.lit("\n"), body)))


def assemble_text(blocks: DataFrame, keys: list[str], name: str = "original_text", rows: int | None = None) -> DataFrame:
    """Text of each group of blocks, parts separated by a blank line; groups without text are absent."""
    return ordered_concat(blocks, keys, ["block_idx"], block_part(), "\n\n", name, dense_chunk("block_idx", rows))


def positions_of(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Positions of the blocks with a valid box, in block order."""
    return (blocks.filter(valid_bbox())
            .groupBy(*keys).agg(F.array_sort(F.collect_list(
                F.struct("block_idx", position_struct(F.col("page_idx"), F.col("bbox")).alias("p")))).alias("_p"))
            .select(*keys, F.transform("_p", lambda p: p["p"]).cast(POSITIONS_DDL).alias("positions")))


def slice_blocks(blocks: DataFrame, spans: DataFrame, span_keys: list[str]) -> DataFrame:
    """Blocks strictly between ``start_idx`` and ``end_idx`` on pages ``first_page``..``last_page`` of each span.

    The page range is spread to pages, so the join is on document and page. A
    span without a range (null pages) joins on the document alone. A range that
    ends before it starts has no page.
    """
    paged = spans.filter("last_page >= greatest(first_page, -1)").withColumn(
        "page_idx", F.explode(F.sequence(F.greatest(F.col("first_page"), F.lit(-1)), "last_page")))
    keyed = blocks.withColumn("page_key", F.coalesce("page_idx", F.lit(-1)))
    inside = (F.col("block_idx") > F.col("start_idx")) & (F.col("block_idx") < F.col("end_idx"))
    columns = [c for c in blocks.columns if c not in span_keys]
    by_page = (keyed.join(paged.withColumnRenamed("page_idx", "page_key"), ["doc_id", "page_key"]).filter(inside)
               .select(*span_keys, *columns))
    free = spans.filter(F.col("first_page").isNull())
    by_doc = blocks.join(free, "doc_id").filter(inside).select(*span_keys, *columns)
    return by_page.unionByName(by_doc)


# -- page sizes and coordinates -------------------------------------------------------------------

def with_page_dims(rows: DataFrame, dims: DataFrame, page: str = "page_idx") -> DataFrame:
    """Add ``width`` and ``height`` of the page, A4 where the page is unknown."""
    sizes = dims.select("doc_id", F.col("page_idx").alias(page), F.col("width").alias("_w"), F.col("height").alias("_h"))
    return (rows.join(sizes, ["doc_id", page], "left")
            .withColumn("width", F.coalesce("_w", F.lit(A4_WIDTH))).withColumn("height", F.coalesce("_h", F.lit(A4_HEIGHT)))
            .drop("_w", "_h"))


def convert_positions(rows: DataFrame, dims: DataFrame, keys: list[str]) -> DataFrame:
    """Positions of each row scaled to points of their pages; rows without positions keep an empty list."""
    spread = rows.select("doc_id", *keys, F.posexplode("positions").alias("_i", "_p"))
    sized = with_page_dims(spread.withColumn("page_idx", F.col("_p.page_idx")), dims)
    points = (sized.withColumn("_q", to_points(F.col("_p"), F.col("width"), F.col("height")))
              .groupBy("doc_id", *keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_q"))).alias("_l"))
              .select("doc_id", *keys, F.transform("_l", lambda s: s["_q"]).cast(POSITIONS_DDL).alias("_points")))
    return (rows.join(points, ["doc_id", *keys], "left")
            .withColumn("positions", F.coalesce("_points", F.array().cast(POSITIONS_DDL))).drop("_points"))


def page_heights(docs: DataFrame, dims: DataFrame, page_index: int = 0) -> DataFrame:
    """Average page height and the height of one page (that of page 0 if missing), A4 without pages."""
    per_doc = dims.groupBy("doc_id").agg(
        F.avg("height").alias("_avg"), F.max(F.when(F.col("page_idx") == page_index, F.col("height"))).alias("_at"),
        F.max(F.when(F.col("page_idx") == 0, F.col("height"))).alias("_first"))
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("_avg", F.lit(A4_HEIGHT)).alias("avg_height"),
        F.coalesce("_at", "_first", F.lit(A4_HEIGHT)).alias("page_height"))


def highlights_by_page(clauses: DataFrame, keys: list[str]) -> DataFrame:
    """Highlight boxes per page, pages counted from 1."""
    spread = clauses.select(*keys, F.posexplode("positions").alias("_i", "_p"))
    return (spread.groupBy(*keys, (F.col("_p.page_idx") + 1).alias("page_num"))
            .agg(F.array_sort(F.collect_list(F.struct("_i", "_p"))).alias("_l"))
            .select(*keys, "page_num", F.transform("_l", lambda s: s["_p"]).alias("boxes")))
