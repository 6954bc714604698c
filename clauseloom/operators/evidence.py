"""Locating clauses in the blocks of their node: exact, similar, substring, keywords; visual clauses by image."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import similarity as sim
from clauseloom.functions import text as tx
from clauseloom.operators import blocks as bl
from clauseloom.operators.anchors import ANCHOR_SIZES, anchor_places, needle_anchors
from clauseloom.operators.clauses import is_visual
from clauseloom.operators.scan import Run, dense_chunk, ordered_concat, scan
from clauseloom.operators.similar import close_pairs
from clauseloom.schemas import POSITIONS_DDL
from clauseloom.session import materialize

# Fixed value: how far two boxes may differ per coordinate and still be the same.
BOX_TOLERANCE = 0.1
PIECE_CHARS = 1 << 20
SPAN_BUCKET = 4096
#: Clauses times characters of a node that are cheaper to search than to look up.
SMALL_NODE = 1 << 20

NODE = ["doc_id", "node_id"]
CLAUSE = ["doc_id", "node_id", "matrix_id"]


def node_blocks(nodes: DataFrame, blocks: DataFrame, tolerance: float = BOX_TOLERANCE) -> DataFrame:
    """Blocks of each node: per position the first block on its page with nearly the same box.

    The left edge is bucketed, a position looks into the one or two buckets its
    tolerance touches; repeated positions repeat their block.
    """
    pos = nodes.select(*NODE, F.posexplode("positions").alias("ord", "p"))
    edge = [F.floor(F.col("p.x0") + d) for d in (-tolerance - 1e-6, tolerance + 1e-6)]
    keyed = pos.select(*NODE, "ord", "p", F.col("p.page_idx").alias("page_idx"),
                       F.explode(F.array_distinct(F.array(*edge))).alias("_edge"))
    boxed = blocks.filter(F.size("bbox") == 4).withColumn("_edge", F.floor(F.col("bbox")[0]))
    near = None
    for i, name in enumerate(("x0", "y0", "x1", "y1")):
        one = F.abs(F.col("bbox")[i] - F.col(f"p.{name}")) <= tolerance
        near = one if near is None else near & one
    hits = keyed.join(boxed, ["doc_id", "page_idx", "_edge"]).filter(near)
    cols = [c for c in blocks.columns if c != "doc_id"]
    first = hits.groupBy(*NODE, "ord").agg(F.min_by(F.struct(*cols), "block_idx").alias("b"))
    return first.select(*NODE, "ord", "b.*")


def _words(text: Column, tokenizer: Callable[[Column], Column], stop_words: Sequence[str]) -> Column:
    words = tokenizer(text)
    return F.array_except(words, F.array(*map(F.lit, stop_words))) if stop_words else words


def prepare_blocks(of_nodes: DataFrame, tokenizer: Callable[[Column], Column] = tx.keywords, stop_words: Sequence[str] = ()) -> DataFrame:
    """Node blocks with their position and normalised text; only text and list blocks take part.

    ``tokenizer`` maps a text column to an array of distinct words, such as a Pandas UDF of one's own; ``stop_words`` don't count.
    """
    items = F.coalesce("list_items", F.array().cast("array<string>"))
    return of_nodes.filter(F.col("type").isin("text", "list")).select(
        *NODE, "ord", "type", bl.block_position().alias("position"),
        F.when(F.col("type") == "text", tx.normalize_evidence("text")).otherwise(
            F.array_join(F.transform(items, tx.normalize_evidence), "")).alias("norm"),
        F.when(F.col("type") == "list", F.transform(items, tx.normalize_evidence)).alias("norm_items"),
        _words(F.when(F.col("type") == "text", F.col("text")).otherwise(F.array_join(items, "")), tokenizer, stop_words).alias("words"))


def _placed(hits: DataFrame, blocks: DataFrame, strategy: str) -> DataFrame:
    """One position per clause from its chosen block ordinal."""
    at = blocks.select(*NODE, "ord", "position")
    return hits.join(at, [*NODE, "ord"]).select(*CLAUSE, F.lit(strategy).alias("strategy"),
                                                F.array("position").cast(POSITIONS_DDL).alias("positions"))


def match_exact(clauses: DataFrame, blocks: DataFrame) -> DataFrame:
    """First text block or list item equal after normalisation: a hash join on the text."""
    whole = blocks.filter(F.col("type") == "text").select(*NODE, "ord", "norm")
    items = blocks.filter(F.col("type") == "list").select(*NODE, "ord", F.explode("norm_items").alias("norm"))
    first = whole.unionByName(items).groupBy(*NODE, "norm").agg(F.min("ord").alias("ord"))
    return _placed(clauses.join(first, [*NODE, "norm"]).select(*CLAUSE, "ord"), blocks, "exact")


def match_similarity(clauses: DataFrame, blocks: DataFrame, threshold: float = sim.EVIDENCE_THRESHOLD) -> DataFrame:
    """Most similar text block at or above the threshold, the first one on a tie.

    Equal texts are compared once, texts meet only by rare runs in common (no
    other pair can reach the threshold), and the scores are combined before the
    shuffle.
    """
    wanted = clauses.select(*NODE, "norm").distinct().withColumnRenamed("norm", "needle").withColumn("_c", F.col("needle"))
    texts = (blocks.filter((F.col("type") == "text") & (F.length("norm") > 0))
             .groupBy(*NODE, "norm").agg(F.min("ord").alias("ord")).withColumn("hay", F.col("norm")))
    pairs = close_pairs(wanted, texts, NODE, threshold).filter(sim.length_bound(F.col("_c"), F.col("norm")) >= threshold)
    scored = pairs.withColumn("_s", sim.ratio(F.col("_c"), F.col("norm"), 1.0)).filter(F.col("_s") >= threshold)
    best = scored.groupBy(*NODE, "_c").agg(F.max_by("ord", F.struct(F.col("_s"), -F.col("ord"))).alias("ord"))
    hits = clauses.join(best.withColumnRenamed("_c", "norm"), [*NODE, "norm"]).select(*CLAUSE, "ord")
    return _placed(hits, blocks, "similarity")


def _starts(sought: DataFrame, placed: DataFrame, piece: int, rows: int | None) -> DataFrame:
    """(node, _needle, _from): where in the joined text of a node each text may begin, by its anchor."""
    anchors = materialize(needle_anchors(sought, NODE), "substring-anchors")
    over = max(ANCHOR_SIZES) - 1
    spread = placed.filter("_end > _off").withColumn("_k", F.explode(F.sequence(
        F.greatest(F.floor((F.col("_off") - over) / piece), F.lit(0)), F.floor((F.col("_end") - 1) / piece))))
    begin = F.greatest(F.col("_k") * piece - F.col("_off"), F.lit(0))
    stop = F.least((F.col("_k") + 1) * piece + over, F.col("_end")) - F.col("_off")
    part = spread.withColumn("_part", F.substring(F.col("norm"), (begin + 1).cast("int"), (stop - begin).cast("int"))).filter(F.col("_part") != "")
    texts = ordered_concat(part, [*NODE, "_k"], ["ord"], F.col("_part"), "", "hay", dense_chunk("ord", rows))
    places = anchor_places(texts, anchors, [*NODE, "_k"]).filter(F.col("_place") < piece)
    begins = (F.col("_k") * piece + F.col("_place") - F.col("_at")).cast("long").alias("_from")
    return places.join(anchors, [*NODE, "_size", "_anchor"]).select(*NODE, "_needle", begins).filter(F.col("_from") >= 0)


def match_substring(clauses: DataFrame, blocks: DataFrame, piece: int = PIECE_CHARS, rows: int | None = None, small: int = SMALL_NODE) -> DataFrame:
    """Blocks that the first occurrence of the clause in the node's joined text touches.

    Small nodes are searched clause by clause. The joined text of others is never
    built whole: it is hashed in pieces that overlap by an anchor. Anchors of the
    clauses meet their places by hash, which gives the clauses' possible
    beginnings; each is compared block by block, and the first that agrees in
    full counts.
    """
    wanted = clauses.filter(F.length("norm") > 0).select(*CLAUSE, "norm", F.md5("norm").alias("_needle"))
    sought = materialize(wanted.select(*NODE, "_needle", F.col("norm").alias("needle")).dropDuplicates([*NODE, "_needle"]), "substring-sought")
    placed = scan(blocks.select(*NODE, "ord", "norm", "position"), NODE, ["ord"],
                  [Run("_off", "sum", F.length("norm").cast("long"), inclusive=False)], dense_chunk("ord", rows))
    placed = materialize(placed.withColumn("_end", F.col("_off") + F.length("norm")), "substring-offsets")
    effort = placed.groupBy(*NODE).agg(F.max("_end").alias("_chars")).join(sought.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_n")), NODE)
    large = materialize(effort.filter(F.col("_chars") * F.col("_n") > small).select(*NODE), "substring-nodes")
    none = large.isEmpty()
    joined = ordered_concat(placed if none else placed.join(large, NODE, "left_anti"), NODE, ["ord"], F.col("norm"), "", "_text", dense_chunk("ord", rows))
    starts = sought.join(joined, NODE).select(*NODE, "_needle", (F.instr(F.col("_text"), F.col("needle")) - 1).cast("long").alias("_from")).filter("_from >= 0")
    if not none:
        starts = starts.unionByName(_starts(sought.join(large, NODE, "left_semi"), placed.join(large, NODE, "left_semi"), piece, rows))

    def bucket(at: Column) -> Column:
        return F.floor(at / SPAN_BUCKET)

    spans = starts.join(sought, [*NODE, "_needle"]).withColumn("_to", F.col("_from") + F.length("needle")).withColumn(
        "_bucket", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_to") - 1))))
    buckets = placed.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_off")), bucket(F.greatest(F.col("_off"), F.col("_end") - 1)))))
    first, last = F.greatest("_from", "_off"), F.least("_to", "_end")
    size = (last - first).cast("int")
    same = F.substring(F.col("norm"), (first - F.col("_off") + 1).cast("int"), size) == F.substring(F.col("needle"), (first - F.col("_from") + 1).cast("int"), size)
    # Span and block share several buckets if both are long; the first one speaks for them.
    touched = (spans.join(buckets, [*NODE, "_bucket"]).filter((F.col("_end") > F.col("_from")) & (F.col("_off") < F.col("_to")))
               .filter(F.col("_bucket") == F.greatest(bucket(F.col("_from")), bucket(F.col("_off"))))
               .groupBy(*NODE, "_needle", "_from", "_to").agg(F.sum(F.when(same, size).otherwise(0)).alias("_same"),
                                                              F.array_sort(F.collect_list(F.struct("ord", "position"))).alias("_p")))
    found = touched.filter(F.col("_same") == F.col("_to") - F.col("_from")).groupBy(*NODE, "_needle").agg(F.min_by("_p", "_from").alias("_p"))
    return wanted.join(found, [*NODE, "_needle"]).select(*CLAUSE, F.lit("substring").alias("strategy"),
                                                         F.transform("_p", lambda p: p["position"]).cast(POSITIONS_DDL).alias("positions"))


def match_keywords(clauses: DataFrame, blocks: DataFrame, threshold: float = sim.KEYWORD_THRESHOLD) -> DataFrame:
    """Block with the largest share of the clause's keywords, at or above the threshold, the first one on a tie.

    A block that reaches the threshold must hold one of any ``n - need + 1``
    keywords; each clause is looked up by its rarest ones only, and the share is
    computed for these candidates.
    """
    with_words = clauses.filter(F.size("words") > 0).select(*CLAUSE, "words")
    usage = blocks.select(*NODE, F.explode("words").alias("_w")).groupBy(*NODE, "_w").agg(F.count(F.lit(1)).alias("_n"))
    ranked = (with_words.select(*CLAUSE, F.size("words").alias("_size"), F.explode("words").alias("_w"))
              .join(usage, [*NODE, "_w"], "left")
              .groupBy(*CLAUSE, "_size").agg(F.array_sort(F.collect_list(
                  F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_w").alias("w")))).alias("_l")))
    # The small slack keeps a share equal to the threshold on the safe side of rounding.
    need = F.ceil(F.col("_size") * F.lit(threshold) - F.lit(1e-9))
    probes = ranked.select(*CLAUSE, F.explode(F.slice("_l", F.lit(1), (F.col("_size") - need + 1).cast("int"))).alias("_p")
                           ).filter(F.col("_p.n") > 0).select(*CLAUSE, F.col("_p.w").alias("_w"))
    candidates = probes.join(blocks.select(*NODE, "ord", F.explode("words").alias("_w")), [*NODE, "_w"]).select(
        *CLAUSE, "ord").distinct()
    scored = (candidates.join(with_words.withColumnRenamed("words", "_cw"), CLAUSE)
              .join(blocks.select(*NODE, "ord", "words"), [*NODE, "ord"])
              .withColumn("_s", tx.keyword_overlap(F.col("_cw"), F.col("words"))).filter(F.col("_s") >= threshold))
    best = scored.groupBy(*CLAUSE).agg(F.max_by("ord", F.struct(F.col("_s"), -F.col("ord"))).alias("ord"))
    return _placed(best, blocks, "keyword")


def locate_text(clauses: DataFrame, of_nodes: DataFrame, rows: int | None = None, tokenizer: Callable[[Column], Column] = tx.keywords,
                stop_words: Sequence[str] = ()) -> DataFrame:
    """(doc_id, node_id, matrix_id, strategy, positions) by the first strategy that succeeds.

    Every strategy sees only the clauses the ones before left open.
    """
    blocks = materialize(prepare_blocks(of_nodes, tokenizer, stop_words), "evidence-blocks")
    left = materialize(clauses.filter(F.coalesce("original_text", F.lit("")) != "").select(
        *CLAUSE, tx.normalize_evidence("original_text").alias("norm"), _words(F.col("original_text"), tokenizer, stop_words).alias("words")),
        "evidence-clauses")
    done = None
    for match in (match_exact, match_similarity, lambda c, b: match_substring(c, b, rows=rows), match_keywords):
        hits = materialize(match(left, blocks), "evidence-hits")
        left = left.join(hits.select(*CLAUSE), CLAUSE, "left_anti")
        done = hits if done is None else done.unionByName(hits)
    return done


# -- visual clauses -------------------------------------------------------------------------------

def locate_by_img_path(clauses: DataFrame, blocks: DataFrame) -> DataFrame:
    """Position of the first block with the clause's image path; an invalid box there ends the search."""
    first = (blocks.filter(F.coalesce("img_path", F.lit("")) != "").groupBy("doc_id", "img_path")
             .agg(F.min_by(F.struct("page_idx", "bbox"), "block_idx").alias("b")))
    ok = (F.size("b.bbox") == 4) & F.col("b.page_idx").isNotNull()
    placed = first.filter(ok).select("doc_id", "img_path", F.array(
        bl.position_struct(F.col("b.page_idx"), F.col("b.bbox"))).cast(POSITIONS_DDL).alias("_img"))
    return clauses.join(placed, ["doc_id", "img_path"], "left")


def locate_first_table(of_nodes: DataFrame) -> DataFrame:
    """Position of the first table with a valid box among the blocks of each node."""
    tables = of_nodes.filter((F.col("type") == "table") & bl.valid_bbox())
    return tables.groupBy(*NODE).agg(F.min_by(F.array(bl.position_struct(F.col("page_idx"), F.col("bbox"))), "ord")
                                     .cast(POSITIONS_DDL).alias("_table"))


def locate_visual(clauses: DataFrame, nodes: DataFrame, blocks: DataFrame, of_nodes: DataFrame) -> DataFrame:
    """Image path, then the node's first table (only without an image path), then the node's own positions."""
    by_image = locate_by_img_path(clauses, blocks)
    with_table = by_image.join(locate_first_table(of_nodes), NODE, "left")
    own = nodes.select(*NODE, F.col("positions").alias("_own"))
    no_path = F.coalesce("img_path", F.lit("")) == ""
    wants_table = no_path & (F.coalesce("table_caption", F.lit("")) != "")
    table = F.when(wants_table, F.col("_table"))
    own_used = F.when(F.size("_own") > 0, F.col("_own"))
    image = F.when(~no_path, F.col("_img"))
    return with_table.join(own, NODE, "left").select(
        *CLAUSE, F.when(image.isNotNull(), "image").when(table.isNotNull(), "table").when(own_used.isNotNull(), "node")
        .alias("strategy"), F.coalesce(image, table, own_used, F.array().cast(POSITIONS_DDL)).alias("positions"))


def locate_clauses(clauses: DataFrame, nodes: DataFrame, blocks: DataFrame, rows: int | None = None,
                   tokenizer: Callable[[Column], Column] = tx.keywords, stop_words: Sequence[str] = ()) -> DataFrame:
    """``strategy`` and ``positions`` for all clauses, visual and text ones; unlocated clauses keep an empty list."""
    of_nodes = materialize(node_blocks(nodes, blocks), "node-blocks")
    visual = clauses.filter(is_visual())
    found = locate_visual(visual, nodes, blocks, of_nodes).unionByName(
        locate_text(clauses.filter(~is_visual()), of_nodes, rows, tokenizer, stop_words))
    return (clauses.drop("positions", "strategy").join(found, CLAUSE, "left")
            .withColumn("positions", F.coalesce("positions", F.array().cast(POSITIONS_DDL))))
