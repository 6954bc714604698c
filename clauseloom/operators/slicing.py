"""Finding titles among blocks, cutting sections out between titles, filling node texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import similarity as sim
from clauseloom.functions import text as tx
from clauseloom.operators import blocks as bl
from clauseloom.operators.containment import containing_pairs
from clauseloom.operators.similar import close_pairs
from clauseloom.operators.tree import boundary_titles, fill_ranges
from clauseloom.schemas import POSITIONS_DDL
from clauseloom.session import materialize

# How far the searches widen, and the pages added behind a found title.
NEAR, FAR, END_BUFFER, FOUND_BUFFER = 2, 5, 2, 3


def searchable(blocks: DataFrame) -> DataFrame:
    """Blocks with text, reduced to what the title search reads."""
    body = bl.block_text()
    return blocks.filter(body != "").select(
        "doc_id", "block_idx", "type", F.coalesce("page_idx", F.lit(-1)).alias("page_key"),
        tx.normalize_title(body).alias("norm"), tx.normalize_title_light(body).alias("light"))


def _pairs(titles: DataFrame, blocks: DataFrame, first: Column, last: Column) -> DataFrame:
    """Titles beside the blocks on their pages: the page range is spread, then an equi join on document and page."""
    spread = (titles.withColumn("_a", first).withColumn("_b", last).filter(F.col("_b") >= F.col("_a"))
              .withColumn("page_key", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b"))
    return spread.join(blocks, ["doc_id", "page_key"]).filter(F.col("block_idx") >= F.col("start_from"))


def _with_norm(titles: DataFrame) -> DataFrame:
    out = titles.withColumn("_title", tx.normalize_title("title")).withColumn("_light", tx.normalize_title_light("title"))
    return out if "start_from" in titles.columns else out.withColumn("start_from", F.lit(0))


def find_title(titles: DataFrame, blocks: DataFrame, keys: list[str], threshold: float = sim.TITLE_THRESHOLD,
               body: DataFrame | None = None) -> DataFrame:
    """(keys, found): first block from ``start_from`` on pages ``first_page``..``last_page`` that holds the title.

    Containment is settled in the JVM first; the similarity then only looks at
    blocks in front of the containment hit. Both read stored titles and blocks;
    ``body`` is the stored ``searchable(blocks)`` of a caller that has it.
    """
    body = materialize(searchable(blocks), "titles-body") if body is None else body
    t = materialize(_with_norm(titles), "titles-sought")
    inside = sim.contains(F.col("_title"), F.col("norm"))
    exact = (_pairs(t, body, F.col("first_page"), F.col("last_page")).filter(inside)
             .groupBy(*keys).agg(F.min("block_idx").alias("_exact")))
    exact = materialize(exact, "titles-exact")
    open_titles = t.join(exact, keys, "left")
    close = (_pairs(open_titles, body, F.col("first_page"), F.col("last_page"))
             .filter((F.col("_exact").isNull() | (F.col("block_idx") < F.col("_exact"))) & ~inside
                     & (sim.window_bound(F.col("_title"), F.col("norm")) >= threshold))
             .filter(sim.window_ratio_above(F.col("_title"), F.col("norm"), threshold) >= threshold)
             .groupBy(*keys).agg(F.min("block_idx").alias("_close")))
    return exact.join(close, keys, "full_outer").select(*keys, F.least("_exact", "_close").alias("found"))


def find_title_anywhere(titles: DataFrame, blocks: DataFrame, keys: list[str], threshold: float = sim.TITLE_THRESHOLD
                        ) -> DataFrame:
    """(keys, found): first block of the whole document that holds the title.

    Equal titles are searched once. Containment runs over anchors. Similar texts
    meet by rare runs in common; where a block is longer than the window, only
    titles long enough to carry the window slack can succeed.
    """
    return first_holding(titles, searchable(blocks).select("doc_id", "block_idx", "norm"), keys, threshold)


def first_holding(titles: DataFrame, body: DataFrame, keys: list[str], threshold: float = sim.TITLE_THRESHOLD) -> DataFrame:
    """(keys, found): the smallest ``block_idx`` of ``body`` (doc_id, block_idx, norm) in the title's document whose text holds the title."""
    # Titles and blocks are read by several joins, which would each derive them anew.
    t = materialize(_with_norm(titles).filter(F.col("_title") != ""), "titles-sought")
    body = materialize(body.select("doc_id", "block_idx", "norm").join(t.select("doc_id").distinct(), "doc_id", "left_semi"), "titles-body")
    wanted = t.select("doc_id", "_title").distinct()
    hits = containing_pairs(wanted.withColumn("needle", F.col("_title")), body.withColumn("hay", F.col("norm")), ["doc_id"])
    exact = materialize(hits.groupBy("doc_id", "_title").agg(F.min("block_idx").alias("_exact")), "titles-exact")
    open_titles = wanted.join(exact, ["doc_id", "_title"], "left")

    before = F.col("_exact").isNull() | (F.col("block_idx") < F.col("_exact"))
    able = sim.window_bound(F.col("_title"), F.col("norm")) >= threshold
    slack = F.length("_title") + sim.WINDOW_EXTRA
    # A window is the whole text where that is shorter than the title and its slack.
    asked, offered = open_titles.withColumn("needle", F.col("_title")), body.withColumn("hay", F.col("norm"))
    longest = wanted.groupBy("doc_id").agg((F.max(F.length("_title")) + sim.WINDOW_EXTRA).alias("_most"))
    brief = offered.join(longest, "doc_id").filter(F.length("norm") < F.col("_most")).drop("_most")
    short = close_pairs(asked, brief, ["doc_id"], threshold).filter(F.length("norm") < slack)
    carrying = 2 * F.length("_title") / (F.length("_title") + slack) >= threshold
    long = close_pairs(asked.filter(carrying), offered, ["doc_id"], threshold, windowed=True).filter(F.length("norm") >= slack)
    close = (short.unionByName(long).filter(before & able & ~F.col("norm").contains(F.col("_title")))
             .filter(sim.window_ratio_above(F.col("_title"), F.col("norm"), threshold) >= threshold)
             .groupBy("doc_id", "_title").agg(F.min("block_idx").alias("_close")))
    found = exact.join(close, ["doc_id", "_title"], "full_outer").select(
        "doc_id", "_title", F.least("_exact", "_close").alias("found"))
    return t.join(found, ["doc_id", "_title"]).select(*keys, "found")


def find_title_robust(titles: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step, found) by the five steps, each a little laxer than the one before.

    One candidate pass over the widest page window: every pair gets the first
    step it satisfies and the smallest (step, block) wins. Pairs settled in the
    JVM come first; the similarity sees only pairs that could still win.
    """
    body, t = searchable(blocks), _with_norm(titles)
    low, high, page = F.col("first_page"), F.col("last_page"), F.col("page_key")

    def within(slack: int) -> Column:
        return page.between(F.greatest(low - slack, F.lit(0)) if slack else low, high + slack)

    widest = (F.least(F.greatest(low - FAR, F.lit(0)), low), high + FAR)
    inside = sim.contains(F.col("_title"), F.col("norm"))
    light = (F.col("type") == "header") & (F.col("_light") != "") & (
        F.col("light").contains(F.col("_light")) | F.col("_light").contains(F.col("light")))

    def steps(strict: Column, loose: Column) -> Column:
        return (F.when(within(0) & strict, 1).when(within(0) & light, 2).when(within(NEAR) & strict, 3)
                .when(within(NEAR) & loose, 4).when(within(FAR) & strict, 5))

    place = F.struct("step", "block_idx")
    exact = (_pairs(t, body, *widest).withColumn("step", steps(inside, inside)).filter(F.col("step").isNotNull())
             .groupBy(*keys).agg(F.min(place).alias("_exact")))
    exact = materialize(exact, "titles-exact")
    open_titles = t.join(exact, keys, "left")
    loose_able = sim.window_bound(F.col("_title"), F.col("norm")) >= sim.LOOSE_THRESHOLD
    # A similar pair takes step 1, 3 or 4, or 5: it can win only with the smaller (step, block).
    best_step = F.when(within(0), 1).when(within(NEAR), 3).otherwise(5)
    could_win = F.col("_exact").isNull() | (F.struct(best_step.alias("step"), F.col("block_idx")) < F.col("_exact"))
    scored = (_pairs(open_titles, body, *widest).filter(loose_able & could_win & ~inside)
              .withColumn("_score", sim.window_ratio_above(F.col("_title"), F.col("norm"), sim.LOOSE_THRESHOLD)))
    strict, loose = F.col("_score") >= sim.TITLE_THRESHOLD, F.col("_score") >= sim.LOOSE_THRESHOLD
    close = (scored.withColumn("step", steps(strict, loose)).filter(F.col("step").isNotNull())
             .groupBy(*keys).agg(F.min(place).alias("_close")))
    best = F.least("_exact", "_close")
    return exact.join(close, keys, "full_outer").select(*keys, best["step"].alias("step"), best["block_idx"].alias("found"))


def resolve_end(spans: DataFrame, blocks: DataFrame, keys: list[str], threshold: float = sim.TITLE_THRESHOLD,
                body: DataFrame | None = None) -> DataFrame:
    """``spans`` plus ``end_idx``: the end title behind the start, else one past the last block in range, else the length."""
    spans = materialize(spans, "spans-open")
    searched = spans.filter(F.coalesce("end_title", F.lit("")) != "").select(
        *keys, *[c for c in ("doc_id",) if c not in keys], F.col("end_title").alias("title"), "first_page",
        (F.col("last_page") + END_BUFFER).alias("last_page"), (F.col("start_idx") + 1).alias("start_from"))
    hit = find_title(searched, blocks, keys, threshold, body).withColumnRenamed("found", "_hit")
    per_page = blocks.groupBy("doc_id", F.coalesce("page_idx", F.lit(-1)).alias("page_key")).agg(F.max("block_idx").alias("_m"))
    in_range = (spans.filter("last_page >= first_page").select(*dict.fromkeys([*keys, "doc_id"]), F.explode(F.sequence("first_page", "last_page")).alias("page_key"))
                .join(per_page, ["doc_id", "page_key"]).groupBy(*keys).agg((F.max("_m") + 1).alias("_last")))
    length = per_page.groupBy("doc_id").agg((F.max("_m") + 1).alias("_length"))
    return (spans.join(hit, keys, "left").join(in_range, keys, "left").join(length, "doc_id", "left")
            .withColumn("end_idx", F.coalesce("_hit", "_last", "_length")).drop("_hit", "_last", "_length"))


def positions_between(titles: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Positions from the start title (included) to the end title (excluded); all in range without a start."""
    titles, body = materialize(titles, "positions-titles"), materialize(searchable(blocks), "titles-body")
    started = titles.join(find_title(titles, blocks, keys, body=body), keys, "left")
    ended = resolve_end(started.withColumn("start_idx", F.coalesce("found", F.lit(-1))), blocks, keys, body=body)
    spans = ended.withColumn("end_idx", F.when(F.col("found").isNull(), F.lit((1 << 31) - 1)).otherwise(
        F.greatest("end_idx", F.col("found") + 1))).withColumn(
        "start_idx", F.when(F.col("found").isNull(), F.lit(-1)).otherwise(F.col("found") - 1))
    inside = bl.slice_blocks(blocks, spans.select(*dict.fromkeys([*keys, "doc_id"]), "start_idx", "end_idx", "first_page",
                                                  "last_page"), keys)
    return bl.positions_of(inside, keys)


def fill_node_text(nodes: DataFrame, blocks: DataFrame, rows: int | None = None) -> DataFrame:
    """``original_text``, ``positions`` and the ``step`` that found the title, for every node.

    Range from the tree, widened to the boundary title's page (or the last page
    without one); title by the five steps; text up to the boundary; the whole
    page range where no title is found; nothing for an illegal range.
    """
    keys = ["doc_id", "node_idx"]
    base = nodes.drop("original_text", "positions")
    ranged = fill_ranges(boundary_titles(base, rows), rows)
    ranged = materialize(ranged, "fill-ranges")

    boundary = ranged.filter(F.coalesce("end_title", F.lit("")) != "").select(*keys, F.col("end_title").alias("title"))
    seen = find_title_anywhere(boundary, blocks, keys)
    pages = blocks.select("doc_id", F.col("block_idx").alias("found"), "page_idx")
    seen = seen.join(pages, ["doc_id", "found"]).select(*keys, F.col("page_idx").alias("_seen"))
    widened = (ranged.join(seen, keys, "left").join(bl.last_page(blocks), "doc_id", "left")
               .withColumn("last_page", F.greatest(F.col("fill_end"), F.coalesce("_seen", "last_page") + 1) - 1)
               .withColumn("first_page", F.col("fill_start") - 1).drop("_seen"))
    legal = widened.filter((F.col("first_page") <= F.col("last_page")) & (F.col("last_page") >= 0))
    legal = materialize(legal.select(*keys, "title", "end_title", "first_page", "last_page"), "fill-widened")

    found = find_title_robust(legal, blocks, keys)
    found = found.join(pages, ["doc_id", "found"]).withColumn("_page", F.col("page_idx")).drop("page_idx")
    placed = materialize(legal.join(found, keys, "left"), "fill-found")

    hit = placed.filter(F.col("found").isNotNull()).withColumn("_at", F.coalesce("_page", "first_page")).select(
        *keys, "end_title", F.col("found").alias("start_idx"), F.least("first_page", "_at").alias("first_page"),
        F.greatest("last_page", F.col("_at") + FOUND_BUFFER).alias("last_page"))
    spans = materialize(resolve_end(hit, blocks, keys), "fill-spans").select(
        *keys, "start_idx", "end_idx", "first_page", "last_page")
    missed = placed.filter(F.col("found").isNull()).select(
        *keys, F.lit(-1).alias("start_idx"), F.lit((1 << 31) - 1).alias("end_idx"), "first_page", "last_page")
    body = bl.slice_blocks(blocks, spans.unionByName(missed), keys)
    text = bl.assemble_text(body, keys, rows=rows)

    opening = blocks.join(spans.select(*keys, F.col("start_idx").alias("block_idx")), ["doc_id", "block_idx"]).select(
        *[c for c in body.columns])
    positions = bl.positions_of(body.unionByName(opening), keys)
    steps = placed.select(*keys, "step")
    return (base.join(text, keys, "left").join(positions, keys, "left").join(steps, keys, "left")
            .withColumn("original_text", F.coalesce("original_text", F.lit("")))
            .withColumn("positions", F.coalesce("positions", F.array().cast(POSITIONS_DDL))))


def alignment_checks(filled: DataFrame) -> DataFrame:
    """Titles found per step and missed, per document."""
    return filled.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("nodes"), *[F.count_if(F.col("step") == s).alias(f"step_{s}") for s in range(1, 6)],
        F.count_if(F.col("step").isNull()).alias("missed"))
