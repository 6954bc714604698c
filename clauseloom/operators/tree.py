"""Section trees as adjacency rows in preorder: ranges, parents, subtrees, labels, paths, thinning.

Nothing here recurses: nearest ancestors, paths and subtree ends come from one
pass with a stack per chunk of the preorder (``stack.above``), totals from
prefix sums, at any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as tx
from clauseloom.operators.scan import Run, dense_chunk, ordered_concat, ordinal, scan, with_adaptive_chunk
from clauseloom.operators.stack import above
from clauseloom.session import materialize


def page_ranges(toc: DataFrame, last_page: Column, rows: int | None = None) -> DataFrame:
    """Start and end page of each item; the end may lie before the start on a shared page."""
    ahead = scan(toc, ["doc_id"], ["item_idx"], [
        Run("_next", "lead", F.struct(F.col("physical_index").alias("p"), F.col("appear_start").alias("a"),
                                      F.lit(True).alias("is_item")))],
                 dense_chunk("item_idx", rows))
    end = (F.when(F.col("_next.is_item").isNull(), last_page)
           .when(F.col("_next.a") == "yes", F.col("_next.p") - 1).otherwise(F.col("_next.p")))
    return ahead.withColumn("start_index", F.col("physical_index")).withColumn("end_index", end.cast("int")).drop("_next")


def assign_node_ids(nodes: DataFrame) -> DataFrame:
    """Four-digit preorder number; longer numbers keep their digits."""
    return nodes.withColumn("node_id", F.format_string("%04d", "node_idx"))


def boundary_titles(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """``end_title``: first child, next sibling or an ancestor's next sibling, which is the next node in preorder."""
    return scan(nodes, ["doc_id"], ["node_idx"], [Run("end_title", "lead", F.col("title"))], dense_chunk("node_idx", rows))


def fill_ranges(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """``fill_start``/``fill_end``: up to the first child's start, else the next sibling's, else the own end."""
    keyed = nodes.withColumn("_up", F.coalesce("parent_idx", F.lit(-1)))
    ahead = scan(keyed, ["doc_id"], ["node_idx"], [
        Run("_n", "lead", F.struct(F.col("parent_idx").alias("up"), F.col("start_index").alias("s")))],
                 dense_chunk("node_idx", rows))
    sibling = scan(ahead, ["doc_id", "_up"], ["node_idx"], [Run("_sib", "lead", F.col("start_index"))],
                   dense_chunk("node_idx", rows))
    child = F.when(F.col("_n.up") == F.col("node_idx"), F.col("_n.s"))
    end = F.coalesce(child, F.col("_sib"), F.col("end_index"))
    return (sibling.withColumn("fill_start", F.col("start_index"))
            .withColumn("fill_end", F.greatest(end, F.col("start_index"))).drop("_up", "_n", "_sib"))


def parents_by_level(nodes: DataFrame, order: str = "node_idx", rows: int | None = None) -> DataFrame:
    """``parent_idx``: the nearest earlier node of a smaller level."""
    return above(nodes, ["doc_id"], order, "level", F.col(order).cast("long"), "parent_idx", dense_chunk(order, rows))


def parents_by_structure(items: DataFrame, order: str = "item_idx", rows: int | None = None) -> DataFrame:
    """``parent_idx``: the latest earlier item whose code is this code without its last part; none means root.

    Definitions and look-ups of a code are put on one line and scanned, so a
    code that repeats very often makes no pairs.
    """
    parent_code = F.when(F.col("structure").contains("."), F.regexp_replace("structure", r"\.[^.]*$", ""))
    defined = items.select("doc_id", F.col("structure").alias("_code"), F.col(order).alias("_at"), F.lit(True).alias("_def"))
    wanted = items.select("doc_id", parent_code.alias("_code"), F.col(order).alias("_at"), F.lit(False).alias("_def"))
    line = defined.unionByName(wanted).filter(F.col("_code").isNotNull())
    found = scan(line, ["doc_id", "_code"], ["_at", "_def"], [
        Run("parent_idx", "last", F.when(F.col("_def"), F.col("_at")), inclusive=False)], dense_chunk("_at", rows))
    picked = found.filter(~F.col("_def")).select("doc_id", F.col("_at").alias(order), F.col("parent_idx").cast("long"))
    return items.drop("parent_idx").join(picked, ["doc_id", order], "left")


def add_preface(toc: DataFrame) -> DataFrame:
    """A ``Preface`` item (code 0, page 1, index -1) for documents whose first item starts after page 1."""
    first = toc.groupBy("doc_id").agg(F.min_by("physical_index", "item_idx").alias("_p")).filter(F.col("_p") > 1)
    types = dict(toc.dtypes)
    preface = first.select("doc_id", F.lit(-1).cast(types["item_idx"]).alias("item_idx"), F.lit("0").alias("structure"),
                           F.lit("Preface").alias("title"), F.lit(1).cast(types["physical_index"]).alias("physical_index"))
    return toc.unionByName(preface, allowMissingColumns=True)


def default_root(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """A whole-document node for documents without any node, up to the page ``pages`` where ``docs`` has it, else up to page 999."""
    known = F.col("pages") if "pages" in docs.columns else F.lit(None)
    return docs.select("doc_id", known.cast("int").alias("_pages")).join(nodes.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", F.lit(0).cast("long").alias("node_idx"), F.lit("0000").alias("node_id"),
        F.lit(None).cast("long").alias("parent_idx"), F.lit(1).alias("level"), F.lit("1").alias("structure"),
        F.lit("Full Document").alias("title"), F.lit(1).alias("start_index"), F.coalesce("_pages", F.lit(999)).alias("end_index"))


# -- leaves, paths, labels ------------------------------------------------------------------------

def with_is_leaf(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """A node is a leaf unless the next node in preorder is its child: a scan instead of a self join."""
    ahead = scan(nodes, ["doc_id"], ["node_idx"], [Run("_up", "lead", F.col("parent_idx"))], dense_chunk("node_idx", rows))
    return ahead.withColumn("is_leaf", ~F.coalesce(F.col("_up") == F.col("node_idx"), F.lit(False))).drop("_up")


def flatten_tree(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """Nodes with their title path ``a/b/c`` and ``has_children``."""
    named = nodes.withColumn("title", F.when(F.coalesce("title", F.lit("")) == "", "Unknown").otherwise(F.col("title")))
    seen = scan(named, ["doc_id"], ["node_idx"], [Run("_up", "lead", F.col("parent_idx"))], dense_chunk("node_idx", rows))
    seen = above(seen, ["doc_id"], "node_idx", "level", F.col("title"), "_titles", dense_chunk("node_idx", rows), whole=True)
    return (seen.withColumn("path", F.array_join(F.concat("_titles", F.array("title")), "/"))
            .withColumn("has_children", F.coalesce(F.col("_up") == F.col("node_idx"), F.lit(False))).drop("_up", "_titles"))


def leaf_nodes(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    return flatten_tree(nodes, rows).filter(~F.col("has_children")).drop("has_children")


def hierarchy_labels(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """``label``: the ranks among siblings from the root down, such as 1.2.3."""
    keyed = nodes.withColumn("_up", F.coalesce("parent_idx", F.lit(-1)))
    ranked = ordinal(keyed, ["doc_id", "_up"], ["node_idx"], "_rank", dense_chunk("node_idx", rows))
    ranked = materialize(ranked.withColumn("_rank", F.col("_rank").cast("string")), "ranks")
    seen = above(ranked, ["doc_id"], "node_idx", "level", F.col("_rank"), "_ranks", dense_chunk("node_idx", rows), whole=True)
    return seen.withColumn("label", F.array_join(F.concat("_ranks", F.array("_rank")), ".")).drop("_up", "_rank", "_ranks")


# -- subtrees -------------------------------------------------------------------------------------

def subtree_ends(nodes: DataFrame, carry: dict[str, Column] | None = None, order: str = "node_idx", rows: int | None = None) -> DataFrame:
    """``_stop``: the first later node that leaves the subtree (index ``at`` and the ``carry`` values); null at the end."""
    values = F.struct(F.col(order).alias("at"), *[v.alias(k) for k, v in (carry or {}).items()])
    return above(nodes, ["doc_id"], order, "level", values, "_stop", dense_chunk(order, rows), later=True, equal=True)


def subtree_sums(nodes: DataFrame, value: Column, name: str, order: str = "node_idx", rows: int | None = None) -> DataFrame:
    """Sum of ``value`` over each node and its descendants, as a difference of two suffix sums."""
    tail = materialize(scan(nodes, ["doc_id"], [order], [Run("_tail", "suffix_sum", value)], dense_chunk(order, rows)),
                       "subtree-tail")
    ends = subtree_ends(tail, {"tail": F.col("_tail")}, order, rows)
    return ends.withColumn(name, F.col("_tail") - F.coalesce(F.col("_stop.tail"), F.lit(0))).drop("_tail", "_stop")


def subtree_tokens(nodes: DataFrame, order: str = "node_idx", rows: int | None = None) -> DataFrame:
    return subtree_sums(nodes, F.col("token_count"), "subtree_tokens", order, rows)


def subtree_clause_counts(nodes: DataFrame, clauses: DataFrame, rows: int | None = None) -> DataFrame:
    """Clauses in the subtree of each node."""
    own = clauses.groupBy("doc_id", "node_id").agg(F.count(F.lit(1)).alias("_own"))
    joined = nodes.join(own, ["doc_id", "node_id"], "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
    return subtree_sums(joined, F.col("_own"), "clause_count", rows=rows).drop("_own")


def thin_tree(nodes: DataFrame, min_tokens: int, rows: int | None = None) -> DataFrame:
    """Fold small subtrees into one node each.

    A node below ``min_tokens`` (its subtree counted) takes in all descendants.
    Survivors are the nodes without such an ancestor; the node that absorbs a
    lost one is the last survivor before it, so the text is one grouped concat.
    """
    sized = materialize(subtree_tokens(nodes, rows=rows), "thin-sized")
    ends = subtree_ends(sized, rows=rows)
    size = F.coalesce(F.col("_stop.at"), F.lit(1 << 62))
    thin = F.col("subtree_tokens") < min_tokens
    marked = scan(ends.withColumn("_thin", thin).withColumn("_size", size), ["doc_id"], ["node_idx"],
                  [Run("_cover", "max", F.when(F.col("_thin"), F.col("_size")), inclusive=False)],
                  dense_chunk("node_idx", rows))
    alive = F.coalesce(F.col("_cover") <= F.col("node_idx"), F.lit(True))
    marked = materialize(marked.withColumn("_alive", alive), "thin-marked")
    owned = scan(marked, ["doc_id"], ["node_idx"],
                 [Run("_owner", "last", F.when(F.col("_alive"), F.col("node_idx")))], dense_chunk("node_idx", rows))
    part = F.when(F.col("_alive") | ~tx.is_blank("text"), F.col("text"))
    merged = ordered_concat(owned.select("doc_id", "_owner", "node_idx", "text", "_alive"), ["doc_id", "_owner"],
                            ["node_idx"], part, "\n\n", "_merged", dense_chunk("node_idx", rows))
    kept = owned.filter("_alive").drop("_stop", "_thin", "_size", "_cover", "_alive", "_owner", "text")
    return (kept.join(merged.withColumnRenamed("_owner", "node_idx"), ["doc_id", "node_idx"])
            .withColumnRenamed("_merged", "text").withColumn("token_count", tx.token_count("text")))


# -- projections and checks -----------------------------------------------------------------------

def project_tree(nodes: DataFrame, drop: list[str] | None = None, first: list[str] | None = None) -> DataFrame:
    """Remove fields and put the named ones first."""
    kept = [c for c in nodes.columns if c not in (drop or [])]
    head = [c for c in (first or []) if c in kept]
    return nodes.select(*head, *[c for c in kept if c not in head])


def over_token_limit(nodes: DataFrame, limit: int = 110000) -> DataFrame:
    return nodes.filter(F.col("token_count") > limit)


def toc_checks(nodes: DataFrame, page_counts: DataFrame, level: int = 1, rows: int | None = None) -> DataFrame:
    """Structure report per document: coverage, illegal ranges, depth, overlaps and gaps between nodes of a level.

    Coverage counts distinct pages through the running maximum of earlier ends,
    so page ranges are never spread out.
    """
    n = nodes.join(page_counts, "doc_id")
    legal = (F.col("start_index") >= 1) & (F.col("end_index") >= F.col("start_index")) & (F.col("end_index") <= F.col("pages"))
    first = F.greatest(F.col("start_index"), F.lit(1))
    last = F.least(F.col("end_index"), F.col("pages"))
    top = n.filter(F.col("level") == level).withColumn("_a", first).withColumn("_b", last)
    cut = with_adaptive_chunk(top, ["doc_id"], F.col("start_index"), "_cut", rows)
    runs = scan(cut, ["doc_id"], ["start_index", "node_idx"], [
        Run("_high", "max", F.col("_b"), inclusive=False), Run("_before", "lag", F.col("end_index"))], "_cut")
    fresh = F.greatest(F.col("_b") - F.greatest(F.col("_a") - 1, F.coalesce("_high", F.lit(0))), F.lit(0))
    spans = runs.groupBy("doc_id").agg(
        F.sum(fresh).alias("covered"), F.count_if(F.col("start_index") < F.col("_before")).alias("overlaps"),
        F.count_if(F.col("start_index") > F.col("_before") + 1).alias("gaps"))
    shape = n.groupBy("doc_id").agg(
        F.max("pages").alias("pages"), F.max("level").alias("depth"), F.count_if(~legal).alias("illegal_ranges"),
        F.count_if(F.col("end_index") < F.col("start_index")).alias("reversed_ranges"), F.count(F.lit(1)).alias("nodes"))
    return (shape.join(spans, "doc_id", "left").fillna(0, ["covered", "overlaps", "gaps"])
            .withColumn("coverage", F.when(F.col("pages") > 0, F.col("covered") / F.col("pages")).otherwise(0.0)))
