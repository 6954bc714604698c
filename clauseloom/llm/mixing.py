"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import WORD, free_name, running_sums
from clauseloom.session import materialize

#: Expected copies are whole multiples of 2**-BITS, so prefix sums are exact in any order of addition.
BITS = 26
#: Weights by the rank of a source's name, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(name: Column, seed: int) -> Column:
    """One offset in [0, 2**BITS) per source, fixed by the seed: reruns and retried tasks agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), name), F.lit("null"))))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - BITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = (3, 2), max_repeat: int = 2) -> DataFrame:
    """Per source: source_size, n_docs, first (its first row in source order), target.

    The sources share budget[0]/budget[1] of all words by weight. A target stops at ``max_repeat`` times the size of its source and
    the rest is shared again by weight: sources fill up in the order of limit over weight, and the first one that the common
    level does not fill fixes that level. Limits and weights are whole numbers, so each target is one exact quotient.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = running_sums(totals, [F.col("source").asc_nulls_last()], {"rank": F.lit(1), "first": F.col("n_docs")}, "mix-sources")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    limited = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeat)
    steps = 1
    for w in set(weights):
        steps *= w
    by_level = [(F.col("cap") * steps / F.col("weight")).cast("long").asc(), F.col("source").asc_nulls_last()]
    filled = materialize(running_sums(limited, by_level, {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, "mix-levels"), "mix-filled")
    whole = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    if whole[1] is None:
        return filled.select("source", "source_size", "n_docs", "first", F.lit(None).cast("double").alias("target"))
    above, below = budget
    spare = F.lit(whole[0] * above) - F.col("cap_before") * below
    left = F.lit(whole[1]) - F.col("weight_before")
    reached = spare * F.col("weight") <= F.col("cap") * left * below
    # The words and weights that are left at the first source that its limit does not stop: one row.
    level = filled.where(reached).agg(F.min_by(F.struct(spare, left), F.struct("weight_before", "cap_before")).alias("at")).first()["at"]
    target = F.col("cap").cast("double")
    if level is not None:
        target = F.least(target, F.col("weight") * F.lit(level[0]) / F.lit(level[1] * below))
    return filled.select("source", "source_size", "n_docs", "first", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = (3, 2), max_repeat: int = 2, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of ``docs`` (doc_id, text, source, any others).

    A document of a source expects target / source_size copies. In the order of size and doc_id within its source, expected copies
    are summed up, one offset per source is added, and a document is emitted once per whole number that its stretch crosses:
    never more often than the expectation rounded up. Ordering by size makes the sample even over short and long documents, so
    the words taken come near the target, not only the number of documents.

    Null texts have size 0, a null source is a source of its own. Repeated rows count one by one. Empty tables give empty tables.
    Runs Spark jobs when called. Rows are ordered by range over (source, size, doc_id), so a hot source is spread over tasks.
    """
    return _dealt(docs, weights, budget, max_repeat, seed).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def _dealt(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = (3, 2), max_repeat: int = 2, seed: int = 7,
           row: tuple[str, ...] = ()) -> DataFrame:
    """``mix`` with the columns ``row``, which tell rows of equal doc_id apart and order them."""
    sizes = materialize(docs.select(*row, "doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sources = materialize(source_targets(sizes, weights, budget, max_repeat), "mix-targets")
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc(), *(F.col(c).asc() for c in row)]
    placed = running_sums(sizes, order, {"place": F.lit(1)}, "mix-order")
    share = sources.withColumn("_step", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size") * 2**BITS + 0.5)).otherwise(F.lit(0)).cast("long")).withColumn(
        "_offset", offset(F.col("source"), seed)).withColumnRenamed("source", "_source")
    upto = lambda place: F.shiftright(place * F.col("_step") + F.col("_offset"), BITS)
    at = F.col("place") - F.col("first")
    return placed.join(share, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", upto(at + 1) - upto(at)).select(
        *row, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it: rows are told apart by a number of their own, not by doc_id."""
    number, copies, copy = (free_name(n, docs.columns) for n in ("_row", "_copies", "_copy"))
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    dealt = materialize(_dealt(numbered, row=(number,), **options).where("copies > 0").select(number, F.col("copies").cast("int").alias(copies)),
                        "mix-dealt")
    return numbered.join(dealt, number).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
