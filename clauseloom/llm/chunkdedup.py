"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import ascii_lower
from clauseloom.session import materialize

#: A chunk ends behind this cut mark, at least SHORTEST and at most LONGEST characters after its start. The mark depends on the
#: characters around it alone, so texts that share a passage soon share the cuts in it. It is rare on purpose (a few hundred
#: characters apart in prose), or else cuts would not fall into step again behind an edit.
CUT = r"[a-h][l-t]\s(?=[a-d])"
SHORTEST, LONGEST = 256, 4096


def chunks(text: Column, cut: str = CUT, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The text as an array of chunks; joined together they give it again. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{shortest},{longest - 3}}}?{cut}|.{{1,{longest}}}"), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and ``recipe``, the ordered chunk identifiers of the normalised text.

    An identifier is (hash, ordinal). Chunks are compared as texts once per distinct chunk: where two different chunks share a
    hash, their ordinals tell them apart, so equal recipes mean equal texts whatever the hash function does.
    """
    texts = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    parts = materialize(texts.select("doc_id", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks")),
                        "chunks")
    distinct = parts.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk").distinct()
    shared = materialize(distinct.groupBy("h").count().where("count > 1").select("h"), "chunk-clashes")
    hashes = parts.select("doc_id", "text_sha256", F.transform("chunks", lambda c: F.xxhash64(c)).alias("hashes"), "chunks")
    if shared.isEmpty():
        plain = F.transform("hashes", lambda h: F.struct(h.alias("h"), F.lit(0).alias("n")))
        return hashes.select("doc_id", "text_sha256", plain.alias("recipe"))
    return _with_ordinals(hashes, distinct.join(shared, "h"))


def _with_ordinals(hashes: DataFrame, clashing: DataFrame) -> DataFrame:
    """Recipes where some hashes belong to several chunks; ``clashing`` has (h, chunk) of those."""
    order = Window.partitionBy("h").orderBy("chunk")
    numbered = clashing.select("h", "chunk", (F.row_number().over(order) - 1).alias("n"))
    keyed = hashes.withColumn("_row", F.monotonically_increasing_id())
    keyed = materialize(keyed, "chunk-rows")
    rows = keyed.select("_row", F.posexplode(F.arrays_zip("hashes", "chunks")).alias("pos", "c")).select(
        "_row", "pos", F.col("c.hashes").alias("h"), F.col("c.chunks").alias("chunk"))
    fixed = rows.join(numbered, ["h", "chunk"]).groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("ordinals"))
    recipe = F.transform("hashes", lambda h, i: F.struct(
        h.alias("h"), F.coalesce(F.try_element_at("ordinals", i), F.lit(0)).alias("n")))
    return keyed.join(fixed, "_row", "left").select("doc_id", "text_sha256", recipe.alias("recipe"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs`` (doc_id, text, any other columns).

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the largest doc_id stays.
    Rows that repeat the doc_id that stays are all kept; a null doc_id stays only where a text has no other. An empty table
    gives an empty table. Runs Spark jobs when called: recipes and the groups of two or more are stored once.

    Only chunks that differ move as texts, each once; documents are compared as short lists. The group sizes are combined
    before the shuffle, and the join back to a hot group has plain exchanges on both sides, which adaptive execution splits.
    """
    staged = materialize(recipes(docs), "recipes")
    groups = staged.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.where("group_size > 1"), "recipe-groups").withColumn("_hit", F.lit(True))
    keep = F.when(F.col("_hit"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return staged.join(groups, "recipe", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
