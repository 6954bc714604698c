"""Which pairs of texts can be similar at all, by an equi join on rare common runs instead of all pairs.

The ratio of two texts is 2M / T, with M characters in common runs and T characters in both. Two neighbouring runs are parted by a
character that has no partner, so there are at most T - 2M + 1 runs, and at least M - (q - 1)(T - 2M + 1) places of one text begin
a run of q characters that the other has as well. The bound is exact: no pair that reaches the threshold is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.similarity import WINDOW_EXTRA
from clauseloom.session import materialize

#: Sizes of runs, the longest that a text's length and the threshold warrant is used.
RUN_SIZES = (3, 2, 1)
#: Pairs of a scope that are cheaper to compare than to look up.
FEW = 1 << 12


def _runs(text: Column, size: Column | int) -> Column:
    """The runs of ``size`` characters at all places of a text, in order."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda at: F.substr(text, at, F.lit(size) if isinstance(size, int) else size))


def _warranted(text: Column, threshold: float, windowed: bool, size: int) -> Column:
    """How many places of ``text`` must begin a run of ``size`` characters that a partner at the threshold has, at least."""
    n = F.length(text).cast("double")
    totals = [2 * n + WINDOW_EXTRA] if windowed else [2 * n / (2 - threshold), 2 * n / threshold]
    counts = [threshold * t / 2 - (size - 1) * (t * (1 - threshold) + 1) for t in totals]
    return F.ceil((F.least(*counts) if len(counts) > 1 else counts[0]) - F.lit(1e-9))


def close_pairs(needles: DataFrame, texts: DataFrame, scope: list[str], threshold: float, windowed: bool = False) -> DataFrame:
    """Rows of ``needles`` (column ``needle``) beside the rows of ``texts`` (column ``hay``) of the same ``scope`` that may be as similar as
    ``threshold``; the ratio itself is left to the caller.

    ``windowed`` is for windows of a text at least ``WINDOW_EXTRA`` longer than the needle, otherwise whole texts are meant. Of a
    needle's runs so many are looked up, the rarest first, that a partner must have one of them. Scopes of up to FEW pairs are not
    worth that: all their pairs come back. Empty texts have no partner.
    Runs Spark jobs when called.
    """
    needles = materialize(needles.filter(F.length("needle") > 0), "similar-needles")
    texts = materialize(texts.filter(F.length("hay") > 0).join(needles.select(*scope).distinct(), scope, "left_semi"), "similar-texts")
    pairs = needles.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).join(texts.groupBy(*scope).agg(F.count(F.lit(1)).alias("_m")), scope)
    large = materialize(pairs.filter(F.col("_n") * F.col("_m") > FEW).select(*scope), "similar-scopes")
    if large.isEmpty():
        return needles.join(texts, scope)
    found = needles.join(large, scope, "left_anti").join(texts, scope)
    by_runs = _by_runs(needles.join(large, scope, "left_semi"), texts.join(large, scope, "left_semi"), scope, threshold, windowed)
    return found.unionByName(by_runs.select(*found.columns))


def _by_runs(needles: DataFrame, texts: DataFrame, scope: list[str], threshold: float, windowed: bool) -> DataFrame:
    text = F.col("needle")
    size, need = F.lit(None).cast("int"), F.lit(None).cast("long")
    for q in sorted(RUN_SIZES):
        least = _warranted(text, threshold, windowed, q)
        able = (least >= 1) & (F.length(text) >= q)
        size, need = F.when(able, q).otherwise(size), F.when(able, least).otherwise(need)
    sized = needles.select(*needles.columns, F.md5(text).alias("_needle"), size.alias("_size"), need.alias("_need"))
    # A needle that would need more runs than it has has no partner.
    wanted = sized.select(*scope, "_needle", "_size", "_need", "needle").dropDuplicates([*scope, "_needle"]).withColumn(
        "_first", F.length(text) - F.col("_size") - F.col("_need") + 2).filter(F.col("_first") >= 1)
    in_use = sorted(r[0] for r in wanted.select("_size").distinct().collect())
    # Two texts of one hash only meet more needles than they need to.
    keyed = texts.withColumn("_hay", F.xxhash64("hay"))
    none = F.array().cast("array<struct<_size:int,_run:bigint>>")

    def runs_of(q: int) -> Column:
        found = F.when(F.length("hay") >= q, F.array_distinct(F.transform(_runs(F.col("hay"), q), lambda r: F.xxhash64(r))))
        return F.coalesce(F.transform(found, lambda r: F.struct(F.lit(q).alias("_size"), r.alias("_run"))), none)

    if not in_use:
        return needles.join(texts, scope).filter(F.lit(False))
    offered = keyed.select(*scope, "_hay", "hay").distinct()
    spread = materialize(offered.select(*scope, "_hay", F.inline(F.concat(none, *map(runs_of, in_use)))), "similar-runs")
    places = wanted.select(*scope, "_needle", "_size", "_first", F.explode(F.transform(_runs(text, F.col("_size")), lambda r: F.xxhash64(r))).alias("_run"))
    usage = spread.groupBy(*scope, "_size", "_run").agg(F.count(F.lit(1)).alias("_n"))
    ranked = places.join(usage, [*scope, "_size", "_run"], "left").groupBy(*scope, "_needle", "_size", "_first").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_run").alias("r")))).alias("_l"))
    rarest = F.array_distinct(F.filter(F.slice("_l", F.lit(1), F.col("_first").cast("int")), lambda p: p["n"] > 0))
    probes = ranked.select(*scope, "_needle", "_size", F.explode(rarest).alias("_p")).select(*scope, "_needle", "_size", F.col("_p.r").alias("_run"))
    found = probes.join(spread, [*scope, "_size", "_run"]).select(*scope, "_needle", "_hay").distinct()
    return keyed.join(found, [*scope, "_hay"]).join(sized.drop("_size", "_need"), [*scope, "_needle"]).drop("_hay", "_needle")
