"""Chunked scans give what plain windows give, whatever the chunk size."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from clauseloom.operators.scan import Run, dense_chunk, ordered_concat, ordinal, scan, with_adaptive_chunk
from clauseloom.operators.stack import above


def rows(n=300, seed=1):
    r = random.Random(seed)
    # One key holds most of the rows.
    keys = ["hot" if r.random() < 0.7 else f"k{r.randrange(5)}" for _ in range(n)]
    count = {}
    out = []
    for k in keys:
        i = count.get(k, 0)
        count[k] = i + 1
        out.append((k, i, r.choice([None, r.randrange(50)])))
    r.shuffle(out)
    return out


def test_scan_equals_windows(spark):
    df = spark.createDataFrame(rows(), "k string, i long, v long")
    runs = [Run("s", "sum", F.col("v")), Run("sx", "sum", F.col("v"), inclusive=False), Run("m", "max", F.col("v")),
            Run("l", "last", F.col("v"), inclusive=False), Run("f", "first", F.col("v"), inclusive=False),
            Run("lead_", "lead", F.col("v")), Run("lag_", "lag", F.col("v")), Run("tail", "suffix_sum", F.col("v"))]
    got = scan(df, ["k"], ["i"], runs, dense_chunk("i", 7))
    w = Window.partitionBy("k").orderBy("i")
    past, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    ahead, rest = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select("k", "i", "v", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"),
                     F.coalesce(F.sum("v").over(past), F.lit(0)).alias("sx"), F.max("v").over(upto).alias("m"),
                     F.last("v", True).over(past).alias("l"), F.first("v", True).over(ahead).alias("f"),
                     F.lead("v").over(w).alias("lead_"), F.lag("v").over(w).alias("lag_"),
                     F.coalesce(F.sum("v").over(rest), F.lit(0)).alias("tail"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_adaptive_chunk_splits_only_hot_keys_and_keeps_order(spark):
    df = spark.createDataFrame(rows(), "k string, i long, v long").withColumn("t", F.col("i") * F.col("i") * 1000)
    cut = with_adaptive_chunk(df, ["k"], F.col("t"), "c", 20)
    by_key = {}
    for r in sorted(cut.collect(), key=lambda r: (r["k"], r["t"])):
        by_key.setdefault(r["k"], []).append(r["c"])
    assert max(by_key["hot"]) > 3
    assert all(c == sorted(c) for c in by_key.values())
    numbered = ordinal(cut, ["k"], ["t"], "n", "c").collect()
    assert all(r["n"] == r["i"] + 1 for r in numbered)


def test_ordered_concat_over_chunks(spark):
    df = spark.createDataFrame([("a", i, None if i == 3 else str(i)) for i in range(10)], "k string, i long, t string")
    got = ordered_concat(df.orderBy(F.rand(3)), ["k"], ["i"], F.col("t"), "-", "s", dense_chunk("i", 2)).collect()
    assert [r["s"] for r in got] == ["0-1-2-4-5-6-7-8-9"]


def test_no_frame_is_evaluated_anew_for_every_row(spark):
    """Spark evaluates a frame that ends with the last row from each row on: quadratic in the rows of a chunk."""
    df = spark.createDataFrame(rows(), "k string, i long, v long")
    kinds = ("sum", "max", "last", "first", "lag", "lead", "suffix_sum")
    both = [scan(df, ["k"], ["i"], [Run(kind, kind, F.col("v"), inclusive)], dense_chunk("i", 7)) for kind in kinds for inclusive in (True, False)]
    level = F.coalesce("v", F.lit(0)) + 1
    both.append(above(df.withColumn("level", level), ["k"], "i", "level", F.col("i"), "up", dense_chunk("i", 7)))
    for out in both:
        frames = re.findall(r"specifiedwindowframe\((.*?)\)", out._jdf.queryExecution().optimizedPlan().toString())
        assert frames and not [f for f in frames if "unboundedfollowing" in f and "unboundedpreceding" not in f]
