"""Hand-made cases for text, geometry, labels and HTML."""

import random

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import geometry as geo
from clauseloom.functions import labels
from clauseloom.functions import similarity as sim
from clauseloom.functions import text as tx
from clauseloom.functions.html import table_text
from clauseloom.functions.similarity import best_window, ratio, title_contained, window_ratio


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("fn, text, want", [
    (tx.normalize_title, "3.1.2 Scope", "scope"), (tx.normalize_title, "2024", ""), (tx.normalize_title, "第三章 总则", "总则"),
    (tx.normalize_title, "Été 1", "t1"), (tx.normalize_title_light, " 3.1.2\tScope　x", "3.1.2scopex"),
    (tx.normalize_evidence, "(1) Foo, Bar_x", "foobar_x"), (tx.normalize_evidence, " (1) Foo", "1foo"),
    (tx.normalize_evidence, "①a) 第二条。", "第二条"), (tx.normalize_evidence, "!!!", ""),
    (tx.strip, " \n a b \t", "a b"), (tx.normalize_leaders, "A .......... 7", "A :  7"),
    (tx.normalize_leaders, "A . . . . . . 7", "A : 7"),
    (tx.drop_first_tagged, "a<physical_index_1>\nx\n<physical_index_1>b<physical_index_2>", "ab<physical_index_2>"),
    (tx.drop_first_tagged, "no tags", "no tags"), (tx.unescape_title, "\\u7b2c1\\u7ae0", "第1章"), (tx.unescape_title, "a\\u00", "a\\u00"),
])
def test_text(spark, fn, text, want):
    assert one(spark, fn("t"), t=text) == want


@pytest.mark.parametrize("raw, want", [("<physical_index_9>", 9), ("physical_index_9", 9), ("9", 9), ("x", None),
                                       ("<physical_index_x>", None), ("physical_index_12>", None)])
def test_physical_index(spark, raw, want):
    assert one(spark, tx.parse_physical_index("t"), t=raw) == want


@pytest.mark.parametrize("raw, want", [
    ('```json\n{"a": None}\n```', '{"a": null}'), ('{"a": [1, 2,]}', '{"a": [1, 2]}'), ('{"a": 1', None), (' [1,\n 2] ', "[1, 2]")])
def test_repair_json(spark, raw, want):
    assert one(spark, tx.repair_json("t"), t=raw) == want


def test_tags_and_images(spark):
    assert one(spark, tx.last_tag("t"), t="<start_index_3> <start_index_12>") == 12
    assert one(spark, tx.first_tag("t"), t="none") == -1
    refs = one(spark, tx.image_refs("t"), t="x ![a b](p/q.jpg) ![](r.png)")
    assert [tuple(r) for r in refs] == [("a b", "p/q.jpg"), ("", "r.png")]
    assert one(spark, tx.image_count("t"), t="![a](b) [Table] ![c](d)") == 2


def test_boxes(spark):
    p = F.struct(F.lit(0).alias("page_idx"), *[F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (213, 253, 784, 317))])
    got = one(spark, geo.to_points(p, F.lit(612.0), F.lit(792.0)))
    assert [round(v, 3) for v in got[1:]] == [130.356, 200.376, 479.808, 251.064]
    box = F.array(*[F.lit(float(v)) for v in (100, 500, 300, 520)])
    assert one(spark, geo.flip_bbox(box, F.lit(800.0))) == [100, 280, 300, 300]
    assert one(spark, geo.flip_bbox(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5), F.lit(2.0)), F.lit(4.5))) == [0, 2, 2, 4]
    assert one(spark, geo.flip_bbox(F.array(F.lit(1.0)), F.lit(800.0))) == [0, 0, 0, 0]
    assert one(spark, geo.page_size_name(F.lit(599.9), F.lit(842.0))) == "A4"
    assert one(spark, geo.page_size_name(F.lit(600.0), F.lit(842.0))) == "Custom"


@pytest.mark.parametrize("seconds, want", [(None, "-"), (0.0, "-"), (59.5, "60秒"), (61.4, "1分1秒"), (125.0, "2分5秒")])
def test_elapsed(spark, seconds, want):
    assert one(spark, labels.format_elapsed(F.lit(seconds).cast("double"))) == want


@pytest.mark.parametrize("html, want", [
    ("<table><tr><td> a </td><th>b</th></tr><tr><td></td></tr><tr><td>c", "a | b"),
    ("<TABLE><TR><TD>x<b>y</b> &amp; &#8364;</TD></TR></TABLE>", "xy & €"), ("<tr><td>outside</td></tr>", ""), ("", ""), (None, ""),
    ("<table><tr><td>1<td>2</td></tr></table><tr><td>3</td></tr>", "2")])
def test_table_text(spark, html, want):
    assert one(spark, table_text(F.lit(html).cast("string"))) == want


def test_similarity(spark):
    assert one(spark, ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert one(spark, ratio(F.lit(""), F.lit("a"))) == 0.0
    assert one(spark, ratio(F.lit(""), F.lit(""), 1.0)) == 1.0
    assert one(spark, window_ratio(F.lit("scope"), F.lit("xxscopexx"))) == pytest.approx(best_window("scope", "xxscopexx"))
    assert one(spark, title_contained(F.lit("scope"), F.lit("thescope"))) is True
    assert one(spark, title_contained(F.lit(""), F.lit("a"))) is False


def test_best_window_equals_plain_search():
    import random
    from difflib import SequenceMatcher
    r = random.Random(5)
    for _ in range(300):
        t = "".join(r.choice("abcd") for _ in range(r.randrange(1, 100)))
        c = "".join(r.choice("abcd") for _ in range(r.randrange(1, 250)))
        if r.random() < 0.3:
            at = r.randrange(len(c))
            c = c[:at] + t[:-1] + c[at:]
        w = min(len(c), len(t) + 10)
        best = 0.0
        for i in range(0, max(1, len(c) - w + 1), 1 if w < 80 else 2):
            best = max(best, SequenceMatcher(None, t, c[i:i + w]).ratio())
            if best >= 0.99:
                break
        assert best_window(t, c) == best


def test_shared_characters_bound_the_window_ratio():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdé中1", k=rng.randint(1, 40))) for _ in range(60)]
    pairs = [(a, b) for a in texts for b in texts]
    bounds = sim.shared_bound(*map(list, zip(*pairs)))
    assert all(bound >= sim.best_window(a, b) - 1e-12 for (a, b), bound in zip(pairs, bounds))
    assert sim.shared_bound(["abcd"], ["wxyz"])[0] == 0 and sim.shared_bound(["abcd"], ["dcba"])[0] == 1
