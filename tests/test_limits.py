"""Inputs at which earlier versions lost rows, stopped or answered wrongly."""

from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clauseloom import session
from clauseloom.functions.html import unescape
from clauseloom.functions.text import character_pairs, keywords
from clauseloom.operators import blocks as bl
from clauseloom.operators import clauses, evidence, tasks, toc, tree
from clauseloom.operators.scan import with_adaptive_chunk
from clauseloom.streaming.progress import _clamp, _feed, _recent


def test_character_references(spark):
    cases = {"&#x41;&#X42;&#67;": "ABC", "&copy; &eacute;&Eacute;": "© éÉ", "&amp;lt;": "&lt;", "&#38;lt;": "&lt;", "&unknown; &#0; &#xD800;": "&unknown; &#0; &#xD800;",
             "a & b; c": "a & b; c", "&lt;p&gt;&nbsp;": "<p>\xa0", "": "", "&#000000065;": "A", "&#x1F600;": "\U0001F600", "&;": "&;"}
    df = spark.createDataFrame(list(cases.items()) + [(None, None)], "s string, want string")
    assert df.select(unescape(F.col("s")).alias("got"), "want").where("NOT got <=> want").collect() == []


def test_keyword_with_backslash(spark):
    df = spark.createDataFrame([(1, "t", 1, r"path C:\temp\x"), (2, "t", 1, "nothing")], "id int, task_id string, page_number int, original_text string")
    assert [r.id for r in tasks.search_clauses(df, r"c:\TEMP").collect()] == [1]


def test_reversed_range_has_no_pages(spark):
    blocks = spark.createDataFrame([(1, i, i) for i in range(6)], "doc_id long, block_idx long, page_idx int")
    spans = spark.createDataFrame([(1, "back", -1, 99, 3, 1), (1, "on", -1, 99, 1, 2)], "doc_id long, node_id string, start_idx long, end_idx long, first_page int, last_page int")
    got = bl.slice_blocks(blocks, spans, ["doc_id", "node_id"]).collect()
    assert sorted((r.node_id, r.page_idx) for r in got) == [("on", 1), ("on", 2)]


def test_long_numbered_line_is_an_item(spark):
    line = "1.2 " + "word " * 40
    df = spark.createDataFrame([(1, 0, "text", line, 0)], "doc_id long, block_idx long, type string, text string, page_idx int")
    row = toc.headers_to_toc(df).first()
    assert row.structure == "1.2" and row.title == line[4:].strip()


def test_short_last_contents_page_continues(spark):
    flags = spark.createDataFrame([(1, 1, False, True), (1, 2, True, True), (1, 3, False, True), (1, 4, False, False), (1, 5, False, True)],
                                  "doc_id long, page_no long, is_toc boolean, continues boolean")
    assert sorted(r.page_no for r in toc.toc_pages(flags).collect()) == [2, 3]


def test_tree_of_forty_levels(spark):
    rows = [(1, i, i + 1, f"t{i}", i - 1 if i else None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, node_idx long, level int, title string, parent_idx long")
    parents = tree.parents_by_level(df.drop("parent_idx")).orderBy("node_idx").collect()
    assert [r.parent_idx for r in parents] == [None, *range(39)]
    last = tree.flatten_tree(df).orderBy(F.desc("node_idx")).first()
    assert last.path == "/".join(f"t{i}" for i in range(40))


def test_default_root_ends_with_the_document(spark):
    docs = spark.createDataFrame([(1, 1500), (2, None)], "doc_id long, pages int")
    none = spark.createDataFrame([], "doc_id long")
    assert {r.doc_id: r.end_index for r in tree.default_root(docs, none).collect()} == {1: 1500, 2: 999}


def test_one_outlier_leaves_even_chunks(spark):
    rows = [("hot", i) for i in range(2000)] + [("hot", 10**12)] + [("cold", i) for i in range(5)]
    cut = with_adaptive_chunk(spark.createDataFrame(rows, "k string, v long"), ["k"], F.col("v"), "c", 100).collect()
    sizes = Counter(r.c for r in cut if r.k == "hot")
    assert max(sizes.values()) <= 250 and {r.c for r in cut if r.k == "cold"} == {0}
    ordered = [r.c for r in sorted(cut, key=lambda r: r.v) if r.k == "hot"]
    assert ordered == sorted(ordered)


class _State:
    """A group's state with a clock of its own."""

    def __init__(self):
        self.now, self.value, self.due, self.hasTimedOut = 0, None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.due = self.now + ms

    def call(self, feed, now, *progress, status=None):
        self.now, self.due = now, None
        rows = pd.DataFrame({"task_id": "a", "id": range(len(progress)), "created_at": pd.Timestamp(0), "progress": pd.Series(progress, dtype="float64"),
                             "message": "m", "status": status})
        return [x for f in feed(("a",), iter([rows]), self) for x in f["progress"]]

    def lapse(self, feed):
        self.now, self.hasTimedOut, self.due = self.due, True, None
        list(feed(("a",), iter([]), self))
        self.hasTimedOut = False


def test_feed_closes_although_entries_go_on():
    """Entries of later batches must not put off the end of a feed, nor reopen it."""
    feed, state = _feed(10), _State()
    assert len(state.call(feed, 1000, None)) == 1 and state.due == 11_000
    assert state.call(feed, 3000, None) == [] and state.call(feed, 5000, 5.0, 5.0, 6.0) == [5.0, 6.0] and state.due == 11_000
    state.lapse(feed)
    assert state.exists and state.due == 21_000
    assert state.call(feed, 15_000, 7.0) == [] and state.due == 21_000
    state.lapse(feed)
    assert not state.exists and state.due is None
    assert state.call(feed, 30_000, 1.0, 2.0, 3.0, status=["x", "completed", "x"]) == [1.0, 2.0] and state.due == 50_000


def test_silent_tasks_are_forgotten():
    """High-water marks and rolling logs go once a task is silent; entries in between put that off."""
    for make in (_clamp(10), _recent(2, 10)):
        state = _State()
        assert state.call(make, 1000, 3.0, 5.0) == [3.0, 5.0] and state.due == 11_000
        assert state.call(make, 9000, 1.0)[-1] == 5.0 and state.due == 19_000
        state.lapse(make)
        assert not state.exists and state.due is None
        assert state.call(make, 30_000, 2.0) == [2.0] and state.due == 40_000
    endless = _State()
    endless.call(_clamp(None), 0, 1.0)
    assert endless.exists and endless.due is None


def test_quantiles_of_many_and_of_no_values(spark):
    import numpy as np
    values = [float(x) for x in np.random.default_rng(3).integers(0, 500, 3000)] + [None, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "elapsed_seconds double")
    known = [v for v in values if v is not None]
    got = tasks.latency_quantiles(df, (0.0, 0.5, 0.95, 1.0)).collect()
    assert [tuple(r) for r in got] == [(*(float(x) for x in np.quantile(known, [0, 0.5, 0.95, 1])), len(known))]
    assert [tuple(r) for r in tasks.latency_quantiles(df.filter("elapsed_seconds IS NULL")).collect()] == [(None, None, 0)]


def test_stored_tables_are_released(spark):
    df = session.materialize(spark.range(3), "probe")
    assert df.count() == 3 and session.release(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_cluster_needs_a_shared_folder():
    class Context:
        applicationId, master = "x", "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.shared_dir(Session, "x")


def test_extracted_clauses_name_actor_action_and_object(spark):
    text = "The supplier shall deliver the spare parts within 30 days. If delayed, the buyer must notify the carrier in writing. 乙方应当提交验收报告。"
    got = clauses.extract_clauses(spark.createDataFrame([(1, text)], "doc_id long, original_text string")).orderBy("item_ord").collect()
    assert [(r.actor, r.action, r.object) for r in got][0] == ("supplier", "deliver", "the spare parts")
    assert [(r.actor, r.action, r.object) for r in got][2] == ("乙方", "提交", "验收报告")
    assert got[0].deadline == "within 30 days" and got[1].condition == "If delayed"


def test_a_tokeniser_finds_chinese_clauses(spark):
    nodes = spark.createDataFrame([(1, "n", 0, "text", "第三条 乙方在验收合格以后应当向甲方提交完整的竣工报告和图纸", None, 0, [0.0, 0.0, 1.0, 1.0])],
                                  "doc_id long, node_id string, ord long, type string, text string, list_items array<string>, page_idx int, bbox array<double>")
    wanted = spark.createDataFrame([(1, "n", "m", "竣工报告和图纸 验收合格")], "doc_id long, node_id string, matrix_id string, original_text string")
    blocks = evidence.prepare_blocks(nodes, character_pairs, ["的竣"])
    words = wanted.withColumn("words", character_pairs("original_text"))
    assert evidence.match_keywords(words, blocks).count() == 1
    plain = wanted.withColumn("words", keywords("original_text"))
    assert evidence.match_keywords(plain, evidence.prepare_blocks(nodes)).count() == 0
    assert "的竣" not in blocks.first().words


def test_titles_are_found_on_any_page_behind_the_contents(spark):
    """No page is too far away, and a range that is given is kept."""
    pages = spark.createDataFrame([(1, p, f"Part number {p:09d}\nsome body text of the page") for p in range(1, 501)], "doc_id long, page_no int, text string")
    items = spark.createDataFrame([(1, i, f"Part number {i:09d}") for i in (1, 2, 21, 22, 23, 450)], "doc_id long, item_idx long, title string")
    last = spark.createDataFrame([(1, 2)], "doc_id long, toc_last int")
    for n, far in ((None, 500), (20, 22)):
        got = {r.item_idx: r.physical_index for r in toc.toc_physical_index(items, pages, last, n).collect()}
        assert got == {i: i if 2 < i <= far else None for i in (1, 2, 21, 22, 23, 450)}
