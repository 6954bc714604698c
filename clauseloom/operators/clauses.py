"""Clause rows: extraction by cue rules, numbering, defaults, sorting, validation, matrix export."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as tx
from clauseloom.functions.labels import clause_type_label, structured_info
from clauseloom.operators.scan import ordinal, with_adaptive_chunk
from clauseloom.schemas import CLAUSE_ITEM_DDL, CLAUSE_TYPES, DEFAULT_CLAUSE_TYPE, UNKNOWN_NODE

# Cue words of the clause types, strongest first, and the field patterns.
CUES = [
    ("penalty", r"(?i)\b(penalty|liquidated damages|fine of|forfeit)|违约金|罚款|赔偿", 1),
    ("prohibition", r"(?i)\b(must not|shall not|may not|prohibited|forbidden)\b|不得|禁止|严禁", 2),
    ("definition", r"(?i)\b(means|is defined as|refers to)\b|是指|定义为", 3),
    ("deadline", r"(?i)\b(no later than|before|within \d+|by the end of|deadline)\b|截止|之前|日内", 4),
    ("deliverable", r"(?i)\b(deliver|submit|provide|hand over)|交付|提交|提供", 5),
    ("obligation", r"(?i)\b(must|shall|is obliged|is required to)\b|必须|应当|应该", 6),
    ("requirement", r"(?i)\b(should|need|require|support)|需要|要求|支持", 7),
]
SENTENCE_END = r"(?<=[.!?;])\s+|(?<=[。！？；])|\n+"
CONDITION = r"(?i)\b((?:if|when|unless|provided that|in case)\b[^,.;]*)|((?:如果|如|当|若)[^，。；]*)"
DEADLINE = (r"(?i)(within \d+ \w+(?: \w+)?|no later than [^,.;]+|before [^,.;]+|by \d{4}-\d{2}-\d{2})"
            r"|(\d+\s*(?:个)?(?:工作日|日|天|月)内)|(\d{4}年\d{1,2}月\d{1,2}日)")
METRIC = (r"(?i)((?:at least|at most|not less than|not more than|up to)?\s*\d+(?:\.\d+)?\s*"
          r"(?:%|percent|units|hours|days|ms|seconds))|((?:不低于|不少于|不超过|至少)\s*\d+(?:\.\d+)?\s*[%\p{L}]*)")
# Who does what: what stands before a word of duty, the word after it, and the rest up to a condition, deadline or mark.
DUTY = r"(?i)^(?:the\s+|an?\s+)?([\p{L}][\p{L}\s-]*?)\s+(?:shall|must|should|will|may|is obliged to|is required to)(?:\s+not)?\s+([\p{L}-]+)\s*([^,.;!?]*)"
DUTY_HAN = r"^(?:如果|如|当|若)?[^，]*?，?(\p{IsHan}{1,12}?)(?:应当|应该|必须|不得|禁止|应|须)(\p{IsHan}{2})(\p{IsHan}*)"
OBJECT_END = r"(?i)\s+\b(?:if|when|unless|provided that|in case|within|no later than|before|by)\b.*$"
NEEDS = {"obligation": ("action", "object")}


def is_visual(image_caption: Column | str = "image_caption", table_caption: Column | str = "table_caption") -> Column:
    """A clause that comes with an image or table caption."""
    return (F.coalesce(image_caption, F.lit("")) != "") | (F.coalesce(table_caption, F.lit("")) != "")


# -- extraction -----------------------------------------------------------------------------------

def extractable(nodes: DataFrame) -> DataFrame:
    """Leaves with non-blank text; the input needs ``is_leaf``."""
    return nodes.filter(F.col("is_leaf") & ~tx.is_blank("original_text"))


def section_prompt_text(title: Column | str, body: Column | str) -> Column:
    """Heading plus body, empty when the body is blank."""
    return F.when(~tx.is_blank(body), F.concat(F.lit("## "), title, F.lit("\n\n"), body)).otherwise("")


def _field(sentence: Column, pattern: str, groups: int) -> Column:
    parts = [F.nullif(F.regexp_extract(sentence, pattern, g), F.lit("")) for g in range(1, groups + 1)]
    return tx.strip(F.coalesce(*parts))


def extract_clauses(sections: DataFrame, cues: Iterable[tuple[str, str, int]] = tuple(CUES)) -> DataFrame:
    """Sentences that carry a cue, one clause each, typed by the strongest cue.

    The cue table is a parameter of a handful of rules, so the type is one CASE
    expression: no join, no shuffle, one pass over the text. The other fields
    (actor, action, object, condition, deadline, metric) are null where no rule
    finds them.
    """
    ranked = sorted(cues, key=lambda c: c[2])
    sentence = F.col("sentence")
    kind = F.lit(None).cast("string")
    for name, pattern, _ in reversed(ranked):
        kind = F.when(sentence.rlike(pattern), name).otherwise(kind)
    rows = (sections.select("*", F.posexplode(F.split("original_text", SENTENCE_END)).alias("item_ord", "_raw"))
            .withColumn("sentence", tx.strip("_raw")).filter(sentence != "")
            .withColumn("type", kind).filter(F.col("type").isNotNull()))
    duty, han = sentence.rlike(DUTY), sentence.rlike(DUTY_HAN)

    def who_what(group: int) -> Column:
        return F.when(duty, F.regexp_extract(sentence, DUTY, group)).when(han, F.regexp_extract(sentence, DUTY_HAN, group))

    rows = (rows.withColumn("actor", F.nullif(tx.strip(who_what(1)), F.lit(""))).withColumn("action", F.nullif(who_what(2), F.lit("")))
            .withColumn("object", F.nullif(tx.strip(F.regexp_replace(who_what(3), OBJECT_END, "")), F.lit(""))))
    return (rows.withColumn("condition", _field(sentence, CONDITION, 2))
            .withColumn("deadline", _field(sentence, DEADLINE, 3)).withColumn("metric", _field(sentence, METRIC, 2))
            .drop("_raw"))


def extract_with(sections: DataFrame, fn: Callable, schema) -> DataFrame:
    """Hook for an extractor of one's own: ``fn`` maps batches of sections to batches of clauses."""
    return sections.mapInPandas(fn, schema)


def responses_to_clauses(responses: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Clauses from model answers (doc_id, node_id, title, start_index, img_path, ordinal, response) with defaults.

    Only what the answer lacks is filled in; the image path of the request always wins.
    """
    body = tx.json_array_text("response")
    items = F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, CLAUSE_ITEM_DDL))
    rows = responses.select("*", F.posexplode(items).alias("item_ord", "c"))
    return rows.select(
        "doc_id", "ordinal", *extra, "item_ord", F.coalesce("c.section_id", "node_id", F.lit(UNKNOWN_NODE)).alias("section_id"),
        F.coalesce("c.section_title", "title").alias("section_title"),
        F.coalesce("c.page_number", "start_index").alias("page_number"),
        F.coalesce("c.type", F.lit(DEFAULT_CLAUSE_TYPE)).alias("type"), "c.actor", "c.action", "c.object", "c.condition",
        "c.deadline", "c.metric", "c.original_text", "c.image_caption", "c.table_caption", F.col("img_path"))


def stamp_clauses(clauses: DataFrame) -> DataFrame:
    """Identity of the node the clause came from; page 0 becomes the node's first page."""
    return (clauses.withColumn("section_id", F.coalesce("node_id", F.lit(UNKNOWN_NODE)))
            .withColumn("section_title", F.col("title"))
            .withColumn("page_number", F.when(F.coalesce("page_number", F.lit(0)) == 0, F.col("start_index"))
                        .otherwise(F.col("page_number"))))


def merge_clauses(text_clauses: DataFrame, visual_clauses: DataFrame) -> DataFrame:
    """Text clauses followed by visual ones, nothing deduplicated."""
    return (text_clauses.withColumn("is_visual", F.lit(False))
            .unionByName(visual_clauses.withColumn("is_visual", F.lit(True)), allowMissingColumns=True))


def number_clauses(clauses: DataFrame, keys: list[str], section: str, order: list[str], position: Column,
                   rows: int | None = None) -> DataFrame:
    """``matrix_id`` as section, ``CLS`` and a three-digit running number in the given order."""
    cut = with_adaptive_chunk(clauses, keys, position, "_cut", rows)
    numbered = ordinal(cut, keys, order, "_seq", "_cut")
    return numbered.withColumn("matrix_id", F.format_string("%s-CLS-%03d", section, "_seq")).drop("_seq", "_cut")


def default_type(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn("type", F.coalesce("type", F.lit(DEFAULT_CLAUSE_TYPE)))


# -- final matrix ---------------------------------------------------------------------------------

def sort_clauses(clauses: DataFrame, numeric: bool = False) -> DataFrame:
    """By section and clause id as strings; ``numeric`` compares the running numbers instead."""
    if numeric:
        number = F.regexp_extract("matrix_id", r"(\d+)$", 1).try_cast("long")
        return clauses.orderBy("section_id", F.asc_nulls_last(number), "matrix_id")
    return clauses.orderBy("section_id", "matrix_id")


def final_matrix(clauses: DataFrame) -> DataFrame:
    """Sorted clauses with text and title stripped."""
    return sort_clauses(clauses.withColumn("original_text", tx.strip("original_text"))
                        .withColumn("section_title", tx.strip("section_title")))


def clause_labels(clauses: DataFrame) -> DataFrame:
    """Clauses with the user label of their type and the actor-action-object line."""
    return (clauses.withColumn("type_label", clause_type_label(F.col("type")))
            .withColumn("structured_info", structured_info(F.col("actor"), F.col("action"), F.col("object"))))


def validate_clauses(clauses: DataFrame, allowed_types: Iterable[str] = CLAUSE_TYPES) -> DataFrame:
    """One row per broken rule (matrix_id, rule, soft); needs ``last_page`` (0-based) for the page rule."""
    pos = F.coalesce(F.col("positions"), F.array().cast("array<struct<page_idx:int,x0:double,y0:double,x1:double,y1:double>>"))
    required = ["matrix_id", "section_id", "section_title", "type", "actor", "original_text", "page_number"]
    rules = [(f"{c}_missing", F.coalesce(F.col(c).cast("string"), F.lit("")) == "", False) for c in required]
    rules += [
        ("type_unknown", F.col("type").isNotNull() & ~F.col("type").isin(*allowed_types), False),
        ("positions_missing", F.size(pos) < 1, False),
        ("position_incomplete", F.exists(pos, lambda p: p["page_idx"].isNull() | p["x0"].isNull() | p["y0"].isNull()
                                         | p["x1"].isNull() | p["y1"].isNull()), False),
        ("page_out_of_range", F.exists(pos, lambda p: (p["page_idx"] < 0) | (p["page_idx"] > F.col("last_page"))), False),
        ("coordinate_negative", F.exists(pos, lambda p: F.least(p["x0"], p["y0"], p["x1"], p["y1"]) < 0), False),
    ]
    for kind, fields in NEEDS.items():
        lacking = F.lit(False)
        for field in fields:
            lacking = lacking | (F.coalesce(F.col(field), F.lit("")) == "")
        rules.append((f"{kind}_incomplete", (F.col("type") == kind) & lacking, True))
    broken = F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(soft).alias("soft")))
        for name, cond, soft in rules]))
    return clauses.select("matrix_id", F.explode(broken).alias("r")).select("matrix_id", "r.rule", "r.soft")


def clause_matrix(nodes: DataFrame, clauses: DataFrame) -> DataFrame:
    """Export rows: one per clause, one for a node without clauses. ``nodes`` need ``label``; sort by node and clause."""
    c = clauses.select(
        "doc_id", "node_id", F.col("matrix_id").alias("clause_id"),
        F.substring("original_text", 1, 100).alias("clause_text"), F.col("page_number").cast("string").alias("page"),
        F.col("type").alias("clause_type"),
        structured_info(F.col("actor"), F.col("action"), F.col("object")).alias("structured"))
    rows = nodes.select("doc_id", "node_idx", "node_id", "label", "title", F.coalesce("summary", F.lit("")).alias("summary"))
    filled = ["clause_id", "clause_text", "page", "clause_type", "structured"]
    return (rows.join(c, ["doc_id", "node_id"], "left")
            .select("doc_id", "node_idx", "label", "title", "summary", *[F.coalesce(k, F.lit("")).alias(k) for k in filled]))
