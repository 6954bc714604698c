"""Small label expressions: quality bands, durations, clause types, parser progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions.text import WHITESPACE

# Labels shown to users, parser log patterns and stage percentages.
TYPE_LABELS = {
    "obligation": "义务",
    "requirement": "需求",
    "prohibition": "禁止",
    "deliverable": "交付物",
    "deadline": "截止时间",
    "penalty": "惩罚",
    "definition": "定义",
}
UNCLASSIFIED = "未分类"
SECONDS_UNIT, MINUTES_UNIT = "秒", "分"
BATCH_LINE = r"Batch\s+(\d+)/(\d+):\s+(\d+)\s+pages/(\d+)\s+pages"
PERCENT_LINE = r"(\d+)%\|"
MODEL_LOADING = "DocAnalysis init"


def quality_band(rate: Column) -> Column:
    return (F.when(rate >= 0.9, "excellent").when(rate >= 0.7, "good").when(rate >= 0.5, "medium").otherwise("poor"))


def _rounded(seconds: Column) -> Column:
    return F.floor(seconds + 0.5).cast("long").cast("string")


def format_elapsed(seconds: Column) -> Column:
    """``-`` for nothing, seconds below a minute, else minutes and seconds."""
    minutes = F.floor(seconds / 60)
    return (F.when(F.coalesce(seconds, F.lit(0.0)) == 0, "-")
            .when(seconds < 60, F.concat(_rounded(seconds), F.lit(SECONDS_UNIT)))
            .otherwise(F.concat(minutes.cast("string"), F.lit(MINUTES_UNIT), _rounded(seconds - minutes * 60),
                                F.lit(SECONDS_UNIT))))


def clause_type_label(kind: Column) -> Column:
    """User label of a clause type; unknown types pass through, none is unclassified."""
    out = F.when(F.coalesce(kind, F.lit("")) == "", UNCLASSIFIED)
    for key, label in TYPE_LABELS.items():
        out = out.when(kind == key, label)
    return out.otherwise(kind)


def structured_info(*parts: Column) -> Column:
    """The non-empty parts joined by a blank."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def parser_message(line: Column) -> Column:
    """Progress message of a parser log line, null when the line says nothing."""
    batch = F.concat(F.lit("processing batch "), F.regexp_extract(line, BATCH_LINE, 1), F.lit("/"),
                     F.regexp_extract(line, BATCH_LINE, 2), F.lit(" ("), F.regexp_extract(line, BATCH_LINE, 3),
                     F.lit(" pages)"))
    return (F.when(F.regexp_replace(line, WHITESPACE, "") == "", F.lit(None))
            .when(line.rlike(BATCH_LINE), batch)
            .when(line.contains(MODEL_LOADING), "loading analysis model")
            .when(line.rlike(PERCENT_LINE), F.concat(F.lit("progress: "), F.regexp_extract(line, PERCENT_LINE, 1),
                                                     F.lit("%"))))


def parser_progress(line: Column) -> Column:
    """Overall progress that the stage named in a parser log line stands for; 0 when it names none."""
    low = F.lower(line)
    whole = line.contains("100%")

    def stage(done: int, running: int) -> Column:
        return F.when(whole, F.lit(done)).otherwise(F.lit(running))

    return (F.when(low.contains("layout predict"), stage(20, 15))
            .when(low.contains("mfd predict"), stage(30, 25))
            .when(low.contains("mfr predict"), stage(40, 35))
            .when(low.contains("table") & low.contains("ocr"), F.lit(43))
            .when(low.contains("ocr") & low.contains("predict"), stage(50, 48))
            .otherwise(F.lit(0)))
