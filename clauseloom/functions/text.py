"""Text expressions: strip, normalisation, tokens, tags and model-answer repair. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, numbering prefixes and marks that results depend on.
WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TITLE_DROPPED = r"[^0-9a-z\x{4e00}-\x{9fff}§]+"
TITLE_PREFIXES = (
    r"^(第?[0-9一二三四五六七八九十]+[章节条款\.]*)",
    r"^[（(]?[一二三四五六七八九十0-9]+[）)]?",
    r"^[0-9]+[\.、]",
)
EVIDENCE_PREFIXES = (
    r"^[\(（]\s*[0-9一二三四五六七八九十百千万零壹贰叁肆伍陆柒捌玖拾佰仟萬零]+\s*[\)）]",
    r"^[0-9一二三四五六七八九十百千万零壹贰叁肆伍陆柒捌玖拾佰仟萬零]+\s*[.、。）\)]",
    r"^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]",
    r"^[a-zA-Z]\s*[\)）.]",
)
WORD = r"[\p{L}\p{N}_]+"
NON_WORD = r"[^\p{L}\p{N}_]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LONG_LEADER = r"\.{5,}"
SPACED_LEADER = r"(\. ){5,}\.?"
PHYSICAL_TAG = r"<physical_index_(\d+)>"
START_TAG = r"<start_index_(\d+)>"
TAGGED_SECTION = r"(?s)<physical_index_\d+>.*?<physical_index_\d+>"
IMAGE_MARK = r"!\[([^\]]*)\]\(([^)]+)\)"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: str | Column) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` removes blanks only)."""
    return F.regexp_replace(_c(col), f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def is_blank(col: str | Column) -> Column:
    """True for null, empty or whitespace-only text."""
    return strip(F.coalesce(_c(col), F.lit(""))) == ""


def normalize_title_light(col: str | Column) -> Column:
    """Lower case without whitespace; punctuation and numbering stay."""
    return F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), f"{WHITESPACE}+", "")


def normalize_title(col: str | Column) -> Column:
    """Lower case, only ASCII letters, digits, ideographs and the section sign, numbering prefixes removed."""
    out = F.regexp_replace(normalize_title_light(col), TITLE_DROPPED, "")
    for prefix in TITLE_PREFIXES:
        out = F.regexp_replace(out, prefix, "")
    return out


def normalize_evidence(col: str | Column) -> Column:
    """One leading number mark per pattern removed, then only word characters, lower case."""
    out = F.coalesce(_c(col), F.lit(""))
    for prefix in EVIDENCE_PREFIXES:
        out = F.regexp_replace(out, prefix, "")
    return F.lower(F.regexp_replace(out, NON_WORD, ""))


def keywords(col: str | Column) -> Column:
    """Distinct word tokens longer than one character, case kept."""
    words = F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))


def character_pairs(col: str | Column) -> Column:
    """Distinct pairs of neighbouring Han characters besides the word tokens: a tokeniser for text without spaces."""
    text = F.coalesce(_c(col), F.lit(""))
    pairs = F.regexp_extract_all(text, F.lit(r"(?=(\p{IsHan}{2}))"), F.lit(1))
    words = F.filter(keywords(text), lambda w: ~w.rlike(r"\p{IsHan}"))
    return F.array_distinct(F.concat(pairs, words))


def keyword_overlap(clause: Column, block: Column) -> Column:
    """Share of the clause keywords found in the block; null for a clause without keywords."""
    return F.when(F.size(clause) > 0, F.size(F.array_intersect(clause, block)) / F.size(clause))


def token_count(col: str | Column) -> Column:
    """Default token measure where no token column is supplied: words plus single marks."""
    return F.regexp_count(F.coalesce(_c(col), F.lit("")), F.lit(TOKEN)).cast("long")


def normalize_leaders(col: str | Column) -> Column:
    """Dot leaders become ``": "``."""
    return F.regexp_replace(F.regexp_replace(_c(col), LONG_LEADER, ": "), SPACED_LEADER, ": ")


def parse_physical_index(col: str | Column) -> Column:
    """``<physical_index_9>``, ``physical_index_9`` or ``9`` to int, anything else to null."""
    raw = _c(col).cast("string")
    tail = F.regexp_extract(raw, r"_([^_]*)$", 1)
    number = (F.when(raw.startswith("<physical_index_"), F.regexp_replace(tail, ">+$", ""))
              .when(raw.startswith("physical_index_"), tail)
              .otherwise(raw))
    return strip(number).try_cast("int")


def parse_page(col: str | Column) -> Column:
    """Printed page as int; null where it is not a number (keep the raw column beside it)."""
    return strip(_c(col).cast("string")).try_cast("int")


def first_tag(col: str | Column) -> Column:
    """Number of the first start tag, -1 if none."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(col), START_TAG, 1), F.lit("")).try_cast("int"), F.lit(-1))


def last_tag(col: str | Column) -> Column:
    """Number of the last start tag, -1 if none."""
    tags = F.regexp_extract_all(_c(col), F.lit(START_TAG), F.lit(1))
    return F.coalesce(F.try_element_at(tags, F.lit(-1)).try_cast("int"), F.lit(-1))


def drop_first_tagged(col: str | Column) -> Column:
    """Remove the first section enclosed by page tags, once."""
    text = _c(col)
    hit = F.regexp_substr(text, F.lit(TAGGED_SECTION))
    at = F.instr(text, hit)
    return F.when(hit.isNull(), text).otherwise(
        F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(hit), F.length(text))))


def image_count(col: str | Column) -> Column:
    """How many image marks a text holds."""
    return F.size(F.split(F.coalesce(_c(col), F.lit("")), r"!\[", -1)) - 1


def image_refs(col: str | Column) -> Column:
    """Array of (alt, path) of the Markdown image references, in order."""
    text = F.coalesce(_c(col), F.lit(""))
    alts = F.regexp_extract_all(text, F.lit(IMAGE_MARK), F.lit(1))
    paths = F.regexp_extract_all(text, F.lit(IMAGE_MARK), F.lit(2))
    return F.zip_with(alts, paths, lambda a, p: F.struct(a.alias("alt"), p.alias("img_path")))


def json_text(col: str | Column) -> Column:
    """The JSON part of a model answer: fenced or whole, ``None`` as null, whitespace runs as one blank."""
    raw = _c(col)
    start = F.instr(raw, "```json")
    after = F.when(start > 0, F.substring(raw, start + 7, F.length(raw))).otherwise(raw)
    tail = F.instr(F.reverse(after), "```")
    body = F.when((start > 0) & (tail > 0), F.substring(after, F.lit(1), F.length(after) - tail - 2)).otherwise(after)
    return strip(F.regexp_replace(F.replace(body, F.lit("None"), F.lit("null")), f"{WHITESPACE}+", " "))


def repair_json(col: str | Column) -> Column:
    """Parseable JSON text of a model answer, trailing commas removed on the second try; null if both fail."""
    body = json_text(col)
    trimmed = F.replace(F.replace(body, F.lit(",]"), F.lit("]")), F.lit(",}"), F.lit("}"))
    return (F.when(F.try_parse_json(body).isNotNull(), body)
            # A failed try is dear, so a text that trimming does not change is not tried again.
            .when(F.try_parse_json(F.when(trimmed != body, trimmed)).isNotNull(), trimmed))


def json_array_text(col: str | Column) -> Column:
    """From the first opening to the last closing bracket; null if there is none."""
    return F.nullif(F.regexp_extract(_c(col), r"\[[\s\S]*\]", 0), F.lit(""))


def extractive_summary(text: str | Column, tokens: Column, limit: int = 200, head: int = 500) -> Column:
    """A short text is its own summary, a long one gives its head and an ellipsis."""
    body = _c(text)
    return F.when(tokens < limit, body).otherwise(F.concat(F.substring(body, 1, head), F.lit("...")))


def unescape_title(col: str | Column) -> Column:
    r"""Decode ``\uXXXX`` escapes; titles without a whole escape stay as they are."""
    raw = _c(col)
    quoted = F.concat(F.lit('{"t":"'), F.regexp_replace(raw, '(["])', r'\\$1'), F.lit('"}'))
    decoded = F.get_json_object(quoted, "$.t")
    return F.when(raw.rlike(r"\\u[0-9a-fA-F]{4}"), F.coalesce(decoded, raw)).otherwise(raw)
