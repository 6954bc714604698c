"""HTML table text as one JVM expression."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions.text import strip

# Tag patterns and named characters.
TABLE_OPEN, TABLE_CLOSE = r"(?i)<table\b[^>]*>", r"(?i)</table\s*>"
ROW_OPEN, ROW_CLOSE = r"(?i)<tr\b[^>]*>", r"(?i)</tr\s*>"
CELL_OPEN, CELL_CLOSE = r"(?i)<t[dh]\b[^>]*>", r"(?i)</t[dh]\s*>"
ANY_TAG = r"(?s)<!--.*?-->|<[^>]*>"
REFERENCE = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def _names() -> Column:
    """The standard's named references as one map, built from Python's table."""
    return F.from_json(F.lit(json.dumps({name[:-1]: char for name, char in html.entities.html5.items() if name.endswith(";")})), "map<string,string>")


def unescape(text: Column) -> Column:
    """Decimal, hexadecimal and named character references, each decoded once; unknown ones stay as they are.

    The text is cut at its references, so what a reference decodes to is never read again as a part of another.
    """
    plain = F.split(text, REFERENCE, -1)
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))

    def one(name: Column) -> Column:
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))
        number = digits.try_cast("long")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number)), 8, "0")), "UTF-32")
        known = F.when(name.startswith("#"), char).otherwise(F.try_element_at(_names(), name))
        return F.coalesce(known, F.concat(F.lit("&"), name, F.lit(";")))

    pieces = F.zip_with(plain, found, lambda p, r: F.concat(p, F.coalesce(one(r), F.lit(""))))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def _opened(text: Column, opening: str) -> Column:
    """What follows each opening tag, up to the next one."""
    parts = F.split(text, opening, -1)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))


def table_text(html: Column) -> Column:
    """Rows as ``a | b`` lines; unclosed rows and cells, empty cells and empty rows are dropped."""
    source = F.coalesce(html, F.lit(""))
    inside = F.transform(_opened(source, TABLE_OPEN), lambda t: F.split(t, TABLE_CLOSE, 2)[0])
    rows = F.flatten(F.transform(inside, lambda t: _opened(t, ROW_OPEN)))
    closed = F.transform(F.filter(rows, lambda r: r.rlike(ROW_CLOSE)), lambda r: F.split(r, ROW_CLOSE, 2)[0])

    def line(row: Column) -> Column:
        cells = F.filter(_opened(row, CELL_OPEN), lambda c: c.rlike(CELL_CLOSE))
        texts = F.transform(cells, lambda c: strip(F.regexp_replace(F.split(c, CELL_CLOSE, 2)[0], ANY_TAG, "")))
        return F.array_join(F.filter(texts, lambda c: c != ""), " | ")

    joined = F.array_join(F.filter(F.transform(closed, line), lambda r: r != ""), "\n")
    return unescape(joined)
