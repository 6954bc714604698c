"""Licence scans: lines and paragraphs against licence templates by the Dice coefficient of word bigrams, in SQL functions only."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

# Usual notices of common licences, and two permission texts.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0-1.0", "This work is dedicated to the public domain."),
    ("proprietary", "All rights reserved."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
]


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def tagged(words: list[str]) -> list[str]:
    """Word pairs, each with the number of its earlier occurrences, so that the sets of tagged pairs behave like bags of pairs."""
    seen: Counter = Counter()
    out = []
    for pair in zip(words, words[1:]):
        name = " ".join(pair)
        out.append(f"{name}#{seen[name]}")
        seen[name] += 1
    return out


def _bounds(size: int, least: float) -> tuple[int, int]:
    """Sizes that reach ``least`` with ``size``: 2 * smaller / (smaller + larger) can't be below it."""
    fits = [n for n in range(1, 2 * size * int(2 / least + 1)) if 2 * min(n, size) + 1e-9 >= least * (n + size)]
    return min(fits), max(fits)


def normal_lines(text: Column) -> Column:
    """Lower case; anything but letters, digits and line ends as one space; no space beside a line end."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(plain, r" ?\n ?", "\n")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, licenses (names, in order), n_matches, best_license and best_dice for every row of ``docs`` (doc_id, text, any others).

    A unit is a line, or a paragraph of several lines (set off by blank lines). A unit matches a template if the Dice coefficient of
    their bags of word bigrams is ``least`` or more; of several, only the best counts: the highest coefficient, ties to the smaller
    name. The best match of a document is chosen likewise. Documents without a match, null and empty texts have an empty list, 0 matches and null for the best.

    Bigrams are built only for units of a size from which some template can be reached, and compared only with templates whose own
    bounds allow that size. Rows are independent: no join and no shuffle, so nothing depends on how rows are distributed, and
    repeated rows give repeated results. The templates are a constant of the query.
    """
    known = []
    for name, text in templates:
        words = template_words(text)
        plain = [" ".join(x) for x in zip(words, words[1:])]
        if plain:
            known.append((name, plain, tagged(words), max(Counter(plain).values()), *_bounds(len(plain), least)))
    fixed = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, sorted(set(plain)))).alias("plain"), F.array(*map(F.lit, pairs)).alias("pairs"),
                               F.lit(most).alias("most"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for name, plain, pairs, most, lo, hi in known))
    sizes = F.array(*map(F.lit, sorted({n for *_, lo, hi in known for n in range(lo, hi + 1)})))

    def units_of(normal: Column) -> Column:
        paragraphs = F.transform(F.filter(F.split(normal, "\n{2,}"), lambda p: F.contains(F.trim(F.btrim(p, F.lit("\n"))), F.lit("\n"))),
                                 lambda p: F.translate(F.btrim(p, F.lit("\n")), "\n", " "))
        return F.transform(F.concat(F.split(normal, "\n"), paragraphs), lambda u: F.split(F.trim(u), " "))

    # Through an array of one, the normal form is worked out once.
    units = F.transform(F.array(normal_lines(F.coalesce("text", F.lit("")))), units_of)[0]
    sized = F.filter(units, lambda w: F.array_contains(sizes, F.size(w) - 1))

    def pairs_of(words: Column) -> Column:
        return F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))

    def tags(pairs: Column) -> Column:
        return F.transform(pairs, lambda p, i: F.concat(p, F.lit("#"), F.size(F.filter(F.slice(pairs, 1, i), lambda q: q == p)).cast("string")))

    def matches(pairs: Column) -> Column:
        size = F.size(pairs)
        # Before occurrences are counted: shared pairs, each as often as it can count, have to reach the coefficient.
        near = F.filter(fixed, lambda t: (t["lo"] <= size) & (t["hi"] >= size) & (
            2 * t["most"] * F.size(F.array_intersect(pairs, t["plain"])) >= least * (size + F.size(t["pairs"])) - 1e-9))
        scored = F.transform(near, lambda t: F.struct(
            (F.size(F.array_intersect(tags(pairs), t["pairs"])) * 2 / (size + F.size(t["pairs"]))).alias("dice"), t["name"].alias("name")))
        ranked = F.array_sort(F.transform(F.filter(scored, lambda m: m["dice"] >= least), lambda m: F.struct(
            (-m["dice"]).alias("less"), m["name"].alias("name"))))
        return F.slice(ranked, 1, 1)

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sized.alias("units"))
    pairs = some.select("doc_id", F.transform("units", pairs_of).alias("units"))
    found = pairs.select("doc_id", F.flatten(F.transform("units", matches)).alias("found"))
    first = F.get(F.array_sort("found"), F.lit(0))
    return found.select("doc_id", F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"]))).alias("licenses"),
                        F.size("found").cast("long").alias("n_matches"), first["name"].alias("best_license"), (-first["less"]).alias("best_dice"))
