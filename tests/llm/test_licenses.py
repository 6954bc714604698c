import re
from collections import Counter

import pytest

from clauseloom.llm.licenses import LEAST, TEMPLATES, scan, template_words


def brute(text):
    lines = [" ".join(re.findall(r"[^\W_]+", x.lower())) for x in (text or "").split("\n")]
    units, part = [x.split() for x in lines], []
    for x in [*lines, ""]:
        if x:
            part.append(x)
            continue
        if len(part) > 1:
            units.append(" ".join(part).split())
        part = []
    best = []
    for u in units:
        found = []
        a = Counter(zip(u, u[1:]))
        for name, t in TEMPLATES:
            w = template_words(t)
            b = Counter(zip(w, w[1:]))
            dice = 2 * (a & b).total() / max(1, a.total() + b.total())
            if dice >= LEAST:
                found.append((-dice, name))
        best += sorted(found)[:1]
    return sorted(best)


def test_equals_all_comparisons(spark):
    long = TEMPLATES[-2][1]
    half = len(long.split()) // 2
    wrapped = " ".join(long.split()[:half]) + "\n" + " ".join(long.split()[half:])
    texts = ["Some prose.\nLicensed under CC BY-NC 4.0.\nMore", None, "", "\n\n", "released UNDER the -- mit license", "All rights reserved",
             "rights", "All rights reserved. All rights reserved.", f"Head\n\n{wrapped}\n\nTail", wrapped, f"x\n{wrapped}", "the the the the the",
             "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", "Ünder Lîcensed " * 30_000,
             "Licensed under the Apache License, Version 2.0 or later"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[5], "y")], "doc_id long, text string, name string")
    got = scan(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute(texts[5 if r.doc_id is None else r.doc_id])
        assert r.licenses == sorted({n for _, n in want}) and r.n_matches == len(want)
        assert (r.best_license, r.best_dice) == ((want[0][1], pytest.approx(-want[0][0])) if want else (None, None))
    assert scan(df.limit(0)).count() == 0
