"""Ratcliff-Obershelp similarity as Arrow-batched UDFs, guarded by exact length bounds in the JVM.

Argument order matters for this measure: the title or clause comes first.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Window slack, step change and early stop of the window search, and the thresholds.
WINDOW_EXTRA = 10
FINE_WINDOW = 80
GOOD_ENOUGH = 0.99
TITLE_THRESHOLD = 0.85
LOOSE_THRESHOLD = 0.70
EVIDENCE_THRESHOLD = 0.85
KEYWORD_THRESHOLD = 0.70
#: Bins that characters are counted in, a power of two.
BINS = 64


def pair_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def best_window(title: str, content: str, enough: float = GOOD_ENOUGH, floor: float = 0.0) -> float:
    """Best ratio of the title with a window of the content; values at or below ``floor`` may be reported as 0.

    The shared characters of title and window bound the ratio from above, and
    are kept up to date while the window slides, so most windows are skipped.
    """
    if not title or not content:
        return 0.0
    width = min(len(content), len(title) + WINDOW_EXTRA)
    step = 1 if width < FINE_WINDOW else 2
    need = Counter(title)
    have = Counter(content[:width])
    shared = sum(min(n, have[c]) for c, n in need.items())
    whole = len(title) + width
    matcher = SequenceMatcher(None)
    matcher.set_seq1(title)
    best = 0.0
    last = max(1, len(content) - width + 1)
    for at in range(last):
        if at:
            gone, came = content[at - 1], content[at + width - 1]
            if have[gone] <= need[gone]:
                shared -= 1
            have[gone] -= 1
            if have[came] < need[came]:
                shared += 1
            have[came] += 1
        if at % step:
            continue
        if 2.0 * shared / whole <= max(best, floor):
            continue
        matcher.set_seq2(content[at:at + width])
        best = max(best, matcher.ratio())
        if best >= enough:
            break
    return best if best > floor else 0.0


def _char_counts(texts: list[str]) -> np.ndarray:
    """How many characters of each text fall on each of ``BINS`` bins, at most 65,535."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.repeat(np.arange(len(texts), dtype=np.int64) * BINS, sizes) + (codes & (BINS - 1))
    return np.minimum(np.bincount(at, minlength=len(texts) * BINS), 0xFFFF).astype(np.uint16).reshape(-1, BINS)


def shared_bound(titles: list[str], contents: list[str]) -> np.ndarray:
    """The largest window ratio that the characters of title and content allow, whatever their order."""
    if not titles:
        return np.zeros(0)
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (titles, contents))
    shared = np.minimum(_char_counts(titles), _char_counts(contents)).sum(axis=1, dtype=np.int64)
    whole = n + np.minimum(m, n + WINDOW_EXTRA)
    # Counts that stop at the limit say nothing.
    return np.where((n == 0) | (m == 0), 0.0, np.where(n >= 0xFFFF, 1.0, 2.0 * np.minimum(shared, n) / np.maximum(whole, 1)))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else pair_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _window(t: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else best_window(x, y) for x, y in zip(t, c)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _window_above(t: pd.Series, c: pd.Series, low: pd.Series) -> pd.Series:
    # Just below the threshold counts as the floor, so that a ratio equal to it survives.
    out = np.full(len(t), np.nan)
    known = np.flatnonzero((t.notna() & c.notna()).to_numpy())
    titles, contents, floors = list(t.iloc[known]), list(c.iloc[known]), low.to_numpy()[known] - 1e-9
    # Most pairs lack the characters: they are told apart a slice at a time, without a look at their windows.
    for begin in range(0, len(known), 1024):
        end = begin + 1024
        able = shared_bound(titles[begin:end], contents[begin:end]) > floors[begin:end]
        out[known[begin:end]] = 0.0
        for i in (begin + np.flatnonzero(able)).tolist():
            out[known[i]] = best_window(titles[i], contents[i], GOOD_ENOUGH, floors[i])
    return pd.Series(out)


def ratio(a: Column, b: Column, empties: float = 0.0) -> Column:
    """2M/T. One empty side gives 0; two empty sides give ``empties``."""
    known = (F.length(a) > 0) & (F.length(b) > 0)
    both = (F.length(a) == 0) & (F.length(b) == 0)
    return (F.when(both, F.lit(empties)).when(~known, F.lit(0.0)).when(a == b, F.lit(1.0))
            .otherwise(_ratio(F.when(known & (a != b), a), F.when(known & (a != b), b))))


def length_bound(a: Column, b: Column) -> Column:
    """The largest ratio the two lengths allow."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb > 0, 2.0 * F.least(la, lb) / (la + lb)).otherwise(0.0)


def window_bound(title: Column, content: Column) -> Column:
    """The largest window ratio the two lengths allow."""
    lt = F.length(title)
    width = F.least(F.length(content), lt + WINDOW_EXTRA)
    return F.when((lt > 0) & (width > 0), 2.0 * F.least(lt, width) / (lt + width)).otherwise(0.0)


def window_ratio(title: Column, content: Column) -> Column:
    """Best ratio of the title with a window of the content; 0 when a side is empty."""
    known = (F.length(title) > 0) & (F.length(content) > 0)
    return F.when(known, _window(F.when(known, title), F.when(known, content))).otherwise(0.0)


def window_ratio_above(title: Column, content: Column, low: float) -> Column:
    """Window ratio where it can reach ``low``; below that it may read 0. Pairs the lengths rule out skip Python."""
    able = window_bound(title, content) >= low
    return F.when(able, _window_above(F.when(able, title), F.when(able, content), F.lit(low))).otherwise(0.0)


def contains(title: Column, content: Column) -> Column:
    """Containment of normalised texts; an empty side never matches."""
    return (F.length(title) > 0) & (F.length(content) > 0) & content.contains(title)


def title_contained(title: Column, content: Column, threshold: float = TITLE_THRESHOLD) -> Column:
    """Normalised title contained in, or close enough to a window of, the normalised content.

    Rows settled by containment pass nulls to the UDF and cost nothing there.
    """
    inside = contains(title, content)
    close = window_ratio_above(F.when(~inside, title), F.when(~inside, content), threshold) >= threshold
    return inside | F.coalesce(close, F.lit(False))
