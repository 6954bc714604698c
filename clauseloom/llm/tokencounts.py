"""Exact token counts of every prefix of a text, by dynamic programming over a BPE vocabulary with word-end marks.

A chain of tokens is the encoding of its symbols exactly if each neighbouring pair of tokens stays apart when it is encoded alone.
So the last token of a prefix is the one vocabulary entry that ends there and stays apart from the last token of the prefix before
it, and its count is one more. All prefixes of a word cost one pass; nothing is encoded twice to learn a shorter prefix.
"""

from __future__ import annotations

import array
import functools
import math
import operator
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.bpe import Bpe

#: Entries of each of a worker's memories, and the longest entry kept there. They save time only.
REMEMBERED, LONGEST_KEPT = 700_000, 96
#: Code points to an output batch; a longer text is a batch of its own.
BATCH = 1 << 20

_SPACES = r" \t\n\r\x0b\x0c"
_RUN = re.compile(f"[^{_SPACES}]+[{_SPACES}]?|[{_SPACES}]")


class _Steps(dict):
    """What each piece of text adds to the counts, code point by code point, as 32-bit numbers; it forgets all when it is full."""

    def __init__(self, counts: Callable[[str], list[int]], spaces: set[str]):
        super().__init__()
        self.counts, self.spaces = counts, spaces

    def __missing__(self, piece: str) -> bytes:
        # A word with a space behind it differs from the word by a prefix that adds nothing.
        word = self.get(piece[:-1]) if piece[-1] in self.spaces else None
        if word is not None:
            found = word + bytes(4)
        else:
            counts = self.counts(piece)
            found = array.array("i", map(operator.sub, counts, [0, *counts])).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found


class Prefixes:
    """The tables of one vocabulary file, and the recurrence over them."""

    def __init__(self, path: str):
        bpe = Bpe(path)
        self.merges, self.words, self.special, self.special_pattern = bpe.merges, bpe.words, bpe.special, bpe.special_pattern
        if any(_RUN.match(s).end() != len(s) or s[-1].isspace() for s in self.special):
            raise ValueError("special strings with white space are not supported")
        known = {i: (bytes([b]), False) for b, i in enumerate(bpe.inner)} | {i: (bytes([b]), True) for b, i in enumerate(bpe.final)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for (left, right), (rank, new) in sorted(bpe.merges.items(), key=lambda m: m[1][0]):
            if left not in known or right not in known or new in known:
                raise ValueError(f"merge {rank} of {path} does not make one new symbol of earlier ones")
            self.parts[new] = left, right, rank
            known[new] = known[left][0] + known[right][0], known[right][1]
        self.apart = functools.lru_cache(1 << 20)(self._apart)
        #: Tokens by their bytes from the last to the first: a walk backwards from a position meets every token that ends there.
        self.back: dict[int, int] = {}
        sound = {i for i in known if i not in self.parts}
        for token, (left, right, _) in self.parts.items():
            if left in sound and right in sound and self._meeting(left, right) == (left, right):
                sound.add(token)
        at = {False: {}, True: {}}
        for token in sound:
            data, closed = known[token]
            node = 0
            for byte in reversed(data):
                node = self.back.setdefault(node << 8 | byte, len(self.back) + 1)
            at[closed][node] = token
        #: The token that goes on, and the one that ends a word, at each node of that walk; negative: none.
        self.opening, self.closing = ([at[closed].get(node, -1) for node in range(len(self.back) + 1)] for closed in (False, True))
        self.pieces = regex.compile(rf"(?:{self.words.pattern})\s?|\s")
        self.spaces = {c for c in map(chr, range(0x3001)) if regex.match(r"\s", c)}
        # For texts of ASCII alone the same classes can be written for the faster library.
        plain = self.words.pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(r"\s", _SPACES)
        self.ascii_pieces = self.pieces if "\\p" in plain else re.compile(f"(?:{plain})[{_SPACES}]?|[{_SPACES}]")
        self.known_pieces, self.known_runs = _Steps(self._piece_counts, self.spaces), _Steps(self._run_counts, set())
        self.states: dict[int, _Prefix] = {}
        self.root, self.numbered = _Prefix(None, 0, 0, -1, 0, 0), 0
        self.root.number = 0

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols that stand at one edge of a token while it is built, each with the rank of the merge that takes it up."""
        found, until = [], math.inf
        while True:
            found.append((token, until))
            if token not in self.parts:
                return found[::-1]
            until, token = self.parts[token][2], self.parts[token][side]

    def _meeting(self, a: int, b: int) -> tuple[int, int] | None:
        """The first merge across the border when the symbols of ``a`` and ``b`` are encoded together, if any.

        Merges run by rank, the leftmost first among equals, and a symbol's merges have higher ranks than those that built it.
        """
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            merge = self.merges.get((x, y))
            if merge is not None and merge[0] < x_until and merge[0] <= y_until:
                return x, y
            if x_until == y_until == math.inf:
                return None
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _apart(self, a: int, b: int) -> bool:
        return self._meeting(a, b) is None

    def steps(self, text: str) -> np.ndarray:
        """For each code point, by how much the count of the prefix that ends with it exceeds the count of the one before."""
        small = _small(text)
        if len(small) == len(text) and unicodedata.is_normalized("NFC", text) and not any(s in text for s in self.special):
            split = self.ascii_pieces if small.isascii() else self.pieces
            return np.frombuffer(b"".join(map(self.known_pieces.__getitem__, split.findall(small))), "i4")
        return np.frombuffer(b"".join(map(self.known_runs.__getitem__, _RUN.findall(text))), "i4")

    def counts(self, text: str) -> np.ndarray:
        """The number of tokens of each non-empty prefix, by code points."""
        return np.cumsum(self.steps(text), dtype=np.int32)

    def _run_counts(self, run: str) -> list[int]:
        """Counts of the prefixes of a run without ASCII white space but at its end.

        A special string counts as one token from its last character on; before that its characters are plain text.
        """
        if self.special_pattern is None or not any(s in run for s in self.special):
            return self._plain_counts(run)
        out, base, at = [], 0, 0
        for m in self.special_pattern.finditer(run):
            plain = self._plain_counts(run[at:m.end() - 1])
            out += [base + n for n in plain]
            before = m.start() - at
            base += (plain[before - 1] if before else 0) + 1
            out.append(base)
            at = m.end()
        return out + [base + n for n in self._plain_counts(run[at:])]

    def _plain_counts(self, text: str) -> list[int]:
        if unicodedata.is_normalized("NFC", text):
            return self._normal_counts(text)
        # A prefix is normalised by itself. It differs from the normalised whole only within its last cluster of characters.
        out: list[int] = []
        line = _Line(self)
        starts = [i for i, c in enumerate(text) if i == 0 or not (unicodedata.combining(c) or c in _joining())]
        for start, end in zip(starts, [*starts[1:], len(text)]):
            for i in range(start + 1, end):
                trial = line.fork()
                trial.add(_small(unicodedata.normalize("NFC", text[start:i])))
                out.append(trial.count())
            line.add(_small(unicodedata.normalize("NFC", text[start:end])))
            out.append(line.count())
        return out

    def _piece_counts(self, piece: str) -> list[int]:
        """Counts of the prefixes of one normalised word, with or without a space character behind it."""
        word = piece[:-1] if piece[-1] in self.spaces else piece
        counts = self._word_counts(word) if word else [0]
        return counts if word == piece or not word else [*counts, counts[-1]]

    def _normal_counts(self, text: str) -> list[int]:
        small = _small(text)
        ends = range(len(small)) if len(small) == len(text) else np.cumsum([len(_small(c)) for c in text]) - 1
        out, total, at = [], 0, 0
        for m in self.words.finditer(small):
            out += [total] * (m.start() - at)
            counts = self._word_counts(m.group())
            out += [total + n for n in counts]
            total += counts[-1]
            at = m.end()
        out += [total] * (len(small) - at)
        return out if len(small) == len(text) else [out[i] for i in ends]

    def _word_counts(self, word: str) -> list[int]:
        if len(word) > 1 and word[0] == "'" and word[1].isalpha():
            # A contraction is one word only when it is complete.
            found = [sum(self._word_counts(part)[-1] for part in self.words.findall(word[:n])) for n in range(1, len(word))]
            return [*found, self._closed_counts(word)[-1]]
        return self._closed_counts(word)

    def _closed_counts(self, word: str) -> list[int]:
        """The counts of a word's prefixes, each taken for a whole word."""
        at, out, states, following = self.root, [], self.states, self.next
        if word.isascii():
            for byte in word.encode():
                at = states.get(at.number << 8 | byte) or following(at, byte)
                out.append(at.closed)
            return out
        for c in word:
            for byte in c.encode():
                at = states.get(at.number << 8 | byte) or following(at, byte)
            out.append(at.closed)
        return out

    def next(self, at: _Prefix, byte: int) -> _Prefix:
        """The prefix that is one byte longer. Words share the states of the beginnings that they share."""
        key = at.number << 8 | byte
        found = self.states.get(key)
        if found is None:
            found = self._longer(at, byte)
            if len(self.states) >= REMEMBERED:
                self.states.clear()
            if at.depth < LONGEST_KEPT and at.number >= 0:
                found.number = self.numbered = self.numbered + 1
                self.states[key] = found
        return found

    def _longer(self, at: _Prefix, byte: int) -> _Prefix:
        """The recurrence: walk back over the bytes and the states before them, along the tokens that may end here."""
        back, opening, closing, apart = self.back, self.opening, self.closing, self.apart
        opened, closed = [], []
        node, before = back.get(byte), at
        while node is not None:
            if opening[node] >= 0:
                opened.append((opening[node], before))
            if closing[node] >= 0:
                closed.append((closing[node], before))
            if not before.depth:
                break
            node, before = back.get(node << 8 | before.byte), before.before
        for last, before in reversed(opened):
            if not before.depth or apart(before.last, last):
                break
        kept = before.kept + 1
        for token, before in reversed(closed):
            if not before.depth or apart(before.last, token):
                break
        return _Prefix(at, byte, at.depth + 1, last, kept, before.kept + 1)


class _Prefix:
    """A prefix of a word: the last token and the number of tokens if the word goes on, and the number if it ends here."""

    __slots__ = ("before", "byte", "closed", "depth", "kept", "last", "number")

    def __init__(self, before: _Prefix | None, byte: int, depth: int, last: int, kept: int, closed: int):
        self.before, self.byte, self.depth, self.last, self.kept, self.closed = before, byte, depth, last, kept, closed
        #: Negative: not among the remembered states.
        self.number = -1


class _Line:
    """Counts over a growing normalised text: whole words so far, and the state of the last one."""

    def __init__(self, prefixes: Prefixes):
        self.prefixes, self.before, self.word, self.at = prefixes, 0, "", prefixes.root

    def fork(self) -> _Line:
        copy = _Line(self.prefixes)
        copy.before, copy.word, copy.at = self.before, self.word, self.at
        return copy

    def add(self, more: str) -> None:
        words = self.prefixes.words
        for c in more:
            # Words are runs of one class, save contractions, which begin at an apostrophe; so few characters tell whether c goes on.
            if self.word and self.word[0] == "'" and len(self.word) < 4:
                whole = self.word + c
                if words.fullmatch(whole, partial=True) is None:
                    self._settle(words.findall(whole), whole)
                    continue
            elif self.word and words.fullmatch(self.word[-1].replace("'", "!") + c) is None:
                self.before, self.word, self.at = self.count(), "", self.prefixes.root
                if not words.match(c):
                    continue
            elif not self.word and not words.match(c):
                continue
            self._append(c)

    def _settle(self, parts: list[str], whole: str) -> None:
        """Start again behind the words that are complete, at the one that the last character belongs to."""
        done = parts if not parts or not whole.endswith(parts[-1]) else parts[:-1]
        self.before += sum(self.prefixes._word_counts(p)[-1] for p in done)
        self.word, self.at = "", self.prefixes.root
        if len(done) < len(parts):
            for c in parts[-1]:
                self._append(c)

    def _append(self, c: str) -> None:
        # Only the first three and the last character of a word matter for what follows.
        self.word = self.word + c if len(self.word) < 4 else self.word[:3] + c
        for byte in c.encode():
            self.at = self.prefixes.next(self.at, byte)

    def count(self) -> int:
        if self.word[:1] == "'" and len(self.word) < 4:
            return self.before + sum(self.prefixes._word_counts(p)[-1] for p in self.prefixes.words.findall(self.word))
        return self.before + self.at.closed


def _small(text: str) -> str:
    """Lower case, character by character: a capital sigma has one small form."""
    return text.replace("Σ", "σ").lower()


@functools.cache
def _joining() -> frozenset[str]:
    """Characters that normalisation may join to the one before though they are no combining marks: vowel and final Hangul
    letters, and second halves of canonical decompositions."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0x110000):
        pair = unicodedata.decomposition(chr(c)).split()
        if len(pair) == 2 and not pair[0].startswith("<"):
            found.add(chr(int(pair[1], 16)))
    return frozenset(found)


@functools.lru_cache(maxsize=2)
def prefixes(path: str) -> Prefixes:
    return Prefixes(path)


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and ``counts`` for every row of ``docs`` (doc_id, text, any others).

    ``counts[i]`` is the exact number of tokens of the first i + 1 code points of the text, special strings as the library's
    default takes them. Null and empty texts have an empty array; the null text stays null. Rows are independent: repeated and
    null doc_ids are rows like others, nothing is shuffled, and a task holds one output batch of about a million code points or
    one longer text. ``path`` must exist on the executors. Kept as a table, the counts answer questions by ``tokens_in_prefix``,
    ``longest_prefix`` and ``truncated`` without the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefixes(path)
        for batch in batches:
            texts = batch.column(1)
            begin, size, waiting = 0, 0, []
            for at, text in enumerate(texts):
                waiting.append(table.counts(text.as_py() or ""))
                size += len(waiting[-1])
                if size >= BATCH or at == batch.num_rows - 1:
                    offsets = np.cumsum([0, *map(len, waiting)], dtype=np.int32)
                    counts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(waiting)))
                    part = batch.slice(begin, at + 1 - begin)
                    yield pa.record_batch([part.column(0), part.column(1), counts], ["doc_id", "text", "counts"])
                    begin, size, waiting = at + 1, 0, []

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, counts array<int>")


def tokens_in_prefix(counts: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points; of the whole text, if it has fewer."""
    last = F.least(F.size(counts), chars.cast("int"))
    return F.when(last < 1, F.lit(0)).otherwise(F.coalesce(F.try_element_at(counts, last), F.lit(0)))


def longest_prefix(counts: Column, budget: int) -> Column:
    """Code points of the longest prefix that has at most ``budget`` tokens. Counts may fall as a word is completed, so a longer
    prefix may fit where a shorter one does not."""
    fits = F.transform(counts, lambda n, i: F.when(n <= budget, i + 1))
    return F.coalesce(F.array_max(fits), F.lit(0))


def truncated(counted: DataFrame, budget: int) -> DataFrame:
    """doc_id, the text cut to the longest prefix of at most ``budget`` tokens, and that prefix's n_tokens, from ``prefix_counts``."""
    keep = longest_prefix(F.col("counts"), budget)
    return counted.select("doc_id", F.substring(F.col("text"), F.lit(1), keep).alias("text"),
                          tokens_in_prefix(F.col("counts"), keep).cast("long").alias("n_tokens"))


def digests(counted: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) from ``prefix_counts``."""
    n_tokens = tokens_in_prefix(F.col("counts"), F.size("counts")).cast("long")
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens.alias("n_tokens"),
                          (n_tokens > limit).alias("over_limit"))
