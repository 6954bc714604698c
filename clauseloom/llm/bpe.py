"""Byte-pair encoding and decoding with a public vocabulary file."""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's word memory before its older half goes. It saves time only; results don't depend on it.
REMEMBERED = 150_000
#: Documents to an output batch.
ROWS = 256


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 characters for themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Memory:
    """A dictionary that forgets: two halves, of which the older is dropped when the newer is full."""

    def __init__(self, limit: int = REMEMBERED):
        self.new: dict = {}
        self.old: dict = {}
        self.limit = limit

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Bpe:
    """A byte-level BPE vocabulary with a word-end mark, read from its JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[left], self.vocab[right]] = rank, self.vocab[left.removesuffix(self.suffix) + right if self.suffix else left + right]
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.suffix] for c in letters]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.strings = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = text
        self.known_words, self.known_pieces = _Memory(), _Memory()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word. Candidate pairs wait in a queue by (rank, position); symbols are a linked list over positions.

        A queue entry is stale if its left symbol was merged away or the pair there has changed since; such entries are skipped.
        """
        ids = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        queue = [(found[0], i, found[1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j]), (0, -1))[1] != new:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, found[1]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> bytes:
        out = []
        # Character by character, capital sigma has one small form; only whole strings know a final one.
        for word in self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()):
            ids = self.known_words.get(word)
            if ids is None:
                ids = np.array(self.merge(word.encode()), "<u4").tobytes()
                self.known_words.put(word, ids)
            out.append(ids)
        return b"".join(out)

    def piece(self, piece: bytes) -> bytes:
        """Ids of a run without ASCII white space. No word spans white space, so runs are encoded one by one."""
        text = piece.decode()
        if self.special_pattern is None or "<" not in text:
            return self._plain(text)
        return b"".join(np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._plain(part)
                        for part in self.special_pattern.split(text))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers. The file's own special strings get their ids."""
        known, out = self.known_pieces, []
        new = known.new
        for piece in text.encode().split():
            ids = new.get(piece)
            if ids is None:
                ids = known.get(piece)
                if ids is None:
                    ids = self.piece(piece)
                    known.put(piece, ids)
                new = known.new
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings, with a space between, as the file names no decoder of its own."""
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit numbers) and decoded (text) for every row of ``docs`` (doc_id, text, any others).

    Null and empty texts have no ids and decode to the empty text. Texts of any length are encoded whole. Rows are independent
    and no shuffle is needed; a task holds one small batch of outputs. ``path`` must exist on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, ROWS):
                ids = [bpe.encode(t.as_py() or "") for t in texts[at:at + ROWS]]
                yield pa.record_batch([keys[at:at + ROWS], pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())],
                                      ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
