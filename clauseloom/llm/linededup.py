"""Fuzzy line deduplication: MinHash over character shingles, banding, exact verification, union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import free_name
from clauseloom.llm.components import components
from clauseloom.operators.scan import with_range_chunk
from clauseloom.session import discard, materialize

#: Characters to a shingle; bands and rows of the signature: lines of similarity 0.8 share a band with probability 0.998.
SHINGLE, BANDS, BAND_ROWS = 5, 12, 4
SIMILARITY = 0.8
#: Of the 48 signature values so many agree, or a pair is not compared as text. At similarity 0.8 the chance to agree less is below 1e-5.
AGREE = 24
#: Entries of a bucket are told apart by two bits of each of the 48 values: so many agree, or lines are no partners. At similarity 0.8 the
#: chance to agree less is below 1e-5 as well.
SKETCH_AGREE = 29
#: A bucket of up to so many lines is compared pair by pair, by signatures inside a task; larger ones are dealt into blocks of DEALT lines,
#: which meet in pairs. With more than CROWDED pairs that agree to a line, lines are compared as sets in blocks of BLOCK; COLUMNS shingles
#: of a block are counted at once.
MANY, CROWDED = 1024, 8
DEALT = 16384
BLOCK, COLUMNS = 1024, 2048
#: Runs of up to so many lines are compared by shifting them, larger ones as tables of so many cells at a time.
SHIFTED, CELLS = 32, 32768
#: Characters that are hashed at a time.
CACHED = 60_000
#: Lines whose first places a task remembers; forgetting them costs time only.
REMEMBERED = 200_000
#: The most bits of a map that tells a pass over documents or lines which lines are wanted. It may err on the side of too many.
MAP_BITS = 27
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 2**32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
_ADDENDS = _RNG.integers(0, 2**32, BANDS * BAND_ROWS, dtype=np.uint32)


def normal_form(line: str) -> str:
    """What lines are compared by: lower case, runs of white space as one space."""
    line = line.lower()
    if "  " not in line and line.isprintable() and line[:1] != " " and line[-1:] != " ":  # its only white space is single spaces inside
        return line
    return " ".join(line.split())


def shingles(line: str) -> set[str]:
    """Of a line in normal form; a line under one shingle is one shingle."""
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similar(a: set[str], b: set[str], least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    common = len(a & b)
    return common >= least * (len(a) + len(b) - common)


def signatures(lines: list[str]) -> np.ndarray:
    """One row per line in normal form: a number per band, which holds the low 16 bits of four minima. Lines are hashed side by side, as
    many at a time as stay in the processor's cache."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    out = np.zeros((len(lines), BANDS * BAND_ROWS), np.uint16)
    group = np.cumsum(sizes) // CACHED
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(lines)]
    for begin, end in zip(cuts, cuts[1:]):
        if begin < end:
            _minima(padded[begin:end], sizes[begin:end], out[begin:end])
    return out.view(np.int64)


def _minima(lines: list[str], sizes: np.ndarray, out: np.ndarray) -> None:
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends, places = np.cumsum(sizes), len(codes) - SHINGLE + 1
    mixed = codes[:places].copy()
    for k in range(1, SHINGLE):
        mixed *= np.uint64(0x100000001B3)
        mixed += codes[k:places + k]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    # Shingles that reach over the end of a line are left out.
    inside = np.ones(places, bool)
    inside[(ends[:-1, None] - np.arange(1, SHINGLE)[None, :]).ravel()] = False
    hashes = (mixed >> np.uint64(32)).astype(np.uint32)[inside]
    starts = ends - sizes - (SHINGLE - 1) * np.arange(len(lines))
    values = np.empty_like(hashes)
    for i in range(BANDS * BAND_ROWS):
        np.multiply(hashes, _FACTORS[i], out=values)
        values += _ADDENDS[i]
        out[:, i] = np.minimum.reduceat(values, starts)  # the low 16 bits


def agreement(a: str, b: str) -> Column:
    """In how many of their values two signatures agree."""
    total = F.lit(0)
    for band in range(BANDS):
        differ = F.col(a)[band].bitwiseXOR(F.col(b)[band])
        for row in range(BAND_ROWS):
            total = total + (F.shiftrightunsigned(differ, 16 * row).bitwiseAND(F.lit(0xFFFF)) == 0).cast("int")
    return total


def _packed(line: str) -> np.ndarray | None:
    """The distinct shingles of a line as sorted numbers that hold their characters; None if these are too many bits, or for one short shingle."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < SHINGLE or codes.max() >> 12:
        return None
    codes = codes.astype(np.uint64)
    packed = codes[:len(codes) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        packed <<= np.uint64(12)
        packed |= codes[k:len(codes) - SHINGLE + 1 + k]
    packed.sort()
    return packed[np.concatenate([[True], packed[1:] != packed[:-1]])]


def _similar_packed(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = np.count_nonzero(both[1:] == both[:-1])
    return common >= least * (len(a) + len(b) - common)


def digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _lines(text: str) -> Iterator[tuple[int, str]]:
    """Position and normal form of the lines that have anything but ASCII white space."""
    for i, line in enumerate(text.split("\n")):
        if line.strip(" \t\n\v\f\r"):
            yield i, normal_form(line) or line


def _slot(row, pos):
    """A number for a line's place that fits a long; works on columns and on numbers."""
    part, own = (F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))) if isinstance(row, Column) else (row >> 33, row & (1 << 33) - 1)
    return part * 1000003 + own * 7919 + pos * 31


def _document_lines(docs: DataFrame) -> DataFrame:
    """(id, row, doc_id, pos, sig) of the lines; ``id`` is a digest of its normal form, ``row`` the number of its row.

    Of a line that a task meets again only a smaller (doc_id, row, pos) comes out; ``REMEMBERED`` lines are known at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, tuple] = {}

        def flush(rows, keys, places, lines):
            first: dict[str, tuple] = {}
            for line, row, key, place in zip(lines, rows, keys, places):
                at = (key is not None, key or 0, row, place)  # null is the least, as it is in Spark
                if line not in first or at < first[line]:
                    first[line] = at
            if len(least) > REMEMBERED:
                least.clear()
            ids = {}
            for line, at in first.items():
                own = digest(line)
                if own not in least or at < least[own]:
                    least[own], ids[line] = at, own
            sigs = signatures(list(ids))
            lists = pa.ListArray.from_arrays(np.arange(0, sigs.size + 1, BANDS, dtype=np.int32), pa.array(sigs.ravel()))
            found = [first[x] for x in ids]
            return pa.record_batch([pa.array(list(ids.values()), pa.binary()), pa.array([x[2] for x in found], pa.int64()),
                                    pa.array([x[1] if x[0] else None for x in found], pa.int64()),
                                    pa.array([x[3] for x in found], pa.int32()), lists], ["id", "row", "doc_id", "pos", "sig"])

        for batch in batches:
            rows, keys, places, lines, held = [], [], [], [], 0
            for row, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for i, line in _lines(text.as_py() or ""):
                    lines.append(line)
                    rows.append(row)
                    keys.append(key)
                    places.append(i)
                    held += len(line)
                    if held > 500_000:
                        yield flush(rows, keys, places, lines)
                        rows, keys, places, lines, held = [], [], [], [], 0
            if lines:
                yield flush(rows, keys, places, lines)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "id binary, row long, doc_id long, pos int, sig array<long>")


def _bit_map(wanted: DataFrame, slot: Column) -> tuple[np.ndarray, int]:
    """A map of the ``slot`` of each row of ``wanted``, as 32-bit words, and its number of bits, which is bounded."""
    bits = min(MAP_BITS, max(16, (16 * wanted.count()).bit_length()))
    words = wanted.select((slot % (1 << bits)).alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(p & 31))")).alias("m")).toArrow()
    marks = np.zeros(1 << (bits - 5), np.uint32)
    marks[words["w"].to_numpy()] = words["m"].to_numpy()
    return marks, bits


def _marked(marks: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return marks[slots >> 5] >> (slots & 31).astype(np.uint32) & np.uint32(1) != 0


def _members(lines: DataFrame, partners: DataFrame) -> DataFrame:
    """(nid, row, pos, sig) of the ``lines`` that are among ``partners``. A bit map of these leaves out most others before the join."""
    marks, bits = _bit_map(partners, _slot(F.col("nid"), 0))
    shared = lines.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            slots = (_slot(batch.column(0).to_numpy(), 0) % (1 << bits)).astype(np.int64)
            yield batch.filter(pa.array(_marked(marks, slots)))

    near = lines.select("nid", "row", "pos", "sig").mapInArrow(run, "nid long, row long, pos int, sig array<long>")
    return near.join(partners.select("nid").distinct(), "nid", "left_semi")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(nid, line) in normal form for ``wanted`` (nid, row, pos), the lines' places in ``docs``.

    Instead of moving the documents to the lines that are asked for, a bit map of their places goes to the documents: its size is
    bounded, and lines that pass by chance are left out by the join. Other lines are not brought to normal form again.
    """
    marks, bits = _bit_map(wanted, _slot(F.col("row"), F.col("pos")))
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, places, lines = [], [], []
                for row, text in zip(batch.column(0)[at:at + 256].to_pylist(), batch.column(1)[at:at + 256]):
                    own = (text.as_py() or "").split("\n")
                    slots = (_slot(row, np.arange(len(own), dtype=np.int64)) % (1 << bits)).astype(np.int64)
                    for i in np.flatnonzero(_marked(marks, slots)).tolist():
                        if own[i].strip(" \t\n\v\f\r"):
                            rows.append(row)
                            places.append(i)
                            lines.append(normal_form(own[i]) or own[i])
                yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(lines, pa.string())], ["row", "pos", "line"])

    found = docs.select(F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, "row long, pos int, line string")
    return found.join(wanted.select("nid", "row", "pos"), ["row", "pos"]).select("nid", "line")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) whose lines' shingle sets have a Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, packed = None, "", None
        for batch in batches:
            lines, others, keep = batch.column(2), batch.column(3), []
            for i, other in enumerate(batch.column(1).to_pylist()):
                if other != last:  # rows come sorted by b
                    last, own = other, others[i].as_py()
                    packed = _packed(own)
                line = lines[i].as_py()
                numbers = None if packed is None else _packed(line)
                keep.append(similar(shingles(line), shingles(own), least) if numbers is None else _similar_packed(numbers, packed, least))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("nid").alias("a"), F.col("line").alias("line_a"))
    two = texts.select(F.col("nid").alias("b"), F.col("line").alias("line_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "line_a", "line_b").sortWithinPartitions("b").mapInArrow(run, "a long, b long")


def _planes(sigs: np.ndarray) -> np.ndarray:
    """Four numbers to a signature: the lowest, second, third and fourth bit of each of its values. Values that are equal have equal bits,
    so signatures that differ in more of these bits' places than allowed need not be compared in full."""
    out = np.zeros((4, len(sigs), 8), np.uint8)
    for k in range(4):
        out[k, :, :BANDS * BAND_ROWS // 8] = np.packbits(sigs >> np.uint16(k) & np.uint16(1) != 0, axis=1)
    return out.view(np.uint64)[..., 0]


def _near_cells(planes: np.ndarray, one: slice, two: slice, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns, counted from the slices' begins, whose ``planes`` differ in ``most`` places or fewer."""
    differ = planes[0, one, None] ^ planes[0, None, two]
    for plane in planes[1:]:
        differ |= plane[one, None] ^ plane[None, two]
    return np.divmod(np.flatnonzero(np.bitwise_count(differ) <= most), differ.shape[1])


def _near_rows(planes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs inside runs, given by their first rows and sizes, whose ``planes`` differ in ``most`` places or fewer."""
    small = sizes <= SHIFTED
    few = sizes[small]
    left = np.repeat(starts[small] - np.cumsum(few) + few, few) + np.arange(few.sum())
    ends, step, ones, twos = np.repeat(starts[small] + few, few), 1, [], []
    while (more := left + step < ends).any():
        left, ends = left[more], ends[more]
        differ = planes[0, left] ^ planes[0, left + step]
        for plane in planes[1:]:
            differ |= plane[left] ^ plane[left + step]
        one = left[np.bitwise_count(differ) <= most]
        ones.append(one)
        twos.append(one + step)
        step += 1
    for begin, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
        step = max(1, CELLS // size)
        for at in range(begin, begin + size, step):
            i, j = _near_cells(planes, slice(at, min(at + step, begin + size)), slice(at, begin + size), most)
            ones.append(i[i < j] + at)
            twos.append(j[i < j] + at)
    one, two = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ones, twos))
    return one, two


def _equal_values(sigs: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many values the signatures of two rows agree, for a few rows at a time."""
    return np.concatenate([np.zeros(0, np.int64), *((sigs[one[k:k + CELLS]] == sigs[two[k:k + CELLS]]).sum(axis=1) for k in range(0, len(one), CELLS))])


def _agreeing(bands: np.ndarray, labels: np.ndarray, sigs: np.ndarray, agree: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the pairs whose labels differ and whose signatures agree, and the first rows of crowded buckets, which give no pairs."""
    starts = np.flatnonzero(np.concatenate([[True], bands[1:] != bands[:-1]]))
    sizes = np.diff(np.append(starts, len(bands)))
    bucket = np.repeat(np.arange(len(starts)), sizes)
    one, two = _near_rows(_planes(sigs), starts, sizes, sigs.shape[1] - agree)
    stay = labels[one] != labels[two]
    one, two = one[stay], two[stay]
    stay = _equal_values(sigs, one, two) >= agree
    one, two = one[stay], two[stay]
    crowded = np.bincount(bucket[one], minlength=len(starts)) > most * sizes
    stay = ~crowded[bucket[one]]
    return one[stay], two[stay], starts[crowded]


def _bucket_pairs(entries: DataFrame) -> DataFrame:
    """(band, a, b) for ``entries`` (band, nid, label, sig): pairs of a bucket whose labels differ and whose signatures agree in ``AGREE``
    values or more. Only these become rows. A crowded bucket gives its band alone."""
    agree, most = AGREE, CROWDED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(bands, nids, labels, sigs):
            one, two, crowded = _agreeing(bands, labels, sigs, agree, most)
            a, b = nids[one], nids[two]
            none = pa.nulls(len(crowded), pa.int64())
            return pa.record_batch([pa.array(np.concatenate([bands[one], bands[crowded]])),
                                    pa.concat_arrays([pa.array(np.minimum(a, b)), none]), pa.concat_arrays([pa.array(np.maximum(a, b)), none])],
                                   ["band", "a", "b"])

        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                new = [part.column(i).to_numpy() for i in range(3)]
                new.append(part.column(3).flatten().to_numpy().reshape(-1, BANDS).view(np.uint16))
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
                if cut:
                    yield pairs(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if held is not None:
            yield pairs(*held)

    return entries.select("band", "nid", "label", "sig").repartition("band").sortWithinPartitions("band").mapInArrow(run, "band long, a long, b long")


def _sketch(first: int, last: int) -> Column:
    """The lowest two bits of each value of the bands from ``first`` to ``last``, a byte to a band."""
    out = F.lit(0).cast("long")
    for at, band in enumerate(range(first, last)):
        low = F.col("sig")[band].bitwiseAND(F.lit(0x0003000300030003))
        for shift in (14, 28, 42):
            low = low.bitwiseOR(F.shiftrightunsigned(F.col("sig")[band].bitwiseAND(F.lit(0x0003000300030003)), shift))
        out = out.bitwiseOR(F.shiftleft(low.bitwiseAND(F.lit(0xFF)), 8 * at))
    return out


def _roots(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest row that links between rows reach, for each of ``n`` rows."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[one], root[two])
        new = root.copy()
        np.minimum.at(new, root[one], least)
        np.minimum.at(new, root[two], least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _partners(entries: DataFrame) -> DataFrame:
    """(band, least, nid) of the ``entries`` (band, nid, s, t) that have a partner in their bucket.

    Buckets fall apart into groups connected by sketches that agree; ``least`` is the smallest line of the group. Lines that share a
    band by chance end here, so what goes on grows with the similar lines and not with the pairs that chance makes. Buckets of more
    than ``MANY`` lines go on whole, with ``least`` -1.
    """
    agree, many = SKETCH_AGREE, MANY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        even = np.uint64(0x5555555555555555)

        def rows(bands, leasts, nids):
            return pa.record_batch([pa.array(bands), pa.array(leasts), pa.array(nids)], ["band", "least", "nid"])

        def groups(bands, nids, s, t):
            order = np.lexsort((nids, bands))
            bands, nids, s, t = bands[order], nids[order], s[order], t[order]
            starts = np.flatnonzero(np.concatenate([[True], bands[1:] != bands[:-1]]))
            sizes = np.diff(np.append(starts, len(bands)))
            large = np.repeat(sizes > many, sizes)
            planes = np.stack([s & even | (t & even) << np.uint64(1), s >> np.uint64(1) & even | t & ~even])
            one, two = _near_rows(planes, starts[sizes <= many], sizes[sizes <= many], 4 * BANDS - agree)
            root = _roots(len(bands), one, two)
            stay = np.zeros(len(bands), bool)
            stay[one] = stay[two] = True
            stay |= large
            return rows(bands[stay], np.where(large, -1, nids[root])[stay], nids[stay])

        held, whole = None, None
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy().view(np.uint64)]
            if whole is not None:  # the rest of a large bucket
                end = int(np.searchsorted(new[0], whole, "right"))
                yield rows(new[0][:end], np.full(end, -1), new[1][:end])
                new = [x[end:] for x in new]
                if not len(new[0]):
                    continue
                whole = None
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
            if len(held[0]) - cut > many:
                whole, cut = held[0][-1], len(held[0])
            if cut:
                yield groups(*(x[:cut] for x in held))
                held = [x[cut:] for x in held] if cut < len(held[0]) else None
        if held is not None:
            yield groups(*held)

    return entries.repartition("band").sortWithinPartitions("band").mapInArrow(run, "band long, least long, nid long")


def _deal(entries: DataFrame) -> DataFrame:
    """``entries`` (band, nid) with ``blocks``, the number of blocks that the band's lines are cut into, and ``block``, the line's own."""
    sizes = entries.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("blocks"))
    return entries.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))


def _in_pairs(dealt: DataFrame, columns: list[str], compared, schema: str) -> DataFrame:
    """What ``compared`` makes of each pair of blocks of a band, and of each block alone, for rows from ``_deal`` with ``sig`` and ``columns``.

    It gets the band, the signatures, the columns as arrays, and how many rows are the first block's; a block alone is all rows. Each row
    goes to as many pairs as its band has blocks, so pairs of a bucket of any size are dealt over tasks.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = dealt.select("band", "block", "sig", *columns, other.alias("with")).select(
        F.xxhash64("band", F.least("block", "with"), F.greatest("block", "with")).alias("pair"), "band", "block", "sig", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(table):
            block = table.column(2).to_numpy()
            sigs = table.column(3).combine_chunks().flatten().to_numpy().reshape(-1, BANDS).view(np.uint16)
            return compared(table.column(1)[0].as_py(), sigs, *(table.column(4 + k).to_numpy() for k in range(len(columns))),
                            int(np.count_nonzero(block == block[0])))

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            pair = held.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            for begin, end in zip(starts.tolist(), starts.tolist()[1:]):
                yield one(held.slice(begin, end - begin))
            held = held.slice(starts[-1])  # the last pair may go on
        if held is not None and held.num_rows:
            yield one(held)

    return met.repartition("pair").sortWithinPartitions("pair", "block", "nid").mapInArrow(run, schema)


def _stars(dealt: DataFrame) -> DataFrame:
    """(a, b) for lines of large buckets: lines ``b`` by whose signatures others are found, and the lines ``a`` that agree with them.

    In each pair of blocks lines look for others in turn; a line that is found by one is not looked for again, nor looks for others, so
    there are at most as many rows as lines, whatever the size of a group.
    """
    agree, cells = AGREE, CELLS

    def compared(band, sigs, nids, n):
        planes, gone = _planes(sigs), np.zeros(len(sigs), bool)
        alone = n == len(sigs)
        left, leaders, members = np.arange(0 if alone else n, len(sigs)), [], []
        near, at = planes[:, left], 0
        while at < n and len(left):
            looking = np.arange(at, min(n, at + max(1, cells // len(left))))
            at = looking[-1] + 1
            looking = looking[~gone[looking]]
            both = np.concatenate([planes[:, looking], near], axis=1)
            i, j = _near_cells(both, slice(0, len(looking)), slice(len(looking), None), sigs.shape[1] - agree)
            one, two = looking[i], left[j]
            if alone:
                one, two = one[one < two], two[one < two]
            stay = _equal_values(sigs, one, two) >= agree
            found, first = np.unique(two[stay], return_index=True)  # pairs come in the order of their first rows
            leaders.append(one[stay][first])
            members.append(found)
            gone[found] = True
            if len(found) or alone:
                left = left[~gone[left] & (left >= at)] if alone else left[~gone[left]]
                near = planes[:, left]
        a, b = (nids[np.concatenate(x)] if x else nids[:0] for x in (members, leaders))
        return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return _in_pairs(dealt, ["nid"], compared, "a long, b long")


def _open_pairs(dealt: DataFrame) -> DataFrame:
    """(band, a, b, label) for lines (band, nid, label) of large buckets: pairs whose labels differ and whose signatures agree.

    Where a pair of blocks has more than ``CROWDED`` of them to a line, each of their lines comes out once instead, as ``a`` with its label.
    """
    agree, most, cells = AGREE, CROWDED, CELLS

    def compared(band, sigs, nids, labels, n):
        planes, alone = _planes(sigs), n == len(sigs)
        ones, twos, held, known = [], [], 0, np.zeros(len(sigs), bool)
        step = max(1, cells // max(1, len(sigs) if alone else len(sigs) - n))
        for at in range(0, n, step):
            begin = at if alone else n
            i, j = _near_cells(planes, slice(at, min(at + step, n)), slice(begin, None), sigs.shape[1] - agree)
            one, two = i + at, j + begin
            stay = (one < two) & (labels[one] != labels[two])
            one, two = one[stay], two[stay]
            stay = _equal_values(sigs, one, two) >= agree
            one, two = one[stay], two[stay]
            known[one] = known[two] = True
            held += len(one)
            if held > most * len(sigs):
                ones, twos = [], []
            else:
                ones.append(nids[one])
                twos.append(nids[two])
        if held > most * len(sigs):
            a, label = pa.array(nids[known]), pa.array(labels[known])
            b = pa.nulls(len(a), pa.int64())
        else:
            one, two = (np.concatenate(x) if x else nids[:0] for x in (ones, twos))
            a, b = pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))
            label = pa.nulls(len(a), pa.int64())
        return pa.record_batch([pa.array(np.full(len(a), band)), a, b, label], ["band", "a", "b", "label"])

    return _in_pairs(dealt, ["nid", "label"], compared, "band long, a long, b long, label long")


def _numbers(lines: list[str]) -> list[np.ndarray]:
    """The shingles of each line as distinct numbers, the same for equal shingles of these lines."""
    if any(ord(max(line)) >> 12 for line in lines):
        return [np.unique(np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in shingles(line)], np.uint64)) for line in lines]
    out = []
    for line in lines:
        packed = _packed(line)
        if packed is None:  # one short shingle, told from others by the top bits
            number = len(line) << 60
            for k, c in enumerate(line):
                number |= ord(c) << 12 * k
            packed = np.array([number], np.uint64)
        out.append(packed)
    return out


def _links_between(lines: list[str], labels: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels that reach ``least``, of the first ``n`` lines with the others; with themselves if there are no others.

    Common shingles of all pairs are counted by products of incidence matrices, ``COLUMNS`` shingles at a time.
    """
    sets = _numbers(lines)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    owner, item = owner[shared[item]], place[item[shared[item]]]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    alone = n == len(lines)
    common = np.zeros((n, n if alone else len(lines) - n), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        begin, end = np.searchsorted(item, [at, at + COLUMNS])
        held = np.zeros((len(lines), COLUMNS), np.float32)
        held[owner[begin:end], item[begin:end] - at] = 1
        common += held[:n] @ (held if alone else held[n:]).T
    ones, twos = np.arange(n), np.arange(n) if alone else np.arange(n, len(lines))
    total = sizes[ones][:, None] + sizes[twos][None, :] - common
    i, j = np.nonzero((common >= least * total) & (labels[ones][:, None] != labels[twos][None, :]))
    return ones[i], twos[j]


def _block_links(entries: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b) that connect what similar lines connect, for ``entries`` (band, nid, label) whose labels differ within their bands.

    Each band's lines are cut into blocks by label, and blocks meet in pairs, so a bucket of any size goes over many tasks and all its
    pairs of different labels are compared exactly, as sets. Of a pair of blocks no more links come out than it has lines.
    """
    dealt = with_range_chunk(entries, ["band"], ["label", "nid"], "chunk", "line-dealt")
    inside = Window.partitionBy("band", "chunk").orderBy("label", "nid")
    rows = dealt.withColumn("block", F.floor((F.row_number().over(inside) - 1) / BLOCK) + F.col("chunk").cast("long") * (1 << 32))
    rows = materialize(rows.select("band", "nid", "label", "block"), "line-blocks")
    blocks = rows.groupBy("band", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    other = blocks.select("band", F.col("block").alias("with"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = blocks.join(other, "band").where((F.col("block") <= F.col("with")) & (F.least("lo", "lo2") < F.greatest("hi", "hi2")))
    sides = meet.select("band", F.xxhash64("band", "block", "with").alias("pair"), F.explode(F.array_distinct(F.array("block", "with"))).alias("block"))
    joined = sides.join(rows, ["band", "block"]).join(texts, "nid").select("pair", "block", "nid", "label", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table):
            block, nids = table.column(1).to_numpy(), table.column(2).to_numpy()
            one, two = _links_between(table.column(4).to_pylist(), table.column(3).to_numpy(), int(np.count_nonzero(block == block[0])), least)
            root = _roots(len(nids), one, two)
            tied = np.flatnonzero(root != np.arange(len(nids)))
            return pa.record_batch([pa.array(nids[root[tied]]), pa.array(nids[tied])], ["a", "b"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            pair = held.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            for begin, end in zip(starts.tolist(), starts.tolist()[1:]):
                yield links(held.slice(begin, end - begin))
            held = held.slice(starts[-1])  # the last pair may go on
        if held is not None and held.num_rows:
            yield links(held)

    return joined.repartition("pair").sortWithinPartitions("pair", "block").mapInArrow(run, "a long, b long")


def line_groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(nid, doc_id, row, pos, label): the first place of each distinct line of ``docs``, and the label its group shares.

    Lines are grouped if links connect them; a link is a shared band and a verified similarity of ``least``. Lines that share a band
    by chance are told apart by two bits of each signature value, which each entry of a bucket carries (``_partners``). In each group of
    partners every line is compared with the smallest one first, so large groups of copies give as many pairs as lines, not as pairs of
    lines. Of the groups that these links leave in parts, all pairs are compared by their signatures, inside tasks. Buckets of more than
    ``MANY`` lines, which chance fills in a large table, are dealt into blocks that meet in pairs (``_stars``, ``_open_pairs``). Only lines
    of crowded buckets are compared as sets (``_block_links``).
    """
    # Tasks have left out their own copies, so nothing is combined, and sorted for it, before the shuffle.
    lines = _document_lines(docs).repartition("id").groupBy("id").agg(F.min(F.struct("doc_id", "row", "pos")).alias("at"), F.first("sig").alias("sig"))
    lines = materialize(lines.select(F.monotonically_increasing_id().alias("nid"), "at.doc_id", "at.row", "at.pos", "sig"), "line-ids")
    entries = lines.select("nid", _sketch(0, 8).alias("s"), _sketch(8, BANDS).alias("t"), F.posexplode("sig").alias("i", "v")).select(
        F.xxhash64("i", "v").alias("band"), "nid", "s", "t")
    partners = materialize(_partners(entries), "line-partners")
    shared = partners.where("least >= 0").select(F.xxhash64("band", "least").alias("band"), "nid", "least")
    large = partners.where("least < 0").select("band", "nid")
    members = materialize(_members(lines, partners), "line-members")
    # Signatures are kept once, for the lines that may have a partner; the others need their places only.
    places = materialize(lines.select("nid", "doc_id", "row", "pos"), "line-places")
    discard(lines)
    texts = materialize(_texts(docs, members), "line-texts")

    def near(pairs: DataFrame) -> DataFrame:
        one = members.select(F.col("nid").alias("a"), F.col("sig").alias("sig_a"))
        two = members.select(F.col("nid").alias("b"), F.col("sig").alias("sig_b"))
        return pairs.join(one, "a").join(two, "b").where(agreement("sig_a", "sig_b") >= AGREE).select("a", "b")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "line-near")
        links = materialize(_verified(pairs, texts, least), "line-links")
        discard(pairs)
        return links

    sigs = members.select("nid", "sig")
    dealt = None if large.isEmpty() else materialize(_deal(large), "line-dealt")
    stars = near(shared.where("nid <> least").select(F.col("nid").alias("a"), F.col("least").alias("b")).distinct())
    if dealt is not None:
        stars = stars.union(_stars(dealt.join(sigs, "nid"))).distinct()
    first = components(linked(stars))
    named = first.select(F.col("node").alias("nid"), "label")

    def mixed(known: DataFrame) -> DataFrame:
        """Members of one group need no comparing; a bucket is looked at again only if it holds several groups besides its first line's."""
        several = known.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where(
            "lo < hi AND n > 2").select("band")
        return known.join(several, "band", "left_semi")

    known = materialize(shared.join(named, "nid", "left").select("band", "nid", F.coalesce("label", "nid").alias("label")), "line-labels")
    left = materialize(mixed(known), "line-mixed")
    discard(partners, known)
    met = materialize(_bucket_pairs(left.join(sigs, "nid")), "line-met")
    crowded = left.join(met.where("a IS NULL").select("band"), "band", "left_semi").select("band", "nid", "label")
    pairs = met.where("a IS NOT NULL").select("a", "b")
    stored = [members, texts, left, met]
    if dealt is not None:
        again = materialize(mixed(dealt.join(named, "nid", "left").withColumn("label", F.coalesce("label", "nid"))), "line-mixed-large")
        open_pairs = materialize(_open_pairs(again.join(sigs, "nid")), "line-met-large")
        pairs = pairs.union(open_pairs.where("b IS NOT NULL").select("a", "b"))
        crowded = crowded.union(open_pairs.where("b IS NULL").select("band", F.col("a").alias("nid"), "label").distinct())
        stored += [dealt, again, open_pairs]
    links = linked(pairs.distinct())
    crowded = materialize(crowded, "line-crowded")
    if not crowded.isEmpty():
        links = links.union(materialize(_block_links(crowded, texts, least), "line-block-links"))
    discard(*stored, crowded)
    labels = links.join(first.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(
        first.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    second = components(labels.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    merged = places.join(first.select(F.col("node").alias("nid"), "label"), "nid", "left").withColumn(
        "label", F.coalesce("label", "nid"))
    return materialize(merged.join(second.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select(
        "nid", "doc_id", "row", "pos", F.coalesce("to", "label").alias("label")), "line-groups")


def kept_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(row, kept): the positions of the lines that stay, for rows that keep any: of each group its smallest (doc_id, row, pos).

    Rows are told apart by their number, as ids may be null or repeat. ``docs`` is a table that is read, here and again by the
    callers, so its rows have the same numbers each time.
    """
    groups = line_groups(docs, least)
    return groups.groupBy("label").agg(F.min(F.struct("doc_id", "row", "pos")).alias("at")).groupBy(F.col("at.row").alias("row")).agg(
        F.sort_array(F.collect_list("at.pos")).alias("kept"))


def deduplicated_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_kept and kept (positions from 0) for every row of ``docs`` (doc_id, text, any others).

    Lines end at line feeds. Blank lines (ASCII white space) are no lines here and always stay. Lines are equal or similar by their
    normal form. Null and empty texts have no lines; rows that repeat a doc_id, or have none, are rows of their own, of which the
    one read first keeps a line that they share; empty tables give empty tables.
    """
    kept = materialize(kept_lines(docs, least), "line-kept")
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.size(F.filter(
        F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"))
    positions = F.coalesce("kept", F.array().cast("array<int>"))
    return own.join(kept, "row", "left").select("doc_id", "n_lines", F.size(positions).cast("long").alias("n_kept"), positions.alias("kept"))


def without_duplicate_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with the lines taken out that ``kept_lines`` doesn't keep; all rows stay, and n_chars, if any, counts anew."""
    number, places = free_name("_row", docs.columns), free_name("_kept", docs.columns)
    kept = materialize(kept_lines(docs, least), "line-kept").select(F.col("row").alias(number), F.col("kept").alias(places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for text, stays in zip(part.column("text"), part.column(places).to_pylist()):
                    stay = set(stays or ())
                    own = text.as_py()
                    texts.append(None if own is None else "\n".join(
                        x for i, x in enumerate(own.split("\n")) if i in stay or not x.strip(" \t\n\v\f\r")))
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns([places])

    joined = docs.withColumn(number, F.monotonically_increasing_id()).join(kept, number, "left").select(*docs.columns, places)
    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
