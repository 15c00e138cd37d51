"""Exact dedup: counting quotient filters of fingerprints, merged by sorted remainders, then the bytes of what repeats.

A fingerprint's upper bits choose a range, the next ones are its quotient, the rest its remainder. A filter keeps the
remainders of a quotient as one run of slots, in order, as near to the slot of the quotient as the runs before allow;
a remainder that came more than once is followed by slots with the digits of its count. So reading a filter from slot
to slot gives its fingerprints in order, and filters merge losslessly by walking them side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.tables import BROADCAST_ROWS, looked_up, written
from bidlens.llm.text import packed, unpacked, whole
from bidlens.session import prepare

BITS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints that a task gathers before it makes filters of them.
GATHERED = 1 << 20
#: Fingerprints in a range, about; ranges are so many that a merged filter stays this small.
RANGE_SIZE = 1 << 20
#: Slots in use at most, as a share.
LOAD = 0.9


class CountingQuotientFilter:
    """Fingerprints of ``bits`` bits with their counts, exactly. Made from sorted distinct fingerprints."""

    def __init__(self, bits: int, q: int, occupied: np.ndarray, used: np.ndarray, run_ends: np.ndarray, digits: np.ndarray, slots: np.ndarray) -> None:
        #: occupied: by quotient; used, run_ends, digits (the slot holds a digit of a count), slots: by slot
        self.bits, self.q, self.r = bits, q, bits - q
        self.occupied, self.used, self.run_ends, self.digits, self.slots = occupied, used, run_ends, digits, slots

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """``prints``: distinct, in order, unsigned 64-bit; ``counts``: one or more each."""
        q = 1
        while True:
            r = bits - q
            extra, left = np.zeros(len(prints), np.int64), counts - 1
            while (more := left > 0).any():
                extra += more
                left = left >> min(r, 62)
            if q >= bits - 1 or len(prints) + extra.sum() <= LOAD * (1 << q):
                break
            q += 1
        width = 1 + extra
        n = int(width.sum())
        owner = np.repeat(np.arange(len(prints)), width)
        nth = np.arange(n) - np.repeat(np.cumsum(width) - width, width)
        quotient = (prints >> np.uint64(r)).astype(np.int64)
        low = np.uint64((1 << r) - 1)
        shift = np.minimum(np.maximum(nth - 1, 0) * r, 62)
        value = np.where(nth == 0, prints[owner] & low, ((counts[owner] - 1) >> shift).astype(np.uint64) & low)
        # a slot lies at its quotient's place or right after the slot before it
        place = np.maximum.accumulate(quotient[owner] - np.arange(n)) + np.arange(n) if n else np.zeros(0, np.int64)
        size = max(1 << q, int(place[-1]) + 1 if n else 0)
        used, ends, digits, slots = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, np.uint64)
        used[place], digits[place], slots[place] = True, nth > 0, value
        if n:
            of_slot = quotient[owner]
            ends[place[np.append(of_slot[1:] != of_slot[:-1], True)]] = True
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        return cls(bits, q, occupied, used, ends, digits, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order, and their counts. The n-th run belongs to the n-th occupied quotient."""
        ends, digits, slots = self.run_ends[self.used], self.digits[self.used], self.slots[self.used]
        run = np.cumsum(ends) - ends
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        heads = np.flatnonzero(~digits)
        prints = quotient[heads] << np.uint64(self.r) | slots[heads]
        owner = np.cumsum(~digits) - 1
        nth = np.arange(len(digits)) - heads[owner] if len(heads) else owner
        shift = np.minimum(np.maximum(nth - 1, 0) * self.r, 62)
        counts = np.ones(len(heads), np.int64)
        np.add.at(counts, owner[digits], slots[digits].astype(np.int64) << shift[digits])
        return prints, counts

    def count(self, value: int) -> int:
        """How often a fingerprint came: its quotient's run is found by rank and select, and read."""
        quotient, low = value >> self.r, value & ((1 << self.r) - 1)
        if not self.occupied[quotient]:
            return 0
        ends = np.flatnonzero(self.run_ends)
        nth = int(self.occupied[:quotient].sum())
        first = max(quotient, int(ends[nth - 1]) + 1 if nth else 0)
        here = np.arange(first, ends[nth] + 1)
        heads = here[~self.digits[here]]
        at = np.searchsorted(self.slots[heads], np.uint64(low))
        if at == len(heads) or self.slots[heads[at]] != np.uint64(low):
            return 0
        stop = heads[at + 1] if at + 1 < len(heads) else ends[nth] + 1
        return 1 + sum(int(x) << (self.r * i) for i, x in enumerate(self.slots[heads[at] + 1 : stop]))

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        return CountingQuotientFilter.of(*merge(self.items(), other.items()), self.bits)

    def to_bytes(self) -> bytes:
        wide = (self.r + 7) // 8
        head = np.array([self.bits, self.q, len(self.used), int(self.used.sum())], "<i8")
        slots = np.ascontiguousarray(self.slots[self.used].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :wide]
        return b"".join([head.tobytes(), *(np.packbits(x).tobytes() for x in (self.occupied, self.used, self.run_ends, self.digits)), slots.tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, q, size, n = np.frombuffer(raw, "<i8", 4).tolist()
        at, out = 32, []
        for length in (1 << q, size, size, size):
            out.append(np.unpackbits(np.frombuffer(raw, np.uint8, (length + 7) // 8, at), count=length).astype(bool))
            at += (length + 7) // 8
        wide = (bits - q + 7) // 8
        full = np.zeros((n, 8), np.uint8)
        full[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, at).reshape(n, wide)
        slots = np.zeros(size, np.uint64)
        slots[out[1]] = full.view("<u8").ravel()
        return cls(bits, q, *out, slots)


Items = tuple[np.ndarray, np.ndarray]


def merge(one: Items, two: Items) -> Items:
    """Two sorted lists of distinct fingerprints as one; counts of what both have are added."""
    (a, n), (b, m) = one, two
    prints, counts = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.int64)
    of_a = np.arange(len(a)) + np.searchsorted(b, a, "left")
    of_b = np.arange(len(b)) + np.searchsorted(a, b, "right")
    prints[of_a], prints[of_b], counts[of_a], counts[of_b] = a, b, n, m
    if not len(prints):
        return prints, counts
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts, first)


def _filters(batches: Iterator[pa.RecordBatch], range_bits: int, bits: int, gathered: int) -> Iterator[pa.RecordBatch]:
    """A filter for each range that the task's fingerprints lie in, whenever ``gathered`` have come together."""

    def made(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        prints, counts = np.unique(np.concatenate(parts), return_counts=True)
        inner = bits - range_bits
        of_range = (prints >> np.uint64(inner)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, of_range[1:] != of_range[:-1]))
        low = np.uint64((1 << inner) - 1)
        raw = [CountingQuotientFilter.of(prints[a:b] & low, counts[a:b].astype(np.int64), inner).to_bytes() for a, b in zip(starts, [*starts[1:], len(prints)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(of_range[starts], pa.int64()), pa.array(raw, pa.binary())], ["range", "filter"])

    parts, n = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(np.asarray(batch.column(0)).view(np.uint64) >> np.uint64(BITS - bits))
            n += batch.num_rows
        if n >= gathered:
            yield from made(parts)
            parts, n = [], 0
    if n:
        yield from made(parts)


def _merged(batches: Iterator[pa.RecordBatch], range_bits: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come by range. Filters merge pairwise, like with like in size, so each fingerprint is moved a few times only."""
    inner = bits - range_bits
    stack: list[Items] = []

    def put(items: Items) -> None:
        while stack and len(stack[-1][0]) <= 2 * len(items[0]):
            items = merge(stack.pop(), items)
        stack.append(items)

    def repeated(of_range: int) -> pa.RecordBatch:
        items = stack.pop()
        while stack:
            items = merge(stack.pop(), items)
        twice = items[1] > 1
        prints = (np.uint64(of_range) << np.uint64(inner) | items[0][twice]) << np.uint64(BITS - bits)
        return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(items[1][twice])], ["print", "copies"])

    now = None
    for batch in batches:
        for of_range, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if now is not None and of_range != now:
                yield repeated(now)
            now = of_range
            put(CountingQuotientFilter.from_bytes(raw.as_py()).items())
    if now is not None:
        yield repeated(now)


def repeated_prints(prints: DataFrame, rows: int, bits: int = BITS, gathered: int = GATHERED, range_size: int = RANGE_SIZE) -> DataFrame:
    """print, copies: of the long column ``print`` the values that occur twice or more, and how often.

    Each partition makes counting quotient filters of its values; those of one range of values meet in a task and merge.
    ``rows`` is the number of rows: it sets the number of ranges, nothing of the result. A value that a third of all
    rows have is one counter in each filter. Only the upper ``bits`` bits of a print are told apart, the others must be 0.
    """
    prepare(prints.sparkSession)
    range_bits = min(bits - 2, max(4, int(rows // range_size).bit_length()))
    filters = prints.select("print").mapInArrow(lambda it: _filters(it, range_bits, bits, gathered), "range bigint, filter binary")
    return filters.repartition("range").sortWithinPartitions("range").mapInArrow(lambda it: _merged(it, range_bits, bits), "print bigint, copies bigint")


def lower_ascii(text: str) -> Column:
    return F.translate(whole(text), UPPER, LOWER)


def _print(normal: Column, bits: int) -> Column:
    """64 bits of hash, of which the upper ``bits`` stay."""
    h = F.xxhash64(normal)
    return h if bits == BITS else F.shiftleft(F.shiftright(h, BITS - bits), BITS - bits)


def _grouped(docs: DataFrame, doc_id: str, text: str, bits: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, row, print, digest) and the classes of texts whose print repeats (print, digest, keep_id, keep_row, ties, group_size), as tables."""
    prepare(docs.sparkSession)
    normal = docs.select(F.col(doc_id).alias("id"), lower_ascii(text).alias("normal"))
    rows = written(normal.select("id", F.monotonically_increasing_id().alias("row"), _print(F.col("normal"), bits).alias("print"), F.unhex(F.sha2("normal", 256)).alias("digest")), "exact-rows")
    prints = written(repeated_prints(rows, rows.count(), bits), "exact-prints")
    texts = looked_up(normal.select(_print(F.col("normal"), bits).alias("print"), "normal"), prints, ["print"], "copies", "left_semi", limit)
    # equal bytes make a class; copies within a partition meet before the shuffle
    same = texts.groupBy("print", "normal").agg(F.count("*").alias("group_size")).select("print", F.unhex(F.sha2("normal", 256)).alias("digest"), "group_size")
    members = looked_up(rows, prints, ["print"], "copies", "left_semi", limit)
    by_id = members.groupBy("print", "digest", "id").agg(F.max("row").alias("row"), F.count("*").alias("ties"))
    top = by_id.groupBy("print", "digest").agg(F.max(F.struct("id", "row", "ties")).alias("top"))
    classes = same.join(top, ["print", "digest"]).select("print", "digest", F.col("top.id").alias("keep_id"), F.col("top.row").alias("keep_row"), F.col("top.ties").alias("ties"), "group_size")
    return rows, written(classes, "exact-classes")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, limit: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept and text_sha256 (of the text with A-Z lower-cased).

    Texts are equal when identical after lower-casing A-Z only; null and empty texts are equal. Of equal texts the row
    with the largest id stays, a null id being less than any; of repeated rows with that id, one. Texts of any length
    are compared whole, byte by byte, where their fingerprints are equal; with fewer ``bits`` that is merely more often.
    An empty table gives an empty result, and other columns are not read.
    """
    rows, classes = _grouped(docs, doc_id, text, bits, limit)
    both = looked_up(rows, classes, ["print", "digest"], "group_size", "left", limit)
    alone = F.col("group_size").isNull()
    return both.select(
        F.col("id").alias(doc_id),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without later copies of a text, columns as before; which row of a group stays is told at :func:`groups`."""
    _, classes = _grouped(docs, doc_id, text, bits, limit)
    normal = docs.select(packed(docs), F.col(doc_id).alias("id"), lower_ascii(text).alias("normal"))
    rows = normal.select("_row", "id", _print(F.col("normal"), bits).alias("print"), F.unhex(F.sha2("normal", 256)).alias("digest"))
    both = looked_up(rows, classes, ["print", "digest"], "group_size", "left", limit)
    stay = both.where("group_size is null or id <=> keep_id")
    once = stay.where("ties is null or ties = 1").select("_row")
    tied = stay.where("ties > 1").dropDuplicates(["print", "digest"]).select("_row")
    return once.union(tied).select(*unpacked(docs.columns))


OP12_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
