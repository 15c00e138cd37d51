"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

The tree of a piece has a leaf for each byte position. The leaf of a live token holds ``rank * size + position`` for
the pair that it forms with the next live token, so the root is the leftmost pair of the lowest rank. A merge changes
three leaves (the token, the one it takes in, the live neighbour before) and walks up from each: logarithmic work.
Short pieces are merged many at a time, as rows of numpy arrays; long ones one by one on plain lists.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.text import unused, whole
from bidlens.session import prepare

NONE = np.int64(1) << 60
#: Pieces of up to so many bytes are merged together; longer ones by themselves.
TOGETHER = 64
#: Pieces whose ids a worker remembers; the store is emptied when full.
REMEMBERED = 250_000
#: Bytes of pieces, with what fills them up to one size, that are merged together at a time.
MERGED_BYTES = 1 << 18
#: Characters that are encoded at a time.
CHUNK_CHARS = 1_000_000


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


@lru_cache(2)
def tokens_of(path: str) -> list[bytes]:
    """The bytes of each id, which is all that decoding needs; made once in each Python worker."""
    ranks = ranks_of(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def bytes_of(path: str, ids: list[bytes]) -> list[bytes]:
    token = tokens_of(path).__getitem__
    return [b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in ids]


class Vocabulary:
    """Ranks of a rank file, and the rank of each pair of tokens that together make a token."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = ranks_of(path)
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.bits = max(ranks.values()).bit_length()
        self.pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << self.bits | b] = rank
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        of_bytes = np.arange(256)
        self.of_bytes = self.rank(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(len(of_bytes), 256)
        self.known: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs; NONE where they make no token."""
        key = a << self.bits | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    # One piece

    def merge_one(self, piece: bytes) -> list[int]:
        n = len(piece)
        if n < 2:
            return [int(self.byte[x]) for x in piece]
        size = 1 << (n - 1).bit_length()
        none, pairs, bits = int(NONE), self.pairs, self.bits
        token = [int(self.byte[x]) for x in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = pairs.get(token[i] << bits | token[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int) -> None:
            j = after[i]
            r = pairs.get(token[i] << bits | token[j]) if j < n else None
            set_leaf(i, none if r is None else r * size + i)

        def set_leaf(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        while (low := tree[1]) < none:
            rank, i = divmod(low, size)
            j = after[i]
            token[i], after[i] = rank, after[j]
            if after[i] < n:
                before[after[i]] = i
            set_leaf(j, none)
            put(i)
            if before[i] >= 0:
                put(before[i])
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    # Many pieces of up to ``size`` bytes

    def merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.zeros((n, size), np.uint8)
        flat[np.arange(size) < length[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        token = self.byte[flat]
        place = np.arange(size)
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * size), NONE)
        rank = self.of_bytes[flat[:, :-1], flat[:, 1:]]
        rank = np.where((place[1:] < length[:, None]) & (rank < NONE), rank * size + place[:-1], NONE)
        tree[:, size : 2 * size - 1] = rank
        step = size
        while step > 1:
            tree[:, step // 2 : step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
            step //= 2

        def climb(rows: np.ndarray, at: np.ndarray) -> None:
            at = at + size
            for _ in range(size.bit_length() - 1):
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        def put(rows: np.ndarray, at: np.ndarray) -> None:
            nxt = after[rows, at]
            has = nxt < length[rows]
            r = self.rank(token[rows, at], token[rows, np.where(has, nxt, 0)])
            tree[rows, size + at] = np.where(has & (r < NONE), r * size + at, NONE)
            climb(rows, at)

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            low = tree[rows, 1]
            at = low % size
            gone = after[rows, at]
            nxt = after[rows, gone]
            token[rows, at] = low // size
            after[rows, at] = nxt
            has = nxt < length[rows]
            before[rows[has], nxt[has]] = at[has]
            tree[rows, size + gone] = NONE
            climb(rows, gone)
            put(rows, at)
            prior = before[rows, at]
            has = prior >= 0
            put(rows[has], prior[has])
            token[rows, gone] = -1
            rows = rows[tree[rows, 1] < NONE]
        live = (token >= 0) & (place < length[:, None])
        ids = token[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, pieces: set[str]) -> None:
        by_size: dict[int, list[str]] = defaultdict(list)
        for p in pieces:
            raw = p.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[p] = rank.to_bytes(4, "little")
            elif len(raw) > TOGETHER:
                self.known[p] = np.array(self.merge_one(raw), "<u4").tobytes()
            else:
                by_size[max(2, 1 << (len(raw) - 1).bit_length())].append(p)
        for size, group in by_size.items():
            step = min(1 << 14, MERGED_BYTES // size)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                self.known.update(zip(part, self.merge_many([x.encode() for x in part], size), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        seen = set()
        for pieces in split:
            seen.update(pieces)
        self.learn({p for p in seen if p not in self.known})
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Made once in each Python worker."""
    return Vocabulary(path, pattern)


def _append(batches: Iterator[pa.RecordBatch], source: str, names: list[str], f: Callable[[list], list[list[bytes]]]) -> Iterator[pa.RecordBatch]:
    """Batches with the binary columns ``names`` that ``f`` makes from a list of the column ``source``, a bounded part at a time."""
    for batch in batches:
        column, start = batch.column(source), 0
        length = pc.binary_length if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pc.utf8_length
        ends = np.cumsum(length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
        while start < batch.num_rows:
            n = max(1, int(np.searchsorted(ends[start:] - (ends[start - 1] if start else 0), CHUNK_CHARS)))
            part = batch.slice(start, n)
            start += n
            made = [pa.array(x, pa.binary()) for x in f(part.column(source).to_pylist())]
            kept = [c for c in part.schema.names if c != source]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], [*kept, *names])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the text replaced by ``ids``: little-endian unsigned 32-bit integers, one after the other.

    Each match of ``pattern`` is merged by itself; no special tokens. Null and empty texts give no ids. Repeated rows
    and other columns, whatever their names, pass through. ``path`` is read on each worker.
    """
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, ids)]
    own = unused(docs, "_text")
    narrow = docs.select(*rest, whole(text).alias(own))
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(ids, T.BinaryType())])
    return narrow.mapInArrow(lambda it: _append(it, own, [ids], lambda texts: [vocabulary(path, pattern).encode(texts)]), schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``tokens`` with a binary column ``decoded``: the bytes that the ids stand for. Null ids give no bytes."""
    prepare(tokens.sparkSession)
    rest = [c for c in tokens.columns if c != decoded]
    none, own = F.lit(b""), unused(tokens, "_ids")
    narrow = tokens.select(*[F.coalesce(F.col(c), none).alias(c) if c == ids else F.col(c) for c in rest], F.coalesce(F.col(ids), none).alias(own))
    schema = T.StructType([*(T.StructField(ids, T.BinaryType()) if c == ids else tokens.schema[c] for c in rest), T.StructField(decoded, T.BinaryType())])
    return narrow.mapInArrow(lambda it: _append(it, own, [decoded], lambda rows: [bytes_of(path, rows)]), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """As :func:`decode` of :func:`encode`: ``docs`` with the text replaced by its ids and the bytes that these stand for.

    One worker does both for a bounded part of the texts; two steps keep twice as many workers, and the ids on their way between them.
    """
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, ids, decoded)]
    own = unused(docs, "_text")
    narrow = docs.select(*rest, whole(text).alias(own))
    schema = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(c, T.BinaryType()) for c in (ids, decoded))])

    def both(texts: list[str]) -> list[list[bytes]]:
        made = vocabulary(path, pattern).encode(texts)
        return [made, bytes_of(path, made)]

    return narrow.mapInArrow(lambda it: _append(it, own, [ids, decoded], both), schema)


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of ids, the hash of the ids and the hash of what they decode to.

    A null text is an empty one: no ids, and the hashes of nothing. Repeated rows and null document ids have rows like any other,
    long texts are encoded whole, and no rows give none.
    """
    tokens = round_trip(docs.select(doc_id, text), path, pattern, text)
    return tokens.select(
        doc_id,
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
