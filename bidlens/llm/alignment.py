"""Cross-tokenizer alignment: where two tokenizers' tokens end at the same byte, both token lists are cut.

The texts of a batch are one run of bytes. The ends of all A tokens and of all B tokens in it are counted once by byte
offset; where both counts are positive is a cut. A token's group is the number of cuts before its end, and what a
document has (groups, links) is the difference of a prefix sum between its first byte and its last.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.tables import BROADCAST_ROWS, looked_up, written
from bidlens.llm.text import unused, whole
from bidlens.session import prepare

#: Characters that are aligned at a time; longer texts are parted where both tokenizers must end a token.
CHUNK_CHARS = 1_000_000
#: A group of more links than this lists its different ids with their numbers instead of its links.
WIDE_GROUP = 256

#: A space between two plain characters, before which long texts are parted.
_PARTING = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Not one of the characters that all versions of Unicode class alike.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u20ac]")


class Coder:
    """Ids of texts by ``encode``, and the bytes of each id. ``parts``: tokens always end before a space between two plain characters."""

    def __init__(self, tokens: list[bytes], encode: Callable[[list[str]], list[np.ndarray]], parts: bool) -> None:
        self.encode, self.parts = encode, parts
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def gives_back(self, ids: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
        """For each text whether its ids stand for just its bytes."""
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        wide = self.lengths[flat]
        per = lambda values, ends: np.diff(np.append(0, np.cumsum(values))[np.append(0, ends)])
        size = np.array([len(t) for t in texts], np.int64)
        good = (per(wide, np.cumsum(n)) == size) & (per(wide == 0, np.cumsum(n)) == 0)
        flat, size = flat[np.repeat(good, n)], size[good]
        wide = self.lengths[flat]
        at = np.repeat(self.starts[flat] - np.cumsum(wide) + wide, wide) + np.arange(int(wide.sum()))
        other = self.bytes[at] != np.frombuffer(b"".join(t for t, g in zip(texts, good, strict=True) if g), np.uint8)
        good[good] = per(other, np.cumsum(size)) == 0
        return good


def _byte_letters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it is visible Latin-1, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(2)
def byte_level(path: str, pattern: str) -> Coder:
    """Coder of a byte-level BPE file whose pieces are the matches of ``pattern``; special tokens' strings are plain text.

    If the file lists its merges by id, as ranks do, texts of plain characters are merged by rank, which gives the
    same ids sooner; all others are left to the file's own library.
    """
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    vocab, letters = tokenizer.get_vocab(), _byte_letters()
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in model["vocab"].items():
        tokens[i] = bytes(letters[c] for c in token)
    by_rank = [model["vocab"][m] for m in merges] == list(range(256, 256 + len(merges)))
    ranked = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={tokens[i]: i for i in model["vocab"].values()}, special_tokens={}) if by_rank else None

    def encode(texts: list[str]) -> list[np.ndarray]:
        plain = [ranked is not None and _OTHER.search(t) is None for t in texts]
        others = iter(tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [ranked.encode_to_numpy(t, disallowed_special=()).astype(np.int64) if p else np.array(next(others).ids, np.int64) for t, p in zip(texts, plain, strict=True)]

    return Coder(tokens, encode, regex.findall(pattern, "a b 1 c") == ["a", " b", " 1", " c"])


@lru_cache(2)
def sentence_pieces(path: str) -> Coder:
    """Coder of a SentencePiece file that writes a space before each text; texts are given with that space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def token(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("\u2581", " ").encode()

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in model.encode([t[1:] for t in texts], num_threads=1)]

    over = any(re.search("[^\u2581]\u2581", model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return Coder([token(i) for i in range(model.get_piece_size())], encode, not over)


class Aligner:
    """Alignment of many texts at a time, each given with its leading space."""

    def __init__(self, a: Coder, b: Coder) -> None:
        self.a, self.b = a, b
        self.of_a, self.of_b = len(a.lengths), len(b.lengths)
        self.parts = a.parts and b.parts
        written = [str(i).encode() for i in range(max(self.of_a, self.of_b))]
        ends = [(self.of_a, b","), (self.of_a, b"|"), (self.of_b, b","), (self.of_b, b";"), (self.of_b, b"")]
        #: an id with what follows it: A , | then B , ; and nothing
        self.spelled = np.array([w + end for n, end in ends for w in written[:n]], object)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Per text (n_a, n_b, n_groups, n_links) and the groups written out; per text and pair: text * ids of A * ids of B + a * ids of B + b in order, how many links, and where each text's pairs begin."""
        of_a, of_b, raw, none = self.a.encode(texts), self.b.encode(texts), [t.encode() for t in texts], np.zeros(0, np.int64)
        good = self.a.gives_back(of_a, raw) & self.b.gives_back(of_b, raw) & (np.array([len(t) for t in raw]) > 1)
        of_a, of_b = ([x if g else none for x, g in zip(c, good, strict=True)] for c in (of_a, of_b))
        n_a, n_b = (np.array([len(x) for x in c], np.int64) for c in (of_a, of_b))
        a, b = np.concatenate(of_a), np.concatenate(of_b)
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        size = int(ends_a[-1]) if len(a) else 0
        cuts = np.cumsum((np.bincount(ends_a, minlength=size + 1) > 0) & (np.bincount(ends_b, minlength=size + 1) > 0))
        group_a, group_b = cuts[ends_a - 1], cuts[ends_b - 1]
        groups = int(cuts[-1])
        p, q = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        first_a, first_b = np.cumsum(p) - p, np.cumsum(q) - q
        last_byte = np.append(0, ends_a)[np.cumsum(n_a)]
        until = cuts[last_byte] if len(a) else np.zeros(len(texts), np.int64)
        n_groups = np.diff(until, prepend=0)
        text_of = np.repeat(np.arange(len(texts)), n_groups)
        links = np.append(0, np.cumsum(p * q))[np.append(0, until)]
        keys, count = self._pairs(a, b, p, q, first_a, first_b, text_of)
        starts = np.searchsorted(keys, np.arange(len(texts) + 1) * (self.of_a * self.of_b))
        spelled = self._spelled(a, b, p, q, first_a, first_b, group_a, group_b, until, n_a + n_b)
        return np.stack([n_a, n_b, n_groups, np.diff(links)]), spelled, keys, count, starts

    def _pairs(self, a, b, p, q, first_a, first_b, text_of) -> tuple[np.ndarray, np.ndarray]:
        of = lambda text, x, y: (text * self.of_a + x) * self.of_b + y
        one = np.flatnonzero((p == 1) & (q == 1))
        some = np.flatnonzero((p * q > 1) & (p * q <= WIDE_GROUP))
        n = (p * q)[some]
        g = np.repeat(some, n)
        k = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        listed = [of(text_of[one], a[first_a[one]], b[first_b[one]]), of(text_of[g], a[first_a[g] + k // q[g]], b[first_b[g] + k % q[g]])]
        keys, count = np.unique(np.concatenate(listed), return_counts=True)
        wide = np.flatnonzero(p * q > WIDE_GROUP)
        if len(wide):
            for g in wide:
                x, m = np.unique(a[first_a[g] : first_a[g] + p[g]], return_counts=True)
                y, l = np.unique(b[first_b[g] : first_b[g] + q[g]], return_counts=True)  # noqa: E741
                keys, count = np.append(keys, of(text_of[g], x[:, None], y).ravel()), np.append(count, np.outer(m, l).ravel())
                if len(keys) > 1 << 22:
                    keys, count = _added(keys, count)
            keys, count = _added(keys, count)
        return keys, count

    def _spelled(self, a, b, p, q, first_a, first_b, group_a, group_b, until, tokens) -> list[bytes]:
        """Each group has its A tokens, then its B tokens; a token's place is its own number plus those of the other side before it."""
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), np.int64)
        last_a[first_a + p - 1] = True
        last_b[first_b + q - 1] = 1
        last_b[(first_b + q - 1)[until[until > 0] - 1]] = 2
        order[np.arange(len(a)) + first_b[group_a]] = a + self.of_a * last_a
        order[np.arange(len(b)) + (first_a + p)[group_b]] = b + 2 * self.of_a + self.of_b * last_b
        spelled, at, out = self.spelled[order].tolist(), 0, []
        for n in tokens.tolist():
            out.append(b"".join(spelled[at : at + n]))
            at += n
        return out


def _added(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, count = keys[order], count[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(count, first) if len(first) else count


@lru_cache(2)
def aligner(a_path: str, pattern: str, b_path: str) -> Aligner:
    """Made once in each Python worker."""
    return Aligner(byte_level(a_path, pattern), sentence_pieces(b_path))


def parted(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """A long text in parts that begin with the space before them; other texts as one part, with a space before it."""
    text, out = " " + text, []
    while len(text) > size and (cut := _PARTING.search(text, size)):
        out.append(text[: cut.start()])
        text = text[cut.start() :]
    return [*out, text]


_PAIR = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("links", T.LongType())])
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _lists(keys: np.ndarray, count: np.ndarray, offsets: np.ndarray, of_b: int) -> pa.Array:
    fields = [pa.field("a", pa.int32()), pa.field("b", pa.int32()), pa.field("links", pa.int64())]
    values = pa.StructArray.from_arrays([pa.array(keys // of_b, pa.int32()), pa.array(keys % of_b, pa.int32()), pa.array(count, pa.int64())], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _long(align: Aligner, parts: list[str], hashed: bool) -> tuple[list[int], bytes, np.ndarray, np.ndarray]:
    """One text in parts: sums, groups of all parts, pairs of all parts. A part that can't be aligned leaves the text without tokens."""
    total, digest, spelled = np.zeros(4, np.int64), hashlib.sha256(), []
    keys, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, part in enumerate(parts):
        n, (groups,), k, c, _ = align.align([part])
        if not n[0, 0]:
            return [0, 0, 0, 0], b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        total += n[:, 0]
        between = b";" if i else b""
        if hashed:
            digest.update(between + groups)
        else:
            spelled.append(between + groups)
        keys, count = _added(np.append(keys, k), np.append(count, c))
    return total.tolist(), digest.hexdigest().encode() if hashed else b"".join(spelled), keys, count


def _aligned(batches: Iterator[pa.RecordBatch], own: str, align: Callable[[], Aligner], hashed: bool) -> Iterator[pa.RecordBatch]:
    """Batches with the counts, the groups (or their hash) and the pairs of the texts in the column ``own``."""
    tool = align()
    shown = lambda g: hashlib.sha256(g).hexdigest() if g and hashed else g.decode()
    for batch in batches:
        texts = [" " + t for t in batch.column(own).to_pylist()]
        rest = [c for c in batch.schema.names if c != own]
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHUNK_CHARS):
                size += len(texts[stop])
                stop += 1
            if size > CHUNK_CHARS and tool.parts and len(parts := parted(texts[start][1:])) > 1:
                n, spelled, keys, count = _long(tool, parts, hashed)
                counts, groups, offsets = np.array(n).reshape(4, 1), [spelled.decode()], np.array([0, len(keys)])
            else:
                counts, spelled, keys, count, offsets = tool.align(texts[start:stop])
                groups, keys = [shown(g) for g in spelled], keys % (tool.of_a * tool.of_b)
            part = batch.slice(start, stop - start)
            made = [*(pa.array(c, pa.int64()) for c in counts), pa.array(groups, pa.string()), _lists(keys, count, offsets, tool.of_b)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made], [*rest, *_COUNTS, "groups", "pairs"])
            start = stop


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str, text: str = "text", hashed: bool = False) -> DataFrame:
    """``docs`` with the text replaced by n_a, n_b, n_groups, n_links, groups and pairs.

    ``a_path`` is a byte-level BPE file, its pieces the matches of ``pattern``; ``b_path`` a SentencePiece file. Both are
    read on each worker. ``groups`` is ``a1,a2|b1;a3|b2,b3`` in ids, or the hash of that; ``pairs`` are the different (a, b)
    that share a group, with the number of token pairs. Null and empty texts, and texts that a tokenizer can't give
    back byte by byte, have no tokens: zeros, an empty string and no pairs. Long texts are aligned in parts, which
    changes nothing; a group's links are counted, not listed, if it is wide. Columns named as the new ones are replaced.
    """
    prepare(docs.sparkSession)
    new = (*_COUNTS, "groups", "pairs")
    rest = [c for c in docs.columns if c not in (text, *new)]
    own = unused(docs, "_text")
    schema = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(_PAIR))])
    narrow = docs.select(*[F.col(f"`{c}`") for c in rest], whole(text).alias(own))
    return narrow.mapInArrow(lambda it: _aligned(it, own, lambda: aligner(a_path, pattern, b_path), hashed), schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, docs (rows of ``aligned`` that link them), best (no other b of this a has more), for all pairs linked anywhere.

    Counts are partial sums before their shuffle; there are at most as many highest counts as A has ids, so these are broadcast.
    """
    counts = written(aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.count("*").alias("docs")), "alignment-pairs")
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    return counts.join(F.broadcast(top), "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best"))


def scored(docs: DataFrame, a_path: str, pattern: str, b_path: str, text: str = "text", hashed: bool = False, limit: int = BROADCAST_ROWS) -> DataFrame:
    """What :func:`align` gives, with n_best (links whose pair is its A id's most frequent, ties included) and count_sum (documents that hold the pair, summed over links) for ``pairs``.

    Every row is a document, repeated rows and those without an id too. A document's pairs meet their counts in place
    if the counts are few; else the most frequent pairs do, and the others, none of which is hot, in a shuffle.
    """
    row = unused(docs, "_place")
    aligned = written(align(docs, a_path, pattern, b_path, text, hashed).withColumn(row, F.monotonically_increasing_id()), "alignment")
    counts = written(pair_counts(aligned), "alignment-counts")
    held = looked_up(aligned.select(F.col(row).alias("place"), F.inline("pairs")), counts, ["a", "b"], "docs", "inner", limit)
    sums = held.groupBy("place").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("docs")).alias("count_sum"))
    kept = [c for c in aligned.columns if c not in (row, "pairs", "n_best", "count_sum")]
    both = aligned.drop("pairs", "n_best", "count_sum").join(sums, F.col(row) == F.col("place"), "left")
    return both.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"), hashed=True)
    return out.withColumnRenamed("groups", "groups_sha256")
