"""Removal of word passages that an earlier document has, by FM-indexes on content shards.

A window of WINDOW consecutive words chooses an anchor: of its grams of GRAM words, the one of the least hash. Equal
windows choose equal anchors, wherever they are, so windows that occur in two documents can only be found
around anchors that occur in two documents.

1. Anchors per text; those that two texts have are shared. (One partial count for each anchor, not its rows.) Copies of
   one text are one text, that of the least id; all windows of the later copies repeat it.
2. Around each shared anchor the text's segment: all words of the windows that chose it. Equal segments become one,
   with the least document that has it.
3. Segments are sharded by anchor. In each shard an FM-index is built: the suffix order of all segments, the transform as
   a wavelet matrix of packed bits with counts per block. The segments are streamed through it: backward search computes
   matching statistics, for each place the length of the longest match that ends there, up to a window's, and the range
   of suffixes that begin with it. Where the length is a window's, the range gives the least document that has it.
4. Windows that an earlier document has are reported as intervals of the document, and their words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.tables import written
from bidlens.llm.text import whole
from bidlens.session import prepare

WINDOW = 13
GRAM = 5
#: Words in one FM-index, about; a shard has as many as it takes, one after the other.
INDEX_WORDS = 150_000
#: Anchors of more different segments, or of more windows in these, are given more precise shards: by their windows.
WIDE_ANCHOR, WIDE_WINDOWS = 1_000, 400_000
#: Windows of a segment at most; a text of one repeated word makes one as long as itself, which lies in several rows.
PART_WINDOWS = 4_000
CHUNK_ROWS = 300
REMEMBERED = 400_000


class Known(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> bytes:
        h = self[word] = xxhash.xxh3_64_digest(word)
        return h


class Hasher:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self) -> None:
        self.known = Known()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each ``gram`` consecutive words: their hashes by odd factors, summed and mixed."""
    n = max(0, len(h) - gram + 1)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(gram):
        out += h[j : j + n] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
    return _mix(out)


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per run of consecutive windows with one anchor: the anchor's hash, the first window, the number of windows."""
    g = gram_hashes(h, gram)
    span = window - gram + 1
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    least, done = g, 1
    while done < span:  # least of 1, 2, 4, ... grams
        step = min(done, span - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[starts], starts, np.diff(np.concatenate([starts, [n]]))


# The index


class BitRank:
    """Packed bits, and the number of ones before each block of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))[:-1]])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        rest = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(rest)


class WaveletMatrix:
    """Occurrences of a symbol among the first i of a sequence, from one bit of all symbols at a time, the highest first."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[BitRank] = []
        self.zeros: list[int] = []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.bits.append(BitRank(bit.astype(np.uint8)))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

        self.start = np.zeros(sigma, np.int64)
        self.start = self.rank(np.arange(sigma), self.start)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = i
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = self.bits[k].ones(at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at - self.start[symbol]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` symbols at least, by doubling.

    Backward search for up to ``depth`` symbols needs no more. Ends of segments (symbol 0) are told apart by their place.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + len(ends) + int(symbols.max(initial=0)) + 2) + nxt
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= min(n, depth):
            return order


class FMIndex:
    """Index of segments of symbols from 1 on, with a document for each segment, for searches of up to ``depth`` symbols."""

    def __init__(self, segments: list[np.ndarray], docs: np.ndarray, depth: int) -> None:
        end = np.zeros(1, np.int64)
        self.text = np.concatenate([x for s in segments for x in (s, end)])
        sigma = int(self.text.max(initial=0)) + 1
        order = suffix_order(self.text, depth)
        self.wavelet = WaveletMatrix(self.text[order - 1], sigma)
        counts = np.bincount(self.text, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.owner = np.repeat(docs, [len(s) + 1 for s in segments])
        self.least = [self.owner[order]]
        width = 1
        while 2 * width <= len(order):  # least document of 1, 2, 4, ... suffixes
            prior = self.least[-1]
            self.least.append(np.minimum(prior[: len(prior) - width], prior[width:]))
            width *= 2

    def matching_statistics(self, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each place the length, up to ``depth``, of the longest match that ends there and is elsewhere, too.

        Besides, which places reach ``depth``, and the ranges of the suffixes that begin with their matches. All places
        are searched at once; a place leaves where one suffix is left, which is its own.
        """
        length = np.full(len(ends), depth)
        open_ = np.arange(len(ends))
        lo = np.zeros(len(ends), np.int64)
        hi = np.full(len(ends), len(self.text), np.int64)
        for k in range(depth):
            c = self.text[ends[open_] - k]
            lo = self.first[c] + self.wavelet.rank(c, lo)
            hi = self.first[c] + self.wavelet.rank(c, hi)
            more = hi - lo > 1
            length[open_[~more]] = k
            open_, lo, hi = open_[more], lo[more], hi[more]
        return length, open_, lo, hi

    def least_document(self, ends: np.ndarray, window: int) -> np.ndarray:
        """For each place: the least document that has the ``window`` symbols up to it."""
        out = self.owner[ends]
        _, reached, lo, hi = self.matching_statistics(ends, window)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for lv in np.unique(level):
            m = level == lv
            table = self.least[lv]
            out[reached[m]] = np.minimum(table[lo[m]], table[hi[m] - (1 << int(lv))])
        return out


def least_documents(segments: list[np.ndarray], docs: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each window of each segment the least document of a segment that has the window."""
    flat = np.concatenate(segments)
    _, inverse = np.unique(flat, return_inverse=True)
    cuts = np.cumsum([len(s) for s in segments])
    dense = np.split(inverse.astype(np.int64) + 1, cuts[:-1])
    index = FMIndex(dense, docs, window)
    begin = np.concatenate([[0], cuts[:-1] + np.arange(1, len(segments))])
    windows = np.array([len(s) - window + 1 for s in segments])
    ends = np.repeat(begin + window - 1, windows) + np.concatenate([np.arange(w) for w in windows])
    return np.split(index.least_document(ends, window), np.cumsum(windows)[:-1])


# On Spark


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, batch.num_rows, CHUNK_ROWS):
        for i, t in enumerate(batch.column(column).slice(at, CHUNK_ROWS).to_pylist()):
            yield at + i, t.encode().split()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """anchor, body: the anchors of each text; copies of a text that the task has seen lately add nothing."""
    hashes, seen = Hasher(), set()
    for batch in batches:
        bodies = batch.column("body").to_pylist()
        found, owner = [], []
        for i, t in enumerate(batch.column("text")):
            if len(seen) > REMEMBERED:
                seen.clear()
            if bodies[i] in seen:
                continue
            seen.add(bodies[i])
            words = t.as_py().encode().split()
            if len(words) >= window:
                a = np.unique(anchors(hashes(words), window, gram)[0])
                found.append(a)
                owner.append(np.full(len(a), bodies[i]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(found))), pa.array(np.concatenate(owner))], ["anchor", "body"])


def _segment_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Segments around shared anchors: anchor, key (a digest of the words), words, id, body, start, windows. Long ones in parts that share all but their windows."""
    hashes = Hasher()
    for batch in batches:
        ids = batch.column("id").to_pylist()
        bodies = batch.column("body").to_pylist()
        shared = batch.column("anchors")
        out: list[tuple] = []
        for i, words in _texts(batch, "text"):
            if len(words) < window:
                continue
            a, start, count = anchors(hashes(words), window, gram)
            take = np.isin(_signed(a), shared[i].values.to_numpy(zero_copy_only=False))
            for x, s, n in zip(_signed(a)[take].tolist(), start[take].tolist(), count[take].tolist(), strict=True):
                for at in range(s, s + n, PART_WINDOWS):
                    m = min(PART_WINDOWS, s + n - at)
                    passage = b" ".join(words[at : at + m + window - 1])
                    out.append((x, xxhash.xxh3_128_digest(passage), passage.decode(), ids[i], bodies[i], at, m))
        if out:
            yield _as_segments(out)


SEGMENT = "anchor long, key binary, words string, id long, body long, start int, windows int"


def _as_segments(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["anchor", "key", "words", "id", "body", "start", "windows"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _index_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The segments of which some document has a repeated window, with the least document for each window.

    Rows come in order of anchor. One index for as many whole anchors as INDEX_WORDS allow.
    """
    hashes = Hasher()

    def result(rows: list[tuple]) -> pa.RecordBatch:
        segments = [hashes(w) for _, _, w, _, _ in rows]
        least = least_documents(segments, np.array([r[3] for r in rows], np.int64), window)
        told = [(a, k, x.tobytes()) for (a, k, _, first, last), x in zip(rows, least, strict=True) if last > first or x.min() < first]
        columns = list(zip(*told, strict=True)) if told else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.binary(), pa.binary()], strict=True)], ["anchor", "key", "least"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 5_000):
            part = batch.slice(at, 5_000)
            for anchor, key, words, first, last in zip(*(part.column(c).to_pylist() for c in ("anchor", "key", "words", "first", "last")), strict=True):
                if size > INDEX_WORDS and anchor != rows[-1][0]:
                    yield result(rows)
                    rows, size = [], 0
                rows.append((anchor, key, words.encode().split(b" "), first, last))
                size += len(rows[-1][2])
    if rows:
        yield result(rows)


def _interval_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """id, body, first word and end of each run of windows that an earlier document has. The windows of a batch are one array."""
    for batch in batches:
        raw = batch.column("least").to_pylist()
        n = np.array([len(x) // 8 for x in raw], np.int64)
        owner = np.repeat(np.arange(len(raw)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(np.frombuffer(b"".join(raw), np.int64) < batch.column("id").to_numpy(zero_copy_only=False)[owner])
        owner, place = owner[hit], place[hit]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1))) if len(hit) else hit
        last = np.append(first[1:], len(hit))[: len(first)] - 1
        of = owner[first]
        start = batch.column("start").to_numpy(zero_copy_only=False)[of]
        made = [pa.array(start + place[first], pa.int32()), pa.array(start + place[last] + window, pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), batch.column("body").take(pa.array(of)), *made], ["id", "body", "begin", "end"])


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(whole(text)).alias("body"), whole(text).alias("text"))


def _distinct(segments: DataFrame) -> DataFrame:
    return segments.groupBy("anchor", "key").agg(F.any_value("words").alias("words"), F.min("id").alias("first"), F.max("id").alias("last"))


def _wide(segments: DataFrame) -> DataFrame:
    """Anchors whose different segments are more than WIDE_ANCHOR or have more than WIDE_WINDOWS windows; segments are told apart only where there is so much."""
    large = lambda rows: rows.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("windows").alias("w")).where((F.col("n") > WIDE_ANCHOR) | (F.col("w") > WIDE_WINDOWS)).select("anchor")
    return large(segments.select("anchor", "key", "windows").join(large(segments), "anchor", "left_semi").distinct())


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, body (hash of the text), spans: for the first copy of each text its intervals of windows that a document with a smaller id has.

    ``spans`` has begin and end (words; end exclusive), which may overlap or touch, or is null if there are none. The later
    copies of a text have no row: the first has all their windows. Null and empty texts are texts like any other; null ids
    have no row. Repeated rows have one, for all of them.
    """
    prepare(docs.sparkSession)
    rows = _rows(docs, doc_id, text).where("id is not null")
    firsts = rows.groupBy("body", F.octet_length("text").alias("size")).agg(F.min("id").alias("id")).select("id", "body")
    of = written(rows.select("body", "text").mapInArrow(lambda it: _anchor_rows(it, window, gram), "anchor long, body long"), "anchors", "snappy")
    shared = of.groupBy("anchor").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low < high").select("anchor")
    lists = of.join(shared, "anchor").groupBy("body").agg(F.collect_set("anchor").alias("anchors")).join(firsts, "body")
    segments = rows.join(lists, ["id", "body"]).select("id", "body", "text", "anchors").mapInArrow(lambda it: _segment_rows(it, window, gram), SEGMENT)
    segments = written(segments, "segments")
    # An anchor with many or long different segments is cut into single windows, which meet by their own content.
    wide = written(_wide(segments), "wide-anchors")
    if not wide.isEmpty():
        words = F.split("words", " ")
        cut = F.transform(F.sequence(F.lit(0), F.col("windows") - 1), lambda k: F.struct(F.array_join(F.slice(words, k + 1, window), " ").alias("words"), k.alias("k")))
        hot = segments.join(wide, "anchor").select("id", "body", "start", F.explode(cut).alias("w")).select(F.xxhash64("w.words").alias("anchor"), F.unhex(F.md5("w.words")).alias("key"), F.col("w.words").alias("words"), "id", "body", (F.col("start") + F.col("w.k")).alias("start"), F.lit(1).alias("windows"))
        segments = segments.join(wide, "anchor", "left_anti").select(hot.columns).union(hot)
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = _distinct(segments).repartition(parts, "anchor").sortWithinPartitions("anchor", "first").mapInArrow(lambda it: _index_rows(it, window), "anchor long, key binary, least binary")
    hits = segments.drop("words", "windows").join(found, ["anchor", "key"]).select("id", "body", "start", "least")
    spans = hits.mapInArrow(lambda it: _interval_rows(it, window), "id long, body long, begin int, end int").groupBy("id", "body").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    return written(firsts.join(spans, ["id", "body"], "left"), "repeats")


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        later = batch.column("later").to_pylist()
        spans = batch.column("spans").to_pylist()
        n, gone, left = [], [], []
        for i, words in _texts(batch, "text"):
            n.append(len(words))
            if later[i]:
                words = words if len(words) < window else []
            elif spans[i]:
                mark = np.zeros(len(words) + 1, np.int32)
                for s in spans[i]:
                    mark[s["begin"]] += 1
                    mark[s["end"]] -= 1
                stay = np.cumsum(mark)[:-1] == 0
                words = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
            gone.append(n[-1] - len(words))
            left.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], ["id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: its id, n_words, n_removed and kept_text, the words left, joined by one space.

    Each word that a reported interval covers is removed; windows are judged on the input. A later copy of a text loses
    all words, if it has a window. A document without words has an empty text. A null id keeps all its words. Repeated
    rows lose the same words, and none because of each other.
    """
    found = repeated_passages(docs, doc_id, text, window).toDF("of", "of_body", "spans")
    both = _rows(docs, doc_id, text).join(found, (F.col("id") == F.col("of")) & (F.col("body") == F.col("of_body")), "left")
    rows = both.select("id", "text", "spans", (F.col("id").isNotNull() & F.col("of").isNull()).alias("later"))
    kinds = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return rows.mapInArrow(lambda it: _cut(it, window), kinds).withColumnRenamed("id", doc_id)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM split WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM starts),
firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM firsts WHERE first < doc_id),
places AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM split WHERE len(w) > 0),
kept AS (
  SELECT p.doc_id, count(g.i) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL), '') AS t
  FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
