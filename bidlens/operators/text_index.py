"""A positional inverted index: for each term the notices that have it, and where. Phrases and nearness are joins of postings.

Postings lie in a :class:`Store` whose buckets are chosen by the term, sorted by it: a query reads one bucket for each of its words.
A row has the postings of one term from one batch of notices, so that a term is shuffled and sorted once for many notices.
Beside it lie the words of each notice, so that a change finds the postings to take out; a posting that a change leaves as it was isn't
touched. Positions are kept as steps, most of them in one byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.functions.fence import fenced
from bidlens.functions.search import folded, searchable
from bidlens.operators.store import Store
from bidlens.session import prepare, scratch


#: Of a term the notices are dealt to this many parts, each with files of its own.
PARTS = 4


def _spans(words: pa.Array, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of words: each different word of a row as row * words + word, in order; where its positions begin (and the end); positions."""
    n, sizes = max(len(dictionary), 1), pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
    code = pc.index_in(words.flatten(), dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    key = np.repeat(np.arange(len(sizes)), sizes) * n + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
    return key[order[first]], np.append(first, len(key)), (np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]


def _cut(starts: np.ndarray, which: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and joined values of the spans ``which``."""
    sizes = starts[which + 1] - starts[which]
    return sizes, values[np.repeat(starts[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


def _packed(positions: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and where the bytes of each position begin: steps from one to the next of a notice in groups of seven bits; the lowest bit tells its first."""
    step = np.diff(positions, prepend=0)
    step[starts] = positions[starts]
    step = step * 2
    step[starts] += 1
    sizes = 1 + sum((step >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.append(0, np.cumsum(sizes))
    out = np.empty(ends[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        more = sizes > k
        out[ends[:-1][more] + k] = (step[more] >> 7 * k & 127) | ((sizes[more] > k + 1) * 128)
    return out, ends


def _unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions, and where those of each notice begin."""
    last = np.flatnonzero(data < 128)
    first = np.append(0, last[:-1] + 1)
    shift = 7 * (np.arange(len(data)) - np.repeat(first, last - first + 1))
    step = np.add.reduceat((data & 127).astype(np.int64) << shift, first)
    starts = np.flatnonzero(step & 1)
    sums = np.cumsum(step >> 1)
    before = sums[starts] - (step[starts] >> 1)
    return sums - np.repeat(before, np.diff(np.append(starts, len(step)))), starts


def _bytes(array: pa.Array) -> np.ndarray:
    """What lies in the values of a binary array, joined."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def _blocks(kind: int, part: np.ndarray, ids: pa.Array, dictionary: pa.Array, key: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Postings (``key`` as in :func:`_spans`) as rows: a row for each part and term."""
    row, code = key // len(dictionary), key % len(dictionary)
    group = part[row].astype(np.int64) * len(dictionary) + code
    order = np.argsort(group, kind="stable")
    sizes, values = _cut(np.append(0, np.cumsum(sizes)), order, values)
    group, row, ends = group[order], row[order], np.append(0, np.cumsum(sizes))
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    lists = np.append(first, len(group))
    data, at = _packed(values, ends[:-1])
    offsets = pa.array(at[ends[lists]], pa.int32()).buffers()[1]
    positions = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(data)])
    term, where = dictionary.take(pa.array(group[first] % len(dictionary))), pa.array(part[row[first]], pa.int32())
    held = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), ids.take(pa.array(row)))
    return pa.RecordBatch.from_arrays([term, where, held, positions, pa.array(np.full(len(first), kind, np.int32))], [*_BLOCK, "kind"])


_BLOCK = ("term", "part", "ids", "positions")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks (ids, positions): a row for each notice."""
    for batch in batches:
        if batch.num_rows:
            positions, starts = _unpacked(_bytes(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(positions)), pa.int32()), pa.array(positions, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), lists], ["id", "positions"])


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, part, was, now), words between spaces: postings that are new or have other positions (kind 2), and those that go (kind 1)."""
    for batch in batches:
        ids, part = batch.column(0), batch.column(1).to_numpy()
        was, now = (pc.split_pattern(batch.column(k), " ") for k in (2, 3))
        dictionary = pa.concat_arrays([was.flatten(), now.flatten()]).unique()
        (old, old_at, old_values), (new, new_at, new_values) = _spans(was, dictionary), _spans(now, dictionary)
        _, i, j = np.intersect1d(old, new, assume_unique=True, return_indices=True)
        alike = np.diff(old_at)[i] == np.diff(new_at)[j]
        i, j = i[alike], j[alike]
        if len(i):
            sizes, left = _cut(old_at, i, old_values)
            differ = np.add.reduceat((left != _cut(new_at, j, new_values)[1]).astype(np.int64), np.cumsum(sizes) - sizes)
            j = j[differ == 0]
        fresh, stale = np.setdiff1d(np.arange(len(new)), j), np.flatnonzero(~np.isin(old, new, assume_unique=True))
        for kind, key, starts, values, which in ((2, new, new_at, new_values, fresh), (1, old, old_at, old_values, stale)):
            if len(which):
                yield _blocks(kind, part, ids, dictionary, key[which], *_cut(starts, which, values))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks in order of part and term, what is new or goes first: those that stay, without the notices that these name."""
    at, named = None, []
    for batch in batches:
        term, part, ids, positions, kind, bucket = (batch.column(k) for k in range(6))
        kinds, keep = kind.to_numpy(), {}
        for k, key in enumerate(zip(bucket.to_pylist(), part.to_pylist(), term.to_pylist(), strict=True)):
            if key != at:
                at, named = key, []
            if kinds[k]:
                named.append(ids[k].values)
            elif named:
                named = [pa.concat_arrays(named)] if len(named) > 1 else named
                stay = ~pc.is_in(ids[k].values, value_set=named[0]).to_numpy(zero_copy_only=False)
                if not stay.all():
                    values, starts = _unpacked(_bytes(positions.slice(k, 1)))
                    sizes, values = _cut(np.append(starts, len(values)), np.flatnonzero(stay), values)
                    keep[k] = (ids[k].values.filter(pa.array(stay)), _packed(values, np.cumsum(sizes) - sizes)[0].tobytes())
        yield batch.take(pa.array([k for k in np.flatnonzero(kinds != 1) if k not in keep], pa.int64()))
        cut = [k for k, x in keep.items() if len(x[0])]
        if cut:
            take = pa.array(cut, pa.int64())
            held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(keep[k][0]) for k in cut])), pa.int32()), pa.concat_arrays([keep[k][0] for k in cut]))
            yield pa.RecordBatch.from_arrays([term.take(take), part.take(take), held, pa.array([keep[k][1] for k in cut], pa.binary()), kind.take(take), bucket.take(take)], names=batch.schema.names)


@dataclass
class TextIndex:
    """Found notices are frames of one column ``id``, each notice once; see :func:`both`, :func:`either` and :func:`without`."""

    terms: Store
    notices: Store

    @classmethod
    def at(cls, spark: SparkSession, path: str, id_type: T.DataType, buckets: int = 64) -> TextIndex:
        text = T.StringType()
        block = T.StructType([T.StructField(n, t) for n, t in zip(_BLOCK, (text, T.IntegerType(), T.ArrayType(id_type), T.BinaryType()), strict=True)])
        held = T.StructType([T.StructField("id", id_type), T.StructField("words", text)])
        small = {"compression": "zstd"}
        return cls(Store(spark, f"{path}/terms", block, ("term", "part"), ("term",), buckets, sort=("term",), options=small | {"parquet.writer.version": "v2"}), Store(spark, f"{path}/notices", held, ("id",), (), buckets, options=small))

    @classmethod
    def of(cls, texts: DataFrame, key: str, text: str, path: str | None = None, buckets: int = 64) -> TextIndex:
        """An index of ``texts``, in a new folder unless one is given."""
        spark = texts.sparkSession
        index = cls.at(spark, path or scratch(spark, "index"), texts.schema[key].dataType, buckets)
        index.update(texts, key, text)
        return index

    def update(self, texts: DataFrame, key: str, text: str, gone: DataFrame | None = None) -> None:
        """Take in new and changed notices, and leave out those whose ids are in ``gone``. Ids are unique in ``texts``.

        A text that is null or empty takes its notice out. Only notices whose words change are looked at further. Terms come
        first: if the second step fails, the same update may be run again.
        """
        spark = prepare(texts.sparkSession)
        now = fenced(texts.select(F.col(key).alias("id"), text), {"now": F.nullif(F.btrim(searchable(F.col(text))), F.lit(""))}).select("id", "now")
        if self.notices.folders():
            if gone is not None:
                others = gone.select("id").distinct().join(texts.select(F.col(key).alias("id")), "id", "left_anti")
                now = now.unionByName(others.withColumn("now", F.lit(None).cast("string")))
            now = now.join(self.notices.read().withColumnRenamed("words", "was"), "id", "left")
        else:
            now = now.withColumn("was", F.lit(None).cast("string"))
        staged = f"{self.terms.path}/update-{self.terms.version() + 1}-{self.notices.version() + 1}"
        now.where(~F.col("was").eqNullSafe(F.col("now"))).write.mode("overwrite").option("compression", "zstd").parquet(staged)
        changes = spark.read.schema(T.StructType([self.notices.schema["id"], T.StructField("now", T.StringType()), T.StructField("was", T.StringType())])).parquet(staged)
        self._post(changes)
        self.notices.merge(changes.where("now is not null").select("id", F.col("now").alias("words")), changes.where("now is null").select("id"))

    def _post(self, changes: DataFrame) -> None:
        """Bring the postings of notices (id, was, now) up to date."""
        part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
        new = changes.select("id", part.alias("part"), "was", "now").mapInArrow(_changed, T.StructType([*self.terms.schema, T.StructField("kind", T.IntegerType())])).withColumn("_bucket", self.terms.bucket())
        version = self.terms.version()
        if not self.terms.folders(version):
            self.terms.replace(version, None, new.where("kind = 2").repartition("_bucket", "part").sortWithinPartitions("_bucket", "term"))
            return
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most as many as there are buckets
        old = self.terms.read(version, touched).withColumns({"kind": F.lit(0), "_bucket": self.terms.bucket()})
        met = old.unionByName(new).repartition("_bucket", "part").sortWithinPartitions("_bucket", "part", "term", F.col("kind").desc())
        self.terms.replace(version, touched, met.mapInArrow(_merged, met.schema).sortWithinPartitions("_bucket", "term"))

    # Queries

    def _hits(self, word: str, going_on: bool = False) -> DataFrame:
        """id and positions of a word, or of all words that begin with it."""
        if not going_on:
            bucket = self.terms.bucket_of(word)
            return self._each(self.terms.read(buckets=[bucket]).where(F.col("term") == word))
        rows = self._each(self.terms.read().where(F.col("term").startswith(word)))
        return rows.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))  # within one notice

    def _each(self, blocks: DataFrame) -> DataFrame:
        """id and positions of each posting in ``blocks``."""
        schema = T.StructType([self.notices.schema["id"], T.StructField("positions", T.ArrayType(T.IntegerType()))])
        return blocks.select("ids", "positions").mapInArrow(_postings, schema)

    def _ordered(self, words: list[str], going_on: bool) -> DataFrame:
        """Notices where the words follow each other: starts that all words agree on, one join for each further word."""
        shifted = lambda k: self._hits(words[k], going_on and k == len(words) - 1).select("id", F.transform("positions", lambda p: p - k).alias(f"s{k}"))
        found = shifted(0)
        for k in range(1, len(words)):
            found = found.join(shifted(k), "id").select("id", F.array_intersect("s0", f"s{k}").alias("s0")).where(F.size("s0") > 0)
        return found.select("id")

    def phrase(self, words: str) -> DataFrame:
        """Notices that have these words, one after the other."""
        return self._ordered(folded(words), False)

    def prefix(self, words: str) -> DataFrame:
        """As :meth:`phrase`; the last word may go on."""
        return self._ordered(folded(words), True)

    def near(self, one: str, other: str, most: int = 10) -> DataFrame:
        """Notices that have both words, in either order, with ``most`` words between them at most."""
        (a,), (b,) = folded(one), folded(other)
        around: Column = F.flatten(F.transform("positions", lambda p: F.array(*[p + d for d in range(-most - 1, most + 2) if d])))
        return self._hits(a).select("id", around.alias("around")).join(self._hits(b), "id").where(F.arrays_overlap("around", "positions")).select("id")


def both(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "id", "left_semi"), found)


def either(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found).distinct()


def without(found: DataFrame, other: DataFrame) -> DataFrame:
    return found.join(other, "id", "left_anti")
