"""SimHash near-duplicates: fingerprints of word shingles, candidates by pigeonring filtering, groups.

The 64 bits are cut into SEGMENTS on a ring. If two fingerprints differ in at most T bits, then from some segment on
each chain of l consecutive segments differs in at most floor(l * T / SEGMENTS) bits, for every l. The chains whose
budget is 0 must be equal: they are the keys that bring fingerprints together. The other chains prune what
meets there before the count over all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.components import connect
from bidlens.llm.tables import written
from bidlens.llm.text import packed, unpacked, unused, whole
from bidlens.session import prepare

BITS = 64
SEED = 42
SEGMENTS = 7
#: Fingerprints that share a key are compared with each other up to this many, and linked through midpoints beyond.
DENSE = 48
CHUNK_BYTES = 4_000_000


def shingle_hashes(text: str, words: int, seed: int = SEED) -> list[int]:
    """Hashes of the word shingles, repeats included; of the whole sequence if it has fewer words."""
    split = text.encode().lower().split()
    if not split:
        return []
    line = b" ".join(split)
    if len(split) <= words:
        return [xxhash.xxh64_intdigest(line, seed)]
    h, at, ends = xxhash.xxh64_intdigest, 0, []
    for w in split:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0, *[e + 1 for e in ends[: 1 - words]]] if words > 1 else [0, *[e + 1 for e in ends]]
    return [h(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :])]  # noqa: B905


def fingerprints_of(texts: list[str], words: int, seed: int = SEED) -> np.ndarray:
    """The fingerprints as signed 64-bit integers; 0 for a text without words."""
    hashes = [shingle_hashes(t, words, seed) for t in texts]
    out = np.zeros(len(texts), np.uint64)
    weight = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for i, h in enumerate(hashes):
        if h:
            bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduce(bits, axis=0, dtype=np.uint32)
            out[i] = weight[2 * ones.astype(np.int64) > len(h)].sum(dtype=np.uint64)
    return out.view(np.int64)


def _map(batches: Iterator[pa.RecordBatch], source: str, words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(source)
        keep = [c for c in batch.schema.names if c != source]
        made = [fingerprints_of(text.slice(i, 200).to_pylist(), words, seed) for i in range(0, batch.num_rows, 200)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.concatenate(made) if made else np.zeros(0, np.int64), pa.int64())], [*keep, "fingerprint"])


def fingerprint(docs: DataFrame, text: str = "text", words: int = 3, seed: int = SEED) -> DataFrame:
    """``docs`` with the text replaced by ``fingerprint`` (long). Null and empty texts get 0. A-Z count as a-z."""
    prepare(docs.sparkSession)
    rest = docs.drop(text, "fingerprint")
    own = unused(docs, "_text")
    narrow = docs.select(*rest.columns, whole(text).alias(own))
    schema = rest.schema.add("fingerprint", "long")
    return narrow.mapInArrow(lambda it: _map(it, own, words, seed), schema)


# Candidates


def _mask(at: int, width: int) -> int:
    m = sum(1 << ((at + i) % BITS) for i in range(width))
    return m - (1 << BITS) if m >> (BITS - 1) else m


def ring(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    ends = [BITS * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def chain_masks(length: int, segments: int = SEGMENTS) -> list[int]:
    """For each start the bits of ``length`` consecutive segments."""
    r = ring(segments)
    return [_mask(r[k][0], sum(r[(k + j) % segments][1] for j in range(length))) for k in range(segments)]


def budget(length: int, most: int, segments: int = SEGMENTS) -> int:
    return length * most // segments


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def within_chain(a: Column, b: Column, start: Column, most: int, segments: int = SEGMENTS) -> Column:
    """Each chain from ``start`` keeps to its budget, up to the whole ring, which is the full check."""
    out = F.lit(True)
    for length in range(1, segments + 1):
        if length == segments or budget(length, most, segments) < budget(length + 1, most, segments):  # sums only grow: the last chain of each budget
            mask = F.element_at(_longs(chain_masks(length, segments)), start + 1)
            out = out & (F.bit_count(a.bitwiseXOR(b).bitwiseAND(mask)) <= budget(length, most, segments))
    return out


def links(fingerprints: DataFrame, most: int = 2, segments: int = SEGMENTS, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between distinct fingerprints, such that all fingerprints within ``most`` bits are connected by them.

    ``fingerprints`` has one column, ``fp``, without repeats. Keys of up to ``dense`` fingerprints: each pair that passes
    the chains. Keys of more (needs ``most`` of 2): there the fingerprints that differ in at most one bit from a common
    midpoint, so in at most two from each other, hang on the least of them. Two that differ in at most two bits always
    have such a midpoint. A midpoint has at most one member for each bit and one more, so no group is large.
    """
    zero = max(k for k in range(segments) if budget(k, most, segments) == 0)
    key_masks = chain_masks(zero, segments)
    if zero == 0:
        raise ValueError("more segments than differing bits are needed")
    spread = fingerprints.select("fp", F.posexplode(_longs(key_masks)).alias("start", "mask")).select("fp", "start", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    counts = spread.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = spread.join(counts, ["start", "key"]).checkpoint()
    few = members.where(F.col("n") <= dense)
    a, b = few.select("start", "key", F.col("fp").alias("a")), few.select("start", "key", F.col("fp").alias("b"))
    on = ["start", "key"]
    pairs = a.join(b, (a["start"] == b["start"]) & (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & within_chain(F.col("a"), F.col("b"), a["start"], most, segments)).select("a", "b")
    many = members.where(F.col("n") > dense)
    if most != 2 and not many.isEmpty():
        raise ValueError("midpoints serve for two differing bits")
    free = F.element_at(_longs([~m for m in key_masks]), F.col("start") + 1)
    flips = _longs([0, *[1 << i if i < BITS - 1 else -(1 << i) for i in range(BITS)]])
    mids = many.withColumn("free", free).select("fp", "start", F.explode(F.filter(flips, lambda f: f.bitwiseAND(F.col("free")) == f)).alias("flip"))
    stars = mids.groupBy("start", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")).agg(F.array_sort(F.collect_set("fp")).alias("near")).where(F.size("near") > 1)
    hung = stars.select(F.element_at("near", 1).alias("a"), F.explode(F.slice("near", 2, BITS + 1)).alias("b"))
    return pairs.union(hung.distinct())


def groups(prints: DataFrame, doc_id: str, most: int = 2) -> DataFrame:
    """A row for each distinct fingerprint of ``prints``: fp and component_id, the least id that links reach.

    Documents of equal fingerprints are one from here on, so that copies are neither compared nor linked pairwise.
    """
    least = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(doc_id).alias("least")).checkpoint()
    parts = connect(links(least.select("fp"), most), "a", "b")
    named = least.join(parts, least["fp"] == parts["id"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(smallest, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, most: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id.

    Texts without words share fingerprint 0 and are linked like others. Repeated rows are all returned. A null id never
    names a group; a group of null ids alone has a null component_id. An empty table gives an empty result.
    """
    prints = fingerprint(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", words).checkpoint()
    found = groups(prints, "id", most)
    return prints.join(found, prints["fingerprint"] == found["fp"]).select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# Similar texts: shingle sets, exactly


#: Wide fingerprints of shingle sets: longs, segments of 16 bits, and the length of the chains that are tried before all bits.
WIDE, WIDE_SEGMENTS, WIDE_CHAIN = 4, 16, 8
#: Documents drawn to learn which shingles are frequent, and how many of these are sent to the tasks. They only order the shingles.
SAMPLE_DOCUMENTS, FREQUENT = 20_000, 100_000
#: Members of a key that one task holds against another such block.
BLOCK = 256


def shingle_set(text: str, words: int) -> np.ndarray:
    """Hashes of the shingles, each once; texts without words have one in common."""
    return np.unique(np.array(shingle_hashes(text, words) or [0], np.uint64))


def prefix_length(n: int, similarity: float) -> int:
    """Of two sets of that similarity, in one order, the first ``n - ceil(similarity * n) + 1`` of each have an element in common."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``WIDE`` longs: a bit is 1 if it is set in over half of the shingles' hashes, each mixed anew for each long."""
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(shingles), 4096):
        h = shingles[at : at + 4096]
        mixed = np.empty((len(h), WIDE), np.uint64)
        for k in range(WIDE):
            x = (h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            mixed[:, k] = x ^ (x >> np.uint64(32))
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)


def wide_budget(similarity: float, deviations: float = 7) -> int:
    """Bits of the wide fingerprints in which sets of that Jaccard similarity differ at most.

    A bit differs with the probability angle / pi, the cosine being 2s / (1 + s) for sets of like size. At 0.8 that is 39
    bits of 256 with a deviation of 6, and the budget is 78: no pair of 0.8 goes, and those below about 0.4 do.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * WIDE
    return int(np.ceil(bits * p + deviations * np.sqrt(bits * p * (1 - p))))


def keeps_to_budget(a: Column, b: Column, most: int) -> Column:
    """Pigeonring on two wide fingerprints: from some segment on, each chain up to ``WIDE_CHAIN`` segments keeps to its share of ``most``; then all bits."""
    differing = F.flatten(F.array(*[F.transform(F.array(*[F.shiftrightunsigned(F.get(a, k).bitwiseXOR(F.get(b, k)), 16 * j) for j in range(4)]), lambda x: F.bit_count(x.bitwiseAND(F.lit(0xFFFF).cast("long")))) for k in range(WIDE)]))

    def chained(d: Column) -> Column:
        ring_ = F.concat(d, F.slice(d, 1, WIDE_CHAIN - 1))

        def holds(start: Column) -> Column:
            sums, out = F.lit(0), F.lit(True)
            for length in range(1, WIDE_CHAIN + 1):
                sums = sums + F.get(ring_, start + length - 1)
                out = out & (sums <= length * most // WIDE_SEGMENTS)
            return out

        return F.exists(F.sequence(F.lit(0), F.lit(WIDE_SEGMENTS - 1)), holds) & (F.aggregate(d, F.lit(0), lambda x, y: x + y) <= most)

    return F.get(F.transform(F.array(differing), chained), F.lit(0))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            made = [shingle_set(t, words).view(np.int64) for t in part.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))], ["id", "shingles"])


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """id, a digest of the shingle set, its size, its wide fingerprint, and its prefix in the order of frequency (as far as known) and hash."""
    known, times = frequent
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            digests, sizes, prints, made = [], [], [], []
            for text in part.column("text").to_pylist():
                s = shingle_set(text, words)
                place = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                often = np.where(known[place] == s, times[place], 0) if len(known) else np.zeros(len(s), np.int64)
                digests.append(xxhash.xxh128_digest(s.tobytes()))
                sizes.append(len(s))
                prints.append(wide_fingerprint(s))
                made.append(s[np.lexsort((s, often))[: prefix_length(len(s), similarity)]].view(np.int64))
            ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.list_(pa.int64())), lists], ["id", "body", "size", "print", "prefix"])


def _frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a bounded hash sample have, in order, and in how many they are."""
    n = max(1, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(n)) < SAMPLE_DOCUMENTS)
    kinds = T.StructType([rows.schema["id"], T.StructField("shingles", T.ArrayType(T.LongType()))])
    each = drawn.mapInArrow(lambda it: _sets(it, words), kinds).select(F.explode("shingles").alias("s"))
    top = each.groupBy("s").agg(F.count("*").alias("times")).where("times > 2").orderBy(F.desc("times"), "s").limit(FREQUENT).toPandas()
    known, times = top["s"].to_numpy(np.int64).view(np.uint64), top["times"].to_numpy(np.int64)
    order = np.argsort(known)
    return known[order], times[order]


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether sizes allow it, and what is left of both sets from this shingle on, if it is the first in common."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    rest = F.least(size_a - F.col(f"{a}.pos"), size_b - F.col(f"{b}.pos"))
    return (F.least(size_a, size_b) >= similarity * F.greatest(size_a, size_b) - 1e-9) & (rest * (1 + similarity) >= similarity * (size_a + size_b) - 1e-9)


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _similar(pairs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have that Jaccard similarity or more."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    kinds = T.StructType([rows.schema["id"], T.StructField("shingles", T.ArrayType(T.LongType()))])
    sets = rows.join(asked, "id", "left_semi").mapInArrow(lambda it: _sets(it, words), kinds)
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared = both.select("a", "b", (F.size("set_a") + F.size("set_b")).alias("sizes"), F.size(F.array_intersect("set_a", "set_b")).alias("shared"))
    return written(shared.where(F.col("shared") / (F.col("sizes") - F.col("shared")) >= similarity).select("a", "b"), "similar")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per id: id and component_id, for texts whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

    Exact at every number of texts. Fingerprints alone can't tell 0.8 (pairs at it differ in 39 bits of 256, give or take 6),
    and keys of equal segments miss more pairs the more texts there are; so

    1. pairs meet at a shingle: of two similar sets in one order, the prefixes share one. Frequent shingles come last in that
       order, so that few texts share one. What shares one is held first against the least and the greatest id there. Then
       all members of a shingle that are not yet in one component are held against each other, in blocks, so that no task has
       all of a frequent one;
    2. wide SimHash fingerprints prune them by pigeonring: chains of segments within their budgets, then all bits;
    3. what is left is decided by the whole sets.

    Equal sets are one from the start. Null, empty and blank texts are alike. Null ids are left out; repeated rows do no
    harm; very long texts are compared whole.
    """
    spark = prepare(docs.sparkSession).sparkContext
    rows = docs.select(F.col(doc_id).alias("id"), whole(text).alias("text")).where("id is not null")
    sent = spark.broadcast(_frequent(rows, words))
    kinds = T.StructType([rows.schema["id"], T.StructField("body", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("print", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))])
    wide = written(rows.mapInArrow(lambda it: _prefixes(it, words, similarity, sent.value), kinds), "prefixes")
    same = wide.select("id", "body")
    firsts = same.groupBy("body").agg(F.min("id").alias("first")).checkpoint()
    one = wide.join(firsts.withColumnRenamed("first", "id"), ["body", "id"], "left_semi").dropDuplicates(["body", "id"])
    prints = one.groupBy("id").agg(F.first("print").alias("print"))

    def pruned(pairs: DataFrame) -> DataFrame:
        both = pairs.join(prints.toDF("a", "print_a"), "a").join(prints.toDF("b", "print_b"), "b")
        return both.where(keeps_to_budget(F.col("print_a"), F.col("print_b"), wide_budget(similarity))).select("a", "b")

    keyed = one.select("id", "size", F.posexplode("prefix").alias("pos", "key"))
    member = F.struct("id", "size", "pos")
    ends_of = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(member).alias("low"), F.max(member).alias("high")).where("n > 1")
    met = written(keyed.join(ends_of, "key").select("key", "id", "size", "pos", "n", "low", "high"), "met")
    ends = met.select(F.struct("id", "size", "pos").alias("m"), F.explode(F.array("low", "high")).alias("e"))
    near = written(ends.where((F.col("m.id") != F.col("e.id")) & _may_be_similar("m", "e", similarity)).select(*_pair(F.col("m.id"), F.col("e.id"))).distinct(), "near")
    links_ = _similar(written(pruned(near), "near-pruned"), rows, words, similarity)

    inner = met.where((F.col("n") > 3) & (F.col("id") != F.col("low.id")) & (F.col("id") != F.col("high.id"))).select("key", "id", "size", "pos")
    so_far = connect(links_, "a", "b").withColumnRenamed("component", "part")
    placed = written(inner.join(so_far, "id", "left").select("key", "id", "size", "pos", F.coalesce("part", "id").alias("part")), "placed")
    apart_ = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("one"), F.max("part").alias("other")).where("one < other").select("key", "n")
    mixed = written(placed.join(apart_, "key"), "mixed")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    x = mixed.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).alias("x")
    y = mixed.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).alias("y")
    apart = (F.col("x.id") < F.col("y.id")) & (F.col("x.part") != F.col("y.part")) & _may_be_similar("x", "y", similarity)
    more = written(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & apart).select(*_pair(F.col("x.id"), F.col("y.id"))).distinct(), "more")
    left = written(pruned(more.join(near, ["a", "b"], "left_anti")), "more-pruned")
    parts_ = connect(links_.union(_similar(left, rows, words, similarity)), "a", "b")
    groups_ = firsts.join(parts_, firsts["first"] == parts_["id"], "left").select("body", F.coalesce("component", "first").alias("component_id"))
    return same.join(groups_, "body").select(F.col("id").alias(doc_id), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of similar texts, that of the least id; columns as before.

    Rows of one id are one document: of its equal texts one row stays, the first by its JSON; other texts of it stay,
    as nothing tells which is meant. Rows with a null id are kept: nothing names them. Null and empty texts are alike,
    so one of them stays.
    """
    first = similar_groups(docs, doc_id, text, words, similarity).select(F.col("component_id").alias("_keep")).distinct()
    rows = docs.select(packed(docs), F.col(doc_id).alias("_id"), F.xxhash64(whole(text)).alias("_body"))
    kept = rows.join(first, rows["_id"] == first["_keep"], "left_semi")
    several = kept.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id").checkpoint()
    one = kept.where(F.col("_id").isNotNull()).select("_row")
    if not several.isEmpty():
        of_many = kept.join(several, "_id", "left_semi").groupBy("_id", "_body").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
        one = kept.join(several, "_id", "left_anti").select("_row").union(of_many.select("_row"))
    return one.union(rows.where("_id is null").select("_row")).select(*unpacked(docs.columns))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
