"""Exact dedup and its filters against plain dictionaries and SQL."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from bidlens.llm import exact

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
LOWER = str.maketrans(exact.UPPER, exact.LOWER)


@pytest.mark.parametrize(("bits", "high", "n"), [(64, 1 << 63, 5000), (20, 1 << 19, 5000), (8, 200, 300), (30, 1000, 1000), (64, 10, 50)])
def test_filter_keeps_each_count(bits, high, n):
    draw = np.random.default_rng(bits)
    prints, counts = np.unique(draw.integers(0, high, n).astype(np.uint64), return_counts=True)
    counts = counts * draw.integers(1, 5000, len(counts))
    made = exact.CountingQuotientFilter.of(prints, counts, bits)
    for f in (made, exact.CountingQuotientFilter.from_bytes(made.to_bytes())):
        assert [x.tolist() for x in f.items()] == [prints.tolist(), counts.tolist()]
        assert all(f.count(p) == c for p, c in list(zip(prints.tolist(), counts.tolist(), strict=True))[:200])
        assert all(f.count(x) == 0 for x in range(150) if x not in set(prints.tolist()))


def test_filters_merge_losslessly():
    draw = np.random.default_rng(5)
    parts = [draw.integers(0, 300, k).astype(np.uint64) for k in (0, 1, 400, 3000)]
    merged = exact.CountingQuotientFilter.of(np.zeros(0, np.uint64), np.zeros(0, np.int64), 16)
    for p in parts:
        prints, counts = np.unique(p, return_counts=True)
        merged = merged.merged(exact.CountingQuotientFilter.of(prints, counts, 16))
    assert dict(zip(*(x.tolist() for x in merged.items()), strict=True)) == Counter(np.concatenate(parts).tolist())


def test_repeated_prints_of_many_small_filters(spark):
    """Filters of 50 prints each; one print has a third of all rows."""
    values = [(hash((i, "x")) if i % 3 else 77) & ~0xFF for i in range(3000)] + [v << 30 for v in range(200)] * 2
    df = spark.createDataFrame([(v,) for v in values], "print bigint").repartition(6)
    got = {r["print"]: r["copies"] for r in exact.repeated_prints(df, len(values), 56, 50, 100).collect()}
    assert got == {v: n for v, n in Counter(values).items() if n > 1}


ROWS = [
    (1, "Same TEXT é"), (2, "same text é"), (3, "same text É"), (4, None), (5, ""), (None, ""), (6, "x" * 200_000), (7, "X" * 200_000),
    (8, "alone"), (9, "twice"), (9, "twice"), (9, "Twice"), (None, "no id"), (None, "no id"), (10, " "), (11, "İ"), (12, "i̇"),
]


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = ids.index(keep)
        for k, i in enumerate(ids):
            yield i, keep, len(ids), k == first, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("bits", "limit"), [(64, exact.BROADCAST_ROWS), (64, 2), (4, 2), (6, exact.BROADCAST_ROWS)])
def test_groups_of_odd_rows(spark, bits, limit):
    docs = spark.createDataFrame([(*r, "a", 1, True) for r in ROWS], "doc_id bigint, text string, print string, row int, kept boolean").repartition(3)
    got = sorted((tuple(r) for r in exact.groups(docs, bits=bits, limit=limit).select(*COLUMNS).collect()), key=str)
    assert got == sorted(plain(ROWS), key=str)
    left = exact.deduplicate(docs, bits=bits, limit=limit)
    assert left.columns == docs.columns
    kept = Counter((r[0], r[4]) for r in plain(ROWS) if r[3])
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").translate(LOWER).encode()).hexdigest()) for r in left.collect()) == kept


def test_sql_and_no_rows(spark, sf):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact.groups(none).collect() == [] == exact.deduplicate(none).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({exact.OP12_SQL})").fetchall())
    assert sorted(tuple(r) for r in exact.op12_exact_dedup(spark, sf).select(*COLUMNS).collect()) == want
