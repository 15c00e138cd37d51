"""Whitening against the covariance that it never forms, and against exact integers."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from bidlens.llm import whitening
from bidlens.llm.tables import written


def plain(rows):
    """(n, variances, trace, per row: exact deviation and projections of either sign)."""
    x = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    e, vectors = np.linalg.eigh(c.T @ c / n)
    e, vectors = e[::-1][:16], vectors[:, ::-1][:, :16]
    out = {}
    for i, v in x:
        d = [n * a - s for a, s in zip(v, sums, strict=True)]
        out.setdefault(i, []).append((sum(y * y for y in d), np.abs(np.array(d) / n @ vectors / np.sqrt(e))))
    return n, e, np.trace(c.T @ c / n), out


def test_query_equals_the_plain_form(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    n, e, trace, want = plain(rows)
    got = whitening.op13_whitening(spark, sf).collect()
    assert len(got) == sum(map(len, want.values())) * 16
    for r in got:
        assert any(r["deviation"] == d and abs(abs(r["whitened"]) - w[r["component"] - 1]) < 1e-7 for d, w in want[r["vec_id"]])
        assert r["n"] == n and abs(r["explained"] / (e[r["component"] - 1] / trace) - 1) < 1e-9 and r["identity_error"] < 1e-9


def rows_of(k, d, seed=1):
    draw = np.random.default_rng(seed)
    return [(i, (draw.normal(size=d) * np.linspace(3, 0.2, d) + 5).astype("float32").tolist()) for i in range(k)]


@pytest.mark.parametrize("parts", [1, 2, 30])
def test_odd_rows_and_any_partitioning(spark, parts):
    rows = rows_of(300, 5)
    rows += [(i + 1000, rows[0][1]) for i in range(200)] + [(None, rows[1][1]), (7, rows[2][1]), (8, None), (9, []), (10, [1.0, None, 1.0, 1.0, 1.0])]
    rows += [(11, [float("nan")] * 5), (12, [float("inf")] * 5), (13, [1.0] * 4), (14, [1e6, -1e6, 0.0, -0.0, 1.5])]
    n, e, trace, want = plain([r for r in rows if r[1] is None or len(r[1]) != 4])
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id bigint, embedding array<float>, deviation int, _row string").repartition(parts)
    out, w, error = whitening.whiten(df)
    got = out.selectExpr("_row.vec_id", "_row._row", "deviation", "whitened").collect()
    assert (w.n, len(got)) == (n, sum(map(len, want.values()))) and error < 1e-6
    assert np.allclose(w.variances, e) and np.isclose(w.total, trace)
    for r in got:
        assert r["_row"] == "c" and any(r["deviation"] == (d if d < 1 << 63 else None) and np.allclose(np.abs(r["whitened"]), p, atol=1e-6) for d, p in want[r["vec_id"]])


def test_directions_without_variance(spark):
    for rows, live in (([(1, [1.0, 2.0])] * 3, 0), ([(1, [1.0, 2.0]), (2, [3.0, 2.0])], 1), ([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], 1)):
        out, w, error = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>"))
        assert (w.variances > 0).sum() == live and (error is None) == (live == 0)
        assert all(x == 0 for r in out.collect() for x in r["whitened"][live:])
    out, w, error = whitening.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id int, embedding array<double>"))
    assert (out.collect(), w, error) == ([], None, None)


def test_large_entries_stay_exact(spark):
    """Entries of 2^40, sums past 2^53, and a deviation that no long holds."""
    big = [[(1 << 40) + 3 * i, i * i, -(1 << 41) - i] for i in range(40)] * 2
    fit = written(spark.createDataFrame([(v,) for v in big], "x array<bigint>").distinct().repartition(7), "test-fit")
    n, sums = whitening.exact_sums(fit)
    assert (n, sums) == (40, tuple(sum(c) // 2 for c in zip(*big, strict=True)))
    w = whitening.fit_whitening(fit)
    x = np.array(big[:40])
    assert w.deviations(x) == [sum((n * int(a) - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert w.deviations(np.array([[1 << 60, 0, 0]])) == [None]
    c = np.array([[float(n * int(a) - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    assert np.allclose(w.variances, np.linalg.eigvalsh(c.T @ c / n)[::-1], rtol=1e-9, atol=1e-6)


def test_hot_vector_and_tree_of_factors(spark):
    rows = rows_of(2000, 12, 3)
    df = spark.createDataFrame(rows + [(9, rows[0][1])] * 1000, "vec_id bigint, embedding array<float>").repartition(70)
    _, w, error = whitening.whiten(df, components=12)
    n, e, _, _ = plain(rows)
    assert w.n == n and np.allclose(w.variances, e, rtol=1e-9) and error < 1e-9
    fit = written(whitening.quantised(df, "embedding").select("x").distinct().repartition(70), "test-fit")
    assert np.allclose(whitening.fit_whitening(fit, 12).variances, e, rtol=1e-9)
