"""Embedding whitening by TSQR: exact sums, a QR of each partition, R factors merged as a tree, the SVD of the last R.

The centred fit list X has no more to say about its directions than the R of its QR: with R = U s W', the columns of W are
the unit eigenvectors of X'X, and s² / n the eigenvalues of the covariance, which is never formed. Entries are
integers; sums are taken of integers, so centring loses nothing to their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.tables import written
from bidlens.llm.text import packed, unpacked
from bidlens.session import prepare

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: R factors that a task merges at a time.
FAN_IN = 8
#: Rows that a task stacks onto its R at a time, at least.
STACKED = 4096
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Whitening:
    """``directions``: unit vectors as columns by falling variance; ``variances``: theirs; ``total``: that of all directions."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    total: float

    def explained(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else np.zeros(len(self.variances))

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; a direction without variance gives 0."""
        root = np.sqrt(self.variances)
        return centred(x, self.n, self.sums) @ self.directions / np.where(root > 0, root, np.inf)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum of (n x - S)², exact: integers that wrap around are right wherever the true sum fits a long; elsewhere null."""
        sums = np.array([s % (1 << 64) for s in self.sums], np.uint64)
        off = np.uint64(self.n) * x.astype(np.uint64) - sums
        exact = (off * off).sum(1, dtype=np.uint64).view(np.int64)
        about = ((centred(x, self.n, self.sums) * self.n) ** 2).sum(1)
        return [int(e) if a < 9.2e18 else None for e, a in zip(exact, about, strict=True)]


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x less the means: the whole part as integers, then the fraction."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in sums])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def quantised(vectors: DataFrame, vector: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vectors`` as rows (_row, x): those whose vector has entries, all of them finite, of the length that most have.

    x is floor(scale * entry) + offset, as long. Of lengths that equally many rows have, the larger counts.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    fine = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad))
    lengths = fine.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    x = F.transform(v, lambda e: F.floor(e * scale).cast("long") + F.lit(offset).cast("long"))
    return fine.where(F.size(v) == (lengths["d"] if lengths else 0)).select(packed(vectors), x.alias("x"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension the sums of the upper and the lower halves of the entries: neither overflows."""
    high = low = None
    n = 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            h, w = (x >> 32).sum(0), (x & _LOW).sum(0)
            high, low, n = (h, w, n + len(x)) if high is None else (high + h, low + w, n + len(x))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(high)), pa.int32()), pa.array(high), pa.array(low), pa.array([n] * len(high), pa.int64())], ["dim", "high", "low", "n"])


def exact_sums(fit: DataFrame) -> tuple[int, tuple[int, ...]]:
    """n and the sums of the column x per dimension: as many rows come to the driver as there are dimensions."""
    parts = fit.select("x").mapInArrow(_sums, "dim int, high bigint, low bigint, n bigint")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = sorted(parts.groupBy("dim").agg(total("high").alias("high"), total("low").alias("low"), total("n").alias("n")).collect())
    return (int(rows[0]["n"]) if rows else 0), tuple((int(r["high"]) << 32) + int(r["low"]) for r in rows)


def _triangle(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def _factor(batches: Iterator[pa.RecordBatch], n: int, sums: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The R of a partition's centred rows, some thousand rows at a time."""
    r, held, count = None, [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(centred(_matrix(batch.column(0)), n, sums))
            count += batch.num_rows
        if count >= STACKED:
            r, held, count = _triangle(r, np.vstack(held)), [], 0
    if held:
        r = _triangle(r, np.vstack(held))
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])


def _fold(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    factors = (np.frombuffer(raw.as_py()).reshape(-1, d) for batch in batches for raw in batch.column(0))
    r = reduce(_triangle, factors, None)
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])


def last_factor(fit: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The R factor of the whole centred column x. Each round of the tree merges ``FAN_IN`` factors in a task."""
    d, parts = len(sums), fit.rdd.getNumPartitions()
    factors = fit.select("x").mapInArrow(lambda it: _factor(it, n, sums), "r binary").select(F.spark_partition_id().alias("node"), "r")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        dealt = factors.select(F.floor(F.col("node") / FAN_IN).cast("int").alias("node"), "r")
        # a group is at most FAN_IN factors
        factors = dealt.groupBy("node").applyInArrow(lambda key, table: pa.table({"node": [key[0]], "r": pa.array([x.column(0)[0].as_py() for x in _fold(iter(table.select(["r"]).to_batches()), d)], pa.binary())}, pa.schema([("node", pa.int32()), ("r", pa.binary())])), "node int, r binary")
    return np.frombuffer(factors.first()["r"]).reshape(-1, d)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From the rows of the column x, a written table; None for an empty one. Each of the two passes shuffles R factors or sums alone."""
    prepare(fit.sparkSession)
    n, sums = exact_sums(fit)
    if not n:
        return None
    _, s, rows = np.linalg.svd(last_factor(fit, n, sums), full_matrices=True)
    variances = np.zeros(len(sums))
    variances[: len(s)] = s**2 / n
    # what rounding leaves of a direction without variance
    variances[np.sqrt(variances * n) <= s[0] * max(len(sums), 1) * np.finfo(float).eps] = 0
    k = min(components, len(sums))
    return Whitening(n, sums, np.ascontiguousarray(rows[:k].T), variances[:k], float(variances.sum()))


def _moments(batches: Iterator[pa.RecordBatch], w: Whitening) -> Iterator[pa.RecordBatch]:
    k, total = w.directions.shape[1], None
    for batch in batches:
        if batch.num_rows:
            y = np.hstack([w.project(_matrix(batch.column(0))), np.ones((batch.num_rows, 1))])
            total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "value"])


def identity_error(fit: DataFrame, w: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity, over directions with variance; None without any."""
    k, live = w.directions.shape[1], np.flatnonzero(w.variances > 0)
    if not len(live):
        return None
    m = np.zeros((k + 1, k + 1))
    for r in fit.select("x").mapInArrow(lambda it: _moments(it, w), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["value"]
    mean = m[:k, k] / w.n
    off = m[:k, :k] / w.n - np.outer(mean, mean) - np.eye(k)
    return float(np.abs(off[np.ix_(live, live)]).max())


def _whitened(batches: Iterator[pa.RecordBatch], w: Whitening) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            y = w.project(x)
            values = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(w.deviations(x), pa.int64()), values], ["_row", "deviation", "whitened"])


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, Whitening | None, float | None]:
    """The rows of ``vectors`` that can be whitened, as (_row, deviation, whitened), with the fit and its identity error.

    Left out are vectors that are null, empty, hold null or non-finite entries, or are of another length than most.
    The fit takes each distinct quantised vector once, so copies, however many, weigh as one; all rows are whitened,
    repeated ones and those without an id, too. ``_row`` holds the row's columns, whatever their names. A direction
    without variance (one distinct vector, fewer vectors than dimensions, a constant entry) gives 0 and explains 0.
    No rows give no fit and an empty result.
    """
    prepare(vectors.sparkSession)
    rows = quantised(vectors, vector, scale, offset)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    w = fit_whitening(fit, components)
    schema = T.StructType([rows.schema["_row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if w is None:
        return vectors.sparkSession.createDataFrame([], schema), None, None
    return rows.mapInArrow(lambda it: _whitened(it, w), schema), w, identity_error(fit, w)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    out, w, error = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    explained = F.array(*[F.lit(float(e)) for e in (w.explained() if w else [0.0])])
    flat = out.select(*unpacked(["vec_id"]), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(w.n if w else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
