"""Session helpers shared by every part of the package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bidlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and give checkpoints a shared folder.

    A cluster names the folder in ``spark.checkpoint.dir``; only where it is unset
    (a local test session) a temporary one is chosen.
    """
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_root(spark))
    return spark


def _shared_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
    return named or f"file://{tempfile.mkdtemp(prefix='spark-bidlens-')}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for a table that one job writes and the next reads."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Rows of a large table that one partition of a shuffle gets on average.
PARTITION_ROWS = 250_000
_PARTITIONS = "spark.sql.shuffle.partitions"


def partitions_for(spark: SparkSession, rows: int) -> int:
    """The session's number of shuffle partitions, or more if that leaves more than ``PARTITION_ROWS`` rows to each."""
    return max(int(spark.conf.get(_PARTITIONS)), -(-rows // PARTITION_ROWS))


@contextmanager
def partitioned_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside shuffle into :func:`partitions_for` so many rows; the session's number holds again after them.

    Memory of a task then depends on the rows of a partition, not on those of the input. Adaptive execution joins small ones.
    """
    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(partitions_for(spark, rows)))
    try:
        yield
    finally:
        spark.conf.set(_PARTITIONS, before)
