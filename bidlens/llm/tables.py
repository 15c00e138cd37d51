"""Steps written as tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.session import scratch

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df``, written as a compressed table and read again: lineage ends here, and shuffle files that led here go.

    Columns of hashes hardly shrink; for a table of these a quick ``compression`` will do.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a looked-up table that are broadcast at most.
BROADCAST_ROWS = 300_000


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``weight`` the number of rows of ``left`` with it.

    Up to ``limit`` rows are broadcast. Beyond it, only keys of more than a ``limit``-th of all weight are, of which
    there are fewer than ``limit`` whatever the input; the others, none of them hot, meet in a shuffle. ``how`` is left,
    inner or left_semi. ``right`` should be a written table, as it is read more than once. Keys are never null.
    """
    n, total = right.agg(F.count("*"), F.sum(weight)).first()
    if n <= limit:
        return left.join(F.broadcast(right), keys, how)
    heavy, light = right.where(F.col(weight) > total / limit), right.where(F.col(weight) <= total / limit)
    hot = left.join(F.broadcast(heavy), keys, "left_semi" if how == "left_semi" else "inner")
    cold = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return hot.unionByName(cold)
