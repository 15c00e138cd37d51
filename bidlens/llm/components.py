"""Connected components of a link table, by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.session import prepare

MAX_ROUNDS = 60


def _to_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the least of u's own id and its v as ``m``. Partial minima meet first, so a hub is no burden."""
    least = pairs.groupBy("u").agg(F.min("v").alias("w"))
    return pairs.join(least.withColumnRenamed("u", "x"), F.col("u") == F.col("x")).select("u", "v", F.least("u", "w").alias("m"))


def connect(links: DataFrame, a: str, b: str) -> DataFrame:
    """For each id in a link: id, component (the least id that links reach).

    Ids are compared as they are (long or string); links with a null side are left out; self links and repeated links
    do no harm; no links give an empty result. Each round hangs what is above an id on the least neighbour, then what
    is below it; lineage is cut by ``checkpoint``. When a round changes nothing, the links are stars. An id appears as
    often in a task as it has links, never its whole component.
    """
    prepare(links.sparkSession)
    ids = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    edges = ids.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    mark = None
    for _ in range(MAX_ROUNDS):
        n, h = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, h) == mark or not n:
            break
        mark = (n, h)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _to_least(large)
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v")).where("u <> v")).distinct().checkpoint()
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
