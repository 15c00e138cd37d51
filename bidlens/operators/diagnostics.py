"""Checks of stored tables, all of them in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _ids(rows: DataFrame, key: str, kind: str, **flags: Column) -> DataFrame:
    named = {"empty": F.lit(False), "amiss": F.lit(False)} | flags
    return rows.select(F.col(key).alias("id"), F.lit(kind).alias("kind"), *[v.alias(k) for k, v in named.items()])


def checked(notices: DataFrame, matches: DataFrame, indexed: DataFrame, key: str, text: str, fingerprint: str, judged: str) -> DataFrame:
    """One row: notices, those without a text, those whose judged fingerprint is another one, ids that come twice, matches, matches without a notice, indexed notices, notices with a text that the index lacks, indexed ids without a notice.

    The three tables meet once, by id: partial counts of each id are made before the shuffle.
    """
    blank = F.coalesce(F.trim(F.col(text)) == "", F.lit(True))
    rows = _ids(notices, key, "notice", empty=blank, amiss=~F.col(fingerprint).eqNullSafe(F.col(judged))).unionByName(_ids(matches, key, "match")).unionByName(_ids(indexed, key, "index"))
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    by_id = rows.groupBy("id").agg(n("notice"), n("match"), n("index"), F.count_if("empty").alias("empty"), F.count_if("amiss").alias("amiss"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    here, listed = F.col("notice") > 0, F.col("index") > 0
    return by_id.agg(
        total("notice", "notices"),
        total("empty", "without_text"),
        total("amiss", "pending"),
        F.count_if(F.col("notice") > 1).alias("repeated_ids"),
        total("match", "matches"),
        total(F.when(~here, F.col("match")), "matches_without_notice"),
        F.count_if(listed).alias("indexed"),
        F.count_if(here & (F.col("empty") < F.col("notice")) & ~listed).alias("not_indexed"),
        F.count_if(~here & listed).alias("indexed_without_notice"),
    )


def observed(rows: DataFrame, text: str, name: str = "stored") -> tuple[DataFrame, Observation]:
    """``rows``, of which whatever writes them also counts rows and missing texts; the counts are in the observation when it has."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.trim(F.col(text)) == "", F.lit(True))).alias("without_text")), seen
