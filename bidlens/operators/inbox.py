"""The inbox: matched notices, triaged, one row per case; and the counters of its header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.operators.grain import Filters

NEW_DAYS = 7
COLUMNS = ("notice_id", "case_key", "source", "region", "state", "score", "profiles", "reasons", "first_published", "notices", "days_left", "is_new")


def _orders(as_of: str) -> dict[str, list[Column]]:
    left, score, first = F.col("days_left"), F.col("score"), F.col("first_published")
    return {
        "urgency": [F.when(left < 0, 2).when(left.isNull(), 1).otherwise(0), F.abs(F.coalesce(left, F.lit(9999))), score.desc()],
        "score": [score.desc(), first.desc_nulls_last()],
        "recent": [first.desc_nulls_last()],
        "oldest": [first.asc_nulls_last()],
        "amount": [F.col("budget").desc_nulls_last()],
    }


def one_per_case(entry: DataFrame, filters: Filters, as_of: str) -> DataFrame:
    """The latest notice of each case among those that pass; counts and first publication look at these alone."""
    by_case = Window.partitionBy("case_key")
    latest = by_case.orderBy(F.col("published").desc_nulls_last(), F.col("notice_id").desc())
    day = F.lit(as_of).cast("date")
    rows = entry.where(filters.condition(as_of)).withColumns({"rn": F.row_number().over(latest), "notices": F.count("*").over(by_case), "first_published": F.min("published").over(by_case)})
    since = F.datediff(day, F.col("first_published"))
    return rows.where("rn = 1").drop("rn").withColumns({"days_left": F.datediff("deadline", day), "is_new": F.coalesce(since.between(0, NEW_DAYS), F.lit(False))})


def inbox(entry: DataFrame, as_of: str, filters: Filters = Filters(), order: str = "urgency", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the inbox. ``entry`` has discarded notices, too, so that they can be asked for."""
    rows = one_per_case(entry, filters, as_of).orderBy(*_orders(as_of)[order], F.col("notice_id")).offset(offset).limit(limit)
    return rows.select(*COLUMNS)


def count(entry: DataFrame, as_of: str, filters: Filters = Filters()) -> DataFrame:
    """The number of cases that pass."""
    return entry.where(filters.condition(as_of)).agg(F.countDistinct("case_key").alias("cases"))


def header(entry: DataFrame, as_of: str, new_after: int) -> DataFrame:
    """All counters in one pass; each equals the length of the list with the same filters, but ``new_notices`` counts notices."""
    on = lambda **f: F.bool_or(F.coalesce(Filters(**f).condition(as_of), F.lit(False)))
    cases = entry.groupBy("case_key").agg(
        on().alias("all_cases"),
        on(live=True).alias("open_cases"),
        on(live=True, closing_days=7).alias("closing"),
        on(review="siguiendo").alias("followed"),
        on(review="descartado").alias("discarded"),
        F.count(F.when(Filters(after_id=new_after).condition(as_of), 1)).alias("new_notices"),
    )
    counted = [F.count_if(c).alias(c) for c in ("all_cases", "open_cases", "closing", "followed", "discarded")]
    return cases.agg(*counted, F.coalesce(F.sum("new_notices"), F.lit(0)).alias("new_notices"))


def by_profile(matches: DataFrame, notices: DataFrame) -> DataFrame:
    """Cases per profile, without discarded ones."""
    kept = notices.where(F.coalesce("review_state", F.lit("nuevo")) != "descartado").select("notice_id", "case_key")
    return matches.join(kept, "notice_id").groupBy("profile").agg(F.countDistinct("case_key").alias("cases"))


def by_profile_in_row(notices: DataFrame, found: str = "found") -> DataFrame:
    """As :func:`by_profile`, of notices that carry their matches as an array: no join."""
    kept = notices.where(F.coalesce("review_state", F.lit("nuevo")) != "descartado")
    pairs = kept.select("case_key", F.explode(F.transform(found, lambda x: x["profile"])).alias("profile")).distinct()
    return pairs.groupBy("profile").agg(F.count("*").alias("cases"))


def regions(notices: DataFrame) -> DataFrame:
    return notices.where("region is not null").groupBy("region").agg(F.countDistinct("case_key").alias("cases"))


def coverage(entry: DataFrame) -> DataFrame:
    """Per source: first and last month, cases, and cases that no notice gives a region."""
    bare = entry.groupBy("source", "case_key").agg(F.max("region").alias("region"), F.min(F.date_format("published", "yyyy-MM")).alias("low"), F.max(F.date_format("published", "yyyy-MM")).alias("high"))
    return bare.groupBy("source").agg(F.min("low").alias("first_month"), F.max("high").alias("last_month"), F.count("*").alias("cases"), F.count(F.when(F.col("region").isNull(), 1)).alias("without_region"))
