"""The grain of the model: notices that a profile matched, and the cases that they make."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions.search import prefix, searchable
from bidlens.session import prepare

LIVE_STATES = ("previo", "publicada", "evaluacion")


def matched(matches: DataFrame) -> DataFrame:
    """One row per notice: best score, profiles and reasons. Before the join, so that two profiles never double a notice."""
    return matches.groupBy("notice_id").agg(
        F.max("score").alias("score"),
        F.array_join(F.array_sort(F.collect_set("profile")), ",").alias("profiles"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("profile", "reason"))), lambda x: F.concat(x["profile"], F.lit(": "), x["reason"])), " · ").alias("reasons"),
    )


def entry_in_row(notices: DataFrame, found: str = "found", discarded: bool = False) -> DataFrame:
    """As :func:`entry`, of notices that carry their matches (profile, score, reason) as an array: no join, no shuffle."""
    some = notices.where(F.size(found) > 0)
    rows = some if discarded else some.where(F.coalesce("review_state", F.lit("nuevo")) != "descartado")
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["profile"].alias("profile"), x["reason"].alias("reason"))))
    told = {
        "score": F.array_max(F.transform(found, lambda x: x["score"])),
        "profiles": F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["profile"]))), ","),
        "reasons": F.array_join(F.transform(ordered, lambda x: F.concat(x["profile"], F.lit(": "), x["reason"])), " · "),
    }
    return rows.withColumns(told).drop(found)


def entry(notices: DataFrame, matches: DataFrame, discarded: bool = False) -> DataFrame:
    """Matched notices with score, profiles and reasons; those that a reviewer discarded only on demand."""
    out = notices.join(matched(matches), "notice_id")
    return out if discarded else out.where(F.coalesce("review_state", F.lit("nuevo")) != "descartado")


def live(as_of: str) -> Column:
    """An open state, and a deadline that isn't past."""
    return F.col("state").isin(*LIVE_STATES) & (F.col("deadline").isNull() | (F.col("deadline") >= F.lit(as_of).cast("date")))


@dataclass(frozen=True)
class Filters:
    """What an inbox list and its counters share. Unset fields don't filter; set ones all hold."""

    profile: str | None = None
    review: str | None = None
    live: bool = False
    closing_days: int | None = None
    region: str | None = None
    source: str | None = None
    min_amount: float | None = None
    after_id: int | None = None
    words: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None

    def condition(self, as_of: str) -> Column:
        state, day = F.coalesce("review_state", F.lit("nuevo")), F.lit(as_of).cast("date")
        out = state == self.review if self.review else state != "descartado"
        if self.profile:
            out &= F.array_contains(F.split("profiles", ","), self.profile)
        if self.live:
            out &= live(as_of)
        if self.closing_days is not None:
            out &= F.col("deadline").between(day, F.date_add(day, self.closing_days))
        if self.region:
            out &= F.col("region") == self.region
        if self.source:
            out &= F.col("source").ilike(f"{self.source}%")
        if self.min_amount:
            out &= F.col("budget") >= self.min_amount
        if self.after_id is not None:
            out &= F.col("notice_id") > self.after_id
        for w in self.words:  # each begins a word of the title; marks and case aside
            out &= prefix(searchable(F.col("title")), w)
        if self.since:
            out &= F.date_format("published", "yyyy-MM") >= self.since
        if self.until:
            out &= F.date_format("published", "yyyy-MM") <= self.until
        return out


def cases(rows: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row per case: month of the first publication, largest amount, best score; months as yyyy-MM, a case without one is in no range."""
    out = rows.groupBy("case_key").agg(F.min(F.date_format("published", "yyyy-MM")).alias("month"), F.max("money").alias("money"), F.max("score").alias("score"))
    for bound, ok in ((since, F.col("month") >= since), (until, F.col("month") <= until)):
        out = out.where(ok) if bound else out
    return out


def in_range(rows: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """The rows, all of them, of the cases whose first publication is in the months given (yyyy-MM, both ends included)."""
    for month in (since, until):
        if month is not None and not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", month):
            raise ValueError(f"not a month: {month!r}")
    return rows.join(cases(rows, since, until).select("case_key"), "case_key", "left_semi") if since or until else rows


def ranks(values: DataFrame, value: str, percents: tuple[int, ...] = (25, 75)) -> DataFrame:
    """One row: n, median (mean of the middle two) and, per percent, the nearest rank (half to even).

    Equal values become one with a count; distinct values are dealt by range, so that no task holds them all,
    and the counts of the ranges (a row for each partition) give the places.
    """
    prepare(values.sparkSession)
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("p")).checkpoint()
    from pyspark.sql import Window

    totals = dealt.groupBy("p").agg(F.sum("n").alias("sum"))
    before = totals.select("p", (F.sum("sum").over(Window.orderBy("p")) - F.col("sum")).alias("before"), F.sum("sum").over(Window.partitionBy()).alias("all"))
    placed = dealt.join(F.broadcast(before), "p")
    end = F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    placed = placed.select("v", "all", (end - F.col("n")).alias("first"), end.alias("end"))
    at = lambda i: F.max(F.when((F.col("first") <= i) & (i < F.col("end")), F.col("v")))
    last = F.col("all") - 1
    nearest = [at(F.bround(F.lit(p / 100) * last, 0)).alias(f"p{p}") for p in percents]
    return placed.agg(F.coalesce(F.max("all"), F.lit(0)).alias("n"), ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("median"), *nearest)


def bins(values: DataFrame, value: str, cuts: tuple[int, ...]) -> DataFrame:
    """low, high (null: open) and n of half-open bins; each value is in one, and empty bins are there, too."""
    spark = values.sparkSession
    edges = [(0 if k == 0 else cuts[k - 1], cuts[k] if k < len(cuts) else None, k) for k in range(len(cuts) + 1)]
    spine = spark.createDataFrame(edges, "low bigint, high bigint, k int")
    k = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        k = F.when(F.col(value) < cut, F.lit(i)).otherwise(k)
    counts = values.where(F.col(value).isNotNull()).groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    return F.broadcast(spine).join(counts, "k", "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"))
