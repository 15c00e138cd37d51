"""Contracts that end soon, and who holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.functions.fence import fenced
from bidlens.functions.scalars import company_key, window_end, without_marks
from bidlens.session import prepare


def within(rows: DataFrame, as_of: str, months: int) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return rows.where((F.col("ends_on") >= day) & (F.col("ends_on") < window_end(day, months)))


def expiries(entry: DataFrame, as_of: str, months: int = 6, limit: int = 200) -> DataFrame:
    """The list: nearest end first. Counts notices, as its totals do."""
    left = F.datediff("ends_on", F.lit(as_of).cast("date")).alias("days_left")
    rows = within(entry, as_of, months).orderBy("ends_on", F.col("money").desc(), "notice_id").limit(limit)
    return rows.select("notice_id", "buyer", "region", "awardee", "profiles", "ends_on", F.col("money").cast("double").alias("money"), left)


def windows(entry: DataFrame, as_of: str, months: tuple[int, ...] = (3, 6, 12, 24)) -> DataFrame:
    """Notices and money of each window, in one pass: the narrow windows lie in the widest."""
    day = F.lit(as_of).cast("date")
    inside = lambda m: F.col("ends_on") < window_end(day, m)
    sums = within(entry, as_of, max(months)).agg(*[x for m in months for x in (F.count(F.when(inside(m), 1)).alias(f"n{m}"), F.coalesce(F.sum(F.when(inside(m), F.col("money"))), F.lit(0)).cast("double").alias(f"s{m}"))])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(m).alias("months"), F.col(f"n{m}").alias("total"), F.col(f"s{m}").alias("money")) for m in months])))


def awardees(entry: DataFrame, limit: int = 20) -> DataFrame:
    """Companies by contracts, spellings of one name together; discarded notices count here. The key is made once for each spelling."""
    prepare(entry.sparkSession)
    pairs = entry.where("awardee is not null").groupBy("awardee", "buyer").agg(F.count("*").alias("n"), F.sum("money").alias("money")).checkpoint()
    names = fenced(pairs.select("awardee").distinct(), {"company_key": company_key(F.col("awardee"))}).where("company_key is not null")
    longest = F.max_by("awardee", F.struct(F.length("awardee"), "awardee"))
    rows = pairs.join(names, "awardee").groupBy("company_key").agg(longest.alias("company"), F.sum("n").alias("contracts"), F.sum("money").cast("double").alias("money"), F.countDistinct("buyer").alias("buyers"))
    return rows.orderBy(F.col("contracts").desc(), F.col("money").desc(), "company_key").limit(limit)


def contracts_of(entry: DataFrame, company: str, limit: int = 60) -> DataFrame:
    """Contracts of a company under any spelling of its name. Only names that have all words of its key are cut down to theirs."""
    key, name = company_key(F.lit(company)), without_marks(F.lower("awardee"))
    some = F.forall(F.split(key, " "), lambda w: name.contains(w))
    rows = entry.where(F.when(some, company_key(F.col("awardee"))) == key).orderBy(F.col("money").desc(), "notice_id").limit(limit)
    return rows.select("notice_id", "awardee", "buyer", F.col("money").cast("double").alias("money"))


def renewals(entry: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    rows = within(entry, as_of, months).groupBy("case_key").agg(F.max("awardee").alias("holder"))
    return rows.agg(F.count("*").alias("cases"), F.count("holder").alias("with_holder"))


def discard_reasons(notices: DataFrame) -> DataFrame:
    rows = notices.where("review_state = 'descartado' and discard_reason is not null").select("case_key", "discard_reason").distinct()
    return rows.groupBy("discard_reason").agg(F.count("*").alias("cases"))
