"""Blocks of the analytics view. What a statistic leaves out is counted beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlens.operators.grain import cases, live

AMOUNT_CUTS = (10_000, 25_000, 50_000, 75_000)
DISCOUNT_CUTS = (5, 15, 30, 50)
CYCLE_CUTS = (3, 5, 8, 12)
BID_CUTS = (10, 20, 30, 45)
MOST_CREDIBLE_DISCOUNT = 50.0
LONGEST_BID_WINDOW = 400
REGION_CAP = 300_000
SHORT_LIST, MIDDLE = 5.0, 4.0
#: Names of procedures that mean the same.
PROCEDURES = {"4-not specified": "5-low"}


#: What another language calls a procedure, in lower case.
PROCEDURE_SPELLINGS = {
    "obert": "Abierto", "obert simplificat": "Abierto simplificado", "obert simplificat abreujat": "Abierto simplificado",
    "restringit": "Restringido", "negociat sense publicitat": "Negociado sin publicidad", "negociat amb publicitat": "Negociado con publicidad",
    "contracte menor": "Contrato menor", "normes internes": "Normas internas", "altres": "Otros",
}
#: Procedures that are named, how the rest is called, and what a block needs before it says anything.
TOP_PROCEDURES, REST = 7, "el resto"
LEAST_MONTHS, LEAST_DISCOUNTS, LEAST_CYCLES, LEAST_WINDOWS = 12, 50, 50, 50
#: Fixed value: the month from which history is taken to be whole.
HISTORY_SINCE = "2024-01"


def ranges(as_of: str, history_since: str = HISTORY_SINCE) -> dict[str, str]:
    """The first month (yyyy-MM) of the three ranges that a user chooses among: this year, the last 24 months, all history."""
    year, month = int(as_of[:4]), int(as_of[5:7])
    back = year * 12 + month - 1 - 23
    return {"year": f"{year}-01", "24m": f"{back // 12}-{back % 12 + 1:02}", "all": history_since}


def calendar_months(entry: DataFrame) -> DataFrame:
    return cases(entry).where("month is not null").groupBy("month").agg(F.count("*").alias("cases"))


def calendar_filled(entry: DataFrame) -> DataFrame:
    """Cases of each month from the first to the last, those without any as 0. One row per month of history."""
    months = calendar_months(entry)
    day = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    span = months.agg(day(F.min("month")).alias("a"), day(F.max("month")).alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("day")).select(F.date_format("day", "yyyy-MM").alias("month"))
    return every.join(months, "month", "left").select("month", F.coalesce("cases", F.lit(0)).alias("cases"))


def calendar_mean(entry: DataFrame) -> DataFrame:
    """Mean cases of each calendar month over complete years, the year of the newest publication left out. Few rows: one per month of history."""
    months = calendar_months(entry).withColumn("year", F.substring("month", 1, 4))
    newest = entry.agg(F.date_format(F.max("published"), "yyyy").alias("newest"))
    years = months.groupBy("year").agg(F.count("*").alias("n")).where("n = 12").join(F.broadcast(newest), F.col("year") != F.col("newest")).select("year")
    rows = months.join(years, "year").groupBy(F.substring("month", 6, 2).alias("month")).agg(F.sum("cases").alias("sum"), F.count("*").alias("years"))
    return rows.select("month", F.bround(F.col("sum") / F.col("years"), 1).alias("mean"))


def calendar_cover(entry: DataFrame) -> DataFrame:
    row = entry.agg(F.max("published").alias("newest"))
    return row.select("newest", F.dayofmonth("newest").alias("days_covered"), F.dayofmonth(F.last_day("newest")).alias("days_in_month"))


def amounts(entry: DataFrame) -> DataFrame:
    return cases(entry).where("money is not null")


def amount_top(entry: DataFrame, n: int = 5) -> DataFrame:
    """The largest cases, each by its largest notice."""
    best = F.max_by(F.struct("notice_id", "title", "buyer"), F.struct("money", -F.col("notice_id"))).alias("best")
    rows = entry.where("money is not null").groupBy("case_key").agg(F.max("money").alias("money"), best).orderBy(F.col("money").desc(), "case_key").limit(n)
    return rows.select("case_key", "best.notice_id", "best.buyer", F.col("money").cast("double").alias("money"))


def discounts(entry: DataFrame) -> DataFrame:
    """case_key, kind (repeated, overrun, incomparable, kept) and discount of the latest award of each case; both amounts of one notice."""
    last = Window.partitionBy("case_key").orderBy(F.col("published").desc_nulls_last(), F.col("notice_id").desc())
    rows = entry.where("budget > 0 and award > 0").withColumn("rn", F.row_number().over(last)).where("rn = 1")
    share = 100.0 * (F.col("budget") - F.col("award")).cast("double") / F.col("budget").cast("double")
    kind = F.when(F.col("award") == F.col("budget"), "repeated").when(share < 0, "overrun").when(share > MOST_CREDIBLE_DISCOUNT, "incomparable").otherwise("kept")
    return rows.select("case_key", kind.alias("kind"), share.alias("discount"))


def bid_windows(entry: DataFrame) -> DataFrame:
    """case_key, kind (expired, implausible, kept) and days between both dates of the first notice; a first notice without a date drops its case."""
    first = Window.partitionBy("case_key").orderBy(F.col("published").asc_nulls_first(), F.col("notice_id"))
    rows = entry.withColumn("rn", F.row_number().over(first)).where("rn = 1 and published is not null and deadline is not null")
    days = F.datediff("deadline", "published")
    return rows.select("case_key", F.when(days < 0, "expired").when(days > LONGEST_BID_WINDOW, "implausible").otherwise("kept").alias("kind"), days.alias("days"))


def excluded(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("cases"))


def cycles(events: DataFrame, last: str = "purchase") -> DataFrame:
    """Per key the days from its first version to its first later ``last``; ``events`` has key, state, previous and day."""
    rows = events.groupBy("key").agg(F.min(F.when(F.col("previous").isNull(), F.col("day"))).alias("a"), F.min(F.when((F.col("state") == last) & F.col("previous").isNotNull(), F.col("day"))).alias("b"))
    return rows.where("a is not null and b is not null").select("key", F.datediff("b", "a").alias("days"))


def cpv_divisions(entry: DataFrame, n: int = 6) -> DataFrame:
    codes = entry.select("case_key", F.explode("cpv").alias("code")).select("case_key", F.substring("code", 1, 2).alias("division")).distinct()
    return codes.groupBy("division").agg(F.count("*").alias("cases")).orderBy(F.col("cases").desc(), "division").limit(n)


def cpv_products(entry: DataFrame, products: tuple[str, ...] = ("79417000", "80533100")) -> DataFrame:
    codes = entry.select("case_key", F.explode("cpv").alias("code")).where(F.col("code").isin(*products)).distinct()
    return codes.groupBy("code").agg(F.count("*").alias("cases"))


def by_lot(entry: DataFrame, as_of: str) -> DataFrame:
    """One row per case: the largest amount of each lot, so that a lot published again counts once, and their sum over lots."""
    lots = entry.groupBy("case_key", "lot").agg(
        F.max("region").alias("region"), F.max("award").alias("award"), F.max("budget").alias("budget"), F.max(live(as_of)).alias("open")
    )
    return lots.groupBy("case_key").agg(F.max("region").alias("region"), F.sum("award").alias("award"), F.sum("budget").alias("budget"), F.max("open").alias("open"))


def _by_region(rows: DataFrame, money: str, cap: int) -> DataFrame:
    m = F.col(money)
    return rows.where(F.col("region").isNotNull() & m.isNotNull()).groupBy("region").agg(
        F.count("*").alias("cases"),
        F.coalesce(F.sum(F.when(m <= cap, m)), F.lit(0)).cast("double").alias("money"),
        F.sum(m).cast("double").alias("money_with_outliers"),
        F.count(F.when(m > cap, 1)).alias("outliers"),
    )


def regions_awarded(entry: DataFrame, as_of: str, cap: int = REGION_CAP) -> DataFrame:
    return _by_region(by_lot(entry, as_of), "award", cap)


def regions_active(entry: DataFrame, as_of: str, cap: int = REGION_CAP) -> DataFrame:
    return _by_region(by_lot(entry, as_of).where("open"), "budget", cap)


def procedures(entry: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent procedures and one row for the rest."""
    name = F.col("procedure")
    for old, new in PROCEDURES.items():
        name = F.when(F.col("procedure") == old, new).otherwise(name)
    counts = entry.groupBy("case_key").agg(F.max(name).alias("procedure")).groupBy("procedure").agg(F.count("*").alias("cases"))
    first = counts.orderBy(F.col("cases").desc(), "procedure").limit(top).select("procedure", F.lit(True).alias("first"))  # a report of a few names
    both = counts.join(first, "procedure", "left")
    return both.groupBy(F.when(F.col("first"), F.col("procedure")).otherwise("rest").alias("procedure")).agg(F.sum("cases").alias("cases"))


def procedures_named(entry: DataFrame, top: int = TOP_PROCEDURES) -> DataFrame:
    """Cases by procedure under one name for all spellings, the most frequent ``top`` and one row for the rest. Cases without one aren't listed."""
    spelled = F.create_map(*[F.lit(x) for kv in PROCEDURE_SPELLINGS.items() for x in kv])
    raw = F.trim("procedure")
    per = entry.groupBy("case_key").agg(F.max("procedure").alias("procedure")).where(raw != "")
    counts = per.groupBy(F.coalesce(F.element_at(spelled, F.lower(raw)), raw).alias("procedure")).agg(F.count("*").alias("cases"))
    first = counts.orderBy(F.col("cases").desc(), "procedure").limit(top).select("procedure", F.lit(True).alias("first"))  # a report of a few names
    both = counts.join(F.broadcast(first), "procedure", "left")
    return both.groupBy(F.when(F.col("first"), F.col("procedure")).otherwise(REST).alias("procedure")).agg(F.sum("cases").alias("cases"))


def floors(entry: DataFrame, versions: DataFrame) -> DataFrame:
    """block, n, least and enough: how much each block rests on, and whether that is enough to show it."""
    kept = F.col("kind") == "kept"
    blocks = (
        ("calendar", LEAST_MONTHS, calendar_months(entry)),
        ("discount", LEAST_DISCOUNTS, discounts(entry).where(kept)),
        ("bid_window", LEAST_WINDOWS, bid_windows(entry).where(kept)),
        ("cycle", LEAST_CYCLES, cycles(versions).where("days > 0")),
    )
    counted = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("block"), "n", F.lit(least).alias("least"), (F.col("n") >= least).alias("enough")) for name, least, rows in blocks]
    return reduce(DataFrame.unionByName, counted)


def buyers(entry: DataFrame, top: int = 8) -> DataFrame:
    rows = entry.where("buyer is not null").groupBy("buyer").agg(F.countDistinct("case_key").alias("cases"))
    return rows.orderBy(F.col("cases").desc(), "buyer").limit(top)


def portfolio(entry: DataFrame, as_of: str) -> DataFrame:
    rows = entry.groupBy("case_key").agg(F.max("score").alias("score"), F.max(live(as_of)).alias("open"))
    s = F.col("score")
    sums = rows.agg(
        F.count("*").alias("cases"), F.count(F.when(s > SHORT_LIST, 1)).alias("short_list"), F.count(F.when((s > MIDDLE) & (s <= SHORT_LIST), 1)).alias("middle"),
        F.count(F.when(s <= MIDDLE, 1)).alias("rest"), F.count(F.when(F.col("open"), 1)).alias("open_cases"),
    )
    return sums.withColumn("is_archive", F.col("open_cases") / F.greatest("cases", F.lit(1)) < 0.05)


def latest_states(entry: DataFrame) -> DataFrame:
    newest = F.max_by("state", F.struct(F.coalesce(F.col("published"), F.lit("0001-01-01").cast("date")), "notice_id")).alias("state")
    return entry.groupBy("case_key").agg(newest).groupBy("state").agg(F.count("*").alias("cases"))


def early(entry: DataFrame, source: str, amount: str = "money") -> DataFrame:
    """The number of cases of which all notices come from ``source`` and none has an amount: consultations before any tender."""
    rows = entry.groupBy("case_key").agg(F.bool_and(F.col("source").startswith(source)).alias("only"), F.max(amount).alias("amount"))
    return rows.agg(F.count_if(F.col("only") & F.col("amount").isNull()).alias("cases"))
