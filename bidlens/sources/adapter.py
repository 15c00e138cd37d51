"""Order lines as notices: the same relation for Spark and, as text, for SQL engines that check it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlens.session import partitions_for

AS_OF = "1998-08-01"
#: Lines of more than this many are dealt to partitions of a bounded number of lines.
LARGE = 2_000_000


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line. Null keys and dates stand for what sources leave out."""
    line = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    order = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    supplier = _read(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    part = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size", "p_brand")
    nation = _read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    n = line.count()
    if n > LARGE:  # by number, as adaptive execution would join them to 64 MB of shuffled data, which are ten times as many in the sorts
        line = line.repartition(partitions_for(spark, n), "l_orderkey")
    by_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    placed = order.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by the schema's definition
    rows = (
        line.withColumn("rn", F.row_number().over(by_order))
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    discount = F.col("l_discount").cast("decimal(4,2)")
    budget = F.col("l_extendedprice").cast("decimal(15,2)")
    factor = F.lit("1.08").cast("decimal(4,2)") - F.lit(8).cast("decimal(2,0)") * discount
    award = F.when(F.col("o_orderstatus") == "F", F.when(discount == F.lit("0.01").cast("decimal(4,2)"), budget).otherwise((budget * factor).cast("decimal(15,2)")))
    source = F.when(F.col("l_returnflag") == "A", "national:tenders").when(F.col("l_returnflag") == "N", "regional").otherwise("eu")
    form = F.element_at(F.array(F.lit(", S.L."), F.lit(" S.A.U."), F.lit(" SL"), F.lit("")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    ship = F.to_date("l_shipdate")
    code = F.concat(F.when(F.col("p_size") % 2 == 0, "72").otherwise("48"), F.lpad((F.col("p_size") * 1000).cast("string"), 6, "0"))
    codes = F.filter(F.array(code, F.when(F.col("p_size") % 3 == 0, F.lit("80533100")), F.when(F.col("p_size") % 5 == 0, F.lit("79417000"))), lambda x: x.isNotNull())
    out = rows.select(
        (F.col("l_orderkey") * 1000 + F.col("rn")).alias("notice_id"),
        source.alias("source"),
        F.when(F.col("l_orderkey") % 97 != 0, F.col("l_orderkey").cast("string")).alias("group_key"),
        F.col("l_linenumber").cast("string").alias("lot"),
        F.col("p_name").alias("title"),
        F.col("c_name").alias("buyer"),
        F.when(source != "eu", F.col("n_name")).alias("region"),
        F.concat(F.col("s_name"), form).alias("awardee"),
        budget.alias("budget"),
        award.alias("award"),
        F.when(F.col("o_orderstatus") == "O", "publicada").when(F.col("o_orderstatus") == "P", "evaluacion").otherwise("adjudicada").alias("state"),
        F.when(F.col("l_partkey") % 50 != 0, F.date_add(F.to_date("o_orderdate"), (10 * (F.col("l_linenumber") - 1)).cast("int"))).alias("published"),
        F.when(F.col("l_suppkey") % 20 != 0, ship).alias("deadline"),
        F.add_months(ship, F.col("l_quantity").cast("int")).alias("ends_on"),
        F.lower("o_orderpriority").alias("procedure"),
        codes.alias("cpv"),
        F.col("c_mktsegment").alias("segment"),
        F.col("l_quantity").cast("int").alias("months"),
        (3.0 + 0.5 * (F.col("p_size") % 6)).alias("base_score"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("o_custkey") % 11 == 0, "descartado").when(F.col("o_custkey") % 11 == 1, "siguiendo").alias("review_state"),
        F.when(F.col("o_custkey") % 11 == 0, F.col("o_orderpriority")).alias("discard_reason"),
    )
    return out.withColumns({"case_key": F.coalesce("group_key", F.col("notice_id").cast("string")), "money": F.coalesce("award", "budget")})


def found() -> Column:
    """The matches of a notice, in its row: one of its segment, and one of its quantity if that is large."""
    one = F.struct(F.col("segment").alias("profile"), F.col("base_score").alias("score"), F.concat(F.lit("brand "), "brand").alias("reason"))
    two = F.when(F.col("months") > 40, F.struct(F.lit("bulk").alias("profile"), (F.col("base_score") - 0.5).alias("score"), F.lit("quantity").alias("reason")))
    return F.filter(F.array(one, two), lambda x: x.isNotNull())


def matches(rows: DataFrame) -> DataFrame:
    """A row per notice and profile."""
    return rows.select("notice_id", F.inline(found()))


NOTICES_SQL = """
WITH lined AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS rn FROM lineitem),
notice AS (
  SELECT l_orderkey * 1000 + rn AS notice_id,
    CASE l_returnflag WHEN 'A' THEN 'national:tenders' WHEN 'N' THEN 'regional' ELSE 'eu' END AS source,
    CASE WHEN l_orderkey % 97 <> 0 THEN l_orderkey::VARCHAR END AS group_key,
    coalesce(CASE WHEN l_orderkey % 97 <> 0 THEN l_orderkey::VARCHAR END, (l_orderkey * 1000 + rn)::VARCHAR) AS case_key,
    l_linenumber::VARCHAR AS lot, p_name AS title, c_name AS buyer, CASE WHEN l_returnflag <> 'R' THEN n_name END AS region,
    s_name || [', S.L.', ' S.A.U.', ' SL', ''][l_linenumber % 4 + 1] AS awardee,
    l_extendedprice::DECIMAL(15,2) AS budget,
    CASE WHEN o_orderstatus = 'F' THEN CASE WHEN l_discount::DECIMAL(4,2) = 0.01 THEN l_extendedprice::DECIMAL(15,2)
      ELSE (l_extendedprice::DECIMAL(15,2) * (1.08::DECIMAL(4,2) - 8 * l_discount::DECIMAL(4,2)))::DECIMAL(15,2) END END AS award,
    CASE o_orderstatus WHEN 'O' THEN 'publicada' WHEN 'P' THEN 'evaluacion' ELSE 'adjudicada' END AS state,
    CASE WHEN l_partkey % 50 <> 0 THEN (o_orderdate::DATE + (10 * (l_linenumber - 1))::INT)::DATE END AS published,
    CASE WHEN l_suppkey % 20 <> 0 THEN l_shipdate::DATE END AS deadline,
    (l_shipdate::DATE + to_months(l_quantity::INT))::DATE AS ends_on, lower(o_orderpriority) AS procedure,
    list_filter([CASE WHEN p_size % 2 = 0 THEN '72' ELSE '48' END || lpad((p_size * 1000)::VARCHAR, 6, '0'), CASE WHEN p_size % 3 = 0 THEN '80533100' END, CASE WHEN p_size % 5 = 0 THEN '79417000' END], lambda x: x IS NOT NULL) AS cpv,
    c_mktsegment AS segment, l_quantity::INT AS months, 3.0::DOUBLE + 0.5::DOUBLE * (p_size % 6) AS base_score, p_brand AS brand,
    CASE o_custkey % 11 WHEN 0 THEN 'descartado' WHEN 1 THEN 'siguiendo' END AS review_state,
    CASE WHEN o_custkey % 11 = 0 THEN o_orderpriority END AS discard_reason
  FROM lined JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
valued AS (SELECT *, coalesce(award, budget) AS money FROM notice),
match AS (
  SELECT notice_id, segment AS profile, base_score AS score, 'brand ' || brand AS reason FROM notice
  UNION ALL SELECT notice_id, 'bulk', base_score - 0.5, 'quantity' FROM notice WHERE months > 40),
matched AS (
  SELECT notice_id, max(score) AS score, string_agg(DISTINCT profile, ',' ORDER BY profile) AS profiles, string_agg(profile || ': ' || reason, ' · ' ORDER BY profile, reason) AS reasons
  FROM match GROUP BY notice_id),
entry AS (SELECT valued.*, score, profiles, reasons FROM valued JOIN matched USING (notice_id) WHERE coalesce(review_state, 'nuevo') <> 'descartado')
"""
