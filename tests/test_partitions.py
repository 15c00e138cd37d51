"""Shuffles that are dealt by the size of their input."""

from pyspark.sql import functions as F

from bidlens import session
from bidlens.plans import registry
from bidlens.sources import adapter


def digest(df):
    return df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()


def test_lines_of_a_large_table_are_dealt_by_their_number(spark, sf, monkeypatch):
    plain = adapter.notices(spark, sf)
    want, lines = digest(plain), spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(adapter, "LARGE", 100)
    monkeypatch.setattr(session, "PARTITION_ROWS", 500)
    n = -(-lines // 500)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = adapter.notices(spark, sf)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert f", {n}), REPARTITION_BY_NUM" in plan and "REPARTITION_BY_NUM" not in plain._jdf.queryExecution().executedPlan().toString()
    assert digest(dealt) == want


def test_an_export_shuffles_by_its_lines_and_leaves_the_session_alone(spark, sf, monkeypatch):
    want, seen, write = digest(registry.queries()["export_file_rows"](spark, sf)), [], registry.X.write
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(session, "PARTITION_ROWS", 500)
    monkeypatch.setattr(registry.X, "write", lambda *a: (seen.append(spark.conf.get("spark.sql.shuffle.partitions")), write(*a))[1])
    assert digest(registry.queries()["export_file_rows"](spark, sf)) == want
    assert int(seen[0]) > int(before) == int(spark.conf.get("spark.sql.shuffle.partitions"))
