"""Change detection on a stream: each row is nueva, igual or actualizada against the row of its key before it.

Within a micro-batch Spark compares rows by a window over key and place; its sort spills, so a busy key needs no room in
memory. Across batches the last fingerprint of each key is a table, written anew by each batch in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlens.session import scratch

OUTPUT = "key string, seq bigint, fingerprint string, outcome string"
STATE = "key string, last string"


def outcomes(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` (key, seq, fingerprint) with their outcome; ``state`` has the last fingerprint of each key before them."""
    line = Window.partitionBy("key").orderBy("seq")
    told = rows.withColumns({"before": F.lag("fingerprint").over(line), "place": F.row_number().over(line)})
    both = told.join(state.withColumnRenamed("key", "_key"), (F.col("place") == 1) & F.col("key").eqNullSafe(F.col("_key")), "left").withColumn("known", F.col("place") > 1)
    was = F.when(F.col("known"), F.col("before")).otherwise(F.col("last"))
    new = ~F.col("known") & F.col("_key").isNull()
    return both.select("key", "seq", "fingerprint", F.when(new, "nueva").when(F.col("fingerprint").eqNullSafe(was), "igual").otherwise("actualizada").alias("outcome"))


def after(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The state when ``rows`` have been seen: the last of a key by its place, else what it was."""
    last = rows.groupBy("key").agg(F.max_by("fingerprint", "seq").alias("last"))
    return last.unionByName(state.join(last, state["key"].eqNullSafe(last["key"]), "left_anti"))


def run_once(spark: SparkSession, stream: DataFrame, name: str = "changes") -> DataFrame:
    """All that is there now, through the stream and a checkpoint in the shared folder, as a table.

    A batch writes to folders of its own number, so one that is run again after a failure replaces what it had written.
    """
    path = scratch(spark, name)

    def step(batch: DataFrame, k: int) -> None:
        own = batch.sparkSession
        state = own.read.schema(STATE).parquet(f"{path}-last/{k - 1}") if k else own.createDataFrame([], STATE)
        outcomes(batch, state).write.mode("overwrite").parquet(f"{path}/batch={k}")
        after(batch, state).write.mode("overwrite").parquet(f"{path}-last/{k}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTPUT).parquet(path).select("key", "seq", "fingerprint", "outcome")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as (key, seq, fingerprint): user, place in time, kind of event."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may be a file or a folder
    return source.selectExpr("cast(user_id as string) as key", "unix_micros(cast(ts as timestamp)) * 1000 + event_id % 1000 as seq", "event_type as fingerprint")
