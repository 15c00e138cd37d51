"""Re-evaluation on a stream: only notices whose content changed are judged again, against the matches held so far."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlens.operators.evaluation import Evaluation
from bidlens.operators.rules import Profile, matches, reevaluate
from bidlens.session import scratch

OUTPUT = "key string, profile string, change string, score double, reason string"
MATCHES = "key string, profile string, score double, reason string"
SEEN = "key string, fingerprint string"


def latest(rows: DataFrame, order: str) -> DataFrame:
    """The last row of each key in a micro-batch."""
    line = Window.partitionBy("key").orderBy(F.col(order).desc())
    return rows.withColumn("_rn", F.row_number().over(line)).where("_rn = 1").drop("_rn")


def step(batch: DataFrame, seen: DataFrame, held: DataFrame, profiles: Sequence[Profile]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes of a batch (one row a key), and what is seen and held after it.

    ``batch`` has key, fingerprint and what rules read. A notice with the fingerprint that was seen isn't judged.
    """
    fresh = batch.join(seen, ["key", "fingerprint"], "left_anti")
    now = matches(fresh, profiles, "key").select("key", "profile", F.col("score").cast("double").alias("score"), "reason")
    changes = reevaluate(held.join(fresh.select("key"), "key", "left_semi"), now, "key")
    seen_after = seen.join(fresh.select("key"), "key", "left_anti").unionByName(fresh.select("key", "fingerprint"))
    held_after = held.join(fresh.select("key"), "key", "left_anti").unionByName(now)
    return changes, seen_after, held_after


def run_once(spark: SparkSession, stream: DataFrame, profiles: Sequence[Profile], order: str) -> DataFrame:
    """All that is there now; the changes of every batch as a table. A batch that runs again replaces what it had written."""
    path = scratch(spark, "matching")

    def each(batch: DataFrame, k: int) -> None:
        own = batch.sparkSession
        seen = own.read.schema(SEEN).parquet(f"{path}-seen/{k - 1}") if k else own.createDataFrame([], SEEN)
        held = own.read.schema(MATCHES).parquet(f"{path}-held/{k - 1}") if k else own.createDataFrame([], MATCHES)
        changes, seen_after, held_after = step(latest(batch, order), seen, held, profiles)
        changes.write.mode("overwrite").parquet(f"{path}/batch={k}")
        seen_after.write.mode("overwrite").parquet(f"{path}-seen/{k}")
        held_after.write.mode("overwrite").parquet(f"{path}-held/{k}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTPUT + ", batch int").parquet(path)


def run_stored(stream: DataFrame, evaluation: Evaluation, profiles: Sequence[Profile], order: str, checkpoint: str, at: str) -> list[dict]:
    """All that is there now into a stored evaluation, and what each batch did.

    The rules' fingerprint is part of what is stored: the first batch under other rules judges all stored notices, later
    ones again what they bring. A run without new rows only does so if the rules have changed.
    """
    done: list[dict] = []

    def each(batch: DataFrame, k: int) -> None:
        evaluation.take(latest(batch, order).drop(order), f"{checkpoint} {k}").count()
        done.append(evaluation.evaluate(profiles, at, incremental=True))

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done or [evaluation.evaluate(profiles, at, incremental=True)]
