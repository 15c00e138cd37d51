"""Sources side by side, each a streaming query of its own: one that fails closes its run with the error, and the others go on."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from bidlens.operators.store import Store

RUN = T.StructType([T.StructField("run", T.LongType()), T.StructField("stage", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("part", T.StringType()), T.StructField("seen", T.LongType()), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])


@dataclass(frozen=True)
class Source:
    """``load`` gives the stream; ``each`` takes its batches in, with the batch's number. A source may have parts, as years of an archive; each is on its own."""

    name: str
    load: Callable[[SparkSession], DataFrame]
    each: Callable[[DataFrame, int], None]
    checkpoint: str
    part: str = ""


def _begin(spark: SparkSession, s: Source) -> StreamingQuery:
    return s.load(spark).writeStream.foreachBatch(s.each).option("checkpointLocation", s.checkpoint).queryName(f"{s.name}{s.part and ' ' + s.part}").trigger(availableNow=True).start()


def ingest(spark: SparkSession, stages: Sequence[Sequence[Source]], runs: Store, run: int) -> list[dict]:
    """Stage after stage, the sources of a stage at a time; the log of runs has a row for each source and part.

    A row is open (``ok`` null) while its query runs, and is closed with the rows seen, or with the error. A part that isn't
    there is no error. Later stages run whatever happened in earlier ones, as a source's failure is its own.
    """
    log = []
    for k, stage in enumerate(stages):
        opened = [{"run": run, "stage": k, "source": s.name, "part": s.part, "seen": 0, "ok": None, "error": None} for s in stage]
        runs.merge(spark.createDataFrame(opened, RUN))
        queries: list[StreamingQuery | PySparkException] = []
        for s in stage:
            try:
                queries.append(_begin(spark, s))
            except PySparkException as e:
                queries.append(e)
        for row, q in zip(opened, queries, strict=True):
            failed = q if isinstance(q, PySparkException) else None
            if failed is None:
                try:
                    q.awaitTermination()
                except PySparkException as e:
                    failed = e
                row["seen"] = sum(p["numInputRows"] for p in q.recentProgress)
            absent = failed is not None and failed.getCondition() == "PATH_NOT_FOUND"
            row["ok"], row["error"] = failed is None or absent, None if failed is None or absent else str(failed).split("\n", 1)[0][:500]
        runs.merge(spark.createDataFrame(opened, RUN))
        log += opened
    return log
