"""Change detection with the last fingerprint of each key in Spark's state store.

State lies in RocksDB on the executors, and its changes go to the checkpoint: a batch costs what its own keys cost, not what all
keys ever seen do. A key that isn't seen for ``keep`` is forgotten, and is new when it comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bidlens.session import prepare, scratch

OUTPUT = "key string, seq bigint, fingerprint string, outcome string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Outcomes(StatefulProcessor):
    """Rows of a key in their order against its last one. What lies at or before the last row's place was seen already: overlapping increments are absorbed."""

    def __init__(self, keep: timedelta | None = None) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, fingerprint string", int(self.keep.total_seconds() * 1000) if self.keep else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        parts = [(p["seq"].to_numpy(np.int64), p["fingerprint"].to_numpy(object)) for p in rows]
        seq, mark = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(seq, kind="stable")
        seq, mark = seq[order], mark[order]
        known = self.last.exists()
        before = self.last.get() if known else (None, None)
        fresh = np.append(True, seq[1:] != seq[:-1])  # a place that comes twice counts once
        if known:
            fresh &= seq > before[0]
        seq, mark = seq[fresh], mark[fresh]
        if len(seq):
            was = np.concatenate([np.array([before[1]], object), mark[:-1]])
            same = np.array([a == b for a, b in zip(was, mark, strict=True)], bool)
            outcome = np.where(same, "igual", "actualizada").astype(object)
            if not known:
                outcome[0] = "nueva"
            self.last.update((int(seq[-1]), mark[-1]))
            yield pd.DataFrame({"key": key[0], "seq": seq, "fingerprint": mark, "outcome": outcome})


def outcomes(stream: DataFrame, keep: timedelta | None = None) -> DataFrame:
    """The stream (key, seq, fingerprint) as key, seq, fingerprint and outcome: nueva, igual or actualizada.

    A null key is a key. A task sorts what a batch has of one key; the stream's own limits bound a batch.
    """
    prepare(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = stream.select("key", "seq", "fingerprint")
    return rows.groupBy("key").transformWithStateInPandas(Outcomes(keep), OUTPUT, "append", "processingtime" if keep else "none")


def run(stream: DataFrame, out: str, checkpoint: str, keep: timedelta | None = None) -> None:
    """All that is there now, appended below ``out`` exactly once; a later run on the same checkpoint goes on."""
    # with a time to live there is always another batch to run, without rows, so such a run is one batch
    trigger = {"once": True} if keep else {"availableNow": True}
    outcomes(stream, keep).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start(out).awaitTermination()


def run_once(spark: SparkSession, stream: DataFrame, name: str = "keyed") -> DataFrame:
    path = scratch(spark, name)
    run(stream, path, f"{path}-state")
    return spark.read.schema(OUTPUT).parquet(path)
