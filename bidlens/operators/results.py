"""Results that are kept as long as the tables that they were made from stay as they are."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.operators.store import Store

_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "arguments", "signature", "folder", "schema")])


class Kept:
    """A table of results by name and arguments. A result counts for the versions of the stores that it was made under; when one has another version, it is made anew.

    ``most`` results are kept at most: when there are more, those of older versions are forgotten, then all.
    """

    def __init__(self, spark: SparkSession, path: str, sources: list[Store], most: int = 64) -> None:
        self.spark, self.path, self.sources, self.most = spark, path, sources, most
        self.index = Store(spark, f"{path}/index", _SCHEMA, ["name", "arguments"], buckets=1)

    def signature(self) -> str:
        return json.dumps([s.version() for s in self.sources])

    def get(self, name: str, arguments: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The result of ``make``, read from where it is kept if it is; ``arguments`` (a day that stands for today, too) tell results of one name apart."""
        now, told = self.signature(), json.dumps(arguments, sort_keys=True)
        held = self.index.read()
        found = held.where((F.col("name") == name) & (F.col("arguments") == told) & (F.col("signature") == now)).first()
        if found:
            return self.spark.read.schema(T.StructType.fromJson(json.loads(found["schema"]))).parquet(f"{self.path}/{found['folder']}")
        made, folder = make(), f"results/{uuid.uuid4().hex}"
        made.write.parquet(f"{self.path}/{folder}")
        gone = None
        if held.count() >= self.most:
            stale = held.where(F.col("signature") != now)
            gone = stale if stale.count() else held
        self.index.merge(self.spark.createDataFrame([(name, told, now, folder, made.schema.json())], _SCHEMA), gone)
        return self.spark.read.schema(made.schema).parquet(f"{self.path}/{folder}")
