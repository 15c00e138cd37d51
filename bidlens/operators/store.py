"""Stored tables that rows are merged into: hash buckets, and a manifest that names the folders of each version.

A merge reads and writes only the buckets that its rows fall into; the others keep their files. What it writes lies in a
new folder, and the version becomes visible when its manifest, a single file, is there. A merge that fails before that leaves
the version before it as it was; of two merges at a time on one table the later manifest is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "version bigint, mark string, bucket int, folder string"


@dataclass
class Store:
    """A table of rows with a unique key. ``by`` are the columns, of the key, that choose the bucket; all of the key unless given.

    ``spread`` is the number of files that a merge writes of a bucket at most, so that one bucket needs no single task.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    key: Sequence[str]
    by: Sequence[str] = ()
    buckets: int = 64
    spread: int = 4
    sort: Sequence[str] = ()
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.key, self.by = list(self.key), list(self.by or self.key)

    # Versions

    def manifests(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def version(self) -> int:
        """The newest version; 0 before the first merge."""
        return self.manifests().agg(F.max("version")).first()[0] or 0

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Bucket to folder, at most as many as there are buckets."""
        at = self.version() if version is None else version
        return {r["bucket"]: r["folder"] for r in self.manifests().where((F.col("version") == at) & F.col("bucket").isNotNull()).collect()}

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, the newest unless given; of some ``buckets`` only if they are named."""
        of = self.folders(version)
        paths = [f"{self.path}/{f}" for b, f in sorted(of.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def bucket_of(self, *values) -> int:
        """The bucket of one value of the columns ``by``."""
        kinds = ", ".join(f"{c} {self.schema[c].dataType.simpleString()}" for c in self.by)
        return self.spark.createDataFrame([values], kinds).select(self.bucket()).first()[0]

    # Changes

    def merge(self, rows: DataFrame, gone: DataFrame | None = None, mark: str | None = None) -> int:
        """``rows`` in the place of those with their keys, without the keys in ``gone``; gives the new version.

        Keys are unique in ``rows``, a null meets a null. Both frames are read twice, so they should be tables or cheap; a
        table's first merge reads them once. Old rows, new ones and keys that go meet in one shuffle. A ``mark`` that a
        version bears already (a batch that is run again) changes nothing.
        """
        if mark is not None and self.manifests().where(F.col("mark") == mark).limit(1).count():
            return self.version()
        version, names = self.version(), self.schema.fieldNames()
        new, there = rows.select(*names), self.folders(version)
        if not there:
            return self.replace(version, None, self._dealt(new).sortWithinPartitions("_bucket", *self.sort), mark)
        told = [new.withColumn("_kind", F.lit(2))]
        if gone is not None:
            told.append(gone.select(*[F.col(c) if c in self.key else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in names], F.lit(1).alias("_kind")))
        told = reduce(DataFrame.unionByName, told)
        touched = sorted(r[0] for r in told.select(self.bucket()).distinct().collect())  # at most as many as there are buckets
        if not touched and mark is None:
            return version
        dealt = self._dealt(told.unionByName(self.read(version, touched).withColumn("_kind", F.lit(0))))
        first = F.rank().over(Window.partitionBy("_bucket", *self.key, "_part").orderBy(F.col("_kind").desc()))
        kept = dealt.withColumn("_rank", first).where("_rank = 1 and _kind <> 1")
        return self.replace(version, touched, kept.sortWithinPartitions("_bucket", *self.sort), mark)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        spread = F.pmod(F.xxhash64(*self.key), F.lit(self.spread)).cast("int")
        return rows.withColumns({"_bucket": self.bucket(), "_part": spread}).repartition("_bucket", "_part")

    def replace(self, version: int, touched: Sequence[int] | None, rows: DataFrame, mark: str | None = None) -> int:
        """The version after ``version``, with ``rows`` as all that the buckets ``touched`` hold (None: all buckets).

        ``rows`` have their ``_bucket``, are dealt to tasks and sorted by it.
        """
        folders, written = self.folders(version), set()
        if touched is None or touched:
            out = f"data/{version + 1:09}-{uuid.uuid4().hex[:8]}"
            rows.select(*self.schema.fieldNames(), "_bucket").write.options(**self.options).partitionBy("_bucket").parquet(f"{self.path}/{out}")
            there = self.spark.read.schema(T.StructType([*self.schema, T.StructField("_bucket", T.IntegerType())])).parquet(f"{self.path}/{out}")
            written = {r[0] for r in there.select("_bucket").distinct().collect()}
        if not written and not touched and mark is None:
            return version
        kept = {b: f for b, f in folders.items() if touched is not None and b not in touched}
        return self._publish(version + 1, mark, kept | {b: f"{out}/_bucket={b}" for b in written})

    def _joined(self) -> Column:
        return (F.col("_old._bucket") == F.col("_key._bucket")) & reduce(lambda a, b: a & b, [F.col(f"_old.{k}").eqNullSafe(F.col(f"_key.{k}")) for k in self.key])

    def _publish(self, version: int, mark: str | None, folders: dict[int, str]) -> int:
        rows = [(version, mark, b, f) for b, f in sorted(folders.items())] or [(version, mark, None, None)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/{version:09}")
        return version

    def upsert(self, rows: DataFrame, fingerprint: str, mark: str | None = None) -> DataFrame:
        """key and outcome (nueva, igual, actualizada) of each row; rows with the fingerprint that is stored are not written again.

        Keys and fingerprints alone are compared first; whole rows move once, when they meet the old ones of their bucket.
        ``rows`` are read twice, so they should be a table or cheap.
        """
        version, there = self.version(), bool(self.folders())
        new = rows.select(*dict.fromkeys([*self.key, fingerprint])).withColumn("_bucket", self.bucket())
        if there:
            was = self.read(version).select(*self.key, F.col(fingerprint).alias("_was"), F.lit(True).alias("_known")).withColumn("_bucket", self.bucket())
            both = new.alias("_old").join(was.alias("_key"), self._joined(), "left")
            outcome = F.when(F.col("_known").isNull(), "nueva").when(F.col(f"_old.{fingerprint}").eqNullSafe(F.col("_was")), "igual").otherwise("actualizada")
            told = both.select(*[F.col(f"_old.{c}").alias(c) for c in self.key], F.col("_old._bucket").alias("_bucket"), outcome.alias("outcome"))
        else:
            told = new.select(*self.key, "_bucket", F.lit("nueva").alias("outcome"))
        table = f"{self.path}/outcome/{uuid.uuid4().hex}"
        told.write.option("compression", "zstd").parquet(table)
        told = self.spark.read.schema(told.schema).parquet(table)
        if not there:
            self.merge(rows, mark=mark)
        elif mark is None or not self.manifests().where(F.col("mark") == mark).limit(1).count():
            touched = sorted(r[0] for r in told.where("outcome <> 'igual'").select("_bucket").distinct().collect())  # at most as many as there are buckets
            self.replace(version, touched, self._changed(rows, fingerprint, version, touched), mark)
        return told.select(*self.key, "outcome")

    def _changed(self, rows: DataFrame, fingerprint: str, version: int, touched: Sequence[int]) -> DataFrame:
        """What the buckets ``touched`` hold with those of ``rows`` that are new or have another fingerprint in the place of the old."""
        names, of_key = self.schema.fieldNames(), Window.partitionBy("_bucket", *self.key, "_part")
        new = rows.select(*names).where(self.bucket().isin(*touched)).withColumn("_new", F.lit(True))
        dealt = self._dealt(new.unionByName(self.read(version, touched).withColumn("_new", F.lit(False))))
        was = F.max(F.when(~F.col("_new"), F.struct(fingerprint))).over(of_key)
        differs = F.col("_new") & (F.col("_was").isNull() | ~F.col(fingerprint).eqNullSafe(F.col(f"_was.{fingerprint}")))
        told = dealt.withColumn("_was", was).withColumn("_differs", differs).withColumn("_gone", F.max("_differs").over(of_key))
        return told.where("_differs or not (_new or _gone)").sortWithinPartitions("_bucket", *self.sort)
