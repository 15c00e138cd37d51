"""Evaluation over stored notices: what is new or changed is judged, and everything when the rules are no longer those of last time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.operators import rules
from bidlens.operators.store import Store
from bidlens.session import scratch

#: Why a pass is complete although a partial one was asked for.
UNKNOWN, CHANGED = "no record of the rules", "the rules have changed"
RULES = "rules"
#: Keys of notices to judge that are sent to the tasks at most; beyond it, they meet in a shuffle.
BROADCAST_KEYS = 1_000_000


class Evaluation:
    """Stored notices (key, fingerprint and what rules read), the mark of each (the fingerprint that was judged), matches, and the rules' fingerprint.

    Each is a :class:`Store` below ``path``. A pass writes matches first, then marks, then the rules, and doing it again after a
    failure gives the same; so does a batch that is taken in again under its mark.
    """

    def __init__(self, spark: SparkSession, path: str, key: T.StructField, buckets: int = 64) -> None:
        text, of = T.StringType(), lambda *f: T.StructType([T.StructField(key.name, key.dataType), *[T.StructField(n, t) for n, t in f]])
        self.spark, self.path, self.key = spark, path, key.name
        self.notices = Store(spark, f"{path}/notices", of(("fingerprint", text), ("text_norm", text), ("region", text), ("amount", T.DoubleType()), ("source", text), ("cpv", T.ArrayType(text))), [key.name], buckets=buckets, options={"compression": "zstd"})
        self.marks = Store(spark, f"{path}/marks", of(("judged", text)), [key.name], buckets=buckets)
        self.matches = Store(spark, f"{path}/matches", of(("profile", text), ("score", T.DoubleType()), ("reason", text), ("created", text), ("updated", text)), [key.name, "profile"], [key.name], buckets=buckets)
        self.settings = Store(spark, f"{path}/settings", T.StructType([T.StructField("name", text), T.StructField("value", text)]), ["name"], buckets=1)

    def take(self, rows: DataFrame, mark: str | None = None) -> DataFrame:
        """Notices that came in: key and outcome. One with the fingerprint that is stored isn't written, nor judged again."""
        return self.notices.upsert(rows, "fingerprint", mark)

    def pending(self, rows: DataFrame | None = None) -> DataFrame:
        """Notices (all that are stored, or ``rows``) whose content isn't the one that was judged."""
        both = (self.notices.read() if rows is None else rows).join(self.marks.read(), self.key, "left")
        return both.where(~F.col("fingerprint").eqNullSafe(F.col("judged"))).drop("judged")

    def _of(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """Those of ``rows`` whose key is in ``keys``. Up to ``BROADCAST_KEYS`` keys go to the rows, so that texts stay where they are."""
        asked = keys.select(F.col(self.key).alias("_asked"))
        asked = F.broadcast(asked) if keys.count() <= BROADCAST_KEYS else asked
        return rows.join(asked, F.col(self.key).eqNullSafe(F.col("_asked")), "left_semi")

    def evaluate(self, profiles: Sequence[rules.Profile], at: str, incremental: bool = False) -> dict:
        """Bring matches up to date at the time ``at``; gives evaluated, complete, why, and the counts of pairs.

        Inactive profiles aren't judged; a pair of a profile that isn't active is an orphan and goes. A pair that stays keeps
        the time at which it was created.
        """
        active = [p for p in profiles if p.active]
        now, known = rules.fingerprint(active), self.settings.read().where(F.col("name") == RULES).first()
        why = None if not incremental or (known and known["value"] == now) else (CHANGED if known else UNKNOWN)
        complete = not incremental or why is not None
        rows = self.notices.read()
        due = rows if complete else self.pending(rows.select(self.key, "fingerprint"))
        stage = scratch(self.spark, "evaluation")
        due.select(self.key, F.col("fingerprint").alias("judged")).write.parquet(f"{stage}/marks")
        marks = self.spark.read.schema(self.marks.schema).parquet(f"{stage}/marks")
        judged = rows if complete else self._of(rows, marks)
        old = self.matches.read() if complete else self.matches.read().join(marks, self.key, "left_semi")
        schema = self.matches.schema
        found = rules.matches(judged, active, self.key) if active else self.spark.createDataFrame([], T.StructType([schema[0], schema[1], schema[2], schema[3]]))
        told = rules.reevaluate(old, found.withColumn("score", F.col("score").cast("double")), self.key)
        told.join(old.select(self.key, "profile", "created"), [self.key, "profile"], "left").write.parquet(f"{stage}/changes")
        changes = self.spark.read.parquet(f"{stage}/changes")
        written = changes.where("change in ('created', 'updated')").select(self.key, "profile", "score", "reason", F.coalesce("created", F.lit(at)).alias("created"), F.lit(at).alias("updated"))
        gone = changes.where("change = 'removed'")
        self.matches.merge(written, gone)
        self.marks.merge(marks)
        self.settings.merge(self.spark.createDataFrame([(RULES, now)], self.settings.schema))
        kind = F.when((F.col("change") == "removed") & ~F.col("profile").isin([p.name for p in active]), "orphans").otherwise(F.col("change"))
        counts = {r[0]: r[1] for r in changes.groupBy(kind.alias("kind")).agg(F.count("*")).collect()}
        return {"evaluated": marks.count(), "complete": complete, "why": why, **{k: counts.get(k, 0) for k in ("created", "updated", "same", "removed", "orphans")}}


def preview_summary(rows: DataFrame, before: DataFrame, after: DataFrame, key: str, shown: Sequence[str], n: int = 5) -> DataFrame:
    """One row: notices that have a match before and after, how many enter and leave, and the first ``n`` of each with the columns ``shown`` of ``rows``.

    A notice counts once, whatever the number of its profiles. Nothing is written.
    """
    a, b = before.select(key).distinct().withColumn("_was", F.lit(1)), after.select(key).distinct().withColumn("_is", F.lit(1))
    both = a.join(b, key, "full").select(key, F.when(F.col("_is").isNull(), "leave").when(F.col("_was").isNull(), "enter").otherwise("stay").alias("change"))
    count = lambda *c: F.count_if(F.col("change").isin(*c))
    totals = both.agg(count("stay", "leave").alias("before"), count("stay", "enter").alias("after"), count("enter").alias("enter"), count("leave").alias("leave"))
    out = totals.withColumn("_one", F.lit(1))
    for change in ("enter", "leave"):
        first = both.where(F.col("change") == change).orderBy(key).limit(n).join(rows.select(key, *shown), key)  # a sample of a few rows, by definition
        listed = first.agg(F.array_sort(F.collect_list(F.struct(key, *shown))).alias(f"{change}_sample")).withColumn("_one", F.lit(1))
        out = out.join(F.broadcast(listed), "_one")  # one row with one row
    return out.drop("_one")
