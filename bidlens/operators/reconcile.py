"""Reconciliation: fusing notices of one case across sources, carrying reviews along, detecting changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fusion_groups(notices: DataFrame, amount: Column, day: str = "deadline") -> DataFrame:
    """amount, day, keys (distinct national keys) and target (the key if it is the only one) where a source of either kind is present."""
    eu = F.col("source") == "eu"
    rows = notices.where((F.col("budget") > 0) & F.col(day).isNotNull()).select(amount.alias("amount"), F.col(day).alias("day"), eu.alias("eu"), F.when(~eu, F.col("group_key")).alias("key"))
    out = rows.groupBy("amount", "day").agg(F.countDistinct("key").alias("keys"), F.max("key").alias("target"), F.bool_or("eu").alias("has_eu"))
    return out.where("has_eu and keys > 0").select("amount", "day", "keys", F.when(F.col("keys") == 1, F.col("target")).alias("target"))


def fuse(notices: DataFrame, amount: Column, day: str = "deadline") -> DataFrame:
    """``notices`` with EU notices under the national key that shares amount and day, if exactly one does; doing it again changes nothing."""
    groups = fusion_groups(notices, amount, day).where("target is not null").select(F.col("amount").alias("_amount"), F.col("day").alias("_day"), "target")
    both = notices.join(groups, (F.col("source") == "eu") & (F.col("budget") > 0) & (amount == F.col("_amount")) & (F.col(day) == F.col("_day")), "left")
    return both.select(*[F.coalesce("target", c).alias(c) if c == "group_key" else notices[c] for c in notices.columns])


def latest_reviews(reviews: DataFrame, notices: DataFrame) -> DataFrame:
    """Per group the review that was updated last."""
    rows = reviews.join(notices.where("group_key is not null").select("notice_id", "group_key"), "notice_id")
    last = Window.partitionBy("group_key").orderBy(F.col("updated").desc(), F.col("notice_id").desc())
    return rows.withColumn("rn", F.row_number().over(last)).where("rn = 1").select("group_key", "state", "updated")


def propagate(reviews: DataFrame, notices: DataFrame) -> DataFrame:
    """Reviews for the notices of reviewed groups that have none: notice_id and state. What has one keeps it."""
    open_ = notices.where("group_key is not null").select("notice_id", "group_key").join(reviews.select("notice_id"), "notice_id", "left_anti")
    return open_.join(latest_reviews(reviews, notices), "group_key").select("notice_id", "group_key", "state")


def upsert(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key and outcome (nueva, igual, actualizada) of each row of ``new`` against the snapshot ``old``."""
    both = new.select(key, F.col(fingerprint).alias("now")).join(old.select(key, F.col(fingerprint).alias("was"), F.lit(True).alias("known")), key, "left")
    outcome = F.when(F.col("known").isNull(), "nueva").when(F.col("now").eqNullSafe(F.col("was")), "igual").otherwise("actualizada")
    return both.select(key, outcome.alias("outcome"))


def versions(log: DataFrame, key: str, order: tuple[str, ...], state: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``log`` where the state of a key or a field of ``also`` changes, with the state before (``previous``).

    What a key had before in all these fields isn't recorded again.
    """
    line, what = Window.partitionBy(key).orderBy(*order), F.struct(state, *also)
    rows = log.withColumns({"previous": F.lag(state).over(line), "_before": F.lag(what).over(line), "_what": what})
    changed = rows.where(~F.col("_what").eqNullSafe(F.col("_before")))
    again = Window.partitionBy(key, state, *also).orderBy(*order)
    return changed.withColumn("rn", F.row_number().over(again)).where("rn = 1").drop("rn", "_before", "_what")


def change_date(first: Column, published: Column, updated: Column) -> Column:
    """The day that the source gives a version: the first by its publication, later ones by their update; the other where one is missing."""
    return F.when(first, F.coalesce(published, updated)).otherwise(F.coalesce(updated, published))


REVIEW_STATES = ("nuevo", "siguiendo", "descartado")


def decide(decisions: DataFrame, notices: DataFrame, reviews: DataFrame) -> DataFrame:
    """``reviews`` (notice_id, state, reason) after ``decisions`` (the same, null meaning keep) on all notices of the case that each names.

    Of several decisions on a case the one on its last notice counts, with its own reason. States other than the known ones
    are an error when the rows are read.
    """
    known = F.col("state").isNull() | F.col("state").isin(*REVIEW_STATES)
    valid = decisions.select("notice_id", F.when(known, F.col("state")).otherwise(F.raise_error(F.concat(F.lit("no review state: "), F.col("state")))).alias("_state"), F.col("reason").alias("_reason"))
    keys = notices.select("notice_id", "case_key")
    of_case = valid.join(keys, "notice_id").groupBy("case_key").agg(F.max_by(F.struct("_state", "_reason"), "notice_id").alias("last")).select("case_key", "last._state", "last._reason")
    touched = keys.join(of_case, "case_key").select("notice_id", "_state", "_reason", F.lit(True).alias("_new"))
    both = reviews.join(touched, "notice_id", "full")
    return both.select("notice_id", F.coalesce("_state", "state", F.when(F.col("_new"), "nuevo")).alias("state"), F.coalesce("_reason", "reason").alias("reason"))


def inherit(new: DataFrame, notices: DataFrame, reviews: DataFrame) -> DataFrame:
    """notice_id and state of notices of ``new`` whose case has a review: what comes in later takes the latest one along."""
    return new.select("notice_id", "group_key").join(latest_reviews(reviews, notices), "group_key").select("notice_id", "state")


def last_runs(log: DataFrame, source: str, run: str, ok: Column) -> DataFrame:
    """Health of each source: its last run, whether that failed, and the last good one."""
    rows = log.groupBy(source).agg(F.max(run).alias("last_run"), F.max_by(ok, run).alias("last_ok"), F.max(F.when(ok, F.col(run))).alias("last_good"), F.count("*").alias("runs"))
    return rows


def pending(rows: DataFrame, now: str, evaluated: str) -> DataFrame:
    return rows.where(~F.col(now).eqNullSafe(F.col(evaluated)))
