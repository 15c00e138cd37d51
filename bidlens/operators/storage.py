"""Stored tables: notices as rows, snapshots of versions, cursors and marks by key, the log of runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bidlens.functions.fence import fenced
from bidlens.functions.scalars import content_hash, text_norm

#: What a hash leaves out: a source touches it without a change, or it is kept as received.
UNHASHED = ("updated", "raw")
SEPARATOR = " \n"


def reference_amount(*amounts: str) -> Column:
    """The first of the amounts that is neither null nor zero."""
    return F.coalesce(*[F.when(F.col(a) != 0, F.col(a)) for a in amounts])


def stored(notices: DataFrame, texts: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """``notices`` as they are stored: codes joined, addresses as JSON, hash, search text, normalised text, reference amount.

    ``texts`` are strings or arrays of strings; a null and an empty one leave no part in the search text.
    """
    kind = {f.name: f.dataType.typeName() for f in notices.schema.fields}
    parts = [F.array_join(c, " ") if kind[c] == "array" else F.col(c) for c in texts]
    search = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), SEPARATOR)
    one = notices.withColumns({
        "fingerprint": content_hash([c for c in notices.columns if c not in UNHASHED]),
        "search_text": search,
        "reference_amount": reference_amount(*amounts),
        **({"cpv": F.array_join("cpv", " ")} if kind.get("cpv") == "array" else {}),
        **({"documents": F.to_json("documents")} if kind.get("documents") == "array" else {}),
    })
    return fenced(one, {"text_norm": text_norm(F.col("search_text"))})


def loaded(rows: DataFrame) -> DataFrame:
    """Stored rows with codes and addresses as arrays again; addresses that aren't a JSON array are none."""
    back = {"cpv": F.filter(F.split(F.coalesce("cpv", F.lit("")), " "), lambda x: x != ""), "documents": F.coalesce(F.from_json("documents", "array<string>"), F.array().cast("array<string>"))}
    return rows.withColumns({k: v for k, v in back.items() if k in rows.columns})


def snapshot(fields: Sequence[str]) -> Column:
    """The fields of a version as JSON, nulls included."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def put(table: DataFrame, rows: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """``table`` with ``rows`` in the place of those that have their keys. Keys are unique on both sides; a null key meets a null key."""
    keys = [key] if isinstance(key, str) else list(key)
    new = rows.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return table.join(new, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti").unionByName(rows.select(*table.columns))


def runs(opened: DataFrame, closed: DataFrame, run: str = "run") -> DataFrame:
    """The log of runs: what was opened, with the counts and the error it closed with; ``ok`` is null while it runs."""
    counts = ("seen", "created", "updated")
    done = closed.select(run, "ended", *counts, "error", F.lit(True).alias("_done"))
    both = opened.join(done, run, "left")
    return both.select(*opened.columns, "ended", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.when(F.col("_done"), F.col("error").isNull()).alias("ok"), "error")


def mark_evaluated(rows: DataFrame, done: DataFrame, key: str, now: str, mark: str) -> DataFrame:
    """``rows`` with ``mark`` set to the fingerprint ``now`` for the keys in ``done``; the others keep theirs."""
    hit = done.select(key).distinct().withColumn("_done", F.lit(True))
    marked = F.when(F.col("_done"), F.col(now)).otherwise(F.col(mark))
    return rows.join(hit, key, "left").select(*[marked.alias(c) if c == mark else F.col(c) for c in rows.columns])


def migrated(rows: DataFrame, schema: StructType) -> DataFrame:
    """``rows`` with the columns of ``schema`` that they lack, null; none is dropped. Doing it again changes nothing."""
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in rows.columns})


def union(*sources: DataFrame) -> DataFrame:
    """Notices of several sources together; a column that a source lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
