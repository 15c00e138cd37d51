"""Upkeep of stored tables: normalised texts that are missing, snapshots that have more than is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.functions.scalars import text_norm

#: A snapshot of more characters still has fields that nothing reads.
LONG_SNAPSHOT = 400


def fill_texts(rows: DataFrame, text: str, normalised: str) -> DataFrame:
    """``rows`` with ``normalised`` where it was null; what is there stays as it is."""
    filled = F.when(F.col(normalised).isNull(), text_norm(F.col(text))).otherwise(F.col(normalised))
    return rows.select(*[filled.alias(c) if c == normalised else F.col(c) for c in rows.columns])


def trim_snapshots(versions: DataFrame, snapshot: str, fields: Sequence[str], longer_than: int = LONG_SNAPSHOT) -> DataFrame:
    """``versions`` with long JSON snapshots cut down to ``fields``; doing it again changes nothing."""
    kept = F.to_json(F.from_json(snapshot, ", ".join(f"`{f}` string" for f in fields)), {"ignoreNullFields": "false"})
    short = F.when(F.length(snapshot) > longer_than, kept).otherwise(F.col(snapshot))
    return versions.select(*[short.alias(c) if c == snapshot else F.col(c) for c in versions.columns])
