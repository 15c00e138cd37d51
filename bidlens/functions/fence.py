"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` (those of the same names are replaced).

    They come out of a generator of one row, so that neither a filter nor a projection above it computes them again for
    each of its uses.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.struct(*[c.alias(k) for k, c in columns.items()]).alias("_fenced")).select(*rest, F.inline(F.array("_fenced")))
