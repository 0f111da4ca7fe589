"""Broadcasts behind a check of what is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a definition table that are broadcast at most.
FEW = 10_000


def is_few(df: DataFrame, rows: int = FEW) -> bool:
    """df has no more than `rows` rows. Meant for tables that people define, whose count costs next to
    nothing."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df, with a broadcast hint if it is small; else the planner decides. Nothing is cut off."""
    return F.broadcast(df) if is_few(df, rows) else df
