"""Tables that are read more than once, and small ones that are joined to large ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a table that is sent to all tasks.
SENT = 20_000


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint if the session has a folder for it, else keep the rows in the session's storage."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def with_rows_of(df: DataFrame, other: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` joined with ``other``, a stable table of a row per group: sent to all tasks after a count shows that it is small, else joined by a shuffle whose large groups Spark splits."""
    return df.join(F.broadcast(other) if other.limit(SENT + 1).count() <= SENT else other, list(by), how)
