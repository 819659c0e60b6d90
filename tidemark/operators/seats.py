"""One seat per user and session out of rows that are sent again, corrected or contradictory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_seats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(user_id, session_id, ``columns``) of the row ingested last (ties: the larger row_id). Users, sessions non-null."""
    value = F.struct(*columns)
    return (
        rows.where(F.col("user_id").isNotNull() & F.col("session_id").isNotNull())
        .groupBy("user_id", "session_id")
        .agg(F.max_by(value, F.struct("ingest_time", "row_id")).alias("v"))
        .select("user_id", "session_id", "v.*")
    )
