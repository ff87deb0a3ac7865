"""Small side inputs that travel to every task, checked for their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

MOST_ROWS = 1_000_000


def side_rows(df: DataFrame, most: int = MOST_ROWS) -> list[Row]:
    """All rows of a side input; an error if there are more than ``most``, so nothing is ever cut silently."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a side input has more than {most} rows")
    return rows
