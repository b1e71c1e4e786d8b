"""Size checks before a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Does the table have at most `rows` rows? Stops counting after that many."""
    return table.limit(rows + 1).count() <= rows


def sent_if(table: DataFrame, small: bool) -> DataFrame:
    """Broadcast when a check has bounded the size; otherwise leave the choice to Spark."""
    return F.broadcast(table) if small else table

