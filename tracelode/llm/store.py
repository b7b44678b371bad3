"""Tables shared by the executors, and limits of what a Python worker holds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.store import BATCH_ROWS, bounded_batches, shared_dir, written

__all__ = ["BATCH_ROWS", "bounded_batches", "row_count_at_most", "shared_dir", "written"]


def row_count_at_most(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows, reading no more than needed."""
    return df.limit(most + 1).count() <= most
