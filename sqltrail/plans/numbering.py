"""Row numbers in a global order, without one task that holds all rows or all rows of a key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Of monotonically_increasing_id: the bits below the partition's number.
ROW_BITS = 33


def numbered(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], store: Callable[[DataFrame], DataFrame], name: str = "number"
) -> DataFrame:
    """Add the place of each row (from 0) among the rows of its key, or among all if there are no keys.

    Rows are sorted over ranges of ``(keys, order)``, so a key with many rows spans several tasks. Each
    task counts its rows of a key, and the counts of earlier tasks are added: one row for each key and
    task that holds it. ``store`` writes the sorted rows, so that the ranges are cut once. Keys must not be
    null; equal rows of ``order`` are numbered in any order and stay in one range.
    """
    by = [F.col(key) for key in keys]
    at = F.monotonically_increasing_id()
    placed = store(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", at))
    placed = placed.withColumn("__part", F.shiftright("__at", ROW_BITS))
    parts = placed.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "__part", "__first", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    if not keys:
        parts = F.broadcast(parts)  # a row for each task
    return (
        placed.join(parts, [*keys, "__part"])
        .withColumn(name, F.col("__at") - F.col("__first") + F.col("__before"))
        .drop("__at", "__part", "__first", "__before")
    )
