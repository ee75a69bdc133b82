"""Rows of a key in order, for keys of any size.

A range sort by (key, order) cuts the rows into slices of even size; a key with a third
of all rows, whatever its order values, fills many of them.  Running values are then
computed in two levels: within each (slice, key), and over one row per (slice, key).
The second level sees at most as many rows of a key as there are slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def sliced(rows: DataFrame, keys: list[str], slices: int | None = None) -> DataFrame:
    """``rows`` with their ``slice``; slices are ranges of ``keys``, the key column first.

    Rows that agree in all of ``keys`` share a slice, so fold those first.  The bounds
    come from a sample: write the result before it is read twice.
    """
    laid = rows.repartitionByRange(slices, *keys) if slices else rows.repartitionByRange(*keys)
    return laid.withColumn("slice", F.spark_partition_id())


def inside(key: str, *order: str) -> WindowSpec:
    """First level: a key's rows of one slice."""
    return Window.partitionBy("slice", key).orderBy(*order)


def across(key: str) -> WindowSpec:
    """Second level: one row of a key per slice."""
    return Window.partitionBy(key).orderBy("slice")


def with_previous(rows: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """``rows`` with the ``value`` of the row before in the key's order; NULL for its first."""
    window = inside(key, *order)
    held = rows.withColumn("_v", value)
    ends = held.groupBy(key, "slice").agg(
        F.max_by("_v", F.struct(*order)).alias("_last")
    ).withColumn("_carried", F.lag("_last").over(across(key))).select(key, "slice", "_carried")
    first = F.row_number().over(window) == 1
    return (
        held.withColumn("_before", F.lag("_v").over(window)).withColumn("_first", first)
        .join(ends, [key, "slice"])
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")))
        .drop("_v", "_before", "_first", "_carried")
    )
