"""Timeline counts of closed days, with late rows written to the side.

Layout under one base folder, every write under the micro-batch that made it:

    closed/batch_id=N   counts of the days that the micro-batch closed
    late/batch_id=N     rows of days closed before it, and rows without a time
    open/batch_id=N     counts of the days still open after it
    mark/batch_id=N     the watermark after it: largest event time less the delay

A micro-batch reads what was written before its own number and overwrites its own
folders: after a failure it is run again with the same result.  Closed days, open days
and late rows together are all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.sources.tables import read_or_empty

MARK = "marca timestamp_ntz, batch_id long"


def counts_schema(key: str) -> T.StructType:
    return T.StructType.fromDDL(f"fecha date, {key} string, total long, batch_id long")


def _last_mark(spark: SparkSession, base: str, before: int):
    """Watermark and number of the micro-batch before, if there is one: one row."""
    marks = read_or_empty(spark, f"{base}/mark", T.StructType.fromDDL(MARK)).filter(F.col("batch_id") < before)
    return marks.orderBy(F.desc("batch_id")).first()


def _merge(batch: DataFrame, batch_id: int, base: str, key: str, ts: str, late: str) -> None:
    spark = batch.sparkSession
    last = _last_mark(spark, base, batch_id)
    day, end = F.to_date(ts), lambda d: F.date_add(d, 1).cast("timestamp_ntz")
    mark = F.lit(last["marca"] if last else None).cast("timestamp_ntz")
    aside = F.col(ts).isNull() | F.coalesce(end(day) <= mark, F.lit(False))
    batch.filter(aside).write.mode("overwrite").parquet(f"{base}/late/batch_id={batch_id}")

    newest = batch.agg((F.max(F.col(ts).cast("timestamp_ntz")) - F.expr(f"INTERVAL {late}")).alias("m"))
    newest.select(F.greatest("m", mark).alias("marca")).write.mode("overwrite").parquet(
        f"{base}/mark/batch_id={batch_id}")
    reached = F.lit(_last_mark(spark, base, batch_id + 1)["marca"]).cast("timestamp_ntz")

    schema = counts_schema(key)
    before = read_or_empty(spark, f"{base}/open", schema).filter(
        F.col("batch_id") == (last["batch_id"] if last else -1)).drop("batch_id")
    fresh = batch.filter(~aside).groupBy(day.alias("fecha"), key).agg(F.count("*").alias("total"))
    days = before.unionByName(fresh).groupBy("fecha", key).agg(F.sum("total").alias("total"))
    closed = F.coalesce(end(F.col("fecha")) <= reached, F.lit(False))
    days.filter(closed).write.mode("overwrite").parquet(f"{base}/closed/batch_id={batch_id}")
    days.filter(~closed).write.mode("overwrite").parquet(f"{base}/open/batch_id={batch_id}")


def daily_counts(events: DataFrame, base: str, checkpoint: str, key: str = "event_type",
                 ts: str = "ts", late: str = "1 hour"):
    """Count rows per day of the event time and key, then stop when the input is drained.

    Event times are zone-free; a day closes when the largest event time has passed its
    end by ``late``.
    """
    return (
        events.writeStream
        .foreachBatch(lambda batch, n: _merge(batch, n, base, key, ts, late))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def closed_days(spark: SparkSession, base: str, key: str = "event_type") -> DataFrame:
    """fecha, key and total of the closed days."""
    return read_or_empty(spark, f"{base}/closed", counts_schema(key)).drop("batch_id")


def late_rows(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """Rows that came after their day had closed, or without a time."""
    return read_or_empty(spark, f"{base}/late", T.StructType([
        *schema, T.StructField("batch_id", T.LongType())]))
