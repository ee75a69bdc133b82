"""Change detection per key against a stored table of last fingerprints.

Layout under one base folder, every write under the micro-batch that made it:

    changes/batch_id=N   status of every row of the micro-batch
    state/batch_id=N     last fingerprint of every key of the micro-batch

A micro-batch reads the state written before its own number, of its own keys only, and
overwrites its own folders: after a failure it is run again with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import scan
from newsloom.sources.tables import kept, read_or_empty

OUTPUT = "clave string, orden long, estado string"
STATE = "clave string, huella string, visto timestamp, batch_id long"


def keyed(df: DataFrame, key: Column, order: Column, fingerprint: Column) -> DataFrame:
    """Narrow rows for change detection: key, order, fingerprint."""
    return df.select(
        key.cast("string").alias("clave"), order.cast("long").alias("orden"),
        fingerprint.alias("huella"),
    )


def last_seen(spark: SparkSession, base: str, before: int, ttl: str | None = None) -> DataFrame:
    """Last fingerprint of each key as it was before a micro-batch.

    ``ttl``, an interval such as ``1 day``, forgets keys that were silent for that long.
    """
    state = read_or_empty(spark, f"{base}/state", T.StructType.fromDDL(STATE)).filter(
        F.col("batch_id") < before)
    latest = state.groupBy("clave").agg(F.max_by(F.struct("huella", "visto"), "batch_id").alias("s"))
    if ttl is not None:
        latest = latest.filter(F.col("s.visto") >= F.current_timestamp() - F.expr(f"INTERVAL {ttl}"))
    return latest.select("clave", F.col("s.huella").alias("huella"))


def compared(rows: DataFrame, known: DataFrame, slices: int | None = None) -> DataFrame:
    """nueva / actualizada / sin_cambios of each row against the one before it of its key.

    Rows go by their order, equal ones by fingerprint; the first is compared with
    ``known`` (clave, huella).  Equal rows are counted before they move, and a key's
    rows are cut into slices, so no key has to fit anywhere.
    """
    same = rows.groupBy("clave", "orden", "huella").agg(F.count("*").alias("n"))
    stored = known.join(rows.select("clave").distinct(), "clave", "left_semi").select(
        "clave", F.lit(None).cast("long").alias("orden"), "huella", F.lit(1).cast("long").alias("n"),
        F.lit(False).alias("llega"))
    every = same.withColumn("llega", F.lit(True)).unionByName(stored)
    laid = kept(scan.sliced(every, ["clave", "llega", "orden", "huella"], slices), "changes")
    # Wrapped, so that a first row without a row before differs from one after a NULL.
    found = scan.with_previous(
        laid, "clave", ["llega", "orden", "huella"], F.struct("huella"), "antes")
    first = (
        F.when(F.col("antes").isNull(), "nueva")
        .when(F.col("antes.huella").eqNullSafe(F.col("huella")), "sin_cambios")
        .otherwise("actualizada")
    )
    again = F.array_repeat(F.lit("sin_cambios"), (F.col("n") - 1).cast("int"))
    return found.filter("llega").select(
        "clave", "orden", F.explode(F.concat(F.array(first), again)).alias("estado"))


def detect(stream: DataFrame, base: str, checkpoint: str, ttl: str | None = None):
    """Write the changes of every micro-batch, then stop when the input is drained."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = kept(batch, "change-rows")
        compared(rows, last_seen(spark, base, batch_id, ttl)).write.mode("overwrite").parquet(
            f"{base}/changes/batch_id={batch_id}")
        rows.groupBy("clave").agg(
            F.max_by("huella", F.struct("orden", "huella")).alias("huella")
        ).withColumn("visto", F.current_timestamp()).write.mode("overwrite").parquet(
            f"{base}/state/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def statuses(spark: SparkSession, base: str) -> DataFrame:
    """Status of every row so far."""
    columns = T.StructType.fromDDL(OUTPUT)
    return read_or_empty(spark, f"{base}/changes", columns).select(*columns.names)
