"""Reading helpers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import work_dir


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet with an explicit schema."""
    return spark.read.schema(schema).parquet(path)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows, planned as an empty relation."""
    return spark.range(0).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    )


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, empty if its folder does not exist yet."""
    try:
        return read(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, schema)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    What follows reads files that outlive a lost executor, as often as it likes.
    """
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return read(df.sparkSession, path, df.schema)
