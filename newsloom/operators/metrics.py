"""Counts, shares, KPIs, timelines, facets and grouped listings.

All of them are hash aggregations with map-side partial results, so a source,
topic or date that holds a large part of the rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed
from newsloom.functions import dates


def count_by(df: DataFrame, column: str, out: str = "total") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(out))


def ordered_count_by(df: DataFrame, column: str) -> DataFrame:
    return count_by(df, column).orderBy(F.desc("total"), F.asc(column))


def share_by(df: DataFrame, column: str) -> DataFrame:
    """Count and share of the whole; the whole is one number, counted apart."""
    counts = count_by(df, column)
    return counts.withColumn(
        "proporcion", F.col("total") / counts.agg(F.sum("total")).scalar()
    )


def count_map(df: DataFrame, column: str) -> DataFrame:
    """The counts of a mapping as rows (clave, total), whatever their number."""
    return count_by(df, column).select(F.col(column).alias("clave"), "total")


def edit_stats(articles: DataFrame, history: DataFrame, approximate: bool = False) -> DataFrame:
    """Total articles and distinct edited articles, one row."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    edited = history.agg(distinct(F.col("noticia_id")).alias("n"))
    return articles.agg(F.count("*").alias("total")).withColumn("editadas", edited.scalar())


def kpis(enriched: DataFrame, condition: Column, limit: int = fixed.FEED_LIMIT) -> DataFrame:
    """KPI row in one pass; ``condition`` is the feed's filter (before the row cap).

    Rows are first folded per (source, topic), so the distinct counts run over a
    few partial rows instead of expanding every article.
    """
    folded = enriched.groupBy("fuente", "topico").agg(
        F.count("*").alias("n"), F.count_if(condition).alias("f"),
        F.max("fecha_final").alias("ultima"),
    )
    return folded.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_distinct(F.col("fuente")).alias("fuentes"),
        F.count_distinct(F.col("topico")).alias("topicos"),
        dates.stamp_text(F.max("ultima")).alias("ultima"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("filtradas_sin_tope"),
    ).withColumn(
        "filtradas", F.least(F.col("filtradas_sin_tope"), F.lit(limit).cast("long"))
    )


def date_window(enriched: DataFrame, days: int = fixed.DEFAULT_WINDOW_DAYS) -> DataFrame:
    return enriched.agg(
        F.to_date(F.min("fecha_final")).alias("desde"),
        F.to_date(F.max("fecha_final")).alias("hasta"),
    ).withColumn("inicio", dates.window_start(F.col("desde"), F.col("hasta"), days))


def timeline(enriched: DataFrame) -> DataFrame:
    """Articles per calendar date and source, dated rows only."""
    return (
        enriched.filter(F.col("fecha_final").isNotNull())
        .groupBy(F.to_date("fecha_final").alias("fecha"), "fuente")
        .agg(F.count("*").alias("total"))
    )


def facets(enriched: DataFrame) -> DataFrame:
    """Sorted distinct sources and topics, one scan for both."""
    pairs = enriched.select("fuente", "topico").distinct()
    return (
        pairs.unpivot([], ["fuente", "topico"], "faceta", "valor")
        .distinct()
        .orderBy("faceta", "valor")
    )


def feed_groups(listed: DataFrame) -> DataFrame:
    """Date groups with their size, in order of first appearance (newest first)."""
    return (
        listed.groupBy("fecha_str")
        .agg(F.count("*").alias("n"), F.max("fecha_final").alias("ultima"))
        .orderBy(F.desc_nulls_last("ultima"), F.asc("fecha_str"))
    )


def with_group_size(listed: DataFrame, key: str = "fecha_str", out: str = "n_grupo") -> DataFrame:
    """Rows labelled with their group's size.

    Counts are aggregated first and joined back, instead of a window over the
    raw rows: the planner picks the join by the size of the counts and splits a
    date with a third of all rows.
    """
    sizes = listed.groupBy(key).agg(F.count("*").alias(out))
    return listed.join(sizes, listed[key].eqNullSafe(sizes[key]), "left").drop(sizes[key])


def run_summary(outcomes: DataFrame, column: str = "estado") -> DataFrame:
    """Outcomes folded to four counters; NULL or unknown outcomes are errors."""
    status = F.col(column)
    known = ["nueva", "actualizada", "sin_cambios"]
    return outcomes.agg(
        F.count_if(status == "nueva").alias("nuevas"),
        F.count_if(status == "actualizada").alias("actualizadas"),
        F.count_if(status == "sin_cambios").alias("sin_cambios"),
        F.count_if(status.isNull() | ~status.isin(known)).alias("errores"),
    )
