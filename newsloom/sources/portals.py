"""Portal configuration as a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import fixed
from newsloom.functions import urls

COLUMNS = [
    "fuente", "portada", "dominio", "sitio", "min_segments",
    "sections", "excluded", "strip_href", "parser",
]


def _literal(value) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast("array<string>")
    return F.lit(value)


def portal_table(spark: SparkSession, portals: list[dict] = fixed.PORTALS) -> DataFrame:
    """The settings as rows of literals (no Python worker behind them)."""
    rows = [F.struct(*[_literal(p[c]).alias(c) for c in COLUMNS]) for p in portals]
    return spark.range(1).select(F.inline(F.array(*rows)))


def site_of(url: Column, portals: list[dict] = fixed.PORTALS) -> Column:
    """Site of the portal whose host (or a parent of it) serves ``url``."""
    host = urls.host(url)
    site = F.lit(None).cast("string")
    for p in reversed(portals):
        match = (host == p["sitio"]) | host.endswith("." + p["sitio"])
        site = F.when(match, p["sitio"]).otherwise(site)
    return site


def with_portal(pages: DataFrame, portals: list[dict] = fixed.PORTALS,
                max_portals: int = 10_000, keep_unknown: bool = False) -> DataFrame:
    """Pages joined to their portal's settings; pages of other hosts are dropped,
    or kept without settings.

    The table is built from the driver-side list, so its size is known before it
    is broadcast; a longer list is joined without the hint.
    """
    config = portal_table(pages.sparkSession, portals)
    if len(portals) <= max_portals:
        config = F.broadcast(config)
    return pages.withColumn("sitio", site_of(F.col("url"), portals)).join(
        config, "sitio", "left" if keep_unknown else "inner")
