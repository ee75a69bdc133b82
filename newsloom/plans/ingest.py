"""The ingest job: gate, portal, parse, merge, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import fixed
from newsloom.operators import pages as pg
from newsloom.sources import tables
from newsloom.sources.store import ArticleStore

EXTRACTED = T.StructType([
    T.StructField("page_id", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("url", "fuente", "titulo", "texto", "fecha_pub")],
])


def extract(pages: DataFrame, portals: list[dict] = fixed.PORTALS) -> DataFrame:
    """Accepted pages, parsed: ``titulo`` is NULL if the parser rejects the page, and
    ``fuente`` as well if it belongs to no portal."""
    return pg.parse(pg.accepted(pages), portals, keep_unknown=True)


def arrivals(pages: DataFrame, portals: list[dict] = fixed.PORTALS) -> DataFrame:
    """Extracted articles in arrival order; the page id is the order."""
    return pg.articles_of(extract(pages, portals)).withColumnRenamed("page_id", "seq")


def rejected(pages: DataFrame, portals: list[dict] = fixed.PORTALS) -> DataFrame:
    """Pages stopped by the gate, by their parser, or for want of a portal."""
    stopped = pg.gate(pages).filter(F.col("gate") != "ok").select(
        "page_id", "url", F.col("gate").alias("motivo")
    )
    unparsed = extract(pages, portals).filter(F.col("titulo").isNull()).select(
        "page_id", "url",
        F.when(F.col("fuente").isNull(), "sin_portal").otherwise("sin_articulo").alias("motivo"),
    )
    return stopped.unionByName(unparsed)


def run(store: ArticleStore, pages: DataFrame, batch_id: int, now: str | None = None,
        portals: list[dict] = fixed.PORTALS) -> None:
    """Merge a batch of landed pages into the store.

    Extraction runs once: its result is written and read back, since the merge
    reads it several times.
    """
    target = f"{store.base}/extracted/batch_id={batch_id}"
    extracted = extract(pages, portals).select(*EXTRACTED.names)
    extracted.write.mode("overwrite").parquet(target)
    extracted = tables.read(store.spark, target, EXTRACTED)
    stopped = pg.gate(pages).filter(F.col("gate") != "ok").select("page_id")
    failed = extracted.filter(F.col("titulo").isNull()).select("page_id").unionByName(stopped)
    incoming = pg.articles_of(extracted).withColumnRenamed("page_id", "seq")
    store.apply(incoming, batch_id, now, rejected=failed)
