"""Landed pages: gate, links, article extraction."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed
from newsloom.functions import html as hx, text as tx, urls
from newsloom.sources.portals import with_portal

ARTICLE_TYPE = "struct<titulo:string,texto:string,fecha_pub:string>"


def gate(pages: DataFrame) -> DataFrame:
    """Add ``gate``: ok, bloqueado, error or no_html.  ``status`` is optional."""
    low = F.lower(F.coalesce("html", F.lit("")))
    code = F.col("status") if "status" in pages.columns else F.lit(None).cast("int")

    def verdict(page: Column) -> Column:
        is_html = (
            page.rlike(rf"^{tx.SPACE_CLASS}*<!doctype")
            | F.substring(page, 1, fixed.HTML_HEAD_CHARS).contains("<html")
        )
        return (
            F.when(code.isin(fixed.BLOCKED_STATUS), "bloqueado")
            .when(tx.contains_any(page, fixed.BLOCKED_PHRASES), "bloqueado")
            .when(code >= 400, "error")
            .when(~is_html, "no_html")
            .otherwise("ok")
        )

    return pages.withColumn("gate", tx.bind(low, verdict))


def accepted(pages: DataFrame) -> DataFrame:
    return gate(pages).filter(F.col("gate") == "ok").drop("gate")


def links(pages: DataFrame, portals: list[dict] = fixed.PORTALS,
          max_links: int | None = fixed.MAX_LINKS_PER_PAGE) -> DataFrame:
    """Article links of each page, first ``max_links`` distinct ones by position (None: all).

    Link rules come from the portal table; everything is per-row array work.
    """
    found = (
        with_portal(pages, portals)
        .withColumn("crudos", hx.hrefs(hx.markup(F.col("html"))))
        .withColumn("crudos", F.when(
            F.col("strip_href"), F.transform("crudos", tx.strip)).otherwise(F.col("crudos")))
        .withColumn("enlaces", F.transform("crudos", lambda h: urls.resolve(h, F.col("dominio"))))
    )

    def keep(link: Column) -> Column:
        return (
            urls.host(link).contains(F.col("sitio"))
            & ~tx.contains_any_of(link, F.col("excluded"))
            & tx.bind(urls.segments(link), lambda parts: (
                (F.size(parts) >= F.col("min_segments"))
                & ((F.size("sections") == 0) | tx.contains_any_of(parts[0], F.col("sections")))
            ))
        )

    kept = F.array_distinct(F.filter("enlaces", keep))
    if max_links is not None:
        kept = F.slice(kept, 1, max_links)
    # Outer, then filtered: no size filter is inferred that would repeat the work.
    return found.withColumn("enlaces", kept).select(
        "page_id", "fuente", F.posexplode_outer("enlaces").alias("pos", "enlace")
    ).filter(F.col("enlace").isNotNull())


def distinct_links(page_links: DataFrame) -> DataFrame:
    return page_links.select("fuente", "enlace").distinct()


def _article(titulo: Column, texto: Column, fecha: Column, min_body: int) -> Column:
    made = F.struct(titulo.alias("titulo"), texto.alias("texto"), fecha.alias("fecha_pub"))
    return tx.bind(made, lambda a: F.when(
        (F.coalesce(a["titulo"], F.lit("")) != "") & (F.length(a["texto"]) >= min_body), a
    ))


def parse_page_header(page: Column) -> Column:
    """Title from the marked h1, else the title meta tag; body from the body div.

    A marked h1 without text rejects the page: the meta tag is not tried.
    """
    titulo = tx.bind(hx.element_inner(page, "h1", fixed.HEADER_CLASS), lambda h1: F.coalesce(
        hx.node_text(h1, ""), tx.strip(hx.meta_content(page, fixed.TITLE_META))
    ))
    texto = tx.join_non_empty(hx.paragraphs(hx.element_inner(page, "div", fixed.BODY_CLASS)))
    fecha = tx.prefix(hx.meta_content(page, fixed.DATE_META), 10)
    return _article(titulo, texto, fecha, fixed.MIN_BODY_PAGE_HEADER)


def parse_article_tag(page: Column) -> Column:
    """Title from the first h1; long paragraphs of the first article; no date."""
    titulo = hx.node_text(hx.element_inner(page, "h1"), "")
    long_ones = F.filter(
        hx.paragraphs(hx.element_inner(page, "article")),
        lambda p: F.length(p) > fixed.MIN_PARAGRAPH_ARTICLE_TAG,
    )
    texto = tx.strip(F.array_join(long_ones, " "))
    return _article(titulo, texto, F.lit(None).cast("string"), fixed.MIN_BODY_ARTICLE_TAG)


# Parser name in the portal table -> expression over the visible markup.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "page_header": parse_page_header,
    "article_tag": parse_article_tag,
}


def parse(pages: DataFrame, portals: list[dict] = fixed.PORTALS,
          parsers: dict[str, Callable[[Column], Column]] = PARSERS,
          keep_unknown: bool = False) -> DataFrame:
    """Add ``titulo``, ``texto``, ``fecha_pub`` by the portal's parser.

    ``titulo`` is NULL where the parser rejects the page; with ``keep_unknown`` pages
    of no portal stay too, with ``fuente`` NULL.  All portals go through
    one scan: the parser is chosen by a CASE on the setting, not by one branch of
    the plan per portal.  A parser may also return a pandas-UDF column.

    The struct is unpacked by a generator, through which the optimizer pushes no
    filter, so the parser runs once per page however its fields are used.
    """
    ready = with_portal(
        pages, portals, keep_unknown=keep_unknown
    ).withColumn("_visible", hx.visible(F.col("html")))
    names = sorted({p["parser"] for p in portals})
    article = _chosen_article(
        pages.sparkSession.sparkContext.applicationId, tuple((n, parsers[n]) for n in names)
    )
    return ready.select(*pages.columns, "fuente", F.inline_outer(F.array(article)))


@lru_cache(maxsize=16)
def _chosen_article(application: str, parsers: tuple) -> Column:
    """CASE over the parsers; large expressions, so built once per application."""
    article = F.lit(None).cast(ARTICLE_TYPE)
    for name, parser in parsers:
        article = F.when(F.col("parser") == name, parser(F.col("_visible"))).otherwise(article)
    return article


def articles_of(parsed: DataFrame) -> DataFrame:
    """Extracted articles in the shape of arriving rows (without ``seq``)."""
    return parsed.filter(F.col("titulo").isNotNull()).select(
        "page_id", "url", "titulo", "texto", "fuente", "fecha_pub"
    )
