"""Views over the generated tables in the shape of the article data model.

Every view covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas

# Keywords that occur in the generated text; the first matching topic wins.
SAMPLE_RULES = [
    ("A", ["entner", "que la"]),
    ("B", ["erth the", "thation"]),
    ("C", ["ción"]),
    ("D", ["schen", "über"]),
]
SAMPLE_DEFAULT = "General"
EPOCH = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """``documents`` as current articles (plus ``extra`` source columns)."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.alias("id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/a/"), doc.cast("string"))
        .alias("url"),
        F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 80).alias("titulo"),
        F.col("text").alias("texto"),
        F.col("source").alias("fuente"),
        F.md5("text").alias("hash_texto"),
        F.when(doc % 7 == 0, None).when(doc % 31 == 0, "")
        .otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (doc % 30).cast("int"))
                   .cast("string")).alias("fecha_pub"),
        (F.lit(EPOCH).cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), doc)).alias("fecha_scrape"),
        *extra,
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two later crawls of every article, plus every raw page as a new article.

    Crawl 1 edits the bodies of ``es`` and ``fr`` documents and the titles of all.
    Crawl 2 restores ``fr`` (A, B, A), edits ``es`` again and retitles the rest.
    Pages come once per crawl with the same body.
    """
    seq, lang, body = F.col("seq"), F.col("lang"), F.col("texto")
    crawls = F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("seq")
    docs = articles(spark, sf_dir, "lang").select(
        "url", "titulo", "texto", "fuente", "fecha_pub", "lang", crawls
    ).select(
        "url",
        F.concat("titulo", F.lit(" v"), seq.cast("string")).alias("titulo"),
        F.when((seq == 1) & lang.isin("es", "fr"), F.concat(body, F.lit(" EDIT")))
        .when((seq == 2) & (lang == "es"), F.concat(body, F.lit(" EDIT2")))
        .otherwise(body).alias("texto"),
        F.concat("fuente", F.lit("-"), seq.cast("string")).alias("fuente"),
        "fecha_pub",
        "seq",
    )
    landed = table(spark, sf_dir, "pages").select(
        "url",
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("titulo"),
        F.col("html").alias("texto"),
        F.lit("web").alias("fuente"),
        F.lit(None).cast("string").alias("fecha_pub"),
        crawls,
    )
    return docs.unionByName(landed)


def later_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles at a later time: bodies in ``es`` edited, those in ``fr`` taken
    down, and every raw page as a new article under a negative id."""
    kept = articles(spark, sf_dir, "lang").filter(~F.col("lang").eqNullSafe(F.lit("fr")))
    old = kept.select("id", "titulo", F.when(
        F.col("lang") == "es", F.concat("texto", F.lit(" edición corregida"))
    ).otherwise(F.col("texto")).alias("texto"))
    return old.unionByName(table(spark, sf_dir, "pages").select(
        (-1 - F.col("page_id")).alias("id"), F.col("url").alias("titulo"),
        F.col("html").alias("texto")))


def sample_rules(spark: SparkSession) -> DataFrame:
    """The sample rules as a rule table."""
    return spark.createDataFrame(
        [(i, topic, words) for i, (topic, words) in enumerate(SAMPLE_RULES)],
        "priority long, topic string, keywords array<string>")


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as a batch of search queries."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("consulta")
    )


def odd_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per ``benchmark`` item: its text, a blank, none, and words no article has."""
    item, text = F.col("item_id"), F.col("text")
    forms = F.array(text, F.lit(" \t\n "), F.lit(None).cast("string"),
                    F.concat(F.lit("zqxj"), item.cast("string")))
    return table(spark, sf_dir, "benchmark").select(
        item, F.posexplode(forms).alias("pos", "consulta")
    ).select((item * 4 + F.col("pos")).alias("query_id"), "consulta")


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of the label's embeddings.

    Each vector contributes one row per dimension and the mean is a partial
    aggregation, so a label with most of the rows does not load one task.
    """
    per_dim = table(spark, sf_dir, "embeddings").select(
        "label", F.posexplode("embedding").alias("dim", "x")
    ).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per_dim.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]
        ).alias("embedding")
    )


def mixed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` of two dimensions: every third label keeps its first 16 parts only."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(
        F.col("label") % 3 == 0, F.slice("embedding", 1, 16)).otherwise(F.col("embedding")).alias("embedding"))


def mixed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label its mean vector whole, its first 16 and first 3 parts, and no vector."""
    whole = F.col("embedding")
    forms = F.array(whole, F.slice(whole, 1, 16), F.slice(whole, 1, 3), F.lit(None))
    return label_centroids(spark, sf_dir).select(
        "query_id", F.posexplode(forms).alias("form", "embedding")
    ).select((F.col("query_id") * 4 + F.col("form")).alias("query_id"), "embedding")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(*schemas.PAGES.names)


def answered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as a crawl meets them: by page id refused, limited, missing, broken,
    with a blocking phrase in either case, without markup at its head, or as they are."""
    n, html = F.col("page_id") % 9, F.col("html")
    return pages(spark, sf_dir).select(
        "page_id", "url",
        F.when(n == 0, 403).when(n == 1, 429).when(n == 2, 404).when(n == 3, 500).otherwise(200)
        .cast("int").alias("status"),
        F.when(n == 4, F.concat(html, F.lit("<p>Please solve the CAPTCHA</p>")))
        .when(n == 5, F.concat(F.lit("<html>Access Denied"), html))
        .when(n == 6, F.concat(F.repeat(F.lit("no markup "), 60), html))
        .when(n == 7, F.concat(F.lit(" \n"), html)).otherwise(html).alias("html"),
    )


def header_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of ``pages`` laid out for the page-header parser, in six forms by page id:
    marked title, title tag only, empty marked title, unmarked title, short body, no body."""
    form, none = F.col("page_id") % 6, F.lit("")
    page = F.col("page_id").cast("string")
    words = F.regexp_replace("html", r"<[^>]*>|[&<> \t\r\n]+", " ")
    title = (
        F.when(form.isin(0, 4, 5), F.concat(F.lit('<h1 class="big page-header"> Título <b>'), page, F.lit("</b></h1>")))
        .when(form == 2, '<h1 class="page-header"> <i></i> </h1>')
        .when(form == 3, "<h1>Sin marca</h1>").otherwise(none)
    )
    body = F.when(form == 4, "<p>Nota breve.</p>").otherwise(
        F.concat(F.lit("<div><p>Nota "), page, F.lit(".</p></div><p>Palabras: <b>"), words, F.lit("</b> fin.</p>")))
    return pages(spark, sf_dir).select("page_id", "url", F.concat(
        F.lit('<!DOCTYPE html><html><head><meta property="og:title" content="Etiqueta '), page,
        F.lit('"><meta content="2024-03-01T10:00:00Z" property="article:published_time"></head><body>'), title,
        F.when(form == 5, "<div>").otherwise('<div class="field field-name-body">'), body,
        F.lit("</div><div><p>Pie de la nota</p></div></body></html>")).alias("html"))


# Portals of the generated pages: hosts end in one of three domains.  Links in
# the pages have one path segment, hence the low minimum.
SAMPLE_PORTALS = [
    {
        "fuente": "Portal Org", "portada": "https://example.org/", "dominio": "https://example.org",
        "sitio": "example.org", "min_segments": 1,
        "sections": ["The", "Nicht", "an", "en"], "excluded": ["#", "javascript", "mailto", ","],
        "strip_href": False, "parser": "article_tag",
    },
    {
        "fuente": "Portal Com", "portada": "https://example.com/", "dominio": "https://example.com",
        "sitio": "example.com", "min_segments": 1, "sections": [],
        "excluded": ["#", "javascript", "mailto"], "strip_href": True, "parser": "article_tag",
    },
    {
        "fuente": "Portal Net", "portada": "https://example.net/", "dominio": "https://example.net",
        "sitio": "example.net", "min_segments": 1, "sections": [],
        "excluded": ["#", "javascript", "mailto"], "strip_href": True, "parser": "article_tag",
    },
]
HEADER_PORTALS = [{**p, "parser": "page_header"} for p in SAMPLE_PORTALS]

