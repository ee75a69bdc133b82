"""Registered queries: every operator over the whole generated tables.

Each entry takes (spark, sf_dir) and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import articles as ar
from newsloom.operators import dense, lexical, metrics, retrieval, transcripts, versions
from newsloom.operators import pages as pg
from newsloom.plans import indexing, ingest
from newsloom.session import work_dir
from newsloom.sources import testviews as tv
from newsloom.sources.store import ArticleStore, DocumentIndex, LexicalTables
from newsloom.streaming import changes as st_changes
from newsloom.streaming import ingest as st_ingest
from newsloom.streaming import timeline as st_timeline

NOW = "2024-03-01 00:00:00"
FEED_FILTERS = {"topico": "A", "start": "2024-01-05", "end": "2024-01-20", "search": " tion|que "}
SOURCE_FILTERS = {"fuente": "src4", "search": "la", "literal": True}
KEYWORD = "tion_th"
LOOKUP_URL = "https://src3.example.org/a/3"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name (less a trailing underscore)."""
    REGISTRY[fn.__name__.rstrip("_")] = fn
    return fn


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return ar.enrich(tv.articles(spark, sf), tv.SAMPLE_RULES, tv.SAMPLE_DEFAULT)


# ---------------------------------------------------------------- listings


@query
def articles_enriched(spark, sf):
    return enriched(spark, sf).select(
        "id", "url", "titulo", "hash_texto", "fuente", "fecha_final", "fecha_str", "topico"
    )


@query
def topics_from_table(spark, sf):
    """The sample topics and one rule per stored title, all read from a table."""
    stated = tv.sample_rules(spark)
    titles = tv.articles(spark, sf).filter(F.length("titulo") > 20).select(
        (F.col("id") + len(tv.SAMPLE_RULES)).cast("long").alias("priority"),
        F.concat(F.lit("T"), F.col("id").cast("string")).alias("topic"),
        F.array(F.lower("titulo")).alias("keywords"))
    rules = stated.unionByName(titles)
    return ar.tag_topics_from_table(tv.articles(spark, sf), rules, tv.SAMPLE_DEFAULT).select("id", "topico")


@query
def filter_feed(spark, sf):
    return ar.with_cards(ar.feed(enriched(spark, sf), **FEED_FILTERS)).select(
        "id", "titulo", "fuente", "etiqueta", "fecha_str", "extracto"
    )


@query
def filter_source(spark, sf):
    return ar.with_cards(ar.feed_filter(enriched(spark, sf), **SOURCE_FILTERS)).select(
        "id", "titulo", "fuente", "etiqueta", "fecha_str", "extracto"
    )


@query
def keyword_search(spark, sf):
    return ar.keyword_search(tv.articles(spark, sf), KEYWORD).select("id", "url", "fecha_scrape")


@query
def recent_articles(spark, sf):
    return ar.table_view(ar.recent(tv.articles(spark, sf))).select(
        "id", "fuente", "titulo_corto", "texto_corto", "fecha"
    )


@query
def all_articles(spark, sf):
    return ar.all_articles(tv.articles(spark, sf)).select(
        "id", "url", "fuente", "fecha_pub", "fecha_scrape"
    )


@query
def article_by_url(spark, sf):
    return ar.by_url(tv.articles(spark, sf), LOOKUP_URL).select("id", "url", "titulo", "hash_texto")


@query
def url_list(spark, sf):
    return ar.url_list(tv.articles(spark, sf))


@query
def first_url_by_title(spark, sf):
    return ar.first_url_by_title(enriched(spark, sf))


# ------------------------------------------------------------------ metrics


@query
def facets(spark, sf):
    return metrics.facets(enriched(spark, sf))


@query
def kpis(spark, sf):
    return metrics.kpis(enriched(spark, sf), ar.feed_condition(**FEED_FILTERS))


@query
def date_window(spark, sf):
    return metrics.date_window(enriched(spark, sf))


@query
def by_source(spark, sf):
    return metrics.ordered_count_by(tv.articles(spark, sf), "fuente")


@query
def source_map(spark, sf):
    return metrics.count_map(tv.articles(spark, sf), "fuente")


@query
def by_topic(spark, sf):
    return metrics.ordered_count_by(enriched(spark, sf), "topico")


@query
def topic_share(spark, sf):
    return metrics.share_by(enriched(spark, sf), "topico").select(
        "topico", "total", F.round("proporcion", 9).alias("proporcion")
    )


@query
def timeline(spark, sf):
    return metrics.timeline(enriched(spark, sf))


@query
def feed_groups(spark, sf):
    return metrics.feed_groups(enriched(spark, sf))


@query
def feed_group_sizes(spark, sf):
    return metrics.with_group_size(enriched(spark, sf)).select("id", "fecha_str", "n_grupo")


# ----------------------------------------------------------------- versions


def merged(spark: SparkSession, sf: str) -> versions.Upsert:
    return versions.upsert(tv.articles(spark, sf), tv.incoming(spark, sf), NOW)


@query
def upsert_status(spark, sf):
    return merged(spark, sf).status


@query
def upsert_current(spark, sf):
    return merged(spark, sf).current.select(
        "url", "titulo", F.md5("texto").alias("md5_texto"), "fuente", "hash_texto", "fecha_pub",
        "fecha_scrape",
    )


@query
def upsert_history(spark, sf):
    return merged(spark, sf).history.select(
        "url", "version", "titulo", F.md5("texto_anterior").alias("md5_texto"), "hash_anterior",
        "fecha_cambio",
    )


@query
def run_summary(spark, sf):
    return metrics.run_summary(merged(spark, sf).status)


@query
def history_for_url(spark, sf):
    u = merged(spark, sf)
    # Cards come first: the sort then moves excerpts, not bodies.
    return versions.history_for(versions.history_cards(u.history), u.current).select(
        F.col("articulo_url").alias("url"), "version", "titulo", "texto_corto", "guardado"
    )


@query
def history_direct(spark, sf):
    u = merged(spark, sf)
    return versions.history_direct(u.history, LOOKUP_URL).select("url", "version", "titulo")


@query
def edit_stats(spark, sf):
    u = merged(spark, sf)
    return metrics.edit_stats(u.current, u.history)


# -------------------------------------------------------------------- pages


@query
def page_gate(spark, sf):
    return pg.gate(tv.pages(spark, sf)).select("page_id", "url", "gate")


@query
def page_gate_answers(spark, sf):
    return pg.gate(tv.answered_pages(spark, sf)).select("page_id", "status", "gate")


@query
def page_articles_header(spark, sf):
    return ingest.arrivals(tv.header_pages(spark, sf), tv.HEADER_PORTALS).select(
        "seq", "url", "titulo", F.md5("texto").alias("md5_texto"), F.length("texto").alias("n"), "fuente",
        "fecha_pub")


@query
def page_links(spark, sf):
    return pg.links(pg.accepted(tv.pages(spark, sf)), tv.SAMPLE_PORTALS)


@query
def portal_links(spark, sf):
    every = pg.links(pg.accepted(tv.pages(spark, sf)), tv.SAMPLE_PORTALS, max_links=None)
    return pg.distinct_links(every)


@query
def page_articles(spark, sf):
    return ingest.arrivals(tv.pages(spark, sf), tv.SAMPLE_PORTALS)


@query
def ingest_job(spark, sf):
    """Run summary of a second crawl of every page, with some bodies edited."""
    store = ArticleStore(spark, work_dir(spark, "ingest-job"), buckets=16)
    first = tv.pages(spark, sf)
    second = first.withColumn("html", F.replace("html", F.lit("$$$"), F.lit("")))
    for batch_id, crawl in enumerate((first, second)):
        ingest.run(store, crawl, batch_id, NOW, tv.SAMPLE_PORTALS)
    return store.runs().filter(F.col("batch_id") == 1).select(
        "nuevas", "actualizadas", "sin_cambios", "errores"
    )


# ------------------------------------------------------------------ lexical


def fitted(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    return lexical.fit(tv.articles(spark, sf))


@query
def tfidf_vocab(spark, sf):
    return fitted(spark, sf).vocab.select(
        "term", "cf", "df", F.round("idf", 6).alias("idf")
    )


@query
def tfidf_weights(spark, sf):
    return fitted(spark, sf).postings.select(
        "id", "term", F.round("peso", 6).alias("peso")
    )


@query
def tfidf_search(spark, sf):
    queries = tv.query_texts(spark, sf)
    hits = lexical.search(fitted(spark, sf), queries)
    return lexical.present(
        hits, tv.articles(spark, sf), queries, tv.SAMPLE_RULES, tv.SAMPLE_DEFAULT
    )


@query
def search_summary(spark, sf):
    queries = tv.query_texts(spark, sf)
    hits = lexical.search(fitted(spark, sf), queries)
    return lexical.summary(queries, hits)


@query
def tfidf_stored_search(spark, sf):
    """Search of stored tables, brought up to date after edits, removals and additions."""
    tables = LexicalTables(spark, work_dir(spark, "lexical"))
    tables.refit(tv.articles(spark, sf), "v1")
    tables.update(tv.later_articles(spark, sf), "v2", "v1")
    return lexical.search(tables.load("v2"), tv.query_texts(spark, sf)).select(
        "query_id", "rank", "id", "similitud", "relevante")


@query
def search_odd(spark, sf):
    """Blank, missing and unknown queries beside plain ones, and all of them again on a
    corpus without articles."""
    queries = tv.odd_queries(spark, sf)
    parts = []
    for name, docs in (("lleno", tv.articles(spark, sf)), ("vacio", tv.articles(spark, sf).filter("false"))):
        hits = lexical.search(lexical.fit(docs), queries)
        parts.append(lexical.summary(queries, hits).withColumn("corpus", F.lit(name)))
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------- dense and prompts


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tv.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query
def dense_topk(spark, sf):
    return dense.nearest(vectors(spark, sf), tv.label_centroids(spark, sf))


@query
def dense_lsh(spark, sf):
    docs = vectors(spark, sf)
    model = dense.lsh_model(docs)
    return dense.nearest_lsh(dense.lsh_index(docs, model), tv.label_centroids(spark, sf), model)


@query
def dense_mixed(spark, sf):
    """Vectors and queries of several dimensions; the queries without an answer say why."""
    docs, queries = tv.mixed_vectors(spark, sf), tv.mixed_queries(spark, sf)
    hits = dense.nearest(docs, queries).withColumn("motivo", F.lit(None).cast("string"))
    return hits.unionByName(dense.incomparable(docs, queries), allowMissingColumns=True)


@query
def index_refresh(spark, sf):
    """The document index after two appends and a refresh of edited articles.

    Vectors are made from the documents' lengths: no model is shipped.
    """
    index = DocumentIndex(spark, work_dir(spark, "index-refresh"))
    articles = tv.articles(spark, sf, "lang")
    later = articles.withColumn("texto", F.when(
        F.col("lang") == "es", F.concat("texto", F.lit(" EDIT"))).otherwise(F.col("texto"))
    ).withColumn("hash_texto", F.md5("texto"))

    def embed(docs: DataFrame) -> DataFrame:
        return docs.withColumn("embedding", F.array(F.length("document").cast("float"), F.lit(1.0).cast("float")))

    indexing.append_new(index, articles.filter(~F.col("lang").eqNullSafe(F.lit("fr"))), 0, embed)
    indexing.append_new(index, later, 1, embed)
    indexing.append_new(index, later, 2, embed, refresh=True)
    return index.read().select(
        "doc_key", F.md5("document").alias("md5_document"), "batch_id",
        F.col("embedding")[0].cast("long").alias("largo"), F.col("metadata")["url"].alias("url"))


@query
def index_delta(spark, sf):
    """Articles to index, with the documents that have a vector indexed already."""
    articles = tv.articles(spark, sf)
    indexed = retrieval.index_documents(articles).join(vectors(spark, sf), "id", "left_semi")
    return retrieval.index_delta(articles, indexed).select(
        "doc_key", F.md5("document").alias("md5_document"), F.col("metadata")["url"].alias("url"),
        F.col("metadata")["fecha_pub"].alias("fecha_pub"),
    )


@query
def rag_prompts(spark, sf):
    """One question per label, asked with the label's mean vector."""
    label = F.col("query_id")
    questions = tv.label_centroids(spark, sf).select(
        "query_id", "embedding",
        F.concat(F.lit("¿Qué se sabe del tema "), label.cast("string"), F.lit("?")).alias("texto"),
        F.when(label % 4 == 0, "ruta").when(label % 4 == 1, "fact_checking")
        .when(label % 4 == 2, "general").otherwise("otro").alias("mode"),
    )
    index = retrieval.index_documents(tv.articles(spark, sf)).join(vectors(spark, sf), "id")
    table = retrieval.prompts(questions, retrieval.contexts(index, questions))
    return table.select(
        "query_id", "mode", "prompt", "respuesta",
        F.array_join(F.transform("fuentes", lambda f: f["url"]), " ").alias("urls"),
    )


@query
def transcripts_(spark, sf):
    return transcripts.transcripts(tv.table(spark, sf, "conversations"))


# ---------------------------------------------------------------- streaming


def drained_store(spark: SparkSession, sf: str) -> ArticleStore:
    """Stored articles and both later crawls, landed and ingested as a stream."""
    base = work_dir(spark, "stream-ingest")
    store = ArticleStore(spark, f"{base}/store", buckets=16)
    columns = schemas.INCOMING.names
    stored = tv.articles(spark, sf).withColumn("seq", F.lit(0).cast("long"))
    for crawl in (stored, tv.incoming(spark, sf)):
        crawl.select(*columns).write.mode("append").option("compression", "zstd").parquet(f"{base}/landing")
        stream = st_ingest.landed(spark, f"{base}/landing")
        st_ingest.ingest(stream, store, f"{base}/checkpoint", NOW).awaitTermination()
    return store


@query
def stream_ingest(spark, sf):
    return drained_store(spark, sf).articles().select(
        "url", "titulo", F.md5("texto").alias("md5_texto"), "fuente", "hash_texto", "fecha_pub"
    )


@query
def store_article(spark, sf):
    """One stored article, read from the one bucket its url belongs to."""
    return drained_store(spark, sf).article(LOOKUP_URL).select(
        "url", "titulo", F.md5("texto").alias("md5_texto"), "fuente", "fecha_pub")


@query
def store_history(spark, sf):
    """Stored history of one article, read from the one bucket its url belongs to."""
    return versions.history_direct(drained_store(spark, sf).history_of(LOOKUP_URL), LOOKUP_URL).select(
        "url", "titulo", F.md5("texto_anterior").alias("md5_texto"), "hash_anterior", "fecha_cambio")


def events_stream(spark: SparkSession, sf: str) -> DataFrame:
    return (
        spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )


@query
def stream_timeline(spark, sf):
    base = work_dir(spark, "stream-timeline")
    st_timeline.daily_counts(
        events_stream(spark, sf), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return st_timeline.closed_days(spark, f"{base}/out")


@query
def stream_late(spark, sf):
    """Events in two landings, those with an even id first: what comes too late in the second."""
    base = work_dir(spark, "stream-late")
    events = tv.table(spark, sf, "events")
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{base}/landing")
        stream = st_ingest.landed(spark, f"{base}/landing", schemas.EVENTS)
        st_timeline.daily_counts(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    closed = st_timeline.closed_days(spark, f"{base}/out").groupBy("event_type").agg(
        F.sum("total").alias("cerradas"))
    late = st_timeline.late_rows(spark, f"{base}/out", schemas.EVENTS).groupBy("event_type").agg(
        F.count("*").alias("tardias"))
    return closed.join(late, "event_type", "full").select(
        "event_type", F.coalesce("cerradas", F.lit(0)).alias("cerradas"),
        F.coalesce("tardias", F.lit(0)).alias("tardias"))


@query
def stream_changes(spark, sf):
    base = work_dir(spark, "stream-changes")
    rows = st_changes.keyed(
        events_stream(spark, sf), F.col("user_id"), F.col("event_id"), F.col("event_type")
    )
    st_changes.detect(rows, base, f"{base}/checkpoint").awaitTermination()
    return st_changes.statuses(spark, base)
