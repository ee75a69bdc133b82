"""Document index, context retrieval and prompt tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed
from newsloom.functions import text as tx
from newsloom.operators import dense

METADATA = ["url", "titulo", "fuente", "fecha_pub"]


def index_documents(articles: DataFrame) -> DataFrame:
    """Articles as index documents: key, labelled text, metadata map."""
    pairs = []
    for name in METADATA:
        value = F.coalesce("fecha_pub", F.lit("")) if name == "fecha_pub" else F.col(name)
        pairs += [F.lit(name), value]
    return articles.select(
        F.concat(F.lit(fixed.DOC_KEY_PREFIX), F.col("id").cast("string")).alias("doc_key"),
        "id",
        F.concat(F.lit(fixed.DOC_TITLE_LABEL), "titulo",
                 F.lit(fixed.DOC_BODY_LABEL), "texto").alias("document"),
        F.create_map(*pairs).alias("metadata"),
        "hash_texto",
    )


def index_delta(articles: DataFrame, indexed: DataFrame, refresh: bool = False) -> DataFrame:
    """Documents not indexed yet.

    An edited article keeps its key and is skipped, unless ``refresh`` compares
    the body hash as well.
    """
    keys = ["doc_key", "hash_texto"] if refresh else ["doc_key"]
    return index_documents(articles).join(indexed.select(*keys), keys, "left_anti")


def contexts(index: DataFrame, queries: DataFrame, k: int = fixed.DENSE_TOP_K,
             **options) -> DataFrame:
    """Nearest documents of each query with their metadata, ranked.

    Only vectors take part in the search; documents are fetched for the hits.
    """
    hits = dense.nearest(index, queries, k, **options)

    def meta(name: str) -> Column:
        return tx.lookup(F.col("metadata"), F.lit(name), "").alias(name)

    return index.select("id", "document", "metadata").join(hits, "id").select(
        "query_id", "rank", "id", "similitud", F.col("document").alias("texto"),
        meta("titulo"), meta("fuente"), meta("url"),
    )


def prompts(queries: DataFrame, context: DataFrame) -> DataFrame:
    """One prompt per query (query_id, mode, texto), by mode.

    At most k context rows exist per query, so the fold is bounded.  Route mode
    without context has a fixed answer and no prompt.
    """
    cut = tx.prefix(F.col("texto"), fixed.CONTEXT_CHARS)

    def fold(head: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("rank", F.concat(head, cut).alias("linea"))))
        return F.array_join(
            F.transform(ordered, lambda s: s["linea"]), fixed.CONTEXT_SEPARATOR
        )

    cited = F.concat(F.lit("[Fuente: "), "fuente", F.lit(" | "), "titulo", F.lit("]\n"))
    plain = F.concat(F.lit("["), "fuente", F.lit(" - "), "titulo", F.lit("]\n"))
    folded = context.groupBy("query_id").agg(
        fold(cited).alias("citado"), fold(plain).alias("simple"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "titulo", "fuente", "url"))), lambda s: s
        ).alias("fuentes"),
    )
    joined = queries.select("query_id", "mode", "texto").join(folded, "query_id", "left")

    def fill(template: str, ctx: Column) -> Column:
        head, rest = template.split("{contexto}")
        middle, tail = rest.split("{pregunta}")
        return F.concat(F.lit(head), ctx, F.lit(middle), F.col("texto"), F.lit(tail))

    ruta, fact = F.col("mode") == "ruta", F.col("mode") == "fact_checking"
    prompt = (
        F.when(ruta, fill(fixed.PROMPT_RUTA, F.col("citado")))
        .when(fact, fill(fixed.PROMPT_FACT_CHECK,
                         F.coalesce("citado", F.lit(fixed.FACT_CHECK_NO_CONTEXT))))
        .otherwise(fill(fixed.PROMPT_GENERAL,
                        F.coalesce("simple", F.lit(fixed.GENERAL_NO_CONTEXT))))
    )
    return joined.select(
        "query_id", "mode", prompt.alias("prompt"),
        F.when(ruta & F.col("citado").isNull(), fixed.RUTA_NO_CONTEXT).alias("respuesta"),
        F.coalesce("fuentes", F.array().cast(
            "array<struct<rank:int,titulo:string,fuente:string,url:string>>")).alias("fuentes"),
    )
