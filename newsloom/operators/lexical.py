"""Distributed TF-IDF index and batch search.

Fit
    Texts are dealt by id and cut into words.  A task adds up the counts of all terms
    over runs of documents, so that Spark adds rows of (run, term), not of (document,
    term).  The vocabulary has a fixed maximum size; up to a limit the fit brings it to
    the driver, and a second pass looks for its terms alone in each text: no other
    term leaves a task.  Weights need one shuffle, of these terms by document.
Search
    Queries go through the same expressions and meet the postings on the term.
    Query terms are broadcast up to a checked number of rows; beyond it both
    sides are salted, so a term found in a large part of all documents is spread
    over several tasks.  Rank per query is cut to the top k before the shuffle.
    Documents are scored whole in the task that reads them: k rows per query leave it,
    and no pair is a row before.  Rows that share an id are one document; where there
    are such rows, the postings are joined instead.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import fixed
from newsloom.functions import scoring, terms, text as tx
from newsloom.functions.terms import Vocabulary, runs_of  # by name: tasks get no module
from newsloom.operators.articles import tag_topics

SIM_DIGITS = 6
SUM_DIGITS = 12  # beyond these a sum hangs on the order of its parts
MAX_BROADCAST_ROWS = 200_000
SALTS = 32
CELLS = 2_000_000  # products and scores a task holds at a time

# Workers get the task function by value and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class LexicalIndex:
    vocab: DataFrame     # term, cf, df, idf (at most max_features rows)
    postings: DataFrame  # id, term, peso (rows of a document have norm 1)
    documents: DataFrame  # id of every document, with or without terms
    stop_words: list[str]
    max_features: int = fixed.MAX_FEATURES
    rows: DataFrame | None = None  # id, terminos (array<struct<term, tf>>)
    texts: DataFrame | None = None  # id, palabras (``terms.word_text``)
    repeated: bool = False  # whether rows share an id or have none


def corpus_text(titulo: Column, texto: Column, title_weight: int = fixed.TITLE_WEIGHT) -> Column:
    """Title repeated for weight, then the body."""
    title = F.coalesce(titulo, F.lit(""))
    return F.concat_ws(" ", *[title] * title_weight, F.coalesce(texto, F.lit("")))


def term_arrays(docs: DataFrame, key: str, content: Column,
                stop_words: list[str]) -> DataFrame:
    """(key, terminos: array<struct<term, tf>>) of every document.

    The words of a row are numbered and its n-grams counted as numbers, so counting
    needs no shuffle and a term becomes text once per run of rows.
    """
    words = docs.select(key, terms.tokens(content, stop_words).alias("w"))
    spec = words.schema[key].dataType.simpleString()
    return words.mapInArrow(
        terms.counted, f"`{key}` {spec}, terminos array<struct<term: string, tf: int>>")


def term_counts(arrays: DataFrame, key: str) -> DataFrame:
    """(key, term, tf), one row per distinct term of a document.

    The outer form matters: for the inner one the optimizer infers a filter on
    the array's size and pushes it down to the scan, computing the array twice.
    """
    return arrays.select(key, F.inline_outer("terminos")).filter(F.col("term").isNotNull())


def vocabulary(counts: DataFrame, n_docs: Column,
               max_features: int = fixed.MAX_FEATURES) -> DataFrame:
    """The ``max_features`` terms of largest corpus frequency, with idf."""
    totals = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return cut(totals, n_docs, max_features)


def cut(totals: DataFrame, n_docs: Column, max_features: int) -> DataFrame:
    """The vocabulary of counted terms (term, cf, df)."""
    return (
        totals.orderBy(F.desc("cf"), F.asc("term"))
        .limit(max_features)
        .withColumn("n", n_docs)
        .withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
        .drop("n")
    )


def _vocab_side(vocab: DataFrame, max_features: int) -> DataFrame:
    """Broadcast the vocabulary while its size limit allows it."""
    return F.broadcast(vocab) if max_features <= MAX_BROADCAST_ROWS else vocab


def weigh(counts: DataFrame, vocab: DataFrame, key: str,
          max_features: int = fixed.MAX_FEATURES) -> DataFrame:
    """L2-normalised sublinear TF-IDF weights of the vocabulary's terms."""
    idf = _vocab_side(vocab.select("term", "idf"), max_features)
    raw = counts.join(idf, "term").select(
        key, "term", ((F.log(F.col("tf")) + 1) * F.col("idf")).alias("w")
    )
    # A document has at most max_features rows here, so the window is bounded.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("peso"))


def word_texts(docs: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, palabras): the text of every document as ``terms.Words`` cuts it.

    Documents are dealt by key before they are cut, so that few input files do not
    leave the cutting to few tasks.
    """
    dealt = docs.select(key, content.alias("contenido")).repartition(key)
    return dealt.select(key, terms.word_text(F.col("contenido")).alias("palabras"))


def counted_texts(texts: DataFrame, key: str, stop_words: list[str]) -> DataFrame:
    """(key, terminos) like ``term_arrays``, from ``word_texts``."""
    spec = texts.schema[key].dataType.simpleString()
    return texts.select(key, "palabras").mapInArrow(
        terms.counted_texts(stop_words), f"`{key}` {spec}, terminos array<struct<term: string, tf: int>>")


def term_totals(texts: DataFrame, stop_words: list[str]) -> DataFrame:
    """(term, cf, df) of all terms of the corpus."""
    parts = texts.select("palabras").mapInArrow(
        terms.totals(stop_words), "term string, cf long, df long")
    return parts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def local_vocabulary(vocab: DataFrame) -> DataFrame:
    """The vocabulary, brought to the driver: it is bounded by its caller."""
    return vocab.sparkSession.createDataFrame(vocab.toArrow())


def weighed_texts(texts: DataFrame, vocab: pd.DataFrame, stop_words: list[str]) -> DataFrame:
    """(id, term, peso) of the vocabulary's terms, like ``weigh``, from one pass of texts."""
    finder = Vocabulary(vocab["term"].tolist(), stop_words)
    idf, names = vocab["idf"].to_numpy(np.float64), pa.array(vocab["term"], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in runs_of(batch.column(1)):
                row, term, tf = finder.counts(batch.column(1).slice(lo, hi - lo))
                w = (np.log(tf) + 1) * idf[term]
                edges = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(
                    [names.take(pa.array(term)), pa.array(w)], ["term", "w"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.bincount(row, w * w, hi - lo)), lists],
                    ["id", "n2", "pesos"])

    spec = texts.schema["id"].dataType.simpleString()
    rows = texts.select("id", "palabras").mapInArrow(
        run, f"id {spec}, n2 double, pesos array<struct<term: string, w: double>>").repartition("id")
    # Rows that share an id have one norm.
    norm = F.sqrt(F.sum("n2").over(Window.partitionBy("id")))
    return rows.select("id", norm.alias("norma"), "pesos").select(
        "id", "norma", F.inline_outer("pesos")).filter(F.col("term").isNotNull()).select(
        "id", "term", (F.col("w") / F.col("norma")).alias("peso"))


def fit(articles: DataFrame, max_features: int = fixed.MAX_FEATURES,
        stop_words: list[str] = fixed.STOP_WORDS,
        title_weight: int = fixed.TITLE_WEIGHT) -> LexicalIndex:
    """Vocabulary and weighed postings of a corpus.

    Up to ``MAX_BROADCAST_ROWS`` features the vocabulary is computed here and held by the
    driver, and postings and scores read the texts once more.  A larger one stays a
    table: the term arrays of all documents are distributed by id once and joined to it.
    """
    content = corpus_text(F.col("titulo"), F.col("texto"), title_weight)
    if max_features > MAX_BROADCAST_ROWS:
        n_docs = articles.agg(F.count("*").alias("n")).scalar()
        arrays = term_arrays(articles, "id", content, stop_words).repartition("id")
        counts = term_counts(arrays, "id")
        vocab = vocabulary(counts, n_docs, max_features)
        return LexicalIndex(vocab, weigh(counts, vocab, "id", max_features),
                            articles.select("id"), stop_words, max_features)
    texts = word_texts(articles, "id", content)
    sizes = articles.groupBy("id").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("n"), F.max("n").alias("most"),
        F.count_if(F.col("id").isNull()).alias("nulls")).first()
    vocab = local_vocabulary(cut(
        term_totals(texts, stop_words), F.lit(sizes.n or 0).cast("long"), max_features))
    known = vocab.select("term", "idf").toPandas()
    return LexicalIndex(
        vocab, weighed_texts(texts, known, stop_words), articles.select("id"), stop_words,
        max_features, texts=texts, repeated=(sizes.most or 0) > 1 or sizes.nulls > 0,
    )


def asked_counts(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    arrays = term_arrays(queries, "query_id", F.col("consulta"), index.stop_words)
    return term_counts(arrays, "query_id")


def scores(index: LexicalIndex, queries: DataFrame,
           max_broadcast_rows: int = MAX_BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Cosine of every (query, document) pair that shares a term.

    ``bruta``, to twelve digits, serves thresholds and display; ``similitud`` is rounded
    further, so that rank and ties do not hang on the order of a sum.

    The number of query terms is checked on the queries alone, before the
    vocabulary is known, and only up to the limit.
    """
    counts = asked_counts(index, queries)
    asked = weigh(counts, index.vocab, "query_id", index.max_features).withColumnRenamed("peso", "q")
    if counts.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        matched = index.postings.join(F.broadcast(asked), "term")
    else:
        all_salts = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
        salted = index.postings.withColumn("sal", F.pmod(F.xxhash64("id"), F.lit(salts)))
        matched = salted.join(asked.withColumn("sal", F.explode(all_salts)), ["term", "sal"])
    return matched.groupBy("query_id", "id").agg(
        F.round(F.sum(F.col("peso") * F.col("q")), SUM_DIGITS).alias("bruta")
    ).withColumn("similitud", F.round("bruta", SIM_DIGITS))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """First k documents per query; Spark cuts each partition to k beforehand."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similitud"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class RowScorer:
    """Scores documents whole, each from its own terms, and keeps k per query.

    ``vocab`` (term, idf) and ``asked`` (query_id, term, peso) are bounded by their
    callers.  A document whose score cannot reach the k-th of any query, by the largest
    weight any query gives each term, is left out before its products are made.
    """

    def __init__(self, vocab: pd.DataFrame, asked: pd.DataFrame, k: int,
                 stop_words: list[str] = fixed.STOP_WORDS):
        self.finder = Vocabulary(vocab["term"].tolist(), stop_words)
        self.terms = pa.array(vocab["term"], pa.string())
        self.idf, self.k = vocab["idf"].to_numpy(np.float64), k
        self.qids, query = np.unique(asked["query_id"].to_numpy(np.int64), return_inverse=True)
        term = pc.index_in(pa.array(asked["term"], pa.string()), value_set=self.terms).to_numpy(
            zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order], asked["peso"].to_numpy(np.float64)[order]
        self.n_asking = np.bincount(term, minlength=len(vocab))
        self.first = np.cumsum(self.n_asking) - self.n_asking
        self.most = np.zeros(len(vocab))
        np.maximum.at(self.most, term, asked["peso"].to_numpy(np.float64))
        self.least = np.zeros(len(self.qids))  # k-th score so far, 0 while there are fewer
        self.best: pd.DataFrame | None = None

    def add(self, ids: np.ndarray, lists: pa.Array) -> None:
        flat = pc.list_flatten(lists)
        doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        code = pc.index_in(flat.field("term"), value_set=self.terms)
        known = code.is_valid().to_numpy(zero_copy_only=False)
        code = code.fill_null(0).to_numpy(zero_copy_only=False)[known]
        tf = flat.field("tf").to_numpy(zero_copy_only=False)[known]
        self._add(ids, doc[known], code, tf)

    def add_texts(self, ids: np.ndarray, texts: pa.Array) -> None:
        for lo, hi in runs_of(texts):
            self._add(ids[lo:hi], *self.finder.counts(texts.slice(lo, hi - lo)))

    def _add(self, ids: np.ndarray, doc: np.ndarray, code: np.ndarray, tf: np.ndarray) -> None:
        w = (np.log(tf) + 1) * self.idf[code]
        w /= np.sqrt(np.bincount(doc, w * w, len(ids)))[doc]
        reach = np.bincount(doc, w * self.most[code], len(ids))
        open_ = (reach > 0) & (reach + 1e-9 >= self.least.min(initial=np.inf))
        here = open_[doc] & (self.n_asking[code] > 0)
        code, doc, w = code[here], doc[here], w[here]
        # Documents are taken in runs of bounded products and bounded score cells.
        work = np.bincount(doc, self.n_asking[code], len(ids)) + len(self.qids)
        run = ((np.cumsum(work) - work) // CELLS)[doc]
        for lo, hi in zip(*_bounds(run)):
            self._run(ids, doc[lo:hi], code[lo:hi], w[lo:hi])

    def _run(self, ids: np.ndarray, doc: np.ndarray, code: np.ndarray, w: np.ndarray) -> None:
        base, width, n = doc[0], len(self.qids), self.n_asking[code]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.first[code], n)
        cell = np.repeat(doc - base, n) * width + self.query[at]
        raw = np.bincount(cell, np.repeat(w, n) * self.weight[at])
        cell = np.flatnonzero(raw)
        raw, who = raw[cell], cell % width
        sims = np.round(raw, SIM_DIGITS)
        keep = sims >= self.least[who]
        found = pd.DataFrame({"q": who[keep], "id": ids[base + cell[keep] // width],
                              "bruta": raw[keep], "similitud": sims[keep]})
        best = found if self.best is None else pd.concat([self.best, found])
        best = best.sort_values(["q", "similitud", "id"], ascending=[True, False, True])
        place = best.groupby("q", sort=False).cumcount()
        self.best = best[place < self.k]
        full = best[place == self.k - 1]
        self.least[full["q"]] = full["similitud"]

    def result(self) -> pa.RecordBatch | None:
        if self.best is None:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(self.qids[self.best["q"]], pa.int64()), pa.array(self.best["id"], pa.int64()),
             pa.array(self.best["bruta"], pa.float64()), pa.array(self.best["similitud"], pa.float64())],
            names=["query_id", "id", "bruta", "similitud"])


def _bounds(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of equal runs."""
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.array([], int)
    return starts, np.append(starts[1:], len(run)) if len(run) else starts


def task_hits(index: LexicalIndex, queries: DataFrame, k: int,
              max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame | None:
    """Top k per query and task of texts or rows; None if queries or vocabulary exceed
    ``max_rows``, of which not more than one row beyond is fetched."""
    if index.max_features > max_rows or index.repeated or (index.texts is None and index.rows is None):
        return None
    read = ("id", "palabras") if index.texts is not None else ("id", "terminos")
    weights = weigh(asked_counts(index, queries), index.vocab, "query_id", index.max_features)
    asked = weights.limit(max_rows + 1).toPandas()
    if len(asked) > max_rows:
        return None
    vocab = index.vocab.select("term", "idf").limit(index.max_features).toPandas()
    stop_words = index.stop_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = RowScorer(vocab, asked, k, stop_words)
        for b in batches:
            if b.num_rows and len(asked):
                add = scorer.add if read[1] == "terminos" else scorer.add_texts
                add(b.column(0).to_numpy(), b.column(1))
        found = scorer.result()
        if found is not None:
            yield found

    source = index.rows if index.texts is None else index.texts
    return source.select(*read).mapInArrow(
        run, "query_id long, id long, bruta double, similitud double"
    ).withColumn("bruta", F.round("bruta", SUM_DIGITS))


def search(index: LexicalIndex, queries: DataFrame, k: int = fixed.LEXICAL_TOP_K,
           max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Top k documents per query; short results are filled up at similarity 0.

    Fillers are the first k documents by id: a query with h < k hits needs k - h
    documents without a hit, and the first k ids contain at least that many.
    Blank queries give no rows.
    """
    asked = queries.withColumn("consulta", tx.strip(F.col("consulta"))).filter(
        F.col("consulta") != ""
    )
    scored = task_hits(index, asked, k, max_broadcast_rows)
    if scored is None:
        scored = scores(index, asked, max_broadcast_rows)
    hits = top_k(scored, k).drop("rank")
    first_ids = index.documents.orderBy("id").limit(k).agg(
        F.array_sort(F.collect_list("id")).alias("ids")
    )
    fillers = asked.select(
        "query_id", F.explode(first_ids.scalar()).alias("id"),
        F.lit(0.0).alias("bruta"), F.lit(0.0).alias("similitud"),
    )
    merged = hits.unionByName(fillers).groupBy("query_id", "id").agg(
        F.max("bruta").alias("bruta"), F.max("similitud").alias("similitud")
    )
    return top_k(merged, k).withColumn("relevante", scoring.relevant(F.col("bruta")))


def summary(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per query: result flag, message, best similarity, relevant hits."""
    per_query = hits.groupBy("query_id").agg(
        F.max("bruta").alias("maxima"),
        F.count_if("relevante").alias("n_relevantes"),
    )
    blank = tx.strip(F.coalesce("consulta", F.lit(""))) == ""
    found = F.col("maxima").isNotNull()
    best = F.coalesce("maxima", F.lit(0.0))
    return queries.join(per_query, "query_id", "left").select(
        "query_id",
        found.alias("tiene_resultados"),
        F.when(found, scoring.result_message(best, F.col("n_relevantes")))
        .when(blank, fixed.MSG_BLANK_QUERY).otherwise(fixed.MSG_EMPTY_CORPUS).alias("mensaje"),
        F.round(best, SIM_DIGITS).alias("max_similitud"),
        F.coalesce("n_relevantes", F.lit(0)).alias("n_relevantes"),
        scoring.three_decimals(best).alias("max_texto"),
        scoring.band(best).alias("banda"),
    )


def present(hits: DataFrame, articles: DataFrame, queries: DataFrame, rules=fixed.TOPIC_RULES,
            default_topic: str = fixed.TOPIC_DEFAULT, max_queries: int = 10_000) -> DataFrame:
    """Hits with their article and display values.

    There are at most k hits per query, so up to ``max_queries`` queries the hits
    are broadcast and article bodies are not shuffled.
    """
    sim = F.col("bruta")
    if queries.limit(max_queries + 1).count() <= max_queries:
        hits = F.broadcast(hits)
    joined = tag_topics(articles.join(hits, "id"), rules, default_topic)
    return joined.select(
        "query_id", "rank", "id", "similitud", "relevante", "titulo", "url", "fuente", "topico",
        tx.prefix(F.coalesce("fecha_pub", F.date_format("fecha_scrape", "yyyy-MM-dd")), 10)
        .alias("fecha"),
        tx.excerpt(F.col("texto"), 200, always=True).alias("extracto"),
        scoring.band(sim).alias("banda"),
        scoring.bar_width(sim).alias("ancho"),
        scoring.three_decimals(sim).alias("sim_texto"),
    )
