"""Exact and approximate nearest neighbours by cosine.

Scoring is a block product inside each task: a batch of document vectors times
the query matrix, cut to the top k per query before anything leaves the task.
No (query, document) pair is ever a row of its own, so neither a cross join nor
a hot bucket can blow up the plan, and a document's payload never moves.

Vectors are compared with queries of their own dimension; the matrix of each is
chosen inside the task.  The query matrix is shipped to the tasks only up to a
checked number of queries; a larger batch is taken in slices, each of which passes
over the documents where they lie and leaves k rows a query in a written table.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom import fixed
from newsloom.session import work_dir

SIM_DIGITS = 6
MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_HITS = 100_000
QUERY_SLICE = 512
PAIR_ROWS = 50_000
LSH_DIGITS = 9  # a projection is rounded before it is cut, whatever the order of its sum

# Workers get the task functions by value and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HITS = "query_id long, id long, similitud double"


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _matrix(column) -> np.ndarray:
    """List column of equal lengths as a float64 matrix."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_list()).astype(np.float64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_width(ids: np.ndarray, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, ids, matrix) of the vectors of each dimension."""
    widths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        same = column if len(at) == len(column) else column.take(pa.array(at))
        yield int(width), ids[at], _matrix(same)


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indexes of the first k per column by (sim desc, id asc).

    ``ids`` must ascend.  Ties at the k-th value are resolved by row order.
    """
    n = sims.shape[0]
    if n <= k:
        rows, cols = np.indices(sims.shape)
        return rows.ravel(), cols.ravel()
    kth = np.partition(sims, n - k, axis=0)[n - k]
    above, equal = sims > kth, sims == kth
    room = k - above.sum(axis=0)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=0) <= room)))


def _keep_best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """First k distinct documents per query, each with its best similarity."""
    frame = frame.sort_values(["query_id", "similitud", "id"], ascending=[True, False, True])
    frame = frame.drop_duplicates(["query_id", "id"])
    return frame.groupby("query_id", sort=False).head(k)


def _score(ids: np.ndarray, docs: np.ndarray, qids: np.ndarray, queries: np.ndarray,
           k: int) -> pd.DataFrame:
    order = np.argsort(ids, kind="stable")
    ids, docs = ids[order], _unit(docs[order])
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else order
    parts = []
    for lo in range(0, len(qids), QUERY_SLICE):
        sims = np.round(docs @ queries[lo:lo + QUERY_SLICE].T, SIM_DIGITS) + 0.0
        if len(first) < len(ids):  # an id stated more than once takes one place
            sims = np.maximum.reduceat(sims, first, axis=0)
        rows, cols = _best(ids[first], sims, k)
        parts.append(pd.DataFrame({
            "query_id": qids[lo:lo + QUERY_SLICE][cols], "id": ids[first][rows],
            "similitud": sims[rows, cols],
        }))
    return pd.concat(parts) if parts else pd.DataFrame(columns=["query_id", "id", "similitud"])


def _as_batch(frame: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(frame["query_id"], pa.int64()), pa.array(frame["id"], pa.int64()),
         pa.array(frame["similitud"], pa.float64())],
        names=["query_id", "id", "similitud"],
    )


def _broadcast_scores(docs: DataFrame, batch: pd.DataFrame, k: int) -> DataFrame:
    """Per-task top k of every query; one pass over the documents."""
    asked = {
        width: (part["query_id"].to_numpy(np.int64), _unit(_matrix(part["embedding"])))
        for width, part in batch.groupby(batch["embedding"].map(len))
    }
    if not asked:
        return docs.sparkSession.createDataFrame([], HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            for width, ids, matrix in _by_width(b.column(0).to_numpy(), b.column(1)):
                if width in asked:
                    found = _score(ids, matrix, *asked[width], k)
                    best = found if best is None else _keep_best(pd.concat([best, found]), k)
        if best is not None:
            yield _as_batch(best)

    return docs.select("id", "embedding").mapInArrow(run, HITS)


def _sliced(queries: DataFrame, limit: int, hits: Callable[[pd.DataFrame], DataFrame]) -> DataFrame:
    """Hits of more queries than ``limit``: slices of about that many, one after the other.

    The driver holds one slice at a time; each slice's hits are written, so a lost
    executor repeats a part of one slice.
    """
    spark = queries.sparkSession
    path = work_dir(spark, "nearest")
    n = math.ceil(queries.count() / limit)
    spark.createDataFrame([], HITS).write.parquet(path)
    for at in range(n):
        batch = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == at).toPandas()
        if len(batch):
            hits(batch).select("query_id", "id", "similitud").write.mode("append").parquet(path)
    return spark.read.schema(HITS).parquet(path)


def _bounded(queries: DataFrame, limit: int) -> pd.DataFrame | None:
    """The query batch on the driver, None if it has more than ``limit`` rows.

    At most ``limit`` + 1 rows are fetched, in one evaluation.
    """
    batch = queries.limit(limit + 1).toPandas()
    return batch if len(batch) <= limit else None


def _whole(df: DataFrame) -> DataFrame:
    """Rows with a vector that has parts, none of them NULL.  A zero vector is similar
    to nothing (0.0)."""
    vector = F.col("embedding")
    return df.filter((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull()))


def incomparable(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, motivo) of queries ``nearest`` gives no rows for: ``sin_vector``, or
    ``sin_documentos`` if no document has their dimension."""
    widths = _whole(docs.select("embedding")).select(F.size("embedding").alias("n")).distinct()
    asked = queries.select("query_id", "embedding")
    whole = _whole(asked).select("query_id", F.size("embedding").alias("n"))
    return asked.select("query_id").join(whole, "query_id", "left_anti").select(
        "query_id", F.lit("sin_vector").alias("motivo")
    ).unionByName(whole.join(widths, "n", "left_anti").select(
        "query_id", F.lit("sin_documentos").alias("motivo")))


def rank(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similitud"), F.asc("id"))
    scored = scored.groupBy("query_id", "id").agg(F.max("similitud").alias("similitud"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(docs: DataFrame, queries: DataFrame, k: int = fixed.DENSE_TOP_K,
            max_broadcast_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Exact top k documents (id, embedding) per query (query_id, embedding).

    The result is marked for broadcast where the number of queries, and with k that
    of hits, was checked: joining it to document payloads then moves no payload.
    """
    docs = _whole(docs.select("id", "embedding"))
    wanted = _whole(queries.select("query_id", "embedding"))
    batch = _bounded(wanted, max_broadcast_queries)
    if batch is None:
        return rank(_sliced(wanted, max_broadcast_queries, lambda part: rank(
            _broadcast_scores(docs, part, k), k)), k)
    hits = rank(_broadcast_scores(docs, batch, k), k)
    return F.broadcast(hits) if len(batch) * k <= MAX_BROADCAST_HITS else hits


# ---------------------------------------------------------------- approximate


@dataclass
class LshModel:
    """Random projections: a bucket is the slice of length ``bucket_length`` that a unit
    vector's projection falls into.

    Coefficients follow a rule of table and dimension, so that an index can be
    built and read anywhere; ``table`` states them for other readers.
    """

    tables: int
    dims: int
    bucket_length: float

    def planes(self) -> np.ndarray:
        """One row of unit length per table."""
        t = np.arange(1, self.tables + 1, dtype=np.int64)[:, None]
        d = np.arange(1, self.dims + 1, dtype=np.int64)[None, :]
        return _unit(((7919 * t * d * d + 104729 * d + 31 * t) % 2003 - 1001) / 1001.0)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, d, float(x)) for t, row in enumerate(self.planes()) for d, x in enumerate(row)]
        return spark.createDataFrame(rows, "tabla int, dim int, coef double")

    def buckets(self, matrix: np.ndarray) -> np.ndarray:
        """Bucket of each vector (row) in each table (column)."""
        along = np.round(_unit(matrix) @ self.planes().T / self.bucket_length, LSH_DIGITS)
        return np.floor(along).astype(np.int32)


@dataclass
class LshIndex:
    buckets: DataFrame  # tabla, cubeta, id; store it partitioned by tabla and cubeta
    vectors: DataFrame  # id, embedding


def lsh_model(docs: DataFrame, bucket_length: float = 0.1, tables: int = 8) -> LshModel:
    """On unit vectors cos = 1 - d^2 / 2, so near vectors fall into near buckets."""
    width = _whole(docs.select("embedding")).agg(F.max(F.size("embedding")).alias("n")).first()
    return LshModel(tables, width["n"] or 0, bucket_length)


def lsh_index(docs: DataFrame, model: LshModel) -> LshIndex:
    """Buckets of all vectors of the model's dimension, one narrow row per table."""
    fits = F.size("embedding") == model.dims
    vectors = _whole(docs.select("id", "embedding")).filter(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = model.buckets(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(model.tables, dtype=np.int32), b.num_rows)),
                    pa.array(found.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), model.tables)),
                ], names=["tabla", "cubeta", "id"])

    return LshIndex(vectors.mapInArrow(run, "tabla int, cubeta int, id long"), vectors)


def _probed_scores(index: LshIndex, batch: pd.DataFrame, model: LshModel, k: int,
                   probe: int) -> DataFrame:
    """Documents that share a probed bucket with some query, scored against those queries.

    A candidate is one row with the queries it meets, at most the batch; vectors are
    fetched for candidates only.
    """
    spark = index.vectors.sparkSession
    if batch.empty:
        return spark.createDataFrame([], HITS)
    qids = batch["query_id"].to_numpy(np.int64)
    matrix = _matrix(batch["embedding"])
    own, queries = model.buckets(matrix), _unit(matrix)
    probes = pd.DataFrame([
        (t, int(own[q, t]) + step, q)
        for q in range(len(qids)) for t in range(model.tables) for step in range(-probe, probe + 1)
    ], columns=["tabla", "cubeta", "q"])
    asked = probes.groupby(["tabla", "cubeta"])["q"].agg(list).reset_index()
    asked = F.broadcast(spark.createDataFrame(asked, "tabla int, cubeta int, q array<int>"))
    met = (
        index.buckets.join(asked, ["tabla", "cubeta"])
        .groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("q"))).alias("q"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            if b.num_rows == 0:
                continue
            doc = pc.list_parent_indices(b.column(2)).to_numpy(zero_copy_only=False)
            who = pc.list_flatten(b.column(2)).to_numpy(zero_copy_only=False)
            ids, vectors = b.column(0).to_numpy(), _unit(_matrix(b.column(1)))
            parts = [] if best is None else [best]
            for lo in range(0, len(doc), PAIR_ROWS):
                d, q = doc[lo:lo + PAIR_ROWS], who[lo:lo + PAIR_ROWS]
                parts.append(_keep_best(pd.DataFrame({
                    "query_id": qids[q], "id": ids[d],
                    "similitud": np.round(np.einsum("ij,ij->i", vectors[d], queries[q]), SIM_DIGITS) + 0.0,
                }), k))
            best = _keep_best(pd.concat(parts), k)
        if best is not None:
            yield _as_batch(best)

    return index.vectors.join(met, "id").select("id", "embedding", "q").mapInArrow(run, HITS)


def nearest_lsh(index: LshIndex, queries: DataFrame, model: LshModel, k: int = fixed.DENSE_TOP_K,
                probe: int = 1, max_broadcast_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Approximate top k: only documents in buckets near a query's own are scored.

    Similarities are exact.  Queries of another dimension than the index give no rows.
    Larger query batches are taken in slices.
    """
    wanted = _whole(queries.select("query_id", "embedding")).filter(F.size("embedding") == model.dims)
    batch = _bounded(wanted, max_broadcast_queries)
    if batch is None:
        return rank(_sliced(wanted, max_broadcast_queries, lambda part: rank(
            _probed_scores(index, part, model, k, probe), k)), k)
    return rank(_probed_scores(index, batch, model, k, probe), k)


# ------------------------------------------------------------------ embedding


def embed(df: DataFrame, text: str, make_predict: Callable, batch_size: int = 256,
          out: str = "embedding") -> DataFrame:
    """Embed a text column with a user model, loaded once per Python worker.

    ``make_predict`` returns a function from an array of texts to a matrix, as
    ``pyspark.ml.functions.predict_batch_udf`` expects.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    udf = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return df.withColumn(out, udf(F.col(text)))
