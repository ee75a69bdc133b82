"""Exact top-k search by inner product over a pivot-distance index.

Vectors of integers are lifted to one common length: with M the largest squared
length, x becomes (x, sqrt(M - |x|^2)) and a query q becomes (q, 0).  Squared
distances are then |q|^2 + M - 2 q.x, so the nearest are those of highest inner
product, and distances to pivots (p, 0) are exact integers under the root.  A
vector is keyed by its nearest pivot and the distance to it; an annulus is a range
of distances around one pivot.  By the triangle inequality no vector of an annulus
is nearer to a query than the gap between the query's own distance and that range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import written

#: Pivots and annuli are fitted on this many vectors at most, the lowest by hash.
SAMPLE = 4096
PIVOTS = 16
RINGS = 8
#: Vectors in one block of an annulus, and queries in one block, about.
BLOCK = 2048
QUERY_BLOCK = 256
#: Annuli searched first for each block of queries, to get a bound for the rest.
FIRST = 4
HITS = "query_id long, vec_id long, score long"


def integers(x: Column) -> Column:
    return F.transform(x, lambda v: F.floor(v.cast("double") * 256))


def usable(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, v) of vectors without null, NaN or infinite components, as integers.

    A vec_id stated more than once counts once, with its greatest vector.
    """
    def fine(v):
        d = v.cast("double")
        return v.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))

    rows = rows.where(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & F.forall(vec, fine))
    return rows.groupBy("vec_id").agg(F.max(integers(F.col(vec))).alias("v"))


def stack(vectors, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros, which add nothing to a product."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T, through floats while these are exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def squared(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


class Index:
    """Pivots, annuli and the common length; small and fixed in size."""

    def __init__(self, sample: np.ndarray, width: int, longest: int):
        self.width, self.longest = width, longest
        norm = squared(sample)
        chosen = [int(np.argmin(norm))] if len(sample) else []
        gap = np.full(len(sample), np.inf)
        while chosen and len(chosen) < PIVOTS:  # farthest point first
            p = sample[chosen[-1:]]
            gap = np.minimum(gap, (norm + squared(p) - 2 * products(sample, p)[:, 0]))
            if gap.max() <= 0:
                break
            chosen.append(int(np.argmax(gap)))
        self.pivots = sample[chosen] if chosen else np.zeros((1, width), np.int64)
        home, far = self.key(sample) if len(sample) else (np.zeros(0, int), np.zeros(0))
        cuts = np.arange(1, RINGS) / RINGS
        self.cuts = np.array([np.quantile(far[home == p], cuts) if (home == p).any()
                              else np.zeros(RINGS - 1) for p in range(len(self.pivots))])

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and lifted squared distance to it."""
        d = self.longest + squared(self.pivots)[None, :] - 2 * products(x, self.pivots)
        home = d.argmin(1)
        return home, d[np.arange(len(x)), home]

    def ring(self, home: np.ndarray, far: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(self.cuts[p], f, side="right")
                         for p, f in zip(home, far)], np.int64)


def fit(data: DataFrame) -> Index:
    """Index structure from a bounded sample; width and length from all vectors."""
    length = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    top = data.agg(F.max(F.size("v")), F.max(length)).first()
    width, longest = max(int(top[0] or 0), 1), int(top[1] or 0)
    rows = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    return Index(stack([r["v"] for r in rows], width), width, longest)


def keyed(data: DataFrame, index: Index) -> DataFrame:
    """Adds pivot, ring and the squared distance to the pivot."""
    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            home, far = index.key(stack(pdf["v"].tolist(), index.width))
            yield pdf.assign(pivot=home, ring=index.ring(home, far), far=far)

    return data.mapInPandas(add, "vec_id long, v array<long>, pivot long, ring long, far long")


def blocks(rows: DataFrame, index: Index, size: int, by: tuple[str, ...]) -> DataFrame:
    """Packs rows that share ``by`` into blocks of about ``size``: ids and a matrix each.

    Groups are split by count, so equal vectors in any number only make more blocks.
    """
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    rows = rows.join(counts, list(by))
    part = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / size))
    rows = rows.withColumn("part", part.cast("long"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        first = pdf.iloc[0]
        return pd.DataFrame({
            "block": ["/".join(str(first[c]) for c in (*by, "part"))],
            **{c: [first[c]] for c in by},
            "low": [pdf["far"].min()], "high": [pdf["far"].max()],
            "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
            "matrix": [stack(pdf["v"].tolist(), index.width).astype(np.int64).tobytes()],
        })

    spec = "block string, " + "".join(f"{c} long, " for c in by) + (
        "low long, high long, ids binary, matrix binary")
    return rows.groupBy(*by, "part").applyInPandas(pack, spec)


def gaps(queries: np.ndarray, rings: pd.DataFrame, index: Index) -> np.ndarray:
    """Least lifted distance between each query and each annulus, rounded down."""
    near = squared(queries)[:, None] + squared(index.pivots)[None, :] - 2 * products(
        queries, index.pivots)
    near = np.sqrt(np.maximum(near, 0))[:, rings["pivot"].to_numpy()]
    low, high = np.sqrt(rings["low"].to_numpy()), np.sqrt(rings["high"].to_numpy())
    slack = 1e-9 * (near + high[None, :]) + 1e-9
    return np.maximum(np.maximum(low[None, :] - near, near - high[None, :]) - slack, 0)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search(rows: DataFrame, wanted: Column, k: int, vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each row that ``wanted`` picks.

    Blocks of queries meet blocks of annuli.  The first annuli of each query block
    give every query a bound, the k-th score so far; then all other annuli are
    visited in the order of their gaps except those whose gap proves every score in
    them lower.  A visit yields at most k rows per query, and only rows that reach
    the bound.  Null, empty-handed and non-finite vectors take no part, shorter
    vectors count as ending in zeros, ties go to the smaller vec_id, an empty table
    gives no rows, and other columns are ignored.
    """
    data = written(usable(rows, vec), "vectors")
    index = fit(data)
    placed = keyed(data, index)
    held = written(blocks(placed, index, BLOCK, ("pivot", "ring")), "vector-blocks")
    asked = keyed(data.where(wanted), index)
    asked = written(blocks(asked, index, QUERY_BLOCK, ("pivot",)), "query-blocks")
    # One row for each annulus: at most PIVOTS * RINGS.
    rings = held.groupBy("pivot", "ring").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    names = held.select("pivot", "ring", "block")
    first = written(scored(visits(asked, names, rings, index, None), asked, held, index, k), "first")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bound = first.withColumn("rank", F.row_number().over(top)).where(F.col("rank") == k)
    bound = bound.select("query_id", F.col("score").alias("bound"))
    # Bounds travel with their query block, in the order of its ids.
    names_of = asked.select("block", F.explode(_ids(F.col("ids"))).alias("query_id"))
    bounds = names_of.join(bound, "query_id").groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("query_id", "bound"))).alias("bounds"))
    asked = written(asked.join(bounds, "block", "left"), "query-bounds")
    rest = scored(visits(asked, names, rings, index, True), asked, held, index, k)
    found = first.unionByName(rest).withColumn("rank", F.row_number().over(top))
    return found.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"),
                                                 "vec_id", "score")


def _ids(packed: Column) -> Column:
    @F.pandas_udf("array<long>")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, np.int64))

    return unpack(packed)


def visits(asked: DataFrame, names: DataFrame, rings: pd.DataFrame, index: Index,
           bounded: bool | None) -> DataFrame:
    """Pairs (query block, data block) to visit: the first annuli, or the rest within bounds."""

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i in range(len(pdf)):
                q = np.frombuffer(pdf["matrix"].iloc[i], np.int64).reshape(-1, index.width)
                gap = gaps(q, rings, index)
                order = np.argsort(gap.mean(0), kind="stable")
                take = order[:FIRST]
                if bounded:
                    ids = np.frombuffer(pdf["ids"].iloc[i], np.int64)
                    known = dict(pdf["bounds"].iloc[i] or {})
                    least = np.array([known.get(int(x), -math.inf) for x in ids], float)
                    # A score of at least the bound needs a distance of at most this.
                    reach = squared(q) + index.longest - 2 * least
                    open_ = (gap ** 2 <= (reach * (1 + 1e-9) + 1)[:, None]).any(0)
                    take = [j for j in order[FIRST:] if open_[j]]
                yield pd.DataFrame({
                    "query_block": pdf["block"].iloc[i],
                    "pivot": rings["pivot"].to_numpy()[take], "ring": rings["ring"].to_numpy()[take]})

    cols = ["block", "ids", "matrix"] + (["bounds"] if bounded else [])
    pairs = asked.select(*cols).mapInPandas(plan, "query_block string, pivot long, ring long")
    return pairs.join(names, ["pivot", "ring"]).select("query_block", "block")


def scored(pairs: DataFrame, asked: DataFrame, held: DataFrame, index: Index, k: int) -> DataFrame:
    """The k best of each visited pair of blocks, as rows of HITS."""
    if "bounds" not in asked.columns:
        asked = asked.withColumn("bounds", F.lit(None).cast("map<long,long>"))
    left = asked.select(F.col("block").alias("query_block"), F.col("ids").alias("query_ids"),
                        F.col("matrix").alias("query_matrix"), "bounds")
    right = held.select("block", "ids", "matrix")
    both = pairs.join(left, "query_block").join(right, "block").select(
        "query_ids", "query_matrix", "bounds", "ids", "matrix")

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for qi, qm, known, ids, m in pdf.itertuples(index=False, name=None):
                qi, ids = np.frombuffer(qi, np.int64), np.frombuffer(ids, np.int64)
                score = products(np.frombuffer(qm, np.int64).reshape(len(qi), -1),
                                 np.frombuffer(m, np.int64).reshape(len(ids), -1))
                known = dict(known or {})
                out = []
                for i, q in enumerate(qi):
                    s = score[i]
                    fit_ = np.flatnonzero((ids != q) & (s >= known.get(int(q), np.iinfo(np.int64).min)))
                    if len(fit_) > 4 * k:
                        cut = np.partition(s[fit_], len(fit_) - k)[len(fit_) - k]
                        fit_ = fit_[s[fit_] >= cut]
                    fit_ = fit_[best(ids[fit_], s[fit_], k)]
                    out.append((np.full(len(fit_), q), ids[fit_], s[fit_]))
                yield pd.DataFrame({n: np.concatenate([o[j] for o in out])
                                    for j, n in enumerate(("query_id", "vec_id", "score"))})

    return both.mapInPandas(visit, HITS)
