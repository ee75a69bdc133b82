"""N-gram Jaccard join by prefix trees over globally ordered shingle sets.

1.  A document can only have a partner if as large a part of its shingles as the
    similarity asked for occurs in another document.  Shingles are counted by buckets of their hash, as
    packed arrays; what passes has copies, near copies or shared passages.
2.  Equal sets are folded to the smallest doc_id and the rest ordered globally by
    document frequency.  Linked sets share one of the rarest shingles of each, so
    documents that share such a shingle, directly or through others, form a cluster
    and links never leave it.
3.  Within a cluster, cut into blocks where large, one block is stored in a trie,
    frequent shingles first.  It is walked once for all sets of the other block,
    carrying their partial overlaps; a set leaves a branch when the shingles left on
    either side can no longer make the overlap large enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import written
from newsloom.llm.components import components
from newsloom.llm.shingles import chunk_name, chunks, sets

#: Words of a shingle, and the least similarity of a link as a fraction: those of op10.
WORDS = 3
PARTS, OF = 90, 100
CHUNK_CHARS = 1 << 22
#: Shingles counted together in one bucket, about.
BUCKET = 4_000_000
#: Members of one block of a cluster, and cells of one overlap matrix.
BLOCK = 2000
CELLS = 100_000_000
#: Small clusters handled in one group, by shingles.
GROUP = 2_000_000


def enough(inter, size_a, size_b, parts: int = PARTS):
    return OF * inter >= parts * (size_a + size_b - inter)


def packed_counts(docs: DataFrame, buckets: int, k: int = WORDS) -> DataFrame:
    """Rows (chunk, bucket, ids, sizes, keys): the shingles of a run of documents, by bucket."""
    shift, low = np.uint64(64 - (buckets - 1).bit_length()), np.uint64(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), count()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts, CHUNK_CHARS):
                found = sets(texts[a:b], k)
                every = np.concatenate(found)
                owner = np.repeat(np.arange(b - a), [len(x) for x in found])
                home = (every >> shift).astype(np.int64)
                keys = (every >> low).astype(np.uint32)
                order = np.argsort(home, kind="stable")
                cut = np.searchsorted(home[order], np.arange(buckets + 1))
                doc = ids[a:b].astype("<i8").tobytes()
                name = chunk_name(doc, partition, next(number))
                rows = [(j, np.bincount(owner[order[x:y]], minlength=b - a).astype("<u4").tobytes(),
                         keys[order[x:y]].astype("<u4").tobytes())
                        for j, (x, y) in enumerate(zip(cut[:-1], cut[1:]))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(rows), pa.binary()), pa.array([r[0] for r in rows], pa.int64()),
                    # One row of the chunk lists its documents.
                    pa.array([doc] + [None] * (len(rows) - 1), pa.binary()),
                    pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
                ], ["chunk", "bucket", "ids", "sizes", "keys"])

    return docs.mapInArrow(run, "chunk binary, bucket long, ids binary, sizes binary, keys binary")


def shared_in_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """How many shingles of each document occur in another one, within a bucket.

    Keys are 32 bits within the bucket, so a few count as shared by chance: the
    filter lets more documents pass, never fewer.
    """
    every = np.sort(np.concatenate([np.frombuffer(k, "<u4") for k in pdf["keys"]]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    shared = []
    for sizes, keys in zip(pdf["sizes"], pdf["keys"]):
        n, k = np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(keys, "<u4")
        at = np.searchsorted(twice, k)
        hit = (twice[np.minimum(at, len(twice) - 1)] == k) if len(twice) else np.zeros(len(k), bool)
        total = np.concatenate([[0], np.cumsum(hit)])
        ends = np.cumsum(n)
        shared.append((total[ends] - total[ends - n]).astype("<u4").tobytes())
    return pd.DataFrame({"chunk": pdf["chunk"], "ids": pdf["ids"], "sizes": pdf["sizes"],
                         "shared": shared})


def by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    def total(col):
        return np.sum([np.frombuffer(x, "<u4") for x in pdf[col]], axis=0, dtype=np.int64)

    ids = next(x for x in pdf["ids"] if x is not None)
    return pd.DataFrame({"doc_id": np.frombuffer(ids, "<i8"),
                         "n_shingles": total("sizes"), "shared": total("shared")})


def counted(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, shared) of every document."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1 << max(4, int(np.ceil(np.log2(max(chars / 6 / BUCKET, 1)))))
    rows = packed_counts(docs, buckets, k)
    rows = rows.groupBy("bucket").applyInPandas(
        shared_in_bucket, "chunk binary, ids binary, sizes binary, shared binary")
    return rows.groupBy("chunk").applyInPandas(
        by_document, "doc_id long, n_shingles long, shared long")


def shingle_sets(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, sig, n, tokens): the set of each document and a digest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts, CHUNK_CHARS):
                found = [x.view(np.int64) for x in sets(texts[a:b], k)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found],
                             pa.binary()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found))),
                ], ["doc_id", "sig", "n", "tokens"])

    return docs.mapInArrow(run, "doc_id long, sig binary, n long, tokens array<long>")


def ordered(reps: DataFrame, parts: int = PARTS) -> DataFrame:
    """(rep, copies, n, tokens): shingles of two or more sets, most frequent first, with prefix.

    ``prefix`` holds those of the n - ceil(n parts / OF) + 1 rarest shingles that occur
    elsewhere; sets without any have no partner and go.
    """
    rows = reps.select("rep", "n", F.explode("tokens").alias("token"))
    common = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    kept = rows.join(common, "token").groupBy("rep", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    rare = F.col("n") - F.ceil(F.col("n") * parts / OF) + 1 - (F.col("n") - F.size("ranked"))
    kept = kept.where(rare > 0).withColumns({
        "prefix": F.slice(F.col("ranked.token"), F.lit(1), rare.cast("int")),
        "tokens": F.reverse(F.col("ranked")),
    })
    return kept.select("rep", "n", "prefix", F.col("tokens.token").alias("tokens"),
                       F.col("tokens.df").alias("dfs"))


class Node:
    __slots__ = ("run", "children", "leaves", "least", "longest")

    def __init__(self, run):
        self.run, self.children, self.leaves = run, [], []


def trie(rows: list[np.ndarray], sizes: np.ndarray) -> Node:
    """Path-compressed trie of sets sorted by rank; each node knows the lengths below it.

    ``longest`` is the most shingles that a set below still adds after the node.
    """
    order = sorted(range(len(rows)), key=lambda i: rows[i].tobytes())
    root = Node(np.zeros(0, np.int64))
    stack = [(root, 0, 0, len(order))]
    nodes = []
    while stack:
        node, depth, a, b = stack.pop()
        nodes.append(node)
        node.least = int(min(sizes[order[i]] for i in range(a, b)))
        node.longest = max(len(rows[order[i]]) for i in range(a, b)) - depth
        while a < b:
            row = rows[order[a]]
            if len(row) == depth:
                node.leaves.append(order[a])
                a += 1
                continue
            end = a + 1
            while end < b and len(rows[order[end]]) > depth and rows[order[end]][depth] == row[depth]:
                end += 1
            last, short = rows[order[end - 1]], min(len(rows[order[i]]) for i in range(a, end))
            width = min(len(row), len(last), short)
            differ = np.flatnonzero(row[depth:width] != last[depth:width])
            stop = depth + int(differ[0]) if len(differ) else width
            child = Node(row[depth:stop])
            node.children.append(child)
            stack.append((child, stop, a, end))
            a = end
    return root


def walk(root: Node, has: np.ndarray, size_q: np.ndarray, size_t: np.ndarray, parts: int = PARTS
         ) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf set, linked query sets); ``has`` marks by rank which query sets hold a shingle."""
    many = has.shape[1]
    stack = [(root, np.arange(many), np.zeros(many, np.int32))]
    while stack:
        node, live, inter = stack.pop()
        if len(node.run):
            if len(live) < many // 4:
                inter = inter + has[np.ix_(node.run, live)].sum(0, dtype=np.int32)
            else:
                inter = inter + has[node.run].sum(0, dtype=np.int32)[live]
        reach = inter + node.longest
        fit = enough(reach, size_q[live], np.maximum(node.least, reach), parts)
        live, inter = live[fit], inter[fit]
        if not len(live):
            continue
        for leaf in node.leaves:
            ok = enough(inter, size_q[live], size_t[leaf], parts)
            if ok.any():
                yield leaf, live[ok]
        for child in node.children:
            stack.append((child, live, inter))


def linked(q: list[np.ndarray], size_q: np.ndarray, t: list[np.ndarray], size_t: np.ndarray,
           parts: int = PARTS) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of the two blocks that link, each block's sets as sorted frequency ranks."""
    if not q or not t:
        return
    used = np.intersect1d(np.concatenate(q), np.concatenate(t))
    if len(q) * len(used) > CELLS and max(len(q), len(t)) > 1:
        if len(q) >= len(t):
            half = len(q) // 2
            yield from linked(q[:half], size_q[:half], t, size_t, parts)
            for leaf, live in linked(q[half:], size_q[half:], t, size_t, parts):
                yield leaf, live + half
        else:
            half = len(t) // 2
            yield from linked(q, size_q, t[:half], size_t[:half], parts)
            for leaf, live in linked(q, size_q, t[half:], size_t[half:], parts):
                yield leaf + half, live
        return

    def places(x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(used, x)
        return at[used[np.minimum(at, len(used) - 1)] == x] if len(used) else at[:0]

    has = np.zeros((len(used), len(q)), np.uint8)
    for i, x in enumerate(q):
        has[places(x), i] = 1
    yield from walk(trie([places(x) for x in t], size_t), has, size_q, size_t, parts)


def join_cluster(pdf: pd.DataFrame, parts: int = PARTS) -> Iterator[tuple[int, int, int]]:
    """(rep, other, links): a spanning set of links, and each set's number of linked documents.

    Rows with ``side`` 0 are queries, 1 the trie, 2 both.
    """
    tokens = np.concatenate(pdf["tokens"].to_list()) if len(pdf) else np.zeros(0, np.int64)
    dfs = np.concatenate(pdf["dfs"].to_list()) if len(pdf) else np.zeros(0, np.int64)
    known, where, back = np.unique(tokens, return_index=True, return_inverse=True)
    # One global order: frequent first, then by hash.
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known, -dfs[where]))] = np.arange(len(known))
    cut = np.cumsum([len(x) for x in pdf["tokens"]])[:-1]
    rows = [np.sort(x) for x in np.split(rank[back], cut)]
    side, n, rep = pdf["side"].to_numpy(), pdf["n"].to_numpy(), pdf["rep"].to_numpy()
    copies = pdf["copies"].to_numpy()
    queries, stored = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    label = np.arange(len(pdf))
    count = np.zeros(len(pdf), np.int64)
    alone = bool((side == 2).all())
    for leaf, live in linked([rows[i] for i in queries], n[queries],
                             [rows[i] for i in stored], n[stored], parts):
        y, xs = stored[leaf], queries[live]
        xs = xs[xs != y]
        count[xs] += copies[y]
        if not alone:
            count[y] += copies[xs].sum()
        new = xs[label[xs] != label[y]]
        while len(new):
            yield int(rep[new[0]]), int(rep[y]), 0
            label[label == label[new[0]]] = label[y]
            new = new[label[new] != label[y]]
    for i in np.flatnonzero(count):
        yield int(rep[i]), int(rep[i]), int(count[i])


def cluster_links(sets_: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, b, links) of all clusters; ``sets_`` has cluster, rep, copies, n, tokens, dfs.

    A cluster beyond BLOCK members is cut into blocks; each pair of blocks is one
    group, so a set is sent once per block of its own cluster only.
    """
    held = sets_.groupBy("cluster").agg(F.count("*").alias("members"))
    rows = sets_.join(held, "cluster").withColumn("parts", F.ceil(F.col("members") / BLOCK))
    total = sets_.agg(F.sum(F.size("tokens"))).first()[0] or 0
    groups = max(1, int(total // GROUP) * 2)
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    rows = rows.withColumn("part", part.cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")), lambda j: F.struct(
        F.least(j, F.col("part")).alias("i"), F.greatest(j, F.col("part")).alias("j"),
        F.when(j == F.col("part"), 2).when(F.col("part") < j, 0).otherwise(1).alias("side"))))
    rows = rows.withColumn("o", other).select(
        "cluster", "rep", "copies", "n", "tokens", "dfs", "o.*",
        F.when(F.col("parts") > 1, F.xxhash64("cluster", F.lit("b"), "o.i", "o.j")).otherwise(
            F.pmod(F.xxhash64("cluster"), F.lit(groups))).alias("task"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part_ in pdf.groupby(["cluster", "i", "j"], sort=False):
            if len(part_) > 1:
                out.extend(join_cluster(part_, parts))
        return pd.DataFrame(out, columns=["a", "b", "links"])

    return rows.groupBy("task").applyInPandas(run, "a long, b long, links long")


def classes(docs: DataFrame, k: int = WORDS, parts: int = PARTS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document.

    Documents link when their sets of ``k``-word shingles have a Jaccard similarity
    of ``parts`` / OF or more; a document with fewer words has one shingle.  Null, empty
    and blank texts have none and stand alone.  doc_id names a document: rows that
    repeat it fall into one class, rows without it are left out.  Extra columns are
    ignored.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    every = written(counted(docs, k), "shingle-counts")
    wanted = every.where(f"n_shingles > 0 AND {OF} * shared >= {parts} * n_shingles")
    # Both grow with the input, so the plan is the same at every size: no broadcast.
    chosen = docs.hint("merge").join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    found = written(shingle_sets(chosen, k), "shingle-sets")
    folded = written(found.groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "equal-sets")
    reps = found.join(folded.select("sig", F.col("rep").alias("doc_id"), "copies"), ["sig", "doc_id"])
    reps = reps.dropDuplicates(["doc_id", "sig"]).withColumnRenamed("doc_id", "rep")
    rows = written(ordered(reps, parts), "ordered-sets")
    near = rows.select("rep", F.explode("prefix").alias("token"))
    hub = near.groupBy("token").agg(F.min("rep").alias("hub"))
    cluster = components(near.join(hub, "token").select(
        F.col("rep").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct())
    inner = rows.join(cluster.withColumnRenamed("node", "rep").withColumnRenamed(
        "component", "cluster"), "rep").join(folded.select("rep", "copies"), "rep")
    links = written(cluster_links(inner.select("cluster", "rep", "copies", "n", "tokens", "dfs"), parts), "set-links")
    joined = components(links.where("a <> b").select("a", "b"))
    counts = links.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of_set = folded.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(
        counts, "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"), (
            F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    members = found.select("doc_id", "sig").join(of_set, "sig").groupBy("doc_id").agg(
        F.min("component").alias("component"), F.max("links").alias("links"))
    return every.join(members, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
