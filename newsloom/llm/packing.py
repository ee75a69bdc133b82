"""Best-fit packing of token sequences into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import word_count, written

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces packed together in one group; more would fill bins hardly better.
SHARD_PIECES = 20_000
SCHEMA = ("doc_id long, piece long, start long, n_tokens long, bin_id long, bin_offset long, "
          "bin_used long, bin_size long")


def bin_cost(capacity: int, longest: int) -> float:
    """Cost of one sequence: its tokens, and attention that grows with their square."""
    return capacity * (1.0 + capacity / (4.0 * longest))


def fill(falling: list[int], at: int, capacity: int) -> int:
    """Tokens a new bin of ``capacity`` would hold: piece ``at`` and the largest later
    ones that still fit, one after the other.  ``falling`` has the sizes negated, in order."""
    room = capacity + falling[at]
    at += 1
    while room and at < len(falling):
        at = bisect_left(falling, -room, at)
        if at < len(falling):
            room += falling[at]
            at += 1
    return capacity - room


def best_fit(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES
             ) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin of each item, its offset, and used and final size of each bin.

    Items come in falling size.  Each goes where least room is left over.  If it fits
    nowhere, every permitted size that holds it is tried on the pieces still to come;
    the one whose contents would cost least a token, after downsizing, is opened.  At
    the end each bin takes the smallest permitted size that holds its contents, which
    is less than it was opened with where its fillers found a tighter bin.
    """
    capacities = tuple(sorted(capacities))
    longest, falling = capacities[-1], [-s for s in sizes]
    open_bins: dict[int, list[int]] = {}
    rooms: list[int] = []
    where, offset, used = [], [], []

    def cost(capacity: int, at: int) -> float:
        held = fill(falling, at, capacity)
        return bin_cost(capacities[bisect_left(capacities, held)], longest) / held

    for at, size in enumerate(sizes):
        i = bisect_left(rooms, size)
        if i < len(rooms):
            room = rooms[i]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
        else:
            b = len(used)
            used.append(0)
            room = min((c for c in capacities if c >= size), key=lambda c: (cost(c, at), c))
        where.append(b)
        offset.append(used[b])
        used[b] += size
        room -= size
        if room:
            if room not in open_bins:
                insort(rooms, room)
            open_bins.setdefault(room, []).append(b)
    final = [capacities[bisect_left(capacities, u)] for u in used]
    return where, offset, used, final


def pieces(docs: DataFrame, length, longest: int) -> DataFrame:
    """Documents cut at the longest permitted length; whole ones are one piece."""
    rows = docs.select("doc_id", F.coalesce(length, F.lit(0)).cast("long").alias("length"))
    last = F.greatest(F.ceil(F.col("length") / longest) - 1, F.lit(0))
    rows = rows.select("doc_id", "length", F.explode(
        F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    start = F.col("piece") * longest
    return rows.select("doc_id", "piece", start.alias("start"),
                       F.least(F.col("length") - start, F.lit(longest)).alias("n_tokens"))


def pack(docs: DataFrame, length=None, capacities: tuple[int, ...] = CAPACITIES,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_used, bin_size.

    ``length`` is the token count of a row (default: plain words of ``text``).
    Pieces are dealt to shards by a hash of (doc_id, piece, n_tokens, number among equal
    ones); a shard holds
    about ``shard_pieces`` of them whatever the input, and bins never cross shards.
    A document without tokens (null or empty text) gives one row of 0 tokens in no
    bin.  Repeated rows are packed once each; ties go by doc_id and piece.
    """
    length = word_count(F.col("text")) if length is None else length
    capacities = tuple(sorted(capacities))
    rows = written(pieces(docs, length, capacities[-1]), "pieces")
    full = rows.where("n_tokens > 0")
    # The count only sizes the shards.  Equal rows are counted and numbered, which
    # spreads them over the shards, the same in every run.
    shards = max(1, -(-full.count() // shard_pieces))
    full = full.groupBy(*full.columns).agg(F.count("*").alias("n")).select(
        *full.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("again"))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "again"), F.lit(shards))
    full = full.withColumn("shard", shard.cast("long"))

    def one_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
        where, offset, used, final = best_fit(pdf["n_tokens"].tolist(), capacities)
        base = int(pdf["shard"].iloc[0]) << 32
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["start"],
            "n_tokens": pdf["n_tokens"], "bin_id": [base + b for b in where],
            "bin_offset": offset, "bin_used": [used[b] for b in where],
            "bin_size": [final[b] for b in where],
        })

    packed = full.groupBy("shard").applyInPandas(one_shard, SCHEMA)
    none = [F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset", "bin_used", "bin_size")]
    empty = rows.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", *none)
    return packed.unionByName(empty)
