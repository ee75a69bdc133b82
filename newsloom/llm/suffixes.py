"""Removal of long repeated byte strings by a distributed merge sort of suffixes.

A string of ``LENGTH`` bytes is repeated if it starts anywhere else.  Every such
window has an anchor, the first of its least ``CORE``-byte strings by hash, which
depends on nothing but the window; windows next to each other mostly share it.
A stretch is the run of windows with one anchor, its context the bytes they cover.

1.  Anchors are counted by hash: windows whose anchor is unique are not repeated.
2.  Equal contexts are folded to their first occurrence.  Suffixes from the anchors
    of the remaining ones are sorted into runs, the runs are front-coded (length of
    the prefix shared with the suffix before, and the rest) and exchanged by anchor.
3.  A loser tree merges the runs.  It keeps the common prefix of every loser with
    the last winner, so known prefixes are never compared again, and yields the
    suffixes in order with their common prefixes.  Neighbours that share the core
    are one class: a window is repeated if its bytes right of the anchor lie within
    the common prefix with another member and those left of it are the same.

A string may also be one of words (``Strings(words=True)``): each word stands as a
hash of eight bytes, and lengths and places count words instead of bytes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import written
from newsloom.llm.shingles import SPACE, chunk_name, chunks, mix

LENGTH = 400
CORE = 100
CHUNK_CHARS = 1 << 22
#: Windows looked at together; longer texts are cut with an overlap.
SEGMENT = 1 << 19
PLACE_BITS = 20
#: Text for each bucket of anchors, about.
BUCKET_CHARS = 1 << 25
LIVE, FIRST, MANY = 1, 2, 4


class Strings(NamedTuple):
    """What counts as a repeat: strings of ``length`` bytes, or words."""

    length: int = LENGTH
    core: int = CORE  # shorter than ``length``; anchors are strings of this length
    words: bool = False

    @property
    def unit(self) -> int:
        return 8 if self.words else 1


BYTES = Strings()

_RANDOM = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def stretches(data: bytes, kind: Strings = BYTES) -> dict[str, np.ndarray]:
    """first, last window and anchor of each stretch; hashes of its core and its context."""
    found = [_segment(data, at, kind)
             for at in range(0, max(len(data) // kind.unit - kind.length + 1, 0), SEGMENT)]
    names = ("first", "last", "anchor", "core", "context")
    if not found:
        return {n: np.zeros(0, np.uint64 if n in ("core", "context") else np.int64) for n in names}
    return {n: np.concatenate([f[n] for f in found]) for n in names}


def _segment(data: bytes, at: int, kind: Strings) -> dict[str, np.ndarray]:
    length, core = kind.length, kind.core
    text = np.frombuffer(data, np.uint64 if kind.words else np.uint8)[at:at + SEGMENT + length - 1]
    up, down = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text if kind.words else _RANDOM[text]) * up[:len(text)], out=total[1:])
    grams = mix((total[core:] - total[:-core]) * down[:len(text) - core + 1])
    wide = length - core + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(key) % wide
    grid = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    windows = len(text) - length + 1
    anchor = (np.minimum(behind[:windows], ahead[wide - 1:wide - 1 + windows]) & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    last = np.append(first[1:] - 1, windows - 1)
    anchor = anchor[first]
    span = (last - first + length).astype(np.uint64) << np.uint64(32)
    context = mix((total[last + length] - total[first]) * down[first])
    context = mix(context ^ span ^ (anchor - first).astype(np.uint64))
    # Least hashes are small: mixed again, they spread over the buckets.
    return {"first": first + at, "last": last + at, "anchor": anchor + at,
            "core": mix(grams[anchor] ^ np.uint64(1)), "context": context}


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    edge = np.diff(np.concatenate([[0], (~SPACE[np.frombuffer(data, np.uint8)]).view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_codes(data: bytes) -> bytes:
    """Eight bytes for each word of a text, a hash of the word."""
    start, end = word_places(data)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[np.frombuffer(data, np.uint8)] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)).tobytes()


def sequences(texts: list[str | None], kind: Strings) -> list[bytes]:
    data = encoded(texts)
    return [word_codes(d) for d in data] if kind.words else data


def anchors(docs: DataFrame, buckets: int, kind: Strings = BYTES) -> DataFrame:
    """Rows (chunk, bucket, docs, at, core, context): hashes of the stretches of some texts."""
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), count()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in chunks(texts, CHUNK_CHARS):
                found = [stretches(t, kind) for t in sequences(texts[a:b], kind)]
                sizes = np.array([len(f["core"]) for f in found], np.int64)
                if not sizes.sum():
                    continue
                core = np.concatenate([f["core"] for f in found])
                context = np.concatenate([f["context"] for f in found])
                docs_ = np.stack([ids[a:b], keys[a:b], sizes], 1).astype("<i8").tobytes()
                name = chunk_name(docs_, partition, next(number))
                home = (core >> shift).astype(np.int64)
                order = np.argsort(home, kind="stable")
                cut = np.searchsorted(home[order], np.arange(buckets + 1))
                rows = [(name, j, order[x:y].astype("<u4").tobytes(), core[order[x:y]].tobytes(),
                         context[order[x:y]].tobytes())
                        for j, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
                # One row of the chunk lists its documents.
                cols.append(pa.array([docs_] + [None] * (len(rows) - 1), pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    cols, ["chunk", "bucket", "at", "core", "context", "docs"])

    return docs.mapInArrow(
        run, "chunk binary, bucket long, at binary, core binary, context binary, docs binary")


def column(values) -> pd.Series:
    """Bytes or lists as they are, also where there are none: no other type is guessed."""
    return pd.Series(list(values), dtype=object)


def count_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Flags of each stretch: anchor repeated, first with its context, context repeated."""
    core = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["core"]])
    context = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["context"]])

    def repeated(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, back, n = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
        lead = np.zeros(len(x), bool)
        lead[first] = True
        return n[back] > 1, lead

    live, _ = repeated(core)
    many, lead = repeated(context)
    flags = np.where(live, LIVE + FIRST * lead + MANY * many, 0).astype(np.uint8)
    cut = np.cumsum([len(x) // 8 for x in pdf["core"]])[:-1]
    return pd.DataFrame({"chunk": pdf["chunk"], "at": pdf["at"], "docs": pdf["docs"],
                         "flags": column(f.tobytes() for f in np.split(flags, cut))})


def flags_by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    docs = next(d for d in pdf["docs"] if d is not None)
    ids, keys, sizes = np.frombuffer(docs, "<i8").reshape(-1, 3).T
    flags = np.zeros(int(sizes.sum()), np.uint8)
    for at, f in zip(pdf["at"], pdf["flags"]):
        flags[np.frombuffer(at, "<u4")] = np.frombuffer(f, np.uint8)
    parts = np.split(flags, np.cumsum(sizes)[:-1])
    keep = [i for i, p in enumerate(parts) if p.any()]
    return pd.DataFrame({"doc_id": ids[keep], "key": keys[keep],
                         "flags": column(parts[i].tobytes() for i in keep)})


def front_coded(rows: list[tuple[bytes, bytes, int, int]]) -> dict[str, bytes]:
    """A sorted run of (suffix, left, context hash, flags): shared prefixes are left out."""
    rows.sort()
    shared, before = [], b""
    for suffix, *_ in rows:
        shared.append(common(before, suffix, 0))
        before = suffix
    sizes = np.array([(h, len(r[0]) - h, len(r[1]), r[3]) for h, r in zip(shared, rows)], "<u4")
    return {"sizes": sizes.tobytes(), "hashes": np.array([r[2] for r in rows], np.uint64).tobytes(),
            "rest": b"".join(r[0][h:] for h, r in zip(shared, rows)),
            "left": b"".join(r[1] for r in rows)}


def decoded(sizes: bytes, hashes: bytes, rest: bytes, left: bytes
            ) -> Iterator[tuple[int, bytes, tuple[bytes, int, int]]]:
    """(shared prefix, suffix, payload) of a run, in order."""
    suffix, r, at = b"", 0, 0
    for (h, n, m, f), c in zip(np.frombuffer(sizes, "<u4").reshape(-1, 4).tolist(),
                               np.frombuffer(hashes, np.uint64).tolist()):
        suffix = suffix[:h] + rest[r:r + n]
        yield h, suffix, (left[at:at + m], c, f)
        r, at = r + n, at + m


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    end = min(len(a), len(b))
    while known < end:
        upto = min(known + 64, end)
        if a[known:upto] != b[known:upto]:
            while a[known] == b[known]:
                known += 1
            return known
        known = upto
    return end


class LoserTree:
    """Merge of sorted runs that keeps common prefixes.

    Each inner node holds the run that lost there and the length of the prefix its
    suffix shares with the winner's.  The next suffix of the run that won last knows
    its prefix shared with that winner from the front coding.  Of two contenders the
    one that shares more with the last winner is smaller; only if they share the
    same length are bytes compared, from there on.
    """

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.suffix: list[bytes | None] = [None] * self.size
        self.payload: list = [None] * self.size
        self.shared = [-1] * self.size
        self.loser = [0] * self.size
        for i in range(len(runs)):
            self._advance(i)
        winner = list(range(self.size))
        while len(winner) > 1:
            level = self.size // 2 if len(winner) == self.size else level // 2
            winner = [self._play(level + i // 2, winner[i], winner[i + 1])
                      for i in range(0, len(winner), 2)]
        self.top = winner[0]

    def _advance(self, i: int) -> None:
        self.shared[i], self.suffix[i], self.payload[i] = next(self.runs[i], (-1, None, None))

    def _play(self, node: int, a: int, b: int) -> int:
        x, y = self.shared[a], self.shared[b]
        if x == y and self.suffix[a] is not None and self.suffix[b] is not None:
            s, t = self.suffix[a], self.suffix[b]
            h = common(s, t, x)
            if s[h:h + 1] > t[h:h + 1]:
                a, b = b, a
            self.shared[b] = h
        elif x < y:
            a, b = b, a
        self.loser[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[int, bytes, tuple]]:
        while self.suffix[self.top] is not None:
            i = self.top
            yield self.shared[i], self.suffix[i], self.payload[i]
            self._advance(i)
            node, winner = (i + self.size) // 2, i
            while node:
                winner = self._play(node, winner, self.loser[node])
                node //= 2
            self.top = winner


def decide(members: list[tuple[int, bytes, tuple[bytes, int, int]]], kind: Strings = BYTES
           ) -> Iterator[tuple[int, list[int]]]:
    """(context hash, repeated windows as first and last in pairs) for a class in suffix order."""
    unit, length = kind.unit, kind.length * kind.unit
    hit = [set() for _ in members]
    reach = [(len(left), len(left) + len(suffix) - length) for _, suffix, (left, _, _) in members]
    for i, (_, _, (_, _, flags)) in enumerate(members):
        if flags & MANY:
            hit[i].update(range(0, reach[i][1] + 1, unit))
    if len(members) > 1:
        # ``o`` bytes of the window lie left of the anchor.
        low = min(r[0] - r[1] for r in reach)
        for o in range(low, max(r[0] for r in reach) + 1, unit):
            groups, group = defaultdict(list), 0
            for i, (shared, _, (left, _, _)) in enumerate(members):
                if i and shared < length - o:
                    group += 1
                if reach[i][0] - reach[i][1] <= o <= reach[i][0]:
                    groups[group, left[len(left) - o:]].append(i)
            for same in groups.values():
                if len(same) > 1:
                    for i in same:
                        hit[i].add(reach[i][0] - o)
    for (_, _, (_, name, _)), found in zip(members, hit):
        if found:
            p = np.array(sorted(found)) // unit
            cut = np.flatnonzero(np.diff(p) > 1)
            yield name, np.stack([p[np.append(0, cut + 1)], p[np.append(cut, len(p) - 1)]], 1).ravel().tolist()


def merge_bucket(pdf: pd.DataFrame, kind: Strings = BYTES) -> pd.DataFrame:
    runs = [decoded(*r) for r in pdf[["sizes", "hashes", "rest", "left"]].itertuples(index=False)]
    out, members = [], []
    for item in LoserTree(runs):
        if members and item[0] < kind.core * kind.unit:
            out.extend(decide(members, kind))
            members = []
        members.append(item)
    out.extend(decide(members, kind))
    names = np.array([o[0] for o in out], np.uint64).view(np.int64)
    return pd.DataFrame({"context": names, "windows": column(o[1] for o in out)})


def runs_of(rows: DataFrame, buckets: int, kind: Strings = BYTES) -> DataFrame:
    """Sorted runs by bucket, and the places of live contexts in each document."""
    shift = np.uint64(64 - (buckets - 1).bit_length())
    unit, length = kind.unit, kind.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts, flags = (c.to_pylist() for c in batch.columns)
            for a, b in chunks(texts, CHUNK_CHARS):
                held, places = defaultdict(list), []
                for doc, key, data, marks in zip(
                        ids[a:b], keys[a:b], sequences(texts[a:b], kind), flags[a:b]):
                    s = stretches(data, kind)
                    mark = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in marks])
                    live = np.flatnonzero(mark & LIVE)
                    places.append((doc, key, s["context"][live].view(np.int64).tolist(),
                                   s["first"][live].tolist()))
                    for i in np.flatnonzero(mark & FIRST):
                        x, y, z = int(s["first"][i]), int(s["last"][i]), int(s["anchor"][i])
                        held[int(s["core"][i] >> shift)].append(
                            (data[z * unit:(y + length) * unit], data[x * unit:z * unit],
                             int(s["context"][i]), int(mark[i])))
                coded = {j: front_coded(r) for j, r in held.items()}
                none = [None] * len(places)
                cols = {"doc_id": [None] * len(coded) + [p[0] for p in places],
                        "key": [None] * len(coded) + [p[1] for p in places],
                        "contexts": [None] * len(coded) + [p[2] for p in places],
                        "starts": [None] * len(coded) + [p[3] for p in places],
                        "bucket": [*coded, *none]}
                for n in ("sizes", "hashes", "rest", "left"):
                    cols[n] = [c[n] for c in coded.values()] + none
                yield pa.RecordBatch.from_pydict(cols, schema=pa.schema([
                    ("doc_id", pa.int64()), ("key", pa.int64()), ("contexts", pa.list_(pa.int64())),
                    ("starts", pa.list_(pa.int64())), ("bucket", pa.int64()), ("sizes", pa.binary()),
                    ("hashes", pa.binary()), ("rest", pa.binary()), ("left", pa.binary())]))

    return rows.mapInArrow(
        run, "doc_id long, key long, contexts array<long>, starts array<long>, bucket long, "
        "sizes binary, hashes binary, rest binary, left binary")


def repeated_spans(docs: DataFrame, kind: Strings = BYTES) -> DataFrame:
    """(doc_id, key, spans): ranges to remove, in bytes or words, as sorted (start, end) pairs.

    ``docs`` has doc_id, key (a hash of the text) and text.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1 << max(4, int(np.ceil(np.log2(max(chars / BUCKET_CHARS, 1)))))
    counted = anchors(docs, buckets, kind).groupBy("bucket").applyInPandas(
        count_bucket, "chunk binary, at binary, docs binary, flags binary")
    flags = counted.groupBy("chunk").applyInPandas(
        flags_by_document, "doc_id long, key long, flags binary")
    # Rows that repeat with the same id and text share one list of marks.
    flags = written(flags.groupBy("doc_id", "key").agg(F.collect_list("flags").alias("flags")), "anchors")
    rows = docs.join(flags, ["doc_id", "key"]).select("doc_id", "key", "text", "flags")
    found = written(runs_of(rows, buckets, kind), "suffix-runs")
    verdicts = found.where("bucket IS NOT NULL").select(
        "bucket", "sizes", "hashes", "rest", "left").groupBy("bucket").applyInPandas(
        lambda pdf: merge_bucket(pdf, kind), "context long, windows array<long>")
    verdicts = written(verdicts, "windows")
    places = found.where("bucket IS NULL").select(
        "doc_id", "key", F.explode(F.arrays_zip("contexts", "starts")).alias("p")).select(
        "doc_id", "key", F.col("p.contexts").alias("context"), F.col("p.starts").alias("start"))
    pairs = F.transform(
        F.sequence(F.lit(0), (F.size("windows") / 2 - 1).cast("int")), lambda i: F.struct(
            (F.col("start") + F.get("windows", 2 * i)).alias("a"),
            (F.col("start") + F.get("windows", 2 * i + 1) + kind.length).alias("b")))
    spans = places.join(verdicts, "context").select("doc_id", "key", F.explode(pairs).alias("s"))
    return spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def with_spans(docs: DataFrame, kind: Strings = BYTES) -> DataFrame:
    """The rows of ``docs`` with ``__suffix_text``, null as empty, and ``__suffix_spans``.

    Spans are null where nothing repeats.  Names that begin with ``__suffix_`` are
    reserved.
    """
    text, key, spans = "__suffix_text", "__suffix_key", "__suffix_spans"
    keyed = docs.withColumn(text, F.coalesce(F.col("text"), F.lit(""))).withColumn(key, F.xxhash64(text))
    narrow = keyed.where("doc_id IS NOT NULL").select(
        "doc_id", F.col(key).alias("key"), F.col(text).alias("text"))
    found = repeated_spans(narrow, kind).select(
        F.col("doc_id").alias("__suffix_doc"), F.col("key").alias("__suffix_of"),
        F.col("spans").alias(spans))
    same = (F.col("doc_id") == F.col("__suffix_doc")) & (F.col(key) == F.col("__suffix_of"))
    return keyed.join(found, same, "left").drop("__suffix_doc", "__suffix_of", key)


def cut(data: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed and number of maximal removed runs."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for s in spans or ():
        a, b = s["a"], s["b"]
        if a > end:
            runs += 1
        if a > at:
            kept.append(data[at:a])
        removed += max(0, b - max(a, at))
        at, end = max(at, b), max(end, b)
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def cleaned(docs: DataFrame, words: int = 50, core: int = 12) -> DataFrame:
    """``docs`` without passages of ``words`` words that stand anywhere else as well.

    Every word of such a passage goes, in each of its places, with the white space
    between; words are compared as they are, the white space is not.  Overlapping
    passages go together.  Rows left without a word go too.  ``n_chars``, if there is
    such a column, is counted anew.
    """
    names, kind = docs.columns, Strings(words, core, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            texts = []
            for data, spans in zip(encoded(cols["text"].to_pylist()), cols["__suffix_spans"].to_pylist()):
                if spans:
                    start, end = word_places(data)
                    data = cut(data, [{"a": int(start[s["a"]]), "b": int(end[s["b"] - 1])} for s in spans])[0]
                texts.append(data.decode("utf-8", "ignore"))
            keep = pa.array([bool(t.strip()) for t in texts])
            cols["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names).filter(keep)

    rows = with_spans(docs, kind).select(*names, "__suffix_spans")
    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row.

    Null text counts as empty; rows that repeat are judged each and remove each
    other; rows without doc_id keep their text and are not compared; texts below
    400 bytes are kept whole; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = (c.to_pylist() for c in batch.columns)
            out = []
            for t, s in zip(encoded(texts), spans):
                kept, removed, n = cut(t, s)
                out.append((len(t), removed, n, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *[pa.array([o[i] for o in out], pa.int64()) for i in range(3)],
                 pa.array([o[3] for o in out], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs.select("doc_id", "text")).select(
        "doc_id", "__suffix_text", "__suffix_spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
