"""Alignment of the tokens of two vocabularies over the same texts.

Both vocabularies begin a token at a single space between two other characters, so a
text falls into units (a space, a word and what white space follows) whose tokens do
not depend on the rest.  A unit is encoded and aligned once per worker:

1.  Token lists are flattened with their parent indices; token lengths are looked up
    and summed within each unit, which gives the byte each token ends at.
2.  An Acero hash join on (unit, end) brings the ends of both vocabularies together.
    Ends of both close a group.  Between two neighbouring ends lies one token of each
    vocabulary, and each pair of tokens that overlaps meets in one such place: after
    filling the missing side backward, the joined rows are the links.
3.  The id pairs of a chunk of texts are counted by ``Table.group_by``; Spark adds the
    counts up, finds the highest count of each id of the second vocabulary, and sends
    both back to the chunks, which never hold more than their own texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import written
from newsloom.llm.units import UnitEncoder, list_of, runs, units_of

CHUNK_CHARS = 1 << 20
#: Units kept by a worker; later ones are aligned each time they occur.
KEPT_UNITS = 200_000
SHIFT = 32

ALIGNED = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
           "n_links array<long>, sha array<string>, n_units array<long>, units binary, "
           "unit_links binary, link_pairs binary, a array<int>, b array<int>, n array<long>")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
          "count_sum long, groups_sha256 string")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteVocabulary:
    """The first vocabulary: byte-level; encodes a space and the text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        self.encoder = UnitEncoder(model)
        self.bytes = self.encoder.bytes

    def encode(self, keys: list[str]) -> pa.ListArray:
        ids, sizes = self.encoder.encode(keys)
        return list_of(sizes, pa.array(ids))


class PieceVocabulary:
    """The second vocabulary: pieces with byte fallback; puts the space there itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        self.bytes = pa.array([
            b"" if self.model.is_control(i) else
            bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else
            p.replace("▁", " ").encode() for i, p in (
                (i, self.model.id_to_piece(i)) for i in range(size))], pa.binary())

    def encode(self, keys: list[str]) -> pa.ListArray:
        ids = self.model.encode(keys, num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return list_of(sizes, pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))))


def ends(lists: pa.ListArray, token_bytes: pa.Array, side: str) -> pa.Table:
    """unit, end and number of each token; ends count bytes from the start of the unit."""
    parent = pc.list_parent_indices(lists)
    size = pc.cast(pc.binary_length(pc.take(token_bytes, pc.list_flatten(lists))), pa.int64())
    total = pc.cumulative_sum(size)
    before = pc.subtract(total, size)
    first = np.minimum(lists.offsets.to_numpy()[:-1], max(len(size) - 1, 0))
    base = pc.take(before, pa.array(first)) if len(size) else pa.array([], pa.int64())
    end = pc.subtract(total, pc.take(base, parent))
    return pa.table({"unit": parent, "end": end, side: pa.array(np.arange(len(size)))})


def joined_bytes(lists: pa.ListArray, token_bytes: pa.Array) -> pa.Array:
    values = pc.take(token_bytes, pc.list_flatten(lists))
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, values), b"")


class Aligned:
    """Aligned units: figures of each, its groups as text, and its links as id pairs."""

    def __init__(self, size: int = 0):
        self.ok = np.zeros(size, bool)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(size, np.int64) for _ in range(4))
        self.groups = pa.array([""] * size, pa.string())
        self.links = np.zeros(0, np.int64)

    def extended(self, other: Aligned) -> Aligned:
        out = Aligned()
        for name in ("ok", "n_a", "n_b", "n_groups", "n_links", "links"):
            setattr(out, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        out.groups = pa.concat_arrays([self.groups, other.groups])
        return out


def align(keys: list[str], one: ByteVocabulary, two: PieceVocabulary) -> Aligned:
    """Tokens, groups and links of units, given without their first space.

    A unit whose tokens do not add up to its bytes in both vocabularies is not ``ok``.
    """
    out = Aligned(len(keys))
    a_ids, b_ids = one.encode(keys), two.encode(keys)
    own = pa.array([b" " + k.encode("utf-8", "surrogatepass") for k in keys], pa.binary())
    good = pc.and_(pc.equal(joined_bytes(a_ids, one.bytes), own),
                   pc.equal(joined_bytes(b_ids, two.bytes), own))
    out.ok = good.to_numpy(zero_copy_only=False)
    a_ids, b_ids = a_ids.filter(good), b_ids.filter(good)
    places = np.flatnonzero(out.ok)
    if not len(places):
        return out
    flat_a, flat_b = pc.list_flatten(a_ids), pc.list_flatten(b_ids)
    both = ends(a_ids, one.bytes, "a").join(
        ends(b_ids, two.bytes, "b"), ["unit", "end"], join_type="full outer", use_threads=False)
    both = both.sort_by([("unit", "ascending"), ("end", "ascending")]).combine_chunks()
    a, b, unit = (both.column(n).combine_chunks() for n in ("a", "b", "unit"))
    close = pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
    group = np.cumsum(close) - close
    unit = unit.to_numpy()
    n_groups = np.bincount(unit[close], minlength=len(places))
    id_a, id_b = (pc.take(f, pc.fill_null_backward(x)).to_numpy() for f, x in ((flat_a, a), (flat_b, b)))
    total = int(close.sum())

    def members(flat: pa.Array, side: pa.Array) -> pa.Array:
        mine = group[side.is_valid().to_numpy(zero_copy_only=False)]
        return pc.binary_join(list_of(np.bincount(mine, minlength=total), pc.cast(flat, pa.string())), ",")

    spelled = pc.binary_join_element_wise(members(flat_a, a), members(flat_b, b), "|")
    spelled = pc.binary_join(list_of(n_groups, spelled), ";")
    out.n_a[places] = pc.list_value_length(a_ids).to_numpy()
    out.n_b[places] = pc.list_value_length(b_ids).to_numpy()
    out.n_groups[places] = n_groups
    out.n_links[places] = np.bincount(unit, minlength=len(places))
    number = np.full(len(keys), -1)
    number[places] = np.arange(len(places))
    filled = pc.take(spelled, pa.array(number, mask=number < 0))
    out.groups = pc.fill_null(filled, "")
    out.links = (id_a.astype(np.int64) << SHIFT) | id_b
    return out


class UnitCache:
    """Aligned units of a worker, found by their text."""

    def __init__(self, vocabularies: tuple[str, str], limit: int = KEPT_UNITS):
        self.one, self.two = ByteVocabulary(vocabularies[0]), PieceVocabulary(vocabularies[1])
        self.limit, self.number, self.held = limit, {}, Aligned()

    def find(self, keys: list[str]) -> tuple[np.ndarray, Aligned]:
        """Place of each key, and the aligned units the places refer to."""
        new = [k for k in keys if k not in self.number]
        base, held = len(self.held.ok), self.held
        if new:
            held = held.extended(align(new, self.one, self.two))
        fresh = dict(zip(new, range(base, base + len(new))))
        at = np.fromiter((self.number[k] if k in self.number else fresh[k] for k in keys),
                         np.int64, len(keys))
        if len(held.ok) <= self.limit:
            self.held = held
            self.number |= fresh
        return at, held


_CACHES: dict[tuple[str, str], UnitCache] = {}


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum over each run of ``sizes`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    return total[edge[1:]] - total[edge[:-1]]


def packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.astype("<i4").tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * size, "zstd", asbytes=True), "<i4")


def aligned_chunk(texts: pa.Array, cache: UnitCache) -> dict:
    """Columns of ALIGNED for some texts."""
    lists = units_of(texts)
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    local = coded.indices.to_numpy().astype(np.int64)
    at, held = cache.find(coded.dictionary.to_pylist())
    whole = (sums(~held.ok[at][local], sizes) == 0) & (sizes > 0)
    local = local[np.repeat(whole, sizes)]
    sizes = np.where(whole, sizes, 0)
    figure = {n: sums(getattr(held, n)[at][local], sizes) for n in ("n_a", "n_b", "n_groups", "n_links")}
    spelled = pc.binary_join(list_of(sizes, pc.take(held.groups, pa.array(at[local]))), ";")
    sha = [hashlib.sha256(s.as_py().encode()).hexdigest() if w else ""
           for s, w in zip(spelled, whole)]
    # Links of the units that occur, and how often each unit does.
    often = np.bincount(local, minlength=len(at))
    links = np.where(often > 0, held.n_links[at], 0)
    first = (np.cumsum(held.n_links) - held.n_links)[at]
    index = np.arange(int(links.sum())) + np.repeat(first - (np.cumsum(links) - links), links)
    pairs = pc.dictionary_encode(pa.array(held.links[index], pa.int64()))
    counted = pa.table({"pair": pairs.indices, "n": pa.array(np.repeat(often, links))}).group_by(
        "pair", use_threads=False).aggregate([("n", "sum")]).sort_by("pair")
    code = pairs.dictionary.to_numpy()
    return figure | {
        "sha": sha, "n_units": sizes, "units": packed(local),
        "unit_links": links.astype("<i4").tobytes(),
        "link_pairs": packed(pairs.indices.to_numpy()),
        "a": (code >> SHIFT).astype(np.int32), "b": (code & ((1 << SHIFT) - 1)).astype(np.int32),
        "n": counted.column("n_sum").to_numpy(),
    }


def aligned(docs: DataFrame, vocabularies: tuple[str, str]) -> DataFrame:
    """One row of ALIGNED per chunk of whole texts of (doc_id, text)."""
    kinds = {"chunk": pa.int64(), "sha": pa.list_(pa.string()), "a": pa.list_(pa.int32()),
             "b": pa.list_(pa.int32())} | {
        n: pa.binary() for n in ("units", "unit_links", "link_pairs")}
    names = [f.split()[0] for f in ALIGNED.split(", ")]
    schema = pa.schema([(n, kinds.get(n, pa.list_(pa.int64()))) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabularies not in _CACHES:
            _CACHES[vocabularies] = UnitCache(vocabularies)
        cache, chunk = _CACHES[vocabularies], TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lengths = pc.utf8_length(texts).to_numpy()
            for x, y in runs(lengths, CHUNK_CHARS):
                row = aligned_chunk(texts.slice(x, y - x), cache) | {
                    "chunk": chunk, "doc_id": ids.slice(x, y - x).to_pylist()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[f.name]], f.type) for f in schema], schema=schema)
                chunk += 1

    return docs.mapInArrow(run, ALIGNED)


def judged_chunk(chunk: pa.Table, pairs: pa.Table) -> pa.Table:
    """Rows of RESULT of a chunk, given count and rank of its pairs."""
    row = chunk.to_pylist()[0]
    pairs = pairs.sort_by("at")
    links = np.frombuffer(row["unit_links"], "<i4")
    units = unpacked(row["units"], sum(row["n_units"]))
    number = unpacked(row["link_pairs"], int(links.sum()))
    best = pairs.column("best").to_numpy().astype(np.int64)
    count = pairs.column("count").to_numpy()
    sizes = np.array(row["n_units"], np.int64)
    per_unit = [sums(v[number], links) for v in (best, count)]
    n_best, count_sum = (sums(v[units], sizes) for v in per_unit)
    return pa.table({
        "doc_id": pa.array(row["doc_id"], pa.int64()),
        **{n: pa.array(row[n], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")},
        "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()),
        "groups_sha256": pa.array(row["sha"], pa.string()),
    })


def cross_align(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    Null and empty texts, and texts that one of the vocabularies does not give back
    byte by byte, have no tokens: zeros and ''.  Strings of special tokens are plain
    text.  Repeated rows count each, rows without doc_id take part, extra columns are
    ignored.  ``vocabularies`` are paths that executors can read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = written(aligned(rows, vocabularies or default_vocabularies()), "aligned")
    pairs = held.select("chunk", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p")).select(
        "chunk", "at", "p.a", "p.b", "p.n")
    counts = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    verdict = counts.join(highest, "b").select(
        "a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = pairs.join(verdict, ["a", "b"]).select(F.col("chunk").alias("home"), "at", "count", "best")
    own = held.drop("a", "b", "n")
    return own.groupBy("chunk").cogroup(back.groupBy("home")).applyInArrow(judged_chunk, RESULT)
