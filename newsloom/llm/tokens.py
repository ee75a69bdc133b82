"""Token ids as parquet list columns, laid out for selective reads."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.shingles import mix
from newsloom.llm.suffixes import powers
from newsloom.llm.units import SLICE, PieceEncoder, pieces_of, runs, string_data, units_of
from newsloom.session import work_dir

END = 0
#: Text encoded together.
CHUNK_CHARS = 1 << 22
FILE_SCHEMA = "doc_id long, start_in_file long, n_tokens long, ids array<int>"

#: Ids as dictionary indices, counts and positions as deltas; small pages with an
#: index each, so that a reader fetches the pages of the rows and columns it asks for.
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_file": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_CACHES: dict[str, WordCache] = {}


def key_hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    found = [np.zeros(0, np.uint64)]
    for i in range(0, len(keys), SLICE):
        edges, data = string_data(keys.slice(i, SLICE))
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mix(np.frombuffer(data, np.uint8) + np.uint64(1)) * up[:len(data)], out=total[1:])
        found.append(mix((total[edges[1:]] - total[edges[:-1]]) * down[edges[:-1]]))
    return np.concatenate(found)


def gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` that begin at ``starts``, one after the other."""
    index = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
    index += np.arange(len(index), dtype=np.int32)
    return ids[index]


class WordCache:
    """Ids of texts by way of their pieces, each of which is encoded once.

    The units of a chunk are split and told apart by Arrow, the different ones are cut into
    pieces, and those are looked up in a sorted table of hashes and compared as strings;
    only pieces not held yet are encoded.  The first ``limit`` of all are kept, later ones
    encoded each time.  A key is a piece less the space it begins with, or a piece that
    begins with none, after a space; both cannot meet, as no unit begins with two.
    """

    def __init__(self, tokenizer, limit: int = 1_000_000):
        self.encoder = PieceEncoder(tokenizer)
        self.kinds = self.encoder.kinds
        self.limit = limit
        self.keys = pa.array([], pa.string())
        self.ids, self.starts, self.sizes = (np.zeros(0, t) for t in (np.int32, np.int32, np.int32))
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different keys, one after the other, and how many each has."""
        hashes = key_hashes(keys)
        at = np.searchsorted(self.hashes, hashes)
        held = at < len(self.hashes)
        held[held] = self.hashes[at[held]] == hashes[held]
        taken = held.copy()  # hashes held, be it by another key
        place = self.places[at[held]]
        same = pc.equal(self.keys.take(pa.array(place)), keys.filter(pa.array(held)))
        same = same.to_numpy(zero_copy_only=False)
        held[held] = same
        starts, sizes = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        starts[held], sizes[held] = self.starts[place[same]], self.sizes[place[same]]
        if held.all():
            return gather(self.ids, starts, sizes), sizes
        new, missing = keys.filter(pa.array(~held)), np.flatnonzero(~held)
        bare = pc.starts_with(new, " ")
        parts = [self.encoder.encode(new.filter(pc.invert(bare)), True),
                 self.encoder.encode(pc.utf8_slice_codeunits(new.filter(bare), 1), False)]
        late = bare.to_numpy(zero_copy_only=False)
        missing = np.concatenate([missing[~late], missing[late]])
        n = np.concatenate([p[1] for p in parts])
        starts[missing], sizes[missing] = len(self.ids) + np.cumsum(n) - n, n
        ids = np.concatenate([self.ids, *[p[0] for p in parts]])
        kept = missing[~taken[missing]][:max(self.limit - len(self.keys), 0)]
        if len(kept):
            self._keep(keys.take(pa.array(kept)), hashes[kept], starts[kept], sizes[kept], ids)
        return gather(ids, starts, sizes), sizes

    def _keep(self, keys: pa.Array, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
              ids: np.ndarray) -> None:
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.places = np.insert(self.places, at, (len(self.keys) + order).astype(np.int32))
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.starts = np.concatenate([self.starts, starts.astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.keys = pa.concat_arrays([self.keys, keys])
        self.ids = ids

    def unit_ids(self, units: pa.Array, spaced: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, of which the first ``spaced`` come after a space, and their numbers."""
        counts, pieces, _ = pieces_of(units, self.kinds)
        edges = np.concatenate([[0], np.cumsum(counts)])
        bare = np.ones(len(pieces), bool)
        bare[edges[:spaced]] = False
        after, alone = (pc.dictionary_encode(pieces.filter(pa.array(b))) for b in (~bare, bare))
        ids, n = self.find(pa.concat_arrays([
            after.dictionary, pc.binary_join_element_wise("", alone.dictionary, " ")]))
        which = np.empty(len(pieces), np.int64)
        which[~bare] = after.indices.to_numpy()
        which[bare] = alone.indices.to_numpy() + len(after.dictionary)
        sizes = n[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return gather(ids, (np.cumsum(n) - n)[which], sizes), np.diff(total[edges])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        lists = units_of(texts)
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        keys = pc.list_flatten(lists)
        leads = np.zeros(len(keys), bool)
        leads[(np.cumsum(counts) - counts)[counts > 0]] = True
        later = pc.dictionary_encode(keys.filter(pa.array(~leads)))
        different = pa.concat_arrays([later.dictionary, keys.filter(pa.array(leads))])
        ids, n = self.unit_ids(different, len(later.dictionary))
        at = np.empty(len(keys), np.int64)
        at[~leads] = later.indices.to_numpy()
        at[leads] = np.arange(len(later.dictionary), len(different))
        sizes = n[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return gather(ids, (np.cumsum(n) - n)[at], sizes), np.diff(total[edges])


def encoder(vocabulary: str | None, end: int = END):
    """A function for ``mapInArrow``: (doc_id, text) to the rows of FILE_SCHEMA."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary or default_vocabulary()
        if path not in _CACHES:  # one for all tasks of a worker
            _CACHES[path] = WordCache(Tokenizer.from_file(path))
        cache = _CACHES[path]
        start = 0
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for a, b in runs(pc.utf8_length(texts).to_numpy(), CHUNK_CHARS):
                ids, sizes = cache.encode(texts.slice(a, b - a))
                ids = np.insert(ids, np.cumsum(sizes), end)
                sizes = sizes + 1
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([
                    docs.slice(a, b - a), pa.array(start + offsets[:-1]), pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ], ["doc_id", "start_in_file", "n_tokens", "ids"])
                start += int(offsets[-1])

    return encode


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Encodes every text and writes it in ascending doc_id order.

    Texts are dealt by ranges of doc_id (and a hash of the text, so that one id with
    very many rows is split), sorted, encoded where they lie and written: the order
    of the files is the order of the ranges.  Null text is an empty document and
    holds the end id only.  Repeated rows are written each; extra columns are not.
    ``vocabulary`` is a path that executors can read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    coded = rows.select("doc_id", "text").mapInArrow(encoder(vocabulary, end), FILE_SCHEMA)
    coded.write.options(**WRITER).parquet(path)


def _placed(spark: SparkSession, path: str, columns: list[str], derive=None) -> DataFrame:
    """Rows of the files with ``start``; ``derive`` works on each row where it is read."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path).select(
        "*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("file").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before.alias("before"))
    rows = derive(rows) if derive else rows
    return rows.join(files, "file").select(
        "doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", *columns)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids; unused columns are never fetched.

    ``start`` counts the ids of all documents before this one.  Files only know it
    within themselves; the ids of the files before are summed over one row a file.
    """
    return _placed(spark, path, ["ids"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(4)
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        at = ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())],
                                         ["file", "doc_id", "start_in_file", "n_tokens", "ids_crc32"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what the files hold.

    Sums are taken where the ids are read; what is joined and shuffled has no ids.
    """
    spec = "file string, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"
    return _placed(spark, path, ["ids_crc32"], lambda rows: rows.select(
        "file", "doc_id", "start_in_file", "n_tokens", "ids").mapInArrow(_checked, spec))


def encode_and_check(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    path = work_dir(docs.sparkSession, "tokens")
    write(docs, path, vocabulary)
    return checksums(docs.sparkSession, path)
