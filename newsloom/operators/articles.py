"""Article views: topic tags, derived dates, feed filters, listings, look-ups."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed
from newsloom.functions import dates, text as tx
from newsloom.sources.tables import kept

# Workers get the task function by value and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Rules = list[tuple[str, list[str]]]


def topic_case(content: Column, rules: Rules = fixed.TOPIC_RULES,
               default: str = fixed.TOPIC_DEFAULT) -> Column:
    """First topic, in rule order, with any keyword as a substring of ``content``.

    One ordered CASE over literal ``contains`` tests: no join, no Python, and the
    first hit ends the evaluation.  The content is bound, so it is built once per
    row even where the optimizer copies the tag into a pushed-down filter.
    """
    def choose(text: Column) -> Column:
        expr = F.lit(default)
        for topic, words in reversed(rules):
            expr = F.when(tx.contains_any(text, words), topic).otherwise(expr)
        return expr

    return tx.bind(content, choose)


def _content() -> Column:
    return F.lower(F.concat(
        F.coalesce("titulo", F.lit("")), F.lit(" "), F.coalesce("texto", F.lit(""))
    ))


def tag_topics(articles: DataFrame, rules: Rules = fixed.TOPIC_RULES,
               default: str = fixed.TOPIC_DEFAULT, out: str = "topico") -> DataFrame:
    return articles.withColumn(out, topic_case(_content(), rules, default))


# Keywords go by size classes: their length in bytes below EXACT, from there the powers of
# two.  A keyword lies in the index under one window of its class's size, told by a hash
# (its anchor); a text that holds the keyword holds the window, and less than the class's
# size of the keyword stands on either side of it.
SMALL_INDEX = 8 << 20  # bytes of index rows that may be broadcast
EXACT = 16
WINDOW_BYTES = 1 << 18  # text whose windows a task holds at a time
PART_BYTES = 1 << 24  # parts that a task makes at a time
# Anchors of the index are marked in a table of bits, in blocks by bits of the anchor.
BLOCK_BITS = 15
MARK_BITS = 28  # of a class's table at most, as the power of two
FLAT_BITS = 24  # up to here a task holds the table as bytes too
MARKS_PER_ANCHOR = 24
BASE = 0x9E3779B97F4A7C15
PROBES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers)


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)
    for shift, factor in zip((30, 27, 31), (*PROBES[:2], 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def _places(anchors: np.ndarray, bits: int, probe: int | None = None) -> np.ndarray:
    """Where anchors are marked in a table of 2 ** ``bits`` bits: first, or by a factor of PROBES."""
    first = (anchors.astype(np.uint32) >> np.uint32(32 - bits)).astype(np.int64)
    if probe is None:
        return first
    inside = (anchors * np.uint64(probe)) >> np.uint64(64 - BLOCK_BITS)
    return (first >> BLOCK_BITS << BLOCK_BITS) | inside.view(np.int64)


def _held(marks: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.flatnonzero((marks[places >> 3] >> (places & 7).astype(np.uint8)) & np.uint8(1))


def mark_tables(index: DataFrame, rows: dict[int, int]) -> dict[int, np.ndarray]:
    """By size class, the bits of the anchors of an index that has so many ``rows`` in each.

    They are made in tasks; the driver sees 2 ** MARK_BITS bits of a class at most.
    """
    bits = {n: min(max((r * MARKS_PER_ANCHOR).bit_length(), BLOCK_BITS), MARK_BITS) for n, r in rows.items()}

    def block_of(group: pa.Table) -> pa.Table:
        anchors, size = group["anchor"].to_numpy().view(np.uint64), group["size"][0].as_py()
        block = np.zeros(1 << BLOCK_BITS, bool)
        for probe in (None, *PROBES):
            block[_places(anchors, bits[size], probe) & ((1 << BLOCK_BITS) - 1)] = True
        return group.select(["size", "block"]).slice(0, 1).append_column(
            "bits", pa.array([np.packbits(block, bitorder="little").tobytes()], pa.binary()))

    low, block = F.col("anchor").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0).cast("long")
    for n, b in bits.items():
        if b > BLOCK_BITS:
            block = F.when(F.col("size") == n, F.shiftrightunsigned(low, 32 - b + BLOCK_BITS)).otherwise(block)
    made = index.select("size", block.alias("block"), "anchor").groupBy("size", "block").applyInArrow(
        block_of, "size int, block long, bits binary")
    tables = {n: np.zeros(1 << (b - 3), np.uint8) for n, b in bits.items()}
    for r in made.collect():
        tables[r.size][r.block << (BLOCK_BITS - 3):][:len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return tables


class _Marks:
    """One class's table of marks, and its first marks as bytes if that is small."""

    def __init__(self, marks: np.ndarray):
        self.marks, self.bits = marks, len(marks).bit_length() + 2
        self.flat = np.unpackbits(marks, bitorder="little").view(bool) if self.bits <= FLAT_BITS else None

    def met(self, sums: np.ndarray, low: np.ndarray, down: np.ndarray, low_down: np.ndarray,
            size: int) -> np.ndarray:
        """Positions of the windows of ``size`` whose anchors may be marked."""
        first = low[size:] - low[:-size]
        first *= low_down[:len(first)]
        first >>= np.uint32(32 - self.bits)
        at = _held(self.marks, first) if self.flat is None else np.flatnonzero(self.flat.take(first, mode="clip"))
        for probe in PROBES:
            anchors = (sums[at + size] - sums[at]) * down[at]
            at = at[_held(self.marks, _places(anchors, self.bits, probe))]
        return at


def _cut(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """``data[first:last]`` for many bounds."""
    ends = np.append(0, np.cumsum(last - first))
    bytes_ = data[np.arange(ends[-1]) + np.repeat(first - ends[:-1], last - first)]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(bytes_)]).cast(pa.binary())


def _bounds(lengths: np.ndarray, room: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that come to about ``room`` bytes."""
    group = (np.cumsum(lengths) - lengths) // room
    return pairwise([0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)])


def _merged(of: np.ndarray, anchors: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parts of one text under one anchor made one where they overlap."""
    order = np.lexsort((first, anchors, of))
    of, anchors, first, last = of[order], anchors[order], first[order], last[order]
    new = np.append(True, (of[1:] != of[:-1]) | (anchors[1:] != anchors[:-1]) | (first[1:] > last[:-1]))[:len(of)]
    end = np.append(new[1:], True)[:len(of)]
    return of[new], anchors[new], first[new], last[end]


def _anchors(batches: Iterator[pa.RecordBatch], sizes: list[int] | None,
             marks: dict[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """(n, size, anchor, part) of (n, size, bytes).

    With ``sizes``: each text's windows of those sizes, less those ``marks`` cannot hold;
    part is as much of the text as a keyword under the window can take up there, overlapping
    parts under one anchor taken together.  Without:
    the first, middle and last window of each row's own size, and no part.
    """
    values = _byte_values()
    tables = {size: _Marks(table) for size, table in (marks or {}).items()}
    up = down = np.empty(0, np.uint64)
    for batch in batches:
        keys, own, texts = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
        lengths = pc.binary_length(texts).to_numpy().astype(np.int64)
        for lo, hi in _bounds(lengths, WINDOW_BYTES):
            data = np.frombuffer(b"".join(texts.slice(lo, hi - lo).to_pylist()), np.uint8)
            starts = np.cumsum(lengths[lo:hi]) - lengths[lo:hi]
            stops = starts + lengths[lo:hi]
            if len(up) <= len(data):
                up, down = _powers(BASE, len(data) + 1), _powers(pow(BASE, -1, 1 << 64), len(data) + 1)
                low_down = down.astype(np.uint32)
            # The hash of a window is the sum over its bytes, moved to the front of the data.
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values.take(data) * up[:len(data)], out=sums[1:])
            if sizes is None:
                size = own[lo:hi].astype(np.int64)
                spare = lengths[lo:hi] - size
                rows = np.tile(np.arange(hi - lo), 3)
                at = np.concatenate([starts, starts + spare // 2, starts + spare])
                new = np.concatenate([spare >= 0, spare > 1, spare > 0])
                rows, at = rows[new], at[new]
                anchors = (sums[at + size[rows]] - sums[at]) * down[at]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows + lo)), pa.array(size[rows].astype(np.int32)),
                     pa.array(anchors.view(np.int64)), pa.nulls(len(rows), pa.binary())],
                    ["n", "size", "anchor", "part"])
                continue
            low, found = sums.astype(np.uint32), []
            for size in sizes:
                if size == 0:  # the empty keyword, which every text holds
                    found.append((np.arange(hi - lo), np.zeros(hi - lo, np.int32), np.zeros(hi - lo, np.uint64),
                                  starts, starts))
                elif len(data) >= size:
                    at = (tables[size].met(sums, low, down, low_down, size) if size in tables
                          else np.arange(len(data) - size + 1))
                    of, aside = np.searchsorted(stops, at, "right"), 0 if size < EXACT else size - 1
                    whole = at + size <= stops[of]  # windows do not cross texts
                    at, of = at[whole], of[whole]
                    anchors = (sums[at + size] - sums[at]) * down[at]
                    first, last = np.maximum(at - aside, starts[of]), np.minimum(at + size + aside, stops[of])
                    if aside:
                        of, anchors, first, last = _merged(of, anchors, first, last)
                    found.append((of, np.full(len(of), size, np.int32), anchors, first, last))
            if not found:
                continue
            rows, size, anchors, first, last = (np.concatenate(x) for x in zip(*found))
            for a, b in _bounds(last - first, PART_BYTES):
                hits = pa.table({
                    "row": rows[a:b], "size": size[a:b], "anchor": anchors[a:b].view(np.int64),
                    "part": _cut(data, first[a:b], last[a:b]),
                }).group_by(["row", "size", "anchor", "part"], use_threads=False).aggregate([])
                for hit in hits.to_batches():
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pc.add(hit["row"], lo)), hit["size"], hit["anchor"], hit["part"]],
                        ["n", "size", "anchor", "part"])


def _with_anchors(rows: DataFrame, sizes: list[int] | None = None,
                  marks: dict[int, np.ndarray] | None = None) -> DataFrame:
    """``rows`` (n, size, bytes) to (n, size, anchor, part), see ``_anchors``."""
    key = rows.schema["n"].dataType.simpleString()
    return rows.mapInArrow(
        lambda batches: _anchors(batches, sizes, marks), f"n {key}, size int, anchor long, part binary")


def keyword_index(rules: DataFrame) -> DataFrame:
    """(size, anchor, priority, topic, keyword): each keyword once, with the rule that
    comes first of those that have it, under the one of its windows that fewest keywords have."""
    words = rules.select("priority", "topic", F.explode("keywords").alias("keyword")).filter(
        F.col("keyword").isNotNull())
    long = F.octet_length("keyword")
    # From EXACT bytes on the greatest power of two that is not above the length.
    size = F.when(long < EXACT, long).otherwise(
        F.call_function("shiftleft", F.lit(1), F.length(F.bin(long)) - 1))
    first = kept(words.groupBy("keyword").agg(F.min(F.struct("priority", "topic")).alias("rule")).select(
        F.monotonically_increasing_id().alias("n"), size.cast("int").alias("size"), "keyword", "rule"), "words")
    anchors = _with_anchors(first.select("n", "size", F.encode("keyword", "UTF-8"))).drop("part")
    often = anchors.groupBy("size", "anchor").agg(F.count("*").alias("often"))
    under = anchors.join(often, ["size", "anchor"]).groupBy("n").agg(
        F.min_by("anchor", F.struct("often", "anchor")).alias("anchor"))
    return first.join(under, "n").select("size", "anchor", "rule.priority", "rule.topic", "keyword")


def tag_topics_from_table(articles: DataFrame, rules: DataFrame,
                          default: str = fixed.TOPIC_DEFAULT, out: str = "topico",
                          key: str = "id", room: int = SMALL_INDEX) -> DataFrame:
    """Same tagger with the rules in a table (priority, topic, keywords) of any size.

    A task cuts from its texts the parts around windows that the keyword index may hold
    (told by a bounded table of marks).  Parts meet the index on the window, are tested
    for containment there, and the hit of least priority wins.  Texts do not move, and an
    article is told by its ``key`` and a hash of its text, as keys may repeat.  Size
    classes of few keywords are broadcast.
    """
    index = kept(keyword_index(rules), "keywords")
    held = index.groupBy("size").agg(F.count("*").alias("n"), F.sum(
        F.octet_length("keyword") + F.octet_length(F.coalesce("topic", F.lit(""))) + 64).alias("held")).collect()
    small, large = [], []
    for r in sorted(held, key=lambda r: (r.held, r.size)):  # a row per size class
        room -= r.held
        (small if room >= 0 else large).append(r.size)
    marks = mark_tables(index, {r.size: r.n for r in held})
    mark = F.xxhash64(F.coalesce("titulo", F.lit("")), F.coalesce("texto", F.lit("")))
    parts = kept(_with_anchors(articles.select(
        F.struct(F.col(key).alias("id"), mark.alias("mark")).alias("n"), F.lit(0).alias("size"),
        F.encode(_content(), "UTF-8").alias("bytes")), sorted(small + large), marks), "parts")

    def met(sizes: list[int], hint=lambda side: side) -> DataFrame:
        few = F.col("size").isin(sizes)
        return parts.filter(few).join(hint(index.filter(few)), ["size", "anchor"]).filter(
            F.contains("part", F.encode("keyword", "UTF-8"))).select("n", "priority", "topic")

    hits = met(small, F.broadcast).unionByName(met(large)) if large else met(small, F.broadcast)
    best = hits.groupBy("n").agg(F.min(F.struct("priority", "topic")).alias("_regla")).select(
        F.col("n.id").alias("_de"), F.col("n.mark").alias("_huella"), "_regla")
    # A column of its own, as a join would move the columns its keys are made from.
    joined = articles.withColumn("_marca", mark).join(
        best, (F.col(key) == F.col("_de")) & (F.col("_marca") == F.col("_huella")), "left")
    return joined.withColumn(out, F.coalesce("_regla.topic", F.lit(default))).drop(
        "_marca", "_de", "_huella", "_regla")


def enrich(articles: DataFrame, rules: Rules = fixed.TOPIC_RULES,
           default_topic: str = fixed.TOPIC_DEFAULT) -> DataFrame:
    """Articles plus ``fecha_final``, ``fecha_str`` and ``topico``, gaps filled."""
    dated = articles.withColumn(
        "fecha_final", dates.final_date(F.col("fecha_pub"), F.col("fecha_scrape"))
    ).withColumn("fecha_str", dates.day_text(F.col("fecha_final")))
    return tag_topics(dated, rules, default_topic).na.fill(fixed.MISSING_DEFAULTS)


def newest_first(enriched: DataFrame) -> DataFrame:
    return enriched.orderBy(F.desc_nulls_last("fecha_final"), F.asc("id"))


def feed_condition(fuente: str = fixed.ALL_SOURCES, topico: str = fixed.ALL_TOPICS,
                   start: str | None = None, end: str | None = None, search: str = "",
                   literal: bool = False, end_inclusive_midnight: bool = True) -> Column:
    """Source, topic, date-range and text filters as one condition.

    The cheap tests come first and the topic, which reads the body, last; AND
    stops at the first failure.

    ``search`` is a regular expression matched on lower-cased title or body
    (``literal=True`` for a plain substring); blank means no filter.
    """
    tests = []
    if fuente != fixed.ALL_SOURCES:
        tests.append(F.col("fuente") == fuente)
    if start is not None or end is not None:
        tests.append(dates.in_range(F.col("fecha_final"), start, end, end_inclusive_midnight))
    query = search.strip().lower()
    if query:
        def test(name):
            low = F.lower(F.col(name))
            return low.contains(query) if literal else low.rlike(query)
        tests.append(test("titulo") | test("texto"))
    if topico != fixed.ALL_TOPICS:
        tests.append(F.col("topico") == topico)
    return reduce(and_, tests, F.lit(True))


def feed_filter(enriched: DataFrame, **filters) -> DataFrame:
    """Articles that pass the feed's filters."""
    return enriched.filter(feed_condition(**filters))


def feed(enriched: DataFrame, limit: int = fixed.FEED_LIMIT, **filters) -> DataFrame:
    """Filtered articles, newest first, first ``limit`` rows."""
    return newest_first(feed_filter(enriched, **filters)).limit(limit)


def with_cards(listed: DataFrame) -> DataFrame:
    """Display columns of a feed card."""
    return listed.withColumn("extracto", tx.excerpt(F.col("texto"), 220)).withColumn(
        "etiqueta", tx.capitalize(F.col("topico"))
    )


def table_view(articles: DataFrame) -> DataFrame:
    """Display columns of the compact table listing."""
    return (
        articles.withColumn("titulo_corto", tx.excerpt(F.col("titulo"), 70))
        .withColumn("texto_corto", tx.excerpt(F.col("texto"), 120, always=True))
        .withColumn("fecha", tx.prefix(
            tx.or_default(F.col("fecha_pub"), F.date_format("fecha_scrape", "yyyy-MM-dd")), 10))
    )


def all_articles(articles: DataFrame) -> DataFrame:
    """Full listing, newest scrape first (a range-partitioned global sort)."""
    return articles.orderBy(F.desc("fecha_scrape"), F.asc("id"))


def recent(articles: DataFrame, limit: int = fixed.RECENT_LIMIT) -> DataFrame:
    return all_articles(articles).limit(limit)


def keyword_search(articles: DataFrame, term: str, limit: int = fixed.KEYWORD_LIMIT) -> DataFrame:
    """LIKE search over title or body, newest scrape first."""
    hit = tx.like_term(F.col("titulo"), term) | tx.like_term(F.col("texto"), term)
    return recent(articles.filter(hit), limit)


def by_url(articles: DataFrame, url: str) -> DataFrame:
    return articles.filter(F.col("url") == url)


def url_list(articles: DataFrame) -> DataFrame:
    return articles.select("url").filter(F.col("url").isNotNull() & (F.col("url") != ""))


def first_by_url(enriched: DataFrame) -> DataFrame:
    """One (url, titulo) per url: the first one in newest-first order."""
    order = _order_key()
    return enriched.groupBy("url").agg(
        F.max_by("titulo", order).alias("titulo"), F.max(order).alias("orden")
    )


def first_url_by_title(enriched: DataFrame) -> DataFrame:
    """Title to url; the first url in newest-first order wins."""
    return first_by_url(enriched).groupBy("titulo").agg(F.max_by("url", "orden").alias("url"))


def _order_key() -> Column:
    """Key whose maximum comes first in newest-first order.

    NULL dates compare lowest inside a struct, so undated rows come last; equal
    dates go to the lower id.
    """
    return F.struct(F.col("fecha_final").alias("fecha"), (-F.col("id")).alias("menos_id"))
