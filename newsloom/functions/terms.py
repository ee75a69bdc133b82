"""Tokens, n-grams and per-document term counts as array expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import bind

# Workers get the task function by value and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without their combining marks.

    Returns the one-to-one part as a pair of equal-length strings and the Latin
    one-to-many part (ligatures) as a map.  Generated from the Unicode data, for
    all of the basic plane but the composed Hangul syllables.
    """
    single_from, single_to, many = [], [], {}
    for cp in range(0xA0, 0xFFFF):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        plain = unicodedata.normalize("NFKD", ch)
        if plain == ch:
            continue
        plain = "".join(c for c in plain if not unicodedata.combining(c))
        if len(plain) == 1 and plain != ch:
            single_from.append(ch)
            single_to.append(plain)
        elif len(plain) > 1 and "LATIN" in unicodedata.name(ch, "") and plain.isalpha():
            many[ch] = plain
    return "".join(single_from), "".join(single_to), many


_FROM, _TO, _LIGATURES = _decompositions()


def fold_accents(c: Column) -> Column:
    """Replace accented letters by their base letters and drop combining marks.

    Plain ASCII text, the common case in some languages, skips all of it.
    """
    def ligatures(t: Column) -> Column:
        out = t
        for ch, plain in _LIGATURES.items():
            out = F.replace(out, F.lit(ch), F.lit(plain))
        return F.when(t.rlike("[" + "".join(_LIGATURES) + "]"), out).otherwise(t)

    return bind(c, lambda t: F.when(
        t.rlike(r"[^\x00-\x7F]"),
        F.regexp_replace(F.translate(bind(t, ligatures), _FROM, _TO), r"\p{Mn}+", ""),
    ).otherwise(t))


def tokens(c: Column, stop_words: list[str]) -> Column:
    """Lower-case, accent-free runs of two or more word characters, minus stop words."""
    words = F.regexp_extract_all(
        fold_accents(F.lower(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)
    )
    if not stop_words:
        return words
    # isin() over many literals becomes a hash-set probe.
    return F.filter(words, lambda w: ~w.isin(stop_words))


#: The lower case, folding and class of all but these characters hang on the character alone
#: and have been settled for long; a text with one of these is cut into words by expressions.
#: (Not the negated class of the others, which is ten times as slow.)
OTHER = r"[\u0130\u0250-\u200F\u2028-\u20AB\u20AD-\x{10FFFF}]"
TOLD = "\u0130"  # not plain: begins texts that are words already


def word_text(c: Column) -> Column:
    """The text for ``Words`` to cut: as it is, or after ``TOLD`` in words with blanks between.

    One string crosses to Python instead of an array, and words are lowered, folded and
    looked up among stop words once for all their places in a run of texts.
    """
    words = F.regexp_replace(fold_accents(F.lower(c)), r"[^\p{L}\p{N}_]+", " ")
    return F.when(c.rlike(OTHER), F.concat(F.lit(TOLD + " "), words)).otherwise(c)


def _plain_table() -> dict[int, str]:
    """Each plain character lowered and folded; a blank for one that is in no word."""
    single = dict(zip(_FROM, _TO))
    ranges = (range(0x130), range(0x131, 0x250), range(0x2010, 0x2028), (0x20AC,))
    table = {}
    for cp in (cp for r in ranges for cp in r):
        low = chr(cp).lower()
        plain = _LIGATURES.get(low, single.get(low, low))
        table[cp] = "".join(
            c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in plain)
    return table


_TABLE = _plain_table()
#: Bytes of ASCII lowered, blanks for those in no word; other bytes as they are.
_BYTES = np.array([ord(_TABLE[b]) if b < 128 else b for b in range(256)], np.uint8)


WORDS = 500_000  # words counted together
TEXT_BYTES = 1 << 24  # text of which words are cut together


class Words:
    """The words of some texts (``word_text``) as numbers: ``tokens`` of each row."""

    def __init__(self, texts: pa.Array, stop_words: list[str]):
        texts = texts.fill_null("")
        told = pc.starts_with(texts, TOLD).to_numpy(zero_copy_only=False)
        places, rows, parts, held = [], [], [], 0
        for mine, raw in ((~told, True), (told, False)):
            if not mine.any():
                continue
            some = texts if mine.all() else texts.filter(pa.array(mine))
            lists = pc.split_pattern(_lowered(some) if raw else some, " ")
            sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
            coded = pc.dictionary_encode(pc.list_flatten(lists))
            row, form = np.repeat(np.flatnonzero(mine), sizes), coded.indices.to_numpy()
            words, first, count = _folded(coded.dictionary) if raw else (coded.dictionary, None, None)
            if first is None:
                place = form.astype(np.int64)
            else:
                n = count[form]
                place = np.repeat(first[form] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                row = np.repeat(row, n)
            places.append(place + held)
            rows.append(row)
            parts.append(words)
            held += len(words)
        coded = pc.dictionary_encode(pa.concat_arrays(parts or [pa.array([], pa.string())]))
        words = coded.dictionary
        keep = pc.and_(pc.greater_equal(pc.utf8_length(words), 2), pc.invert(
            pc.is_in(words, value_set=pa.array(stop_words, pa.string()))))
        keep = keep.to_numpy(zero_copy_only=False)
        number = np.where(keep, np.cumsum(keep) - 1, -1)[coded.indices.to_numpy()]
        place, row = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (places, rows))
        code = number[place] if held else place
        if len(parts) > 1:
            order = np.argsort(row, kind="stable")
            code, row = code[order], row[order]
        kept = code >= 0
        self.dictionary = words.filter(pa.array(keep, pa.bool_()))
        self.code, self.row, self.rows = code[kept], row[kept], len(texts)

    def pairs(self) -> np.ndarray:
        """Places of words that the next word of their row follows."""
        return np.flatnonzero(self.row[1:] == self.row[:-1])


def _lowered(texts: pa.Array) -> pa.Array:
    """Texts with their bytes of ASCII lowered and blanks for those in no word."""
    ends, data = texts.buffers()[1:]
    if data is None:
        return texts
    ends = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = _BYTES[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]]
    return pa.StringArray.from_buffers(
        len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(data))


def _folded(forms: pa.Array) -> tuple[pa.Array, np.ndarray | None, np.ndarray | None]:
    """Words of forms between separators; the first word and number of words of each form,
    or none if each form is the word at its place."""
    odd = np.flatnonzero(~pc.string_is_ascii(forms).to_numpy(zero_copy_only=False))
    if not len(odd):
        return forms, None, None
    split = [f.translate(_TABLE).split() for f in forms.take(pa.array(odd)).to_pylist()]
    first, count = np.arange(len(forms)), np.ones(len(forms), np.int64)
    count[odd] = late = np.fromiter(map(len, split), np.int64, len(split))
    first[odd] = len(forms) + np.cumsum(late) - late
    return pa.concat_arrays([forms, pa.array([w for x in split for w in x], pa.string())]), first, count


def runs_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``TEXT_BYTES``."""
    size = pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)
    run = (np.cumsum(size) - size) // TEXT_BYTES
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1), len(texts)]
    return ((lo, hi) for lo, hi in zip(edges[:-1], edges[1:]) if hi > lo)


def totals(stop_words: list[str]):
    """A function for ``mapInArrow``: texts to (term, cf, df), added up over each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in runs_of(batch.column(0)):
                yield _totals(Words(batch.column(0).slice(lo, hi - lo), stop_words))

    return run


def _totals(words: Words) -> pa.RecordBatch:
    base, rows, place = len(words.dictionary) + 1, words.rows, words.pairs()
    # A term is (first, second or none); its rows follow one another.
    key = np.concatenate([words.code * base, words.code[place] * base + words.code[place + 1] + 1])
    key = key * rows + np.concatenate([words.row, words.row[place]])
    key.sort()
    term = key // max(rows, 1)
    start = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else term
    new = np.append(True, key[1:] != key[:-1]) if len(key) else key
    df = np.add.reduceat(new.astype(np.int64), start) if len(start) else start
    return pa.RecordBatch.from_arrays(
        [_text(words.dictionary, base, term[start]), pa.array(np.diff(np.append(start, len(key)))),
         pa.array(df)], ["term", "cf", "df"])


def _text(words: pa.Array, base: int, term: np.ndarray) -> pa.Array:
    """Terms as text, from numbers first * base + second + 1."""
    first, second = np.divmod(term, base)
    return pc.binary_join_element_wise(
        words.take(pa.array(first)), words.take(pa.array(second - 1, mask=second == 0)), " ",
        null_handling="skip")


def counted_texts(stop_words: list[str]):
    """A function for ``mapInArrow``: (key, text) to the rows of ``counted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in runs_of(batch.column(1)):
                words = Words(batch.column(1).slice(lo, hi - lo), stop_words)
                yield from counted([pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(words.row, np.arange(hi - lo + 1)).astype(np.int32)),
                        words.dictionary.take(pa.array(words.code)))],
                    [batch.schema.names[0], "w"])])

    return run


class Vocabulary:
    """Finds the terms of a bounded vocabulary in texts."""

    def __init__(self, terms: list[str], stop_words: list[str]):
        parts = [t.split(" ") for t in terms]
        words = list(dict.fromkeys(w for p in parts for w in p))
        number = {w: i for i, w in enumerate(words)}
        self.words, self.base, self.size = pa.array(words, pa.string()), len(words) + 1, len(terms)
        key = np.array([number[p[0]] * self.base + (number[p[1]] + 1 if len(p) > 1 else 0)
                        for p in parts], np.int64)
        self.order = np.argsort(key)
        self.key, self.stop_words = key[self.order], stop_words

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of the term, tf), by row and number."""
        words, none = Words(texts, self.stop_words), np.zeros(0, np.int64)
        if not self.size or not len(words.code):
            return none, none, none
        number = pc.index_in(words.dictionary, value_set=self.words).fill_null(-1).to_numpy()
        code, place = number[words.code].astype(np.int64), words.pairs()
        place = place[(code[place] >= 0) & (code[place + 1] >= 0)]
        one = np.flatnonzero(code >= 0)
        key = np.concatenate([code[one] * self.base, code[place] * self.base + code[place + 1] + 1])
        row = np.concatenate([words.row[one], words.row[place]])
        at = np.minimum(np.searchsorted(self.key, key), self.size - 1)
        hit = self.key[at] == key
        found = row[hit] * self.size + self.order[at[hit]]
        found, tf = np.unique(found, return_counts=True)
        row, term = np.divmod(found, self.size)
        return row, term, tf


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words) to (key, ``array<struct<term, tf>>``): words and bigrams, sorted."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64)
        run = (np.cumsum(sizes) - sizes) // WORDS
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            lists = _counted(pc.list_flatten(batch.column(1).slice(lo, hi - lo)), sizes[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), lists], [batch.schema.names[0], "terminos"])


def _counted(words: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Term counts of rows of words.

    Words are numbered in the order of their bytes.  All of them sort after the blank
    of a bigram, so terms sort as pairs (first, second or none).
    """
    coded = pc.dictionary_encode(words)
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    w = rank[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    row, base = np.repeat(np.arange(len(sizes)), sizes), len(order) + 1
    pairs = row[1:] == row[:-1]
    key = np.concatenate([
        (row * base + w) * base, ((row * base + w)[:-1] * base + w[1:] + 1)[pairs]])
    key, tf = np.unique(key, return_counts=True)
    row, term = np.divmod(key, base * base)
    term, place = np.unique(term, return_inverse=True)
    first, second = np.divmod(term, base)
    ordered = coded.dictionary.take(order)
    text = pc.binary_join_element_wise(
        ordered.take(pa.array(first)), ordered.take(pa.array(second - 1, mask=second == 0)), " ",
        null_handling="skip")
    at = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(
        [text.take(pa.array(place)), pa.array(tf.astype(np.int32))], ["term", "tf"]))
