"""Language identification by a linear-chain conditional random field over words.

Each word has affix, n-gram and lexicon features; learned transitions say how
likely the language changes from one word to the next, and forward-backward gives
each word its language probabilities, so that a text which switches is labelled
piece by piece.  A document's language is the one with the largest mean
probability over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The field is fitted on about this many documents of each language.
SAMPLE_PER_LANG = 120
#: Hashed feature spaces: inner trigrams, affixes, and words of the lexicon.
GRAMS, AFFIXES, LEXICON = 1 << 15, 1 << 14, 1 << 16
AFFIX = 4
STEPS = 45
SEGMENT = (5, 40)
LENGTH = 64
CHUNK_CHARS = 1 << 21
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[list(range(97, 123)) + list(range(128, 256))] = True
_MIX = np.random.default_rng(4).integers(1, 2**31, (8, 256), dtype=np.uint32)
_POWER = np.cumprod(np.full(256, 0x01000193, np.uint32), dtype=np.uint32)


class Words(NamedTuple):
    """Features of the words of some texts, in order."""

    text: np.ndarray  # text of each word
    first: np.ndarray  # its first position in ``gram``
    gram: np.ndarray  # a feature for each letter: it and its two neighbours
    prefix: np.ndarray
    suffix: np.ndarray
    entry: np.ndarray  # its place in the lexicon


def words_of(texts: list[str]) -> Words:
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(p) + 4 for p in parts], np.int64)
    data = np.frombuffer(b"    " + b"    ".join(parts) + b"    ", np.uint8)
    is_letter = _LETTER[data]
    data = np.where(is_letter, data, 32)
    edge = np.diff(is_letter.astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1)
    letters = np.flatnonzero(is_letter)
    size = end - start + 1
    owner = np.repeat(np.arange(len(start)), size)
    gram = (_MIX[0][data[letters - 1]] ^ _MIX[1][data[letters]] ^ _MIX[2][data[letters + 1]])
    prefix, suffix = np.zeros(len(start), np.uint32), np.zeros(len(start), np.uint32)
    for j in range(AFFIX):
        inside = j < size
        prefix ^= np.where(inside, _MIX[3 + j][data[np.minimum(start + j, end)]], 0).astype(np.uint32)
        suffix ^= np.where(inside, _MIX[3 + j][data[np.maximum(end - j, start)]], 0).astype(np.uint32)
    within = (letters - start[owner]) % len(_POWER)
    first = np.cumsum(size) - size
    mixed = _MIX[7][data[letters]] * _POWER[within]
    entry = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint32)
    entry = entry ^ (entry >> np.uint32(15))
    return Words(np.searchsorted(np.cumsum(sizes), start, side="right"), first,
                 gram & (GRAMS - 1), prefix & (AFFIXES - 1), suffix & (AFFIXES - 1),
                 entry & (LEXICON - 1))


class Field(NamedTuple):
    langs: list[str]
    gram: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray  # centred log frequency of each entry in each language
    trust: np.ndarray  # weight of the lexicon
    change: np.ndarray  # log weights of the transitions


def potentials(w: Words, f: Field) -> np.ndarray:
    """Log weight of each language for each word."""
    if not len(w.first):
        return np.zeros((0, len(f.langs)))
    out = np.add.reduceat(f.gram[w.gram], w.first, axis=0)
    return out + f.prefix[w.prefix] + f.suffix[w.suffix] + f.trust * f.lexicon[w.entry]


def marginals(score: np.ndarray, size: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Language probabilities of each word by forward-backward, for chains of ``size`` words.

    Chains are cut into blocks.  The products of the transfer matrices of all blocks
    are computed at once, one word at a time; messages then pass from block to block
    of a chain, and last inside all blocks at once.  The result is that of one long
    pass, at any length.
    """
    langs = score.shape[1]
    step = np.exp(change - change.max())
    weight = np.exp(score - score.max(1, keepdims=True)) + 1e-12
    blocks_of = -(-size // LENGTH)
    count = int(blocks_of.sum())
    first_block = np.cumsum(blocks_of) - blocks_of
    chain = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(score)) - (np.cumsum(size) - size)[chain]
    block, place = first_block[chain] + within // LENGTH, within % LENGTH
    grid = np.ones((count, LENGTH, langs))
    grid[block, place] = weight
    filled = np.bincount(block, minlength=count)
    opens = np.zeros(count, bool)
    opens[first_block[size > 0]] = True

    carry = np.broadcast_to(np.eye(langs), (count, langs, langs)).copy()
    for t in range(LENGTH):
        live = filled > t
        steps = carry[live] @ step
        if t == 0:  # nothing comes before the first word of a chain
            steps[opens[live]] = carry[live][opens[live]]
        now = steps * grid[live, t][:, None, :]
        carry[live] = now / now.max((1, 2), keepdims=True)

    into, out_of = np.ones((count, langs)) / langs, np.ones((count, langs))
    longest = int(blocks_of.max()) if len(blocks_of) else 0
    message = np.ones((len(size), langs)) / langs
    for j in range(longest):
        live = np.flatnonzero(blocks_of > j)
        into[first_block[live] + j] = message[live]
        now = np.einsum("ij,ijk->ik", message[live], carry[first_block[live] + j])
        message[live] = now / now.sum(1, keepdims=True)
    message = np.ones((len(size), langs))
    for j in range(longest):
        live = np.flatnonzero(blocks_of > j)
        at = first_block[live] + blocks_of[live] - 1 - j
        out_of[at] = message[live]
        now = np.einsum("ijk,ik->ij", carry[at], message[live])
        message[live] = now / now.sum(1, keepdims=True)

    ahead = np.ones((count, LENGTH, langs))
    message = into
    for t in range(LENGTH):
        came = message @ step
        if t == 0:
            came[opens] = message[opens]
        message = came * grid[:, t]
        message = message / message.sum(1, keepdims=True)
        ahead[:, t] = message
    message = out_of
    for t in range(LENGTH - 1, -1, -1):
        live = (filled > t)[:, None]
        both = ahead[:, t] * message
        ahead[:, t] = both / both.sum(1, keepdims=True)
        back = (grid[:, t] * message) @ step.T
        message = np.where(live, back / back.sum(1, keepdims=True), message)
    return ahead[block, place]


def likelihood(score: np.ndarray, gold: np.ndarray, size: np.ndarray, change: np.ndarray
               ) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of labelled chains, and its gradients by ``score`` and by ``change``.

    The chains stand one after the other; ``gold`` holds the label of each word.  The
    expected transitions are the probabilities of both labels of neighbours at once:
    message from before, transition, weight of the later word, message from behind.
    """
    words, langs = score.shape
    firsts = np.cumsum(size) - size
    chain = np.repeat(np.arange(len(size)), size)
    within = np.arange(words) - firsts[chain]
    longest = int(size.max())
    top = score.max(1, keepdims=True)
    grid = np.ones((len(size), longest, langs))
    grid[chain, within] = np.exp(score - top)
    step = np.exp(change - change.max())
    ahead, behind = np.empty_like(grid), np.ones_like(grid)
    total = float(top.sum()) + (words - len(size)) * float(change.max())
    ahead[:, 0] = grid[:, 0]
    for t in range(longest):
        live = size > t
        if t:
            ahead[live, t] = (ahead[live, t - 1] @ step) * grid[live, t]
        norm = ahead[live, t].sum(1, keepdims=True)
        ahead[live, t] /= norm
        total += float(np.log(norm).sum())
    expected = np.zeros((langs, langs))
    for t in range(longest - 1, 0, -1):
        live = size > t
        later = grid[live, t] * behind[live, t]
        pair = ahead[live, t - 1][:, :, None] * step[None] * later[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        back = later @ step.T
        behind[live, t - 1] = back / back.sum(1, keepdims=True)
    prob = (ahead * behind)[chain, within]
    prob /= prob.sum(1, keepdims=True)
    inner = np.flatnonzero(within > 0)
    path = score[np.arange(words), gold].sum() + change[gold[inner - 1], gold[inner]].sum()
    seen = np.zeros((langs, langs))
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    return float(path) - total, np.eye(langs)[gold] - prob, seen - expected


def gradients(params: dict[str, np.ndarray], w: Words, lexicon: np.ndarray, order: np.ndarray,
              gold: np.ndarray, size: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Log likelihood of the words of ``w`` chained in ``order``, and its gradient by each parameter."""
    field = Field([], lexicon=lexicon, **params)
    value, by_score, by_change = likelihood(
        potentials(w, field)[order], gold, size, params["change"])
    gap = np.zeros((len(w.first), by_score.shape[1]))
    gap[order] = by_score
    letters = np.diff(np.append(w.first, len(w.gram)))
    owner = np.repeat(np.arange(len(w.first)), letters)
    return value, {
        "gram": _spread(w.gram, gap[owner], GRAMS), "prefix": _spread(w.prefix, gap, AFFIXES),
        "suffix": _spread(w.suffix, gap, AFFIXES),
        "trust": np.array([(gap * lexicon[w.entry]).sum()]), "change": by_change,
    }


def train(texts: list[str], labels: list[int], langs: list[str], lexicon: np.ndarray,
          seed: int = 4) -> Field:
    """Fits the field to spliced texts: short runs of one language after another.

    Runs of words of the sample are shuffled and chained, so that switches occur and
    the transitions are learned; the likelihood is raised by Adam.
    """
    rng, n = np.random.default_rng(seed), len(langs)
    w = words_of(texts)
    label = np.array(labels, np.int64)[w.text] if len(w.first) else np.zeros(0, np.int64)
    cuts, at = [], 0
    while at < len(label):
        upto = min(at + int(rng.integers(*SEGMENT)), len(label))
        while label[upto - 1] != label[at]:
            upto -= 1
        cuts.append((at, upto))
        at = upto
    order = np.concatenate([np.arange(*cuts[i]) for i in rng.permutation(len(cuts))]) if cuts else (
        np.zeros(0, np.int64))
    full = len(order) // LENGTH * LENGTH
    order = order[:full] if full else order
    sizes = np.full(full // LENGTH, LENGTH) if full else np.array([len(order)])
    params = {"gram": np.zeros((GRAMS, n)), "prefix": np.zeros((AFFIXES, n)),
              "suffix": np.zeros((AFFIXES, n)), "trust": np.full(1, 0.3), "change": np.eye(n)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    for i in range(STEPS if len(order) else 0):
        _, grads = gradients(params, w, lexicon, order, label[order], sizes)
        for k, g in grads.items():
            g = g / len(order) - 1e-6 * params[k]
            m, v = moments[k]
            m[:] = 0.8 * m + 0.2 * g
            v[:] = 0.95 * v + 0.05 * g * g
            correct = np.sqrt(1 - 0.95 ** (i + 1)) / (1 - 0.8 ** (i + 1))
            params[k] = params[k] + 0.1 * correct * m / (np.sqrt(v) + 1e-9)
    as32 = {k: v.astype(np.float32) if k in ("gram", "prefix", "suffix") else v
            for k, v in params.items()}
    return Field(langs, lexicon=lexicon.astype(np.float32), **as32)


def _spread(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, j], size) for j in range(values.shape[1])], 1)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    low, chars = 0, 0
    for i, t in enumerate(texts):
        if i > low and chars + len(t) > CHUNK_CHARS:
            yield low, i
            low, chars = i, 0
        chars += len(t)
    if texts:
        yield low, len(texts)


def lexicon_counts(docs: DataFrame) -> DataFrame:
    """(lang, entry, n) over all rows of (lang, text): each task adds up what it reads."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                w = words_of(texts[a:b])
                names = sorted(set(langs[a:b]))
                code = np.array([names.index(x) for x in langs[a:b]], np.int64)[w.text]
                for i, name in enumerate(names):
                    n = np.bincount(w.entry[code == i], minlength=LEXICON)
                    held[name] = held[name] + n if name in held else n
        for name, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                ["lang", "entry", "n"])

    rows = docs.mapInArrow(count, "lang string, entry long, n long")
    return rows.groupBy("lang", "entry").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Field:
    """A field from rows (doc_id, text, lang): lexicon from all, weights from a sample.

    The sample takes about ``per_lang`` documents of each language by a hash of the
    id, whole texts.  The lexicon comes back as LEXICON numbers per language.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Field([], *[np.zeros((1, 0))] * 4, np.zeros(1), np.zeros((0, 0)))
    counts = np.full((LEXICON, len(langs)), 0.1)
    for r in lexicon_counts(docs.select("lang", "text")).toPandas().itertuples(index=False):
        counts[r.entry, langs.index(r.lang)] += r.n
    lexicon = np.log(counts / counts.sum(0))
    lexicon -= lexicon.mean(1, keepdims=True)
    share = F.create_map(*[x for name in langs for x in (
        F.lit(name), F.lit(min(1.0, per_lang / sizes[name])))])
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    picked = docs.where(lot < share[F.col("lang")]).select("text", "lang", lot.alias("lot"))
    picked = picked.orderBy("lot", "lang", F.length("text")).limit(2 * per_lang * len(langs)).collect()
    return train([r["text"] for r in picked], [langs.index(r["lang"]) for r in picked], langs, lexicon)


def label(texts: list[str], field: Field) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not field.langs:
        return names, scores
    for a, b in chunks(texts):
        w = words_of(texts[a:b])
        size = np.bincount(w.text, minlength=b - a)
        prob = marginals(potentials(w, field), size, field.change)
        total = _spread(w.text, prob, b - a)
        for i in np.flatnonzero(size):
            if any(c.isalpha() for c in texts[a + i]):
                top = int(total[i].argmax())
                names[a + i], scores[a + i] = field.langs[top], float(min(1.0, total[i, top] / size[i]))
    return names, scores


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs``, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = label([t or "" for t in batch.column(1).to_pylist()], field)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` as they are, with ``__lang`` and ``__score`` of their text."""
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = label([t or "" for t in batch.column(at).to_pylist()], field)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*names, "__lang", "__score"])

    return docs.mapInArrow(run, T.StructType([
        *docs.schema.fields, T.StructField("__lang", T.StringType()),
        T.StructField("__score", T.DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row.

    Learns from rows with text and language whose id is not held out.  Null texts
    and texts without a letter are ``und`` with score 0, as is everything if there
    is nothing to learn from.  Repeated rows are labelled each, extra columns ignored.
    """
    field = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, field).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
