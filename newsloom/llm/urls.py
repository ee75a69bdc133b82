"""URL filter by the ratio of two character language models.

Rules decide some URLs.  Those they allow and those they block train one Markov model
each, of variable order: a character is predicted from the longest context seen, and
every order is smoothed by the next shorter one in proportion to the number of
different successors of its context (Witten and Bell).  The score of a URL is the
difference of its log-likelihoods for each character; a logistic curve fitted on
decided URLs that were kept out of the counts turns it into a probability.

Strings of up to ORDER + 1 bytes are packed into one number with their length.  Their
counts are added up by Spark over all decided URLs.  For scoring, a chunk of URLs asks
for the strings it holds, each once, and the counts come back to it by a join: the
model is never in one place, so it may grow with the URLs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import lower_ascii, written
from newsloom.llm.shingles import chunks

#: Characters of context, in bytes of UTF-8.
ORDER = 5
CHUNK_CHARS = 1 << 21
#: One of so many decided URLs is not counted; the curve is fitted on those.
HOLD_OUT = 8
#: Scores are rounded to this for fitting the curve, and cut at ±LIMIT.
STEP, LIMIT = 0.01, 8.0
STRINGS = 48
CHUNK = "chunk long, row array<long>, text array<string>, strings array<long>"


class Rule(NamedTuple):
    """Allows or blocks a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next of ``/?#``, A-Z in lower case."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def first_match(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = (host == r.host) | F.endswith(host, F.lit("." + r.host))
        out = F.when(fits & F.startswith(path, F.lit(r.path)), value(r)).otherwise(out)
    return out


def judged_by_rules(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``urls`` with host, path, rule and ruled (the rule's verdict)."""
    named = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    host, path = F.col("host"), F.col("path")
    return named.withColumn("rule", first_match(host, path, rules, lambda r: F.lit(r.name))).withColumn(
        "ruled", first_match(host, path, rules, lambda r: F.lit(r.verdict)))


def subject(url: Column) -> Column:
    """What the models read: all but the scheme, the host in lower case."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest)).otherwise(
        F.coalesce(url, F.lit("")))


def held_out(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(HOLD_OUT)) == 0


# ------------------------------------------------------------------- strings

def layout(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ORDER zeros and before one, and their sizes with it."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    pad = b"\0" * ORDER
    data = np.frombuffer(b"".join(pad + p + b"\0" for p in parts), np.uint8).astype(np.int64)
    return data, np.array([len(p) + 1 for p in parts], np.int64)


def packed(data: np.ndarray) -> np.ndarray:
    """The strings of 0 to ORDER + 1 bytes that end at each byte, one row per length."""
    out = np.zeros((ORDER + 2, len(data)), np.int64)
    for n in range(1, ORDER + 2):
        body = out[n - 1] & ((1 << STRINGS) - 1)
        shifted = np.zeros(len(data), np.int64)
        shifted[n - 1:] = data[:len(data) - n + 1] << (8 * (n - 1))
        out[n] = body | shifted | (n << STRINGS)
    return out


def predicted(sizes: np.ndarray) -> np.ndarray:
    """Places of the bytes to predict: each text and the zero at its end."""
    start = np.cumsum(sizes + ORDER) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)


def counts(urls: DataFrame) -> DataFrame:
    """(s, n_allow, n_block): strings predicted in rows of (text, ruled), each task adding up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, allowed = batch.column(0).to_pylist(), np.array(
                [v == "allow" for v in batch.column(1).to_pylist()], bool)
            for a, b in chunks(texts, CHUNK_CHARS):
                data, sizes = layout(texts[a:b])
                at = predicted(sizes)
                s, back = np.unique(packed(data)[1:, at].ravel(), return_inverse=True)
                good = np.tile(np.repeat(allowed[a:b], sizes), ORDER + 1)
                n = np.bincount(back, minlength=len(s))
                n_allow = np.bincount(back, good, minlength=len(s)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s), pa.array(n_allow), pa.array(n - n_allow)], ["s", "n_allow", "n_block"])

    rows = urls.mapInArrow(run, "s long, n_allow long, n_block long")
    return rows.groupBy("s").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))


def model(urls: DataFrame) -> DataFrame:
    """For each string: how often it was predicted, how much follows it, and how many kinds.

    Columns n, total and kinds, each for both models.
    """
    seen = written(counts(urls), "url-strings")
    n = F.shiftrightunsigned("s", STRINGS)
    body = F.col("s").bitwiseAND((1 << STRINGS) - 1)
    context = F.shiftrightunsigned(body, 8).bitwiseOR(F.shiftleft(n - 1, STRINGS))
    sides = ("allow", "block")
    own = seen.select("s", *[x for v in sides for x in (
        F.col(f"n_{v}"), F.lit(0).cast("long").alias(f"total_{v}"), F.lit(0).cast("long").alias(f"kinds_{v}"))])
    after = seen.select(context.alias("s"), *[x for v in sides for x in (
        F.lit(0).cast("long").alias(f"n_{v}"), F.col(f"n_{v}").alias(f"total_{v}"),
        (F.col(f"n_{v}") > 0).cast("long").alias(f"kinds_{v}"))])
    columns = own.columns[1:]
    return own.unionByName(after).groupBy("s").agg(*[F.sum(c).alias(c) for c in columns])


# ------------------------------------------------------------------- scoring

def log_likelihood(data: np.ndarray, at: np.ndarray, find, side: int) -> np.ndarray:
    """Log probability of each predicted byte; ``find`` gives n, total, kinds of strings."""
    strings = packed(data)
    prob = np.full(len(at), 1.0 / 256)
    for n in range(ORDER + 1):
        times = find(strings[n + 1, at])[:, 3 * side]
        after = find(strings[n, at - 1])
        total, kinds = after[:, 3 * side + 1], after[:, 3 * side + 2]
        prob = np.where(total > 0, (times + kinds * prob) / np.maximum(total + kinds, 1), prob)
    return np.log(prob)


def score_chunk(chunk: pa.Table, known: pa.Table) -> pa.Table:
    """(row, score) of a chunk's URLs, given the counts of the strings it asked for."""
    held = chunk.to_pylist()[0]
    strings = known.column("s").to_numpy()
    order = np.argsort(strings)
    values = np.stack([known.column(i).to_numpy() for i in range(2, 8)], 1).astype(np.float64)[order]
    strings = np.append(strings[order], -1)
    values = np.concatenate([values, np.zeros((1, 6))])

    def find(s: np.ndarray) -> np.ndarray:
        place = np.searchsorted(strings[:-1], s)
        return values[np.where(strings[place] == s, place, len(strings) - 1)]

    scores = []
    for a, b in chunks(held["text"], CHUNK_CHARS >> 3):
        data, sizes = layout(held["text"][a:b])
        at = predicted(sizes)
        gap = log_likelihood(data, at, find, 0) - log_likelihood(data, at, find, 1)
        scores.append(np.add.reduceat(gap, np.cumsum(sizes) - sizes) / sizes)
    return pa.table({"row": pa.array(held["row"], pa.int64()),
                     "score": pa.array(np.concatenate(scores), pa.float64())})


def asked(urls: DataFrame) -> DataFrame:
    """Chunks of (row, text) with the different strings their scores need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts, CHUNK_CHARS):
                data, sizes = layout(texts[a:b])
                at = predicted(sizes)
                strings, every = packed(data), np.unique(at - 1)
                need = [strings[n, at] for n in range(1, ORDER + 2)]
                need += [strings[n, every] for n in range(ORDER + 1)]
                need = np.unique(np.concatenate(need))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([rows[a:b]], pa.list_(pa.int64())),
                     pa.array([texts[a:b]], pa.list_(pa.string())), pa.array([need], pa.list_(pa.int64()))],
                    ["chunk", "row", "text", "strings"])
                chunk += 1

    return urls.mapInArrow(run, CHUNK)


def scores(urls: DataFrame, train: DataFrame) -> DataFrame:
    """(row, score) of rows (row, text), by models of rows (text, ruled)."""
    held = written(asked(urls), "url-chunks")
    wanted = held.select("chunk", F.explode("strings").alias("s"))
    # Strings without counts come along as zeros, so that every chunk has its group.
    found = wanted.join(model(train), "s", "left").fillna(0).select(
        F.col("chunk").alias("home"), "s", *[f"{c}_{v}" for v in ("allow", "block")
                                             for c in ("n", "total", "kinds")])
    own = held.drop("strings")
    return own.groupBy("chunk").cogroup(found.groupBy("home")).applyInArrow(
        score_chunk, "row long, score double")


def curve(score: np.ndarray, allow: np.ndarray, block: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through counts by score, both sides weighed alike.

    The slope is drawn a little towards 1, so that few URLs give a curve too.
    """
    if not allow.sum() or not block.sum():
        return 1.0, 0.0
    weight = np.stack([allow / allow.sum(), block / block.sum()], 1) * 50
    theta, x = np.array([1.0, 0.0]), np.stack([score, np.ones(len(score))], 1)
    prior, pull = np.array([1.0, 0.0]), np.array([0.05, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        grad = x.T @ (weight[:, 0] * (1 - p) - weight[:, 1] * p) - pull * (theta - prior)
        hess = (x * (weight.sum(1) * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(hess, grad)
        theta = theta + move / max(1.0, float(np.abs(move).max()))
    return float(theta[0]), float(theta[1])


def calibrated(ruled: DataFrame) -> tuple[float, float]:
    """The curve of rows (url, ruled, score), each URL once; its bins are a fixed number."""
    once = ruled.groupBy("url", "ruled").agg(F.first("score").alias("score"))
    cell = F.round(F.greatest(F.least("score", F.lit(LIMIT)), F.lit(-LIMIT)) / STEP).cast("long")
    bins = once.groupBy(cell.alias("cell")).agg(
        F.count_if(F.col("ruled") == "allow").alias("allow"),
        F.count_if(F.col("ruled") == "block").alias("block")).orderBy("cell").collect()
    return curve(np.array([r["cell"] * STEP for r in bins]),
                 *(np.array([r[c] for r in bins], float) for c in ("allow", "block")))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and p_allow of each row's url.

    Rows without a rule take the side of the models: allow from p_allow 0.5 on.  A null
    url is scored as an empty text; where rules leave one side without a URL, both
    models know nothing of it and what they say is biased to the other, so everything
    without a rule is allowed.  Repeated rows are judged each and train once; extra
    columns are ignored.
    """
    rows = judged_by_rules(pages.select("page_id", "url"), rules).withColumn(
        "__url_row", F.monotonically_increasing_id())
    # Written: the numbers of the rows must not change between its readers.
    rows = written(rows, "url-rows")
    once = rows.where("ruled IS NOT NULL").select("url", "ruled").distinct()
    train = once.where(~held_out(F.col("url"))).select(subject(F.col("url")).alias("text"), "ruled")
    scored = scores(rows.select(F.col("__url_row").alias("row"), subject(F.col("url")).alias("text")), train)
    out = written(rows.join(scored, F.col("__url_row") == F.col("row")).drop("row", "__url_row"),
                  "url-scores")
    sides = {r["ruled"] for r in out.select("ruled").distinct().collect()} - {None}
    slope, offset = calibrated(out.where(F.col("ruled").isNotNull() & held_out(F.col("url"))))
    p = 1 / (1 + F.exp(-(F.lit(slope) * F.col("score") + F.lit(offset))))
    p = p if len(sides) == 2 else F.lit(1.0)
    return out.select("page_id", "host", "path", "rule", "ruled", "score", p.alias("p_allow")).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block")).alias("verdict"),
        "score", "p_allow")
