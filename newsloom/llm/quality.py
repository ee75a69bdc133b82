"""Quality rules: a table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import SPACE, WORD

SYMBOL = "[#*$%&|<>]"
BLANK = SPACE.removesuffix("+")
IN_WORD = WORD.removesuffix("+")
#: Positions are packed into the low bits of a sort key up to this word count.
POSITION_BITS = 21


class Rule(NamedTuple):
    """``metric`` must lie within [low, high]; None leaves a side open."""

    metric: str
    low: float | None
    high: float | None


#: Frequent function words of the supported languages, as plain lower-case words.
STOP_WORDS = (
    "the of and to in is that for it was on are as with be by this from have at "
    "der die das und ist nicht von mit den ein eine zu im auf für sich des dem "
    "le la les de des et un une du que qui dans pour est sur pas par au avec "
    "el los las del y en por con para una se no es al lo su"
).split()

STOP_FORMS = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]

#: Bounds sit well outside what running prose reaches; each catches one kind of junk.
RULES = (
    Rule("n_words", 5, None),
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", None, 0.5),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.4),
    Rule("upper_ratio", None, 0.6),
)


def word_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of one text to each row, evaluated inside the row.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and
    ``n_repeat_words`` (words within three-word windows that occur at least twice
    in the text).  Window hashes are sorted together with their positions, so
    repeats are neighbours; nothing is exploded and no row leaves its partition.
    Null text counts as empty.  Two different windows of one text are taken for
    equal if their 64-bit hashes are.  Columns of ``docs`` whose names start with
    ``__`` are reserved.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__words", F.filter(F.split(t, SPACE), lambda w: w != ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(IN_WORD))
    out = out.withColumns({
        "__lines": lines,
        "__stops": F.size(F.filter("__words", lambda w: w.isin(STOP_FORMS))),
        "__hash": F.transform("__words", lambda w: F.xxhash64(w)),
    })
    windows = F.transform("__hash", lambda h, i: F.xxhash64(
        h, F.get("__hash", i + 1), F.get("__hash", i + 2)))
    out = out.withColumn("__win", F.when(
        F.size("__hash") >= 3, F.slice(windows, F.lit(1), F.size("__hash") - 2)))
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("__win")) < F.size("__win")
    out = out.withColumn("__sorted", F.when(
        repeats & (F.size("__win") < (1 << POSITION_BITS)),
        F.sort_array(F.transform("__win", _packed))))
    # A column of its own: inside a lambda it would be sorted again for each element.
    out = out.withColumn("__pairs", F.when(
        repeats & (F.size("__win") >= (1 << POSITION_BITS)), F.array_sort(F.transform(
            "__win", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))))
    out = out.withColumn("__at", F.when(
        F.col("__sorted").isNotNull(), _repeated_packed()).when(
        F.col("__pairs").isNotNull(), _repeated_wide()).otherwise(
        F.array().cast("array<int>")))
    covered = F.aggregate(
        F.transform("__at", lambda p, j: F.least(
            F.lit(3), F.coalesce(F.get("__at", j + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x)

    def characters(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("long")

    return out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(t) - characters(BLANK),
        "n_symbols": characters(SYMBOL),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": covered,
        "n_lines": F.size("__lines").cast("long"),
        "n_stop_words": F.col("__stops").cast("long"),
        "n_upper": characters(r"\p{Lu}"),
    }).drop("__words", "__lines", "__stops", "__hash", "__win", "__sorted", "__pairs", "__at")


def _packed(h: Column, i: Column) -> Column:
    mask = F.lit(-(1 << POSITION_BITS)).cast("long")
    return h.bitwiseAND(mask).bitwiseOR(i.cast("long"))


def _repeated_packed() -> Column:
    """Ascending positions of windows that have an equal one, from the packed keys."""
    low = F.lit((1 << POSITION_BITS) - 1).cast("long")

    def position(x):
        return x.bitwiseAND(low).cast("int")

    def same(x, y):
        return (F.shiftright(x, POSITION_BITS) == F.shiftright(y, POSITION_BITS)) & (
            F.get("__win", position(x)) == F.get("__win", position(y)))

    hit = F.filter("__sorted", lambda x, j: same(x, F.get("__sorted", j + 1)) | same(
        x, F.get("__sorted", j - 1)))
    return F.sort_array(F.transform(hit, position))


def _repeated_wide() -> Column:
    """The same for texts with more positions than the packed keys can hold."""
    equal = F.filter("__pairs", lambda x, j: (x["h"] == F.get("__pairs", j + 1)["h"]) | (
        x["h"] == F.get("__pairs", j - 1)["h"]))
    return F.sort_array(F.transform(equal, lambda x: x["i"]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The ratios that rules may name, besides the counts themselves."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "upper_ratio": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
    }


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one expression: the names of the rules that a row breaks."""
    known = ratios()
    broken = []
    for r in rules:
        value = known.get(r.metric, F.col(r.metric))
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < r.low)
        if r.high is not None:
            bad = bad | (value > r.high)
        broken.append(F.when(bad, F.lit(r.metric)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, counts, ``base_failed``, ``broken`` and ``kept``.

    A document is kept if it passes the base test and breaks no rule.  Null and
    empty texts have no word and fail the base test; repeated rows are judged one
    by one; extra columns of ``docs`` are not looked at, whatever their names.
    """
    rows = word_metrics(docs.select("doc_id", F.col("text")))
    rows = rows.withColumns({"base_failed": base_failed(), "broken": compiled(rules)})
    kept = (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept")
    # Through a generator, so that no filter of a reader is pushed into the
    # expressions above and repeats them.
    return rows.select("doc_id", F.inline_outer(F.array(F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept, "broken"))))
