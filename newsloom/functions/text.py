"""String expressions: trimming, excerpts, folding, matching."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode text libraries see it, not only the blank.
SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"
ELLIPSIS = "…"
REST = 1_000_000_000  # "to the end" for substring and slice; no overflow when added to


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Keeps nested expressions linear where a long one is used several times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.regexp_replace(c, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def excerpt(c: Column, n: int, always: bool = False) -> Column:
    """First ``n`` characters; an ellipsis if cut (or always)."""
    cut = F.substring(c, 1, n)
    if always:
        return F.concat(cut, F.lit(ELLIPSIS))
    return F.when(F.length(c) > n, F.concat(cut, F.lit(ELLIPSIS))).otherwise(c)


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def or_default(c: Column, default: Column) -> Column:
    """``default`` where ``c`` is NULL or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def capitalize(c: Column) -> Column:
    """First character upper case, the rest lower case (not per word)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, REST)))


def join_non_empty(parts: Column, sep: str = " ") -> Column:
    return F.array_join(F.filter(parts, lambda p: p != ""), sep)


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z only; accented letters keep their case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def like_term(c: Column, term: str) -> Column:
    """``c LIKE '%term%'`` with ASCII-only folding and no escape character.

    ``%`` and ``_`` inside the term stay wildcards; only the backslash, which
    Spark would read as an escape, is doubled.
    """
    folded = "".join(ch.lower() if ch in string.ascii_uppercase else ch for ch in term)
    pattern = "%" + folded.replace("\\", "\\\\") + "%"
    return F.like(fold_ascii(c), F.lit(pattern))


def contains_any(c: Column, words: list[str]) -> Column:
    """True if any literal word is a substring of ``c``."""
    return reduce(or_, [c.contains(w) for w in words], F.lit(False))


def contains_any_of(c: Column, words: Column) -> Column:
    """Same, with the words in an array column."""
    return F.exists(words, lambda w: F.contains(c, w))


def lookup(mapping: Column, key: Column, default: str) -> Column:
    return F.coalesce(mapping[key], F.lit(default))
