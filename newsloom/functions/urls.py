"""URL expressions (generic syntax of RFC 3986, appendix B)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GENERIC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)"


def scheme(c: Column) -> Column:
    return F.regexp_extract(c, _GENERIC, 1)


def host(c: Column) -> Column:
    return F.regexp_extract(c, _GENERIC, 2)


def path(c: Column) -> Column:
    """Path without query, fragment and ``;`` parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(c, _GENERIC, 3), r";[^/]*$", "")


def origin(c: Column) -> Column:
    return F.regexp_extract(c, r"^([^:/?#]+://[^/?#]*)", 1)


def segments(c: Column) -> Column:
    """Path segments; an empty path has one (empty) segment."""
    return F.split(F.regexp_replace(path(c), "^/+|/+$", ""), "/", -1)


def _without_dots(href: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a rooted path."""
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    parts = F.split(F.regexp_extract(href, r"^/([^?#]*)", 1), "/", -1)
    last = F.element_at(parts, -1)
    ends_in_dir = (last == ".") | (last == "..")

    def step(acc, s):
        return (
            F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s)))
        )

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(ends_in_dir, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def resolve(href: Column, base: Column) -> Column:
    """Absolute link for a rooted or protocol-relative ``href``; others unchanged."""
    rooted = F.when(href.rlike(r"/\.\.?(/|$|[?#])"), _without_dots(href)).otherwise(href)
    return (
        F.when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(base), rooted))
        .otherwise(href)
    )
