"""Date expressions on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import fixed

_DATE_TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"


def parse_text(c: Column) -> Column:
    """``YYYY-MM-DD`` with an optional time part; NULL when unparsable."""
    long_form = F.try_to_timestamp(
        F.regexp_replace(F.substring(c, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")
    )
    short_form = F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))
    return F.when(c.rlike(_DATE_TIME), long_form).otherwise(short_form).cast("timestamp_ntz")


def final_date(published: Column, scraped: Column) -> Column:
    """Published date, or the scrape time where the published date is NULL.

    An empty published date is a value: it does not parse and yields NULL.
    """
    return F.when(published.isNull(), scraped).otherwise(parse_text(published))


def day_text(c: Column, missing: str = fixed.NO_DATE) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(missing))


def stamp_text(c: Column, missing: str = fixed.NO_LATEST) -> Column:
    return F.coalesce(F.date_format(c, "dd/MM/yyyy HH:mm"), F.lit(missing))


def window_start(lo: Column, hi: Column, days: int = fixed.DEFAULT_WINDOW_DAYS) -> Column:
    """Default start of the date window: not before ``lo``, ``days`` before ``hi``."""
    return F.greatest(F.to_date(lo), F.date_sub(F.to_date(hi), days))


def in_range(c: Column, start: str | None, end: str | None,
             end_inclusive_midnight: bool = True) -> Column:
    """Rows inside [start, end]; rows without a date always pass.

    ``end_inclusive_midnight`` lets 00:00:00 of the day after ``end`` pass.
    """
    ok = F.lit(True)
    if start is not None:
        ok = ok & (c >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        limit = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
        ok = ok & ((c <= limit) if end_inclusive_midnight else (c < limit))
    return c.isNull() | ok
