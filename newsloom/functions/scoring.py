"""Similarity bands, flags, messages and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import fixed


def band(sim: Column, high: float = fixed.HIGH_SIMILARITY,
         low: float = fixed.RELEVANCE_THRESHOLD) -> Column:
    return F.when(sim > high, "alta").when(sim > low, "media").otherwise("baja")


def relevant(sim: Column, threshold: float = fixed.RELEVANCE_THRESHOLD) -> Column:
    return sim >= threshold


def bar_width(sim: Column) -> Column:
    return F.least(F.floor(sim * 400).cast("int"), F.lit(100))


def three_decimals(sim: Column) -> Column:
    return F.format_string("%.3f", sim)


def result_message(max_sim: Column, n_relevant: Column,
                   threshold: float = fixed.RELEVANCE_THRESHOLD,
                   high: float = fixed.HIGH_SIMILARITY) -> Column:
    before, after = fixed.MSG_RELEVANT.split("{n}")
    return (
        F.when(max_sim < threshold, fixed.MSG_WEAK)
        .when(max_sim < high, fixed.MSG_RELATED)
        .otherwise(F.concat(F.lit(before), n_relevant.cast("string"), F.lit(after)))
    )
