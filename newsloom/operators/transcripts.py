"""Ordered conversation transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transcripts(turns: DataFrame) -> DataFrame:
    """Turns of each conversation in append order, role-tagged: one line per turn.

    Lines are dealt by ranges of (conv_id, turn) and sorted in their partitions, so
    the partitions read one after another are the transcripts, and a conversation of
    any length is never collected into a row or a task.
    """
    lines = turns.select(
        "conv_id", "turn", "role", F.concat("role", F.lit(": "), "text").alias("linea"))
    return lines.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
