"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import word_count, written

#: Slices of a source's shuffled order, and of a unit of virtual time.
SLICES = 4096
SEED = 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Sources in code point order, null last, take the weights in turn and share
    ``share`` of all words by weight.  A target stops at ``most`` times its
    source's size and the excess goes to the others by weight; the level at which
    that ends is found by one pass in the order of size over weight.  One row per
    source, so the ordered windows are as long as the list of sources.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("source_rank") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("source_rank", rank).withColumn("weight", weight)
    s = s.withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    everything = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (
        share * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    reached = F.when(F.col("level") <= F.col("cap") / F.col("weight"),
                     F.struct(F.col("cap") / F.col("weight"), "source_rank", "level"))
    s = s.withColumn("level", F.coalesce(
        F.min(reached).over(everything)["level"],
        F.max(F.col("cap") / F.col("weight")).over(everything)))
    return s.select("source", "source_rank", F.col("source_size"),
                    F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def finish_order(docs: DataFrame, seed: int = SEED, **kw) -> DataFrame:
    """Each document with the words of its source up to and including it.

    Rows (doc_id, source, size, source_size, target, through, ...).  The first copy
    finishes at ``through / target``, the next one a whole source later.  Within a
    source documents are shuffled by a hash of the id; the running total is the sum
    of whole slices of that order plus a window within the slice, so a source with
    a third of all rows is spread over its slices.
    """
    sized = written(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id").alias("shuffled")), "mix-sizes")
    slice_of = F.shiftright("shuffled", 64 - SLICES.bit_length() + 1)
    sized = sized.withColumn("slice", slice_of)
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    slices = slices.withColumns({
        "before": F.coalesce(F.sum("words").over(
            Window.partitionBy("source").orderBy("slice").rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0)),
    })
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **kw)
    start = slices.alias("s").join(
        goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        "s.source", "s.slice", "before", "source_rank", "source_size", "target")
    within = Window.partitionBy("source", "slice").orderBy("shuffled", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = sized.withColumn("inside", F.sum("size").over(within))
    rows = inside.alias("d").join(
        start.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (
            F.col("d.slice") == F.col("t.slice"))).select(
        "d.doc_id", "d.source", "d.size", "d.shuffled", "t.source_rank", "t.source_size",
        "t.target", (F.col("before") + F.col("inside")).alias("through"))
    return rows


def mix(docs: DataFrame, seed: int = SEED, **kw) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken.

    Copies are taken whole in the order of their finish times while the total stays
    within the budget, the sum of the targets; ``taken`` counts words with repeats.
    The cut is found in slices of virtual time and then within the one slice where
    the budget ends, so no window holds more than a slice.  The same rows give the
    same mix at every run.  Null text has size 0 and is never taken; null is a
    source of its own; repeated rows are rows of their own and share their fate.
    """
    rows = written(finish_order(docs, seed, **kw), "mix-order")
    copies = range(math.ceil(kw.get("most", 2.0)))
    due = rows.where("size > 0")
    passes = [due.select("size", key(c).alias("key")) for c in copies]
    queue = reduce(DataFrame.unionByName, passes).withColumn("at", _slice(F.col("key.finish")))
    goal = rows.select("source_rank", "target").distinct()
    budget = goal.agg(F.sum("target")).first()[0] or 0.0
    spans = queue.groupBy("at").agg(F.sum("size").alias("words")).withColumn(
        "through", F.sum("words").over(Window.orderBy("at")))
    # One row: the slice in which the budget ends, and the words before it.
    edge = spans.where(F.col("through") > budget).agg(
        F.min(F.struct("at", (F.col("through") - F.col("words")).alias("before")))).first()[0]
    if edge is None:
        chosen = F.lit(True)
    else:
        inside = queue.where(F.col("at") == edge["at"]).withColumn(
            "through", edge["before"] + F.sum("size").over(Window.partitionBy("at").orderBy("key")))
        last = inside.where(F.col("through") <= budget).agg(F.max("key")).first()[0]

        def chosen(c: int) -> Column:
            early = _slice(key(c)["finish"]) < edge["at"]
            if last is None:
                return early
            cut = F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip(KEY, last)])
            return early | (key(c) <= cut)
    taken = sum((F.when(chosen(c) if edge is not None else chosen, F.col("size")).otherwise(0)
                 for c in copies), F.lit(0))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"))


#: What decides the place of a copy in the queue.
KEY = (("finish", "double"), ("source_rank", "int"), ("shuffled", "long"), ("doc_id", "long"),
       ("copy", "int"))


def key(copy: int) -> Column:
    finish = (copy * F.col("source_size") + F.col("through")) / F.col("target")
    values = {"finish": finish, "copy": F.lit(copy)}
    return F.struct(*[values.get(n, F.col(n)).cast(t).alias(n) for n, t in KEY])


def _slice(finish: Column) -> Column:
    """Slices of virtual time; they widen beyond two units, so their number is bounded."""
    return F.when(finish < 2, F.floor(finish * SLICES)).otherwise(
        2 * SLICES + F.floor((F.log2(finish) - 1) * SLICES))
