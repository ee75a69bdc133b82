"""A training corpus from ``documents`` in five stages.

Each stage reads what the stage before wrote and applies one operator to all of it.
The columns of ``documents`` go through to the last stage, which packs what is left
into sequences.  Names that begin with ``__`` are reserved for columns of the stages.
Documents without an id leave with the near duplicates: later results could not name
them.  Of rows that share an id, one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import jaccard, langid, mixing, packing, suffixes
from newsloom.llm.common import table
from newsloom.session import scratch, work_dir

#: Least mean probability of the predicted language for a document to stay.
LEAST_SCORE = 0.3
#: Near copies have a Jaccard similarity of at least 80 hundredths over five-word shingles;
#: op10's three words and 90 hold for that query only.
NEAR_WORDS, NEAR_PARTS = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is in no language: none predicted, or hardly sure."""
    field = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    return langid.with_language(docs, field).where(
        (F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of linked documents.

    Documents link from a Jaccard similarity of 0.8 over their five-word shingles.
    """
    first = jaccard.classes(docs, NEAR_WORDS, NEAR_PARTS).where("doc_id = component_id").select(
        F.col("doc_id").alias("__id")).distinct()
    # An id stated with several texts keeps the row of the least hash, in every run.
    own = F.xxhash64(*[c for c in ("text", "lang", "source", "n_chars") if c in docs.columns])
    keyed = docs.withColumn("__row", own)
    least = keyed.groupBy(F.col("doc_id").alias("__of")).agg(F.min("__row").alias("__least"))
    kept = least.join(first, F.col("__of") == F.col("__id"), "left_semi")
    same = (F.col("doc_id") == F.col("__of")) & (F.col("__row") == F.col("__least"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__row"]).drop("__row")


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words that stand elsewhere too; documents left without a word go.

    The 400 bytes of op7 hold for that query only.
    """
    return suffixes.cleaned(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as the mix asks: not at all, once, or once more."""
    taken = mixing.mix(docs).where("taken > 0").select(
        F.col("doc_id").alias("__id"), F.explode(F.sequence(
            F.lit(1), (F.col("taken") / F.col("size")).cast("int"))).alias("__copy"))
    return docs.join(taken, F.col("doc_id") == F.col("__id")).drop("__id", "__copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of permitted lengths."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", long_repeats),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: The stages cannot be said in SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, read from the one table that the run leaves behind.

    What a stage writes on its way goes when its result stands; the tables between the
    stages go when the last one stands.
    """
    docs, result = table(spark, sf_dir, "documents"), work_dir(spark, "pipeline")
    with scratch(spark, "stages"):
        for name, stage in STAGES:
            label = name.replace(" ", "-")
            target = result if name == STAGES[-1][0] else work_dir(spark, label)
            with scratch(spark, f"{label}-steps"):
                rows = stage(spark, docs, sf_dir)
                rows.write.parquet(target)
            docs = spark.read.schema(rows.schema).parquet(target)
    return docs
