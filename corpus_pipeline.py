"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark
leaks, tokens.  Each stage is written and read again as the next one's input.

A stage takes documents (doc_id, text, lang, source, n_chars) and returns them,
but for the last, which adds n_tokens, digests and the ids themselves, so that
its rows are a corpus for training.  Other columns don't go on.

Defined cases, for every stage: null and empty texts are kept (they are neither
toxic, near copies, repeats nor leaks) and have no tokens; very long texts are
worked on whole; of rows that repeat one stays; a null doc_id stays, unless its
text is a near copy of another that stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, decontamination, jaccard_join, substring_dedup, toxicity
from ledgerline.llm.common import drop_saved, saved, table

#: Of documents; what a stage adds for itself does not go on.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.reject(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least doc_id stays."""
    return jaccard_join.dedup(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; n_chars follows the text."""
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that are left with their token ids, counts and digests."""
    return bpe.encode_documents(docs.select(*COLUMNS), COLUMNS, with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
            if last is not None:
                drop_saved(last)
            last = docs
    return docs


#: SQL expresses neither the toxicity model nor the rolling hash.
ORACLE_SQL = None
