"""A cleaning pipeline over documents: toxicity, recurring lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. run() writes each stage's rows to the shared folder and reads them again for the next. In every stage null texts
count as empty and stay, null ids stay, repeated rows are rows of their own that change alike, other columns pass through
whatever they hold, and no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import line_dedup, near_dedup, packing, queries, toxicity
from lodestone.llm._shared import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The model learns from labelled rows that are not held out."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents go, but for the first document's; so do documents this leaves empty."""
    return line_dedup.without_recurring_lines(docs, drop_emptied=True)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 over five-word shingles, the document of the smallest id stays."""
    return near_dedup.without_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packing.pack(docs, queries.word_bpe_path())


STAGES = [("toxicity", without_toxic), ("line_dedup", without_recurring_lines), ("near_dedup", without_near_duplicates), ("packing", packed)]

#: The scores, hashes and retrieval of the stages are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
