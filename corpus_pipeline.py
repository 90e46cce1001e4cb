"""The corpus pipeline: raw documents to packed token sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
A stage works on everything its predecessor kept. The driver of a run may write each stage's result and read
it again; run() chains them in one session.

All stages take empty tables (and give empty ones), repeated rows and null ids, and leave columns beside doc_id, text, source and n_chars as
they are, whatever their names; what each does with null and empty texts it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import exact_dedup, mixing, ngram_join, packing, quality_lines


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with lines that are common on their host removed. Null and empty texts go; repeated rows stay or go together; a null source is a host of its own."""
    return quality_lines.kept_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for the case of A-Z: the least id, null last. Null and empty texts are one group; of repeated rows one stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.75 or more): the least id, null last. Documents without words all stay, repeated rows of one that stays too."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the source weights ask, three times at most. Documents without words go; a null source is the last one; repeated rows have copies of their own."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 token ids and their places in sequences. Null and empty texts are their end id; repeated rows and null ids have places of their own."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]
#: Random rounding and a tokenizer can't be put as SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
