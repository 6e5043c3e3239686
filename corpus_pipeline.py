"""A training corpus from raw documents, in five stages. Each is written to the shared folder before the next one reads it.

Edge cases, for all stages: an empty table gives empty tables; extra columns, whatever their names, stay up to the last stage;
null texts count as empty (the classifier decides on them, no copies are looked for, nothing is private, the mix takes none of
them); null sources are a source of their own; repeated rows of one text leave one of them after the second stage; without
labels of both classes no document is rejected; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwright.llm import bpe, jaccard, mixing, pii, quality
from meshwright.llm.common import cut, discard, table, tidy
from meshwright.llm.queries import vocabulary


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.distinct_documents(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what gives it away are replaced in the texts."""
    return pii.sanitise(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs, vocabulary())


STAGES = [("quality classifier", quality_filter), ("n-gram Jaccard join", near_duplicates), ("PII", private_data), ("mixing sources", source_mix), ("BPE", tokens)]

#: SQL can't express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        read, docs = docs, cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(read)  # what the stage before wrote; a table that was not written by `cut` stays
        tidy(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
