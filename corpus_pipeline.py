"""A training corpus from raw documents: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes what its predecessor kept and returns the columns of documents; the last one returns the
packed pieces. Extra columns pass through as they are, whatever their names. Nulls: a null text counts as empty,
a null lang or source is a value of its own, a null doc_id is a document like others. Repeated rows are rows of
their own until near duplicates leaves one. Each stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import forget, table, tables_written, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and very short texts among them. Equal rows go or stay together."""
    from quire.llm.quality_rules import keep_good

    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of a smaller doc_id holds go, and documents that lose their last word by it. A null doc_id is the largest."""
    from quire.llm.line_dedup import dedup_lines

    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest doc_id; of equal rows any one. Texts without words stay."""
    from quire.llm.ngram_join import keep_one

    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target weight asks for: not at all, once or twice. Equal rows get equal copies."""
    from quire.llm.mixing import mixed

    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens. A null or empty text is its end alone."""
    from quire.llm.packing import pack

    return pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Robust estimates, minhash groups and tokenised packing have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's intermediate tables, and its input, are removed once its result is written; the last stage's stay for its reader."""
    docs = table(spark, sf_dir, "documents")
    first = tables_written()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = written(docs, name)
            forget(spark, first, keep=1)
    return docs
