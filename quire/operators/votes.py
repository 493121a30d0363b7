"""Terms: variants, majority votes, replacement plans, glossaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def variants(terms: DataFrame) -> DataFrame:
    """(en, zh, pos) to term, zh, n, first: how often each rendering of a lower-cased term occurs; blanks don't count."""
    t = terms.filter((F.trim("en") != "") & (F.trim("zh") != ""))
    return t.groupBy(F.lower("en").alias("term"), "zh").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def majority(counts: DataFrame) -> DataFrame:
    """term, best, renderings: the most frequent rendering, of equals the longest, of those the first."""
    return counts.groupBy("term").agg(F.max_by("zh", F.struct("n", F.length("zh"), -F.col("first"))).alias("best"), F.count("*").alias("renderings"))


def replacement_plan(counts: DataFrame) -> DataFrame:
    """zh, best: each minority rendering with its majority; those inside another chosen rendering are left out.

    A rendering inside another shares that one's substring at some place, so the two meet by their length and a hash of the
    substring: each chosen rendering gives its substrings of the lengths that minority renderings have.
    """
    best = majority(counts).filter("renderings > 1")
    plan = counts.join(best, "term").filter((F.col("zh") != F.col("best")) & (F.length("zh") >= 2)).groupBy("zh").agg(F.max("best").alias("best"))
    lengths = plan.agg(F.collect_set(F.length("zh")).alias("_lengths"))  # one row, as many entries as lengths
    chosen = best.select(F.col("best").alias("_c")).distinct().crossJoin(F.broadcast(lengths))
    size = F.length("_c")
    shorter = F.filter("_lengths", lambda n: n < size)
    parts = F.flatten(F.transform(shorter, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda k: F.substring(F.col("_c"), k, n))))
    inside = chosen.filter(F.size(shorter) > 0).select(F.explode(F.array_distinct(parts)).alias("zh")).distinct()
    return plan.join(inside, "zh", "left_anti")


def glossary(terms: DataFrame, most: int = 80, longest: int = 40) -> DataFrame:
    """(doc_id, en, zh, pos): the first rendering of each term of a document, the first `most` terms."""
    t = terms.filter((F.trim("en") != "") & (F.trim("zh") != "") & (F.length("en") <= longest))
    t = t.withColumn("term", F.lower("en"))
    t = t.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "term").orderBy("pos", "zh"))).filter("_k = 1")
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "term")))
    return t.filter(F.col("rank") <= most).select("doc_id", "rank", "term", "zh")
