"""Conformance of results as one report: a row for each document and rule, with what breaks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.mathtext import MISSING, bare_commands, unrepaired
from quire.operators import quality

RULES = ("not translated", "latin left", "command without argument", "unrepaired", "no terms", "no glossary")
#: Examples that a row of the report shows.
SHOWN = 4
SIDES = ("text", "en", "zh")


def sides(joined: DataFrame) -> DataFrame:
    """doc_id, pos, id, side, content: text, restored text and translation of each paragraph as rows; nulls stay out."""
    parts = F.array(*[F.struct(F.lit(k).alias("order"), F.lit(s).alias("side"), F.col(s).alias("content")) for k, s in enumerate(SIDES)])
    return joined.select("doc_id", "pos", "id", F.explode(parts).alias("_s")).select("doc_id", "pos", "id", "_s.*").filter("content IS NOT NULL")


def report(paragraphs: DataFrame, records: DataFrame, glossary: DataFrame) -> DataFrame:
    """doc_id, rule, passes, found, examples (the first SHOWN, in order of paragraphs) for every document of paragraphs.

    paragraphs: doc_id, pos, id, text. records: doc_id, id, zh, en, terms. glossary: doc_id and a row a term. A record
    without a text counts as none. Every breach is counted; sides are told apart.
    """
    r = records.select("doc_id", "id", "zh", "en", F.size("terms").alias("_terms"))
    p = paragraphs.select("doc_id", "pos", "id", "text").join(r, ["doc_id", "id"], "left")
    made = F.trim(F.coalesce("zh", F.lit(""))) != ""
    breach = lambda d, rule, at, what: d.select("doc_id", F.lit(rule).alias("rule"), F.struct("pos", at.alias("at"), what.alias("what")).alias("_b"))
    here = lambda mark: F.concat("id", F.lit(": "), mark)
    missing = breach(p.filter(~made), RULES[0], F.lit(0), F.col("id"))
    phrase = quality.first_phrase(F.col("zh"))
    latin = breach(p.filter(made).withColumn("_p", phrase).filter(quality.lower_words(F.col("_p")) >= 2), RULES[1], F.lit(0), here(F.substring("_p", 1, 40)))
    bare = sides(p).select("doc_id", "pos", "id", "order", "side", F.posexplode(bare_commands(F.col("content"))).alias("_k", "_c"))
    bare = breach(bare, RULES[2], F.col("order") * 1_000_000 + F.col("_k"), F.concat("id", F.lit("/"), "side", F.lit(":\\"), "_c"))
    why = unrepaired(F.concat(F.coalesce("en", F.lit("")), F.coalesce("zh", F.lit(""))), F.col("text").contains(MISSING))
    covered = breach(p.filter(made).withColumn("_u", why).filter(F.size("_u") > 0), RULES[3], F.lit(0), here(F.array_join("_u", ", ")))
    breaches = missing.unionByName(latin).unionByName(bare).unionByName(covered)
    found = breaches.groupBy("doc_id", "rule").agg(F.count("*").alias("found"), _first("_b").alias("examples"))
    documents = p.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(F.col("_terms") > 0, F.col("_terms"))), F.lit(0)).alias("_t"))
    documents = documents.join(glossary.groupBy("doc_id").agg(F.count("*").alias("_g")), "doc_id", "left")
    whole = F.array(F.struct(F.lit(RULES[4]).alias("rule"), (F.col("_t") == 0).cast("long").alias("n")), F.struct(F.lit(RULES[5]).alias("rule"), F.col("_g").isNull().cast("long").alias("n")), *[F.struct(F.lit(x).alias("rule"), F.lit(0).cast("long").alias("n")) for x in RULES[:4]])
    grid = documents.select("doc_id", F.explode(whole).alias("_r")).select("doc_id", "_r.rule", "_r.n")
    out = grid.join(found, ["doc_id", "rule"], "left").withColumn("found", F.coalesce("found", F.col("n")))
    return out.select("doc_id", "rule", (F.col("found") == 0).alias("passes"), "found", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def _first(column: str) -> Column:
    return F.transform(F.slice(F.sort_array(F.collect_list(column)), 1, SHOWN), lambda b: b["what"])
