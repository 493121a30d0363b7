"""Export: a self-contained page for each document and an index of all, written by tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import embed_json, html_escape, slug

_PAGE = ("<!doctype html><html><head><meta charset='utf-8'><title>", "</title></head><body><script type='application/json' id='data'>", "</script></body></html>")


def pages(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """documents (doc_id, title) and paragraphs (doc_id, pos, id, text) to doc_id, name and html."""
    rows = paragraphs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "text"))).alias("paragraphs"))
    d = documents.select("doc_id", "title").join(rows, "doc_id", "left")
    data = embed_json(F.to_json(F.struct("title", "paragraphs")))
    return d.select("doc_id", F.concat(slug(F.col("title"), 56, "paper", 6), F.lit(".html")).alias("name"), F.concat(F.lit(_PAGE[0]), html_escape(F.col("title")), F.lit(_PAGE[1]), data, F.lit(_PAGE[2])).alias("html"))


def site_index(documents: DataFrame, coverage: DataFrame) -> DataFrame:
    """doc_id, title, name, translated, paragraphs and a badge."""
    d = documents.join(coverage, "doc_id", "left")
    done = F.coalesce(F.col("translated") / F.nullif(F.col("paragraphs"), F.lit(0)), F.lit(0.0))
    return d.select("doc_id", "title", F.concat(slug(F.col("title"), 56, "paper", 6), F.lit(".html")).alias("name"), "translated", "paragraphs", F.when(done >= 1, "complete").when(done > 0, "partial").otherwise("source only").alias("badge"))


def write_pages(rendered: DataFrame, path: str) -> None:
    """One text file line for each page, partitioned by name, through Spark's committer."""
    rendered.select("name", F.col("html").alias("value")).write.partitionBy("name").mode("overwrite").text(path)
