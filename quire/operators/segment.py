"""Documents to ordered paragraphs, paragraphs to bounded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normal


def paragraph_texts(text: Column) -> Column:
    """The normalised lines that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal), lambda x: x != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, pos from 1, id p0001..., text; within a row, so nothing is shuffled."""
    d = docs.select("doc_id", F.posexplode(paragraph_texts(F.col("text"))).alias("_i", "text"))
    return d.select("doc_id", (F.col("_i") + 1).alias("pos"), F.format_string("p%04d", F.col("_i") + 1).alias("id"), "text")


def batches_of(lengths: Column, most: int = 8, most_chars: int = 3500) -> Column:
    """Array of (n, chars): a batch is closed when it is full or the next item would make it too long."""
    kind = "array<struct<n:int,chars:int>>"
    zero = F.struct(F.expr("array()").cast(kind).alias("done"), F.lit(0).alias("n"), F.lit(0).alias("chars"))
    closed = lambda a: F.concat(a["done"], F.array(F.struct(a["n"].alias("n"), a["chars"].alias("chars"))))

    def add(a: Column, x: Column) -> Column:
        full = (a["n"] > 0) & ((a["n"] >= most) | (a["chars"] + x > most_chars))
        return F.struct(F.when(full, closed(a)).otherwise(a["done"]).alias("done"), F.when(full, 1).otherwise(a["n"] + 1).alias("n"), F.when(full, x).otherwise(a["chars"] + x).alias("chars"))

    return F.aggregate(lengths, zero, add, lambda a: F.when(a["n"] > 0, closed(a)).otherwise(a["done"]))


def greedy_batches(docs: DataFrame, most: int = 8, most_chars: int = 3500) -> DataFrame:
    """doc_id, batch from 1, n, chars over the paragraphs of each document."""
    lengths = F.transform(paragraph_texts(F.col("text")), F.length)
    d = docs.select("doc_id", F.posexplode(batches_of(lengths, most, most_chars)).alias("_i", "b"))
    return d.select("doc_id", (F.col("_i") + 1).alias("batch"), "b.n", "b.chars")


def ocr_slices(docs: DataFrame, most: int = 900) -> DataFrame:
    """Paragraphs, those over `most` characters in slices of that length: doc_id, pos, slice from 0, text."""
    p = paragraphs(docs)
    cut = p.select("doc_id", "pos", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / most).cast("int"))).alias("slice"))
    return cut.select("doc_id", "pos", "slice", F.substring(F.col("text"), F.col("slice") * most + 1, F.lit(most)).alias("text"))
