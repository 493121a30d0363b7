"""Words of each document: proven compounds, frequent words, batches of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hyphen_vocabulary(docs: DataFrame) -> DataFrame:
    """doc_id, word: compounds that stand inside a line, in lower case; one that ends its line proves nothing."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z]{2,}-[A-Za-z]{2,}\n?"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("_m")).filter(~F.col("_m").endswith("\n")).select("doc_id", F.lower("_m").alias("word")).distinct()


def lost_hyphens(vocabulary: DataFrame, paragraphs: DataFrame, least: int = 8) -> DataFrame:
    """doc_id, word: compounds of the vocabulary that a document's paragraphs hold only without their hyphen.

    Words and halves are compared as tokens, so the work is a join on words and not a search of every text.
    """
    words = lambda pattern: paragraphs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("_w")).distinct()
    v = vocabulary.filter(F.length("word") >= least)
    kept = words("[a-z]{2,}-[a-z]{2,}").withColumnRenamed("_w", "word")
    glued = v.withColumn("_w", F.replace(F.col("word"), F.lit("-"), F.lit(""))).join(words("[a-z]+"), ["doc_id", "_w"], "left_semi")
    return glued.join(kept, ["doc_id", "word"], "left_anti").select("doc_id", "word")


def batched(rows: DataFrame, keys: list[str], order: str, value: str, most: int) -> DataFrame:
    """keys, batch from 0 and the values of each batch, in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    b = rows.withColumns({"_n": n, "batch": F.floor(n / most)})
    return b.groupBy(*keys, "batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias(value))
