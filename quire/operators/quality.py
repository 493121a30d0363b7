"""Checks over results: coverage, fidelity, tag balance, order, lost numbers, left-over phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import normal, squash
from quire.sources.tables import stored

TAGS = ("p", "div", "ul", "ol", "li", "table", "tr", "td", "th", "span", "a", "b")
#: What ends a run of Latin words; a split, as a pattern for the run itself would recurse once a word.
BREAK = r"[^A-Za-z' \t\n\x0B\f\r-]+"


def tag_balance(html: Column, tags: tuple[str, ...] = TAGS) -> Column:
    """Array of the tags whose opening and closing numbers differ."""
    n = lambda p: F.regexp_count(html, F.lit(p))
    return F.array_compact(F.array(*[F.when(n(f"<{t}(?:[ \t\n/][^>]*)?>") != n(f"</{t}[ \t\n]*>"), F.lit(t)) for t in tags]))


def fidelity(needles: DataFrame, docs: DataFrame, prefix: int = 40, seed: int = 20) -> DataFrame:
    """item_id, doc_id of each document whose squashed text holds the first `prefix` characters of a squashed needle.

    Any occurrence holds a piece of a text that is cut every prefix - seed + 1 characters into pieces of `seed`: the
    pieces, distinct in a document, meet the needles' windows of that length by hash, and candidates are verified on the
    text. HTML entities are resolved and commands of formulas go before squashing.
    """
    step = prefix - seed + 1
    n = needles.select("item_id", F.substring(squash(plain(F.col("text"))), 1, prefix).alias("needle")).filter(F.length("needle") >= prefix)
    n = n.groupBy("needle").agg(F.collect_set("item_id").alias("items"))
    windows = n.select("needle", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(step)), lambda k: F.xxhash64(F.substring("needle", k, F.lit(seed)))))).alias("h"))
    texts = stored(docs.select("doc_id", squash(plain(F.col("text"))).alias("t")).filter(F.length("t") >= prefix), "squashed")
    cut = F.filter(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), lambda x: F.length(x) >= seed)
    pieces = texts.select("doc_id", F.explode(F.array_distinct(F.transform(cut, lambda x: F.xxhash64(F.substring(x, 1, seed))))).alias("h"))
    pairs = pieces.join(windows, "h").select("doc_id", "needle").distinct()
    held = pairs.join(texts, "doc_id").filter(F.col("t").contains(F.col("needle"))).select("doc_id", "needle").distinct()
    return held.join(n, "needle").select(F.explode("items").alias("item_id"), "doc_id")


def plain(x: Column) -> Column:
    """Text with the five HTML entities resolved and without the commands of formulas."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, r"\\[A-Za-z]+", "")


def first_phrase(x: Column) -> Column:
    """The first run of four Latin words or more that has over 24 characters."""
    runs = F.transform(F.split(x, BREAK), normal)
    return F.get(F.filter(runs, lambda p: (F.length(p) > 24) & (F.size(F.split(p, " ")) >= 4)), F.lit(0))


def lower_words(phrase: Column) -> Column:
    return F.size(F.filter(F.split(phrase, " "), lambda w: w.rlike("^[a-z]")))


def numbers(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def lost_numbers(source: Column, result: Column) -> Column:
    return F.array_except(numbers(source), numbers(result))


def keeps_content(source: Column, result: Column, steps: Column, least_steps: int = 2, least: float = 0.45) -> Column:
    """A rewritten protocol keeps all numbers, enough steps and enough of the tokens."""
    from quire.functions.text import tokens

    have = F.size(F.array_intersect(tokens(source), tokens(result))) / F.greatest(F.size(tokens(source)), F.lit(1))
    return (F.size(lost_numbers(source, result)) == 0) & (steps >= least_steps) & (have >= least)


def id_holes(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """key, pos of the numbers that are missing between the first and the last of each key; gaps become sequences, not whole ranges."""
    w = Window.partitionBy(key).orderBy(pos)
    gaps = rows.select(key, pos).distinct().withColumn("_next", F.lead(pos).over(w)).filter(F.col("_next") > F.col(pos) + 1)
    return gaps.select(key, F.explode(F.sequence(F.col(pos) + 1, F.col("_next") - 1)).alias("missing"))
