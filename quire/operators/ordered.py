"""Operators that follow the order of paragraphs: islands, first occurrences, histories, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.predicates import REFERENCES, block_kind, line_kind


def classified(paragraphs: DataFrame) -> DataFrame:
    """With kind; what follows a references heading is a reference."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    head = F.max(F.col("text").rlike(REFERENCES).cast("int")).over(before)
    return paragraphs.withColumn("kind", line_kind(F.col("text"), F.coalesce(head, F.lit(0)) == 1))


def classified_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, pos, text, size, body, bold) with kind and level; what follows a references heading is a reference."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    head = F.coalesce(F.max(F.col("text").rlike(REFERENCES).cast("int")).over(before), F.lit(0)) == 1
    c = blocks.withColumn("_refs", head)
    c = c.withColumn("_k", block_kind(F.col("text"), F.col("size"), F.col("body"), F.col("bold"), F.col("page"), F.col("_refs")))
    return c.withColumns({"kind": F.col("_k.kind"), "level": F.col("_k.level")}).drop("_refs", "_k")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def history(turns: DataFrame, last: int = 6, most: int = 4000) -> DataFrame:
    """The last turns of each conversation, then only what users and assistants said, cut to `most`."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text"))
    t = turns.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= last)
    return t.filter(F.col("role").isin("user", "assistant") & (F.col("text") != "")).select("conv_id", "turn", "role", F.substring("text", 1, most).alias("content"))


def neighbours(rows: DataFrame, key: str, pos: str, text: str, radius: int) -> DataFrame:
    """Each row with the texts around it, joined in order."""
    w = Window.partitionBy(key).orderBy(pos, text).rowsBetween(-radius, radius)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


def merge_across_pages(paragraphs: DataFrame) -> DataFrame:
    """Texts cut by a page's end, joined: (doc_id, page, pos, kind, text) to doc_id, pos, page, page_end, members, text.

    A text continues the one before if that is open at its end, itself begins in lower case or with an opening
    mark, and their pages follow each other. Islands of these are one text.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    tail = F.regexp_replace(F.regexp_replace(F.lag("text").over(w), r"\s+$", ""), r"\$+$", "")
    open_end = F.coalesce(~tail.rlike(r"([.?!:;。？！：；…]|^)$"), F.lit(False))
    goes_on = (F.lag("kind").over(w) == "text") & (F.col("kind") == "text") & open_end & F.col("text").rlike(r"^[a-z(\x{201c}\[]") & (F.col("page") == F.lag("page").over(w) + 1)
    p = paragraphs.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    return p.groupBy("doc_id", "_island").agg(
        F.min("pos").alias("pos"),
        F.min("page").alias("page"),
        F.max("page").alias("page_end"),
        F.count("*").alias("members"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"),
    ).drop("_island")


def merge_glyph_fragments(paragraphs: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Fragments of placeholders alone join what stands before them, if that is an equation or shares `overlap` of the smaller
    of their boxes; (doc_id, pos, kind, text, x0, x1, y0, y1, boxes may be left out), with `fragments`, the positions that joined.

    A fragment that does not join stands for itself, and later ones may join it. Only fragments look back, so a paragraph
    and the fragments after it are followed in order, and nothing else.
    """
    from quire.functions.predicates import glyph_only

    box = ("x0", "x1", "y0", "y1")
    p = paragraphs if all(c in paragraphs.columns for c in box) else paragraphs.withColumns({c: F.lit(None).cast("double") for c in box})
    w = Window.partitionBy("doc_id").orderBy("pos")
    p = p.withColumn("_island", F.sum(F.when(glyph_only(F.col("text")), 0).otherwise(1)).over(w))
    g = p.groupBy("doc_id", "_island").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "text", *[F.col(c).cast("double").alias(c) for c in box]))).alias("_m"))
    kind = "struct<pos:int,kind:string,x0:double,x1:double,y0:double,y1:double,texts:array<string>,fragments:array<int>>"
    head = lambda m: F.struct(m["pos"].alias("pos"), m["kind"].alias("kind"), *[m[c].alias(c) for c in box], F.array(m["text"]).alias("texts"), F.array().cast("array<int>").alias("fragments")).cast(kind)
    area = lambda a: (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])

    def shared(a: Column, b: Column) -> Column:
        width, height = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
        return F.coalesce((width > 0) & (height > 0) & (F.least(area(a), area(b)) > 0) & (width * height >= overlap * F.least(area(a), area(b))), F.lit(False))

    def add(done: Column, m: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce(last.isNotNull() & glyph_only(m["text"]) & ((last["kind"] == "equation") | shared(last, m)), F.lit(False))
        grown = F.struct(*[last[c].alias(c) for c in ("pos", "kind", *box)], F.concat(last["texts"], F.array(m["text"])).alias("texts"), F.concat(last["fragments"], F.array(m["pos"].cast("int"))).alias("fragments")).cast(kind)
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(head(m))))

    merged = g.select("doc_id", F.explode(F.aggregate("_m", F.array().cast(f"array<{kind}>"), add)).alias("_x"))
    return merged.select("doc_id", "_x.pos", "_x.kind", F.array_join("_x.texts", " ").alias("text"), *[f"_x.{c}" for c in box if c in paragraphs.columns], "_x.fragments")


def in_place(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, y, x, kind, item) with their place from 1 in the order of y and x."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("y", "x", "kind", "item")).cast("long"))


def term_marks(paragraphs: DataFrame, terms: DataFrame, kinds: tuple[str, ...] = ("table", "algorithm", "equation")) -> DataFrame:
    """doc_id, term, pos: the paragraph (doc_id, pos, text, kind) in which each term (doc_id, term) of its document is marked first.

    At a place the longest term wins, of equal ones the first by code points; formulas and paragraphs of `kinds` have no marks.
    """
    longest = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    quoted = lambda t: F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    t = terms.filter(F.trim(F.coalesce("term", F.lit(""))) != "").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.lower("term")), longest).alias("_t"))
    t = t.select("doc_id", F.concat(F.lit("(?i)"), F.array_join(F.transform("_t", quoted), "|")).alias("_p"))
    bare = F.regexp_replace("text", r"\$[^$]*\$", " ")
    found = paragraphs.filter(~F.col("kind").isin(*kinds)).join(t, "doc_id").select("doc_id", "pos", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(bare, F.col("_p"), F.lit(0)), F.lower))).alias("term"))
    return found.groupBy("doc_id", "term").agg(F.min("pos").alias("pos"))
