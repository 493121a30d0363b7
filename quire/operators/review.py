"""Reviews of documents and what a provider is asked and answers; Column expressions but where frames are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.predicates import is_furniture, page_number
from quire.functions.text import furniture_key, strip

#: Formulas between dollars, \( \) or \[ \]; no group repeats over single characters, so long texts need no deep stack.
MATH = r"(?s)\$\$.+?\$\$|(?<!\\)\$[^$\\]*+(?:\\.[^$\\]*+)*+\$|\\\(.+?\\\)|\\\[.+?\\\]"
#: Names under which a reply may hold its text.
REPLY_NAMES = ("zh", "translation", "text_zh", "target")


def equation_cell(x: Column, least: float = 0.55) -> Column:
    """boxed: whether the first formula has that share of the text's characters, blanks aside; tag: what is left without it."""
    first = F.regexp_extract(x, MATH, 0)
    solid = lambda t: F.length(F.regexp_replace(t, r"\s+", ""))
    share = F.coalesce(solid(first) / F.nullif(solid(x), F.lit(0)), F.lit(0.0))
    return F.struct((share >= least).alias("boxed"), strip(F.when(first == "", x).otherwise(F.replace(x, first, F.lit("")))).alias("tag"))


def split_math(x: Column) -> Column:
    """Texts and formulas in turn, formulas with their marks; empty texts stay out."""
    formulas = F.regexp_extract_all(x, F.lit(MATH), F.lit(0))
    turns = F.arrays_zip(F.split(x, MATH).alias("t"), formulas.alias("m"))
    return F.filter(F.flatten(F.transform(turns, lambda p: F.array(p["t"], p["m"]))), lambda p: p != "")


def inside_math(x: Column, place: Column) -> Column:
    """Whether an odd number of dollars stands before the place, from 1."""
    return F.regexp_count(F.substring(x, F.lit(1), place - 1), F.lit(r"(?<!\\)\$")) % 2 == 1


def status(wanted: Column, made: Column, failed: Column) -> Column:
    return F.when(wanted == 0, "extracted").when(F.coalesce(failed, F.lit(False)), "error").when(made >= wanted, "ready").otherwise("partial")


def payloads(items: DataFrame) -> DataFrame:
    """Items (doc_id, batch, pos, id, text) to one JSON request a batch: doc_id, batch, payload."""
    g = items.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "text"))).alias("_i"))
    return g.select("doc_id", "batch", F.to_json(F.struct(F.transform("_i", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias("items"))).alias("payload"))


def reply_text(reply: Column) -> Column:
    """The text of a reply under the first of its names that is there and not blank."""
    return F.coalesce(*[F.nullif(strip(F.get_json_object(reply, f"$.{n}")), F.lit("")) for n in REPLY_NAMES])


def outline_prefix(lists: dict[str, tuple[Column, str, int]], terms: Column, most_terms: int = 60) -> Column:
    """Named lists (values, separator, most) and terms (en, zh) as lines; empty ones stay out."""
    part = lambda name, xs, by, most: F.when(F.size(xs) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(xs, 1, most), by)))
    pairs = F.transform(F.filter(terms, lambda t: F.coalesce(t["zh"] != "", F.lit(False))), lambda t: F.concat(t["en"], F.lit("→"), t["zh"]))
    return F.concat_ws("\n", *[part(n, *v) for n, v in lists.items()], part("Terms", pairs, ", ", most_terms))


def zone_furniture(blocks: DataFrame, height: float, top: float = 0.062, bottom: float = 0.945, least: int = 2) -> DataFrame:
    """Blocks (doc_id, text, y0, y1) in the top or bottom zone whose key repeats there in the document, or that are a number."""
    zone = blocks.filter((F.col("y1") <= top * height) | (F.col("y0") >= bottom * height)).withColumn("_key", furniture_key(F.col("text")))
    repeated = zone.groupBy("doc_id", "_key").agg(F.count("*").alias("_n"))
    kept = zone.join(repeated, ["doc_id", "_key"]).filter((F.col("_n") >= least) | F.col("text").rlike("^[0-9]{1,4}$"))
    return kept.drop("_key", "_n")


def page_furniture(blocks: DataFrame, height: float, page_width: float, top: float = 0.062, bottom: float = 0.945, share: float = 0.3) -> DataFrame:
    """Blocks (doc_id, page, text, lines, x0, x1, y0, y1) that are no content.

    In the top or bottom zone those whose key repeats there in the document, twice and on a share of its pages at least,
    known furniture and numbers; anywhere page numbers.
    """
    in_zone = (F.col("y1") <= top * height) | (F.col("y0") >= bottom * height)
    b = blocks.withColumns({"_zone": in_zone, "_key": furniture_key(F.col("text"))})
    pages = blocks.groupBy(F.col("doc_id").alias("_d")).agg(F.countDistinct("page").alias("_pages"))
    often = b.filter("_zone").groupBy(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).agg(F.count("*").alias("_n"))
    often = often.join(pages, "_d").filter(F.col("_n") >= F.greatest(F.lit(2), F.floor(share * F.col("_pages")))).drop("_n", "_pages").withColumn("_often", F.lit(True))
    b = b.join(often, (F.col("doc_id") == F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    gone = F.col("_zone") & (F.coalesce("_often", F.lit(False)) | is_furniture(F.col("text")) | F.col("text").rlike("^[0-9]{1,4}$"))
    return b.filter(gone | page_number(F.col("text"), F.col("lines"), F.col("x1") - F.col("x0"), F.lit(page_width))).select(*blocks.columns)


def scanned_pages(paragraphs: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, page, chars of the pages (doc_id, page, text) whose texts have fewer characters than that."""
    return paragraphs.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars")).filter(F.col("chars") < least)
