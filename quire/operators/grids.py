"""Tables with wide cells, and boxes on a page: words to slots, cells, logical rows and grids; what lies inside or beside a box.

A region is a row: its lines are an array of (y, words), words an array of (x0, x1, t), and its columns an array of
slots (a, b) from left to right. Everything about a grid works inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.predicates import caption_kind
from quire.functions.text import let

CELL = "struct<text:string,start:int,span:int>"


def slots_of_word(x0: Column, x1: Column, slots: Column) -> Column:
    """first and last slot that a word covers by max(1.5, a quarter of its width); without one, the slot of the nearest centre."""
    least = F.greatest(F.lit(1.5), 0.25 * (x1 - x0))
    numbered = F.transform(slots, lambda s, k: F.struct(k.alias("k"), (F.least(x1, s["b"]) - F.greatest(x0, s["a"])).alias("over"), F.abs((s["a"] + s["b"]) / 2 - (x0 + x1) / 2).alias("far")))
    nearest = lambda all_: F.array_min(F.transform(all_, lambda s: F.struct(s["far"].alias("far"), s["k"].alias("k"))))["k"]
    ends = lambda found, all_: F.struct(F.coalesce(F.get(found, F.lit(0))["k"], nearest(all_)).alias("first"), F.coalesce(F.try_element_at(found, F.lit(-1))["k"], nearest(all_)).alias("last"))
    return let(numbered, lambda all_: let(F.filter(all_, lambda s: s["over"] >= least), lambda found: ends(found, all_)))


def cells_of_line(words: Column, slots: Column) -> Column:
    """Words, in order of x0, as cells (text, start, span): a word joins the cell before it if that reaches its first slot."""

    def add(a: Column, w: Column) -> Column:
        joined = lambda last, s: F.struct(F.concat_ws(" ", last["text"], w["t"]).alias("text"), last["start"].alias("start"), (F.greatest(last["start"] + last["span"] - 1, s["last"]) - last["start"] + 1).alias("span"))
        new = lambda s: F.struct(w["t"].alias("text"), s["first"].alias("start"), (s["last"] - s["first"] + 1).alias("span"))
        before = F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        put = lambda last, s: F.when(F.coalesce(last["start"] + last["span"] - 1 >= s["first"], F.lit(False)), F.concat(before, F.array(joined(last, s).cast(CELL)))).otherwise(F.concat(a, F.array(new(s).cast(CELL))))
        return let(F.try_element_at(a, F.lit(-1)), lambda last: let(slots_of_word(w["x0"], w["x1"], slots), lambda s: put(last, s)))

    return F.aggregate(F.array_sort(words), F.array().cast(f"array<{CELL}>"), add)


def logical_rows(lines: Column, size: Column, share: float = 0.8) -> Column:
    """Lines, in order of y, as rows: a line less than share * size under the one before continues its row."""
    kind = "array<struct<y:double,lines:array<struct<y:double,words:array<struct<x0:double,x1:double,t:string>>>>>>"

    def add(a: Column, line: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        goes_on = F.coalesce(line["y"] - last["y"] < share * size, F.lit(False))
        grown = F.struct(line["y"].alias("y"), F.concat(last["lines"], F.array(line)).alias("lines"))
        new = F.struct(line["y"].alias("y"), F.array(line).alias("lines"))
        return F.when(goes_on, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(a, F.array(new)))

    return F.transform(F.aggregate(F.array_sort(lines), F.array().cast(kind), add), lambda r: r["lines"])


def merged_row(lines: Column, slots: Column) -> Column:
    """The cells of a row's lines: each joins the first cell whose slots it meets, and cells are in order of their starts."""
    cells = F.flatten(F.transform(lines, lambda line: cells_of_line(line["words"], slots)))

    def add(a: Column, c: Column) -> Column:
        meets = F.transform(a, lambda m: (m["start"] + m["span"] > c["start"]) & (c["start"] + c["span"] > m["start"]))
        joined = lambda m: F.struct(F.concat_ws(" ", m["text"], c["text"]).alias("text"), F.least(m["start"], c["start"]).alias("start"), (F.greatest(m["start"] + m["span"], c["start"] + c["span"]) - F.least(m["start"], c["start"])).alias("span")).cast(CELL)
        return let(F.array_position(meets, True) - 1, lambda at: F.when(at >= 0, F.transform(a, lambda m, i: F.when(i == at, joined(m)).otherwise(m))).otherwise(F.concat(a, F.array(c))))

    by_start = lambda p, q: F.when(p["start"] < q["start"], -1).when(p["start"] > q["start"], 1).otherwise(0)
    return F.array_sort(F.aggregate(cells, F.array().cast(f"array<{CELL}>"), add), by_start)


def grid(rows: Column, columns: Column) -> Column:
    """Rows of cells as rows of so many places: (text, span) where a cell starts, null under wide cells and where there is none."""
    place = lambda row, k: F.try_element_at(F.filter(row, lambda c: c["start"] == k), F.lit(-1))
    cell = lambda c, k: F.when(c.isNotNull(), F.struct(c["text"].alias("text"), F.greatest(F.lit(1), F.least(c["span"], columns - k)).alias("span")))
    return F.transform(rows, lambda row: F.transform(F.sequence(F.lit(0), columns - 1), lambda k: cell(place(row, k), k)))


def without_captions(lines: Column) -> Column:
    """Lines that are no caption of a table or figure."""
    return F.filter(lines, lambda line: caption_kind(F.array_join(F.transform(F.array_sort(line["words"]), lambda w: w["t"]), " ")).isNull())


def span_grid(lines: Column, slots: Column, size: Column) -> Column:
    """The grid of a region's lines, captions left out."""
    rows = F.transform(logical_rows(without_captions(lines), size), lambda row: merged_row(row, slots))
    return grid(rows, F.size(slots))


def rules(drawings: DataFrame, thin: float = 2.0, least: float = 30.0) -> DataFrame:
    """Drawings (doc_id, page, x0, x1, y0, y1) that are horizontal rules: doc_id, page, y, x0, x1, to a tenth, each once."""
    r = drawings.filter((F.col("y1") - F.col("y0") < thin) & (F.col("x1") - F.col("x0") >= least))
    return r.select("doc_id", "page", F.round("y0", 1).alias("y"), F.round("x0", 1).alias("x0"), F.round("x1", 1).alias("x1")).distinct()


def _named(boxes: DataFrame) -> DataFrame:
    return boxes.select("doc_id", "page", *[F.col(c).alias(f"_{c}") for c in ("x0", "x1", "y0", "y1")])


def outside(blocks: DataFrame, boxes: DataFrame, pad: float = 3.0) -> DataFrame:
    """Blocks (doc_id, page, x0, x1, y0, y1) that lie inside no box of their page, a box being pad larger on all sides."""
    b = _named(boxes).withColumnsRenamed({"doc_id": "_d", "page": "_p"})
    inside = (F.col("x0") >= F.col("_x0") - pad) & (F.col("x1") <= F.col("_x1") + pad) & (F.col("y0") >= F.col("_y0") - pad) & (F.col("y1") <= F.col("_y1") + pad)
    return blocks.join(b, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & inside, "left_anti")


def overlapping(boxes: DataFrame, others: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes (doc_id, page, box, ...) that share `least` of the smaller area with one of the others on their page; with least = 0, any area."""
    j = boxes.join(_named(others), ["doc_id", "page"])
    width, height = F.least("x1", "_x1") - F.greatest("x0", "_x0"), F.least("y1", "_y1") - F.greatest("y0", "_y0")
    area = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    smaller = F.least((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")))
    return j.filter((area > 0) & (area >= least * smaller)).select(*boxes.columns).distinct()


def absorbed_captions(structured: DataFrame, blocks: DataFrame, reach: float = 40.0) -> DataFrame:
    """doc_id, page, region, block, caption: for each structured block (doc_id, page, region, x0, x1, y0, y1) the caption block nearest above or below it."""
    c = blocks.filter(caption_kind(F.col("text")).isNotNull()).select("doc_id", "page", "block", F.col("text").alias("caption"), F.col("y0").alias("_cy0"), F.col("y1").alias("_cy1"))
    far = F.greatest(F.col("y0") - F.col("_cy1"), F.col("_cy0") - F.col("y1"), F.lit(0.0))
    near = structured.join(c, ["doc_id", "page"]).withColumn("_far", far).filter(F.col("_far") <= reach)
    best = near.groupBy("doc_id", "page", "region").agg(F.min_by(F.struct("block", "caption"), F.struct("_far", "block")).alias("_c"))
    return best.select("doc_id", "page", "region", "_c.block", "_c.caption")


def figure_text(lines: Column, least_words: int = 3, most: int = 40) -> Column:
    """Texts of a figure's lines, the first `most`; null where they have fewer words than that in all."""
    texts = F.transform(F.array_sort(lines), lambda line: F.array_join(F.transform(F.array_sort(line["words"]), lambda w: w["t"]), " "))
    words = F.aggregate(lines, F.lit(0), lambda a, line: a + F.size(line["words"]))
    return F.when(words >= least_words, F.slice(texts, 1, most))
