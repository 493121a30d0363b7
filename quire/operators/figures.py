"""Headers of tables, areas of figures and rows of short blocks: steps that follow state within one page or region.

Each is an Arrow function over groups that are as small as a table's header, a page's figures or a first page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.predicates import figure_label

REGION = ["doc_id", "page", "region"]


def headers(cells: DataFrame) -> DataFrame:
    """Header cells (doc_id, page, region, line, start, span, text) to header rows: doc_id, page, region, row, start, span, text.

    Without wide cells all lines are one row, texts of overlapping cells joined. Otherwise wide cells of one range are one
    cell and take in the narrow ones below or above them on their lines; other narrow cells of these lines stay; lines
    without a wide cell are rows of their own.
    """
    cell = T.StructType().add("row", T.IntegerType()).add("start", T.IntegerType()).add("span", T.IntegerType()).add("text", T.StringType())

    # a header is a row, so an Arrow batch holds many of them
    @F.pandas_udf(T.ArrayType(cell))
    def build(line: pd.Series, start: pd.Series, span: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("row", "start", "span", "text"), c, strict=True)) for c in _header(list(zip(*part, strict=True)))] for part in zip(line, start, span, text, strict=True)])

    h = cells.groupBy(*REGION).agg(F.sort_array(F.collect_list(F.struct("line", "start", "span", "text"))).alias("_c"))
    h = h.select(*REGION, *[F.col("_c")[k].alias(f"_{k}") for k in ("line", "start", "span", "text")])
    return h.select(*REGION, F.explode(build("_line", "_start", "_span", "_text")).alias("_x")).select(*REGION, "_x.*")


def _header(cells: list[tuple]) -> list[tuple]:
    """Rows (row, start, span, text) of one header's cells (line, start, span, text), which come in order."""
    wide_lines = {line for line, _, span, _ in cells if span >= 2}
    rows: list[list[list]] = []
    if not wide_lines:
        merged: list[list] = []
        for _, start, span, text in sorted(cells, key=lambda c: (c[1], c[0])):
            if merged and start < merged[-1][0] + merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], start + span - merged[-1][0])
                merged[-1][2] += f" {text}"
            else:
                merged.append([start, span, text])
        rows.append(merged)
    else:
        wide: dict[tuple, list[str]] = {}
        for line, start, span, text in cells:
            if span >= 2:
                wide.setdefault((start, span), []).append(text)
        narrow = [c for c in cells if c[0] in wide_lines and c[2] < 2]
        top = []
        for (start, span), texts in wide.items():
            own = " ".join(texts)
            top.append([start, span, " ".join([own, *[t for _, s, _, t in narrow if start <= s < start + span and t not in own]])])
        outside = [[s, n, t] for _, s, n, t in narrow if not any(a <= s < a + w for a, w in wide)]
        rows.append(sorted(top + outside))
        plain: dict[int, list[list]] = {}
        for line, start, span, text in cells:
            if line not in wide_lines:
                plain.setdefault(line, []).append([start, span, text])
        rows.extend(plain.values())
    return [(k + 1, *cell) for k, row in enumerate(rows) for cell in row]


def figure_areas(captions: DataFrame, boxes: DataFrame, reach: float = 330.0, most_gap: float = 55.0) -> DataFrame:
    """Each figure caption (doc_id, page, caption, x0, x1, y0, y1) with the area of drawings (doc_id, page, x0, x1, y0, y1) over it.

    From the caption upwards drawings join the area until the next lies more than most_gap higher, the caption above
    begins, or reach ends.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "caption")
    above = F.max(F.when(F.col("_y1") < F.col("y0"), F.col("_y1")))
    others = captions.select("doc_id", "page", F.col("caption").alias("_c"), F.col("y1").alias("_y1"))
    c = captions.join(others, ["doc_id", "page"]).groupBy(*captions.columns).agg(above.alias("_above"))
    c = c.withColumns({"_ceiling": F.greatest(F.col("y0") - reach, F.coalesce("_above", F.col("y0") - reach)), "_n": F.row_number().over(page)})
    b = boxes.select("doc_id", "page", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by0"), F.col("y1").alias("by1"))
    near = (F.col("by1") <= F.col("y0") + 2) & (F.col("bx1") >= F.col("x0")) & (F.col("bx0") <= F.col("x1")) & (F.col("by0") >= F.col("_ceiling"))
    key = ["doc_id", "page", "caption"]
    j = c.join(b, ["doc_id", "page"]).filter(near)
    # going up, the area ends where the highest top so far is more than most_gap under the next bottom
    up = Window.partitionBy(*key).orderBy(F.desc("by1"), "by0")
    low = F.coalesce(F.min("by0").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.col("y0"))
    j = j.withColumn("_cut", F.max((F.least(low, F.col("y0")) - F.col("by1") > most_gap).cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    area = j.filter("_cut = 0").groupBy(*key).agg(F.min("bx0").alias("_bx0"), F.max("bx1").alias("_bx1"), F.min("by0").alias("_top"))
    out = c.join(area, key, "left")
    return out.select(*key, F.least("x0", "_bx0").alias("x0"), F.greatest("x1", "_bx1").alias("x1"), F.coalesce("_top", "y0").alias("top"), (F.col("y0") - 2).alias("bottom"))


def absorb_labels(areas: DataFrame, blocks: DataFrame, pad: float = 3.0) -> DataFrame:
    """doc_id, page, caption, labels: the short texts of blocks (doc_id, page, block, text, kind, x0, x1, y0, y1) inside each area, in reading order.

    Headings and captions stay out; a block inside two areas goes to the lower one.
    """
    b = blocks.filter(~F.col("kind").isin("heading", "caption", "title") & figure_label(F.col("text")))
    a = areas.select("doc_id", "page", "caption", F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), "top", "bottom")
    inside = (F.col("x0") >= F.col("ax0") - pad) & (F.col("x1") <= F.col("ax1") + pad) & (F.col("y0") >= F.col("top") - pad) & (F.col("y1") <= F.col("bottom") + pad)
    j = b.join(a, ["doc_id", "page"]).filter(inside)
    one = j.groupBy("doc_id", "page", "block").agg(F.max_by(F.struct("caption", "y0", "x0", "text"), F.struct("bottom", "caption")).alias("_x"))
    return one.groupBy("doc_id", "page", F.col("_x.caption").alias("caption")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.round("_x.y0", 1).alias("y"), F.col("_x.x0").alias("x"), F.col("_x.text").alias("text")))), lambda x: x["text"]).alias("labels"))


def author_rows(blocks: DataFrame, height: float, share: float = 0.30, most: int = 120) -> DataFrame:
    """Short blocks of a first page's upper part (doc_id, block, text, lines, x0, x1, y0, y1) that stand beside each other, as rows: doc_id, row, text, blocks.

    A block belongs to the row before it if their tops differ by 3 at most and the gap between them is -2 to 40.
    A block of two lines reads 'first (second)'.
    """
    short = blocks.filter((F.col("y0") <= height * share) & (F.length("text") <= most) & (F.col("lines") <= 2))
    # a row's base and its right end go from block to block, so a document's short blocks, few by their place, are folded in order
    g = short.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "block", "x1", "text"))).alias("_b"))
    label = lambda t: F.when(t.contains("\n"), F.concat(F.regexp_replace(t, r"^([^\n]*)\n", "$1 ("), F.lit(")"))).otherwise(t)
    one = "struct<base:double,right:double,texts:array<string>>"

    def add(a, b):
        last = F.try_element_at(a, F.lit(-1))
        gap = b["x0"] - last["right"]
        beside = F.coalesce((F.abs(b["y0"] - last["base"]) <= 3) & gap.between(-2, 40), F.lit(False))
        grown = F.struct(last["base"].alias("base"), F.greatest(last["right"], b["x1"]).alias("right"), F.concat(last["texts"], F.array(label(b["text"]))).alias("texts"))
        new = F.struct(b["y0"].cast("double").alias("base"), b["x1"].cast("double").alias("right"), F.array(label(b["text"])).alias("texts"))
        return F.when(beside, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(grown.cast(one)))).otherwise(F.concat(a, F.array(new.cast(one))))

    rows = g.select("doc_id", F.posexplode(F.aggregate("_b", F.array().cast(f"array<{one}>"), add)).alias("_k", "_r"))
    return rows.select("doc_id", (F.col("_k") + 1).alias("row"), F.array_join("_r.texts", ", ").alias("text"), F.size("_r.texts").alias("blocks"))
