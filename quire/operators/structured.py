"""Tables, algorithms and figures: results put back on their source's shape, and what no longer fits it.

A grid is columns, head_rows and rows, an array of arrays of (text, span) structs; cells under a wide one are null.
Everything works inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import dedupe_pair, normal, strip

#: Four words; a search needs no more of them, and an open count would need a deep stack on long lines.
PROSE = r"([A-Za-z][A-Za-z'-]*[ \t]+){3}[A-Za-z]"


def apply_rows(rows: Column, translated: Column) -> Column:
    """The translated cells on the source's rows; null if a row or a cell too many or too few; blank cells keep the source's text."""
    fits = F.coalesce((F.size(rows) == F.size(translated)) & F.forall(F.zip_with(rows, translated, lambda a, b: F.size(a) == F.size(b)), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    cell = lambda c, t: F.when(c.isNotNull(), F.struct(F.coalesce(F.nullif(strip(t), F.lit("")), c["text"]).alias("text"), c["span"].alias("span")))
    return F.when(fits, F.zip_with(rows, translated, lambda a, b: F.zip_with(a, b, cell)))


def apply_lines(lines: Column, translated: Column) -> Column:
    """The translated lines if they are as many; null too if they only repeat a source that holds prose."""
    filled = F.transform(translated, lambda x: F.coalesce(x, F.lit("")))
    copied = (filled == F.transform(lines, lambda x: F.coalesce(x, F.lit("")))) & F.exists(lines, lambda x: F.coalesce(x.rlike(r"[A-Za-z]{3,}\s+[A-Za-z]{3,}"), F.lit(False)))
    return F.when((F.size(lines) == F.size(translated)) & ~copied, filled)


def apply_figure(content: Column, caption: Column, note: Column, translated: Column, groups: Column) -> Column:
    """A figure's result: caption and note must be there; groups (label, items) lose blank items, then those without a label or items."""
    full = lambda xs: F.filter(F.transform(xs, strip), lambda x: x != "")
    tidy = F.transform(groups, lambda g: F.struct(strip(g["label"]).alias("label"), F.transform(full(g["items"]), dedupe_pair).alias("items")))
    tidy = F.filter(tidy, lambda g: (g["label"] != "") & (F.size(g["items"]) > 0))
    result = F.struct(strip(caption).alias("caption"), full(F.coalesce(translated, content)).alias("content"), tidy.alias("groups"), strip(note).alias("note"))
    return F.when((strip(caption) != "") & (strip(note) != ""), result)


def stale_table(columns: Column, rows: Column, result_columns: Column, result_rows: Column) -> Column:
    return F.coalesce(result_columns.isNotNull() & ((columns != result_columns) | (F.size(rows) != F.size(result_rows))), F.lit(False))


def stale_algorithm(lines: Column, result: Column) -> Column:
    """Another number of lines, or a line of four words or more that came back as it was."""
    kept = F.exists(F.arrays_zip(lines.alias("a"), result.alias("b")), lambda x: F.coalesce((strip(x["a"]) == strip(x["b"])) & x["a"].rlike(PROSE), F.lit(False)))
    return F.coalesce((F.size(result) > 0) & ((F.size(lines) != F.size(result)) | kept), F.lit(False))


def markdown(rows: Column, head_rows: Column) -> Column:
    """Rows with text as a Markdown table, the rule after the header; empty under two such rows."""
    full = F.filter(rows, lambda r: F.exists(r, lambda c: F.coalesce(normal(c["text"]) != "", F.lit(False))))
    cell = lambda c: F.coalesce(F.replace(normal(c["text"]), F.lit("|"), F.lit(r"\|")), F.lit(""))
    line = lambda r, i: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"), F.when(i == head_rows - 1, F.concat(F.lit("\n|"), F.repeat(F.lit("---|"), F.size(r)))).otherwise(""))
    return F.when(F.size(full) >= 2, F.array_join(F.transform(full, line), "\n")).otherwise("")


def looks_like_table(rows: Column, columns: Column, most: int = 8, least: float = 0.55) -> Column:
    cells = F.filter(F.flatten(rows), lambda c: c.isNotNull())
    filled = F.filter(cells, lambda c: F.coalesce(normal(c["text"]) != "", F.lit(False)))
    return columns.between(2, most) & (F.size(rows) >= 2) & F.coalesce(F.size(filled) / F.nullif(F.size(cells), F.lit(0)) >= least, F.lit(False))


def indented(lines: Column, size: float = 10.0) -> Column:
    """Lines (x0, text) with the blanks that their distance from the leftmost one stands for."""
    width = max(2.0, 0.5 * size)
    left = F.array_min(F.transform(lines, lambda x: x["x0"]))
    return F.transform(lines, lambda x: F.concat(F.repeat(F.lit(" "), F.floor((x["x0"] - left) / width + 0.5).cast("int")), x["text"]))


def figure_mark(caption: Column, content: Column, labels: Column) -> Column:
    """'Figure 3 (plot)': a diagram without sentences, a plot with many labels of numbers, else reproduced."""
    number = F.regexp_extract(caption, r"(?i)(?:figure|fig\.?|图)\s*([0-9]+)", 1)
    sentences = F.filter(content, lambda x: (F.length(strip(x)) > 30) | strip(x).rlike("[.。;；]$"))
    numeric = F.filter(labels, lambda x: x.rlike(r"^[0-9.\s-]+$"))
    kind = F.when(F.size(sentences) == 0, "diagram").when((F.size(labels) >= 6) & (F.size(numeric) >= 4), "plot").otherwise("reproduced")
    return F.concat(F.lit("Figure "), number, F.lit(" ("), kind, F.lit(")"))


def protocol(title: Column, setup: Column, steps: Column) -> Column:
    """A protocol (steps of text and subs) without its blank parts; null if no step is left."""
    full = lambda xs: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), strip), lambda x: x != "")
    tidy = F.transform(steps, lambda s: F.struct(F.coalesce(strip(s["text"]), F.lit("")).alias("text"), full(s["subs"]).alias("subs")))
    tidy = F.filter(tidy, lambda s: (s["text"] != "") | (F.size(s["subs"]) > 0))
    return F.when(F.size(tidy) > 0, F.struct(F.coalesce(strip(title), F.lit("")).alias("title"), full(setup).alias("setup"), tidy.alias("steps")))


def note_accepted(note: Column, existing: Column) -> Column:
    """An explanation that is taken: none is there, 1 to 80 characters, no stock phrase."""
    t = normal(note)
    return F.coalesce(existing.isNull() & F.length(t).between(1, 80) & ~t.isin("这是一个术语", "术语", "-", "无"), F.lit(False))
