"""Tables and pages that are large enough to show work that grows with their square."""

import time

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import layout


def test_markdown_of_a_large_table(spark):
    rows = [[f" {r}|{c}\n" if c % 3 else " " for c in range(60)] for r in range(300)] + [[" "] * 60]
    d = spark.createDataFrame([(rows,), ([["a", None], ["", "b"]],), ([["a"], ["b"]],)], "rows array<array<string>>")
    began = time.time()
    got = [r.m for r in d.select(text.markdown_table(F.col("rows")).alias("m")).collect()]
    assert time.time() - began < 30  # minutes, when the rows were filtered anew for each cell
    lines = got[0].split("\n")
    assert len(lines) == 301 and lines[1] == "|" + " --- |" * 40 and lines[2] == "| " + " | ".join(f"1\\|{c}" for c in range(60) if c % 3) + " |"
    assert got[1] == "| a |  |\n| --- | --- |\n|  | b |" and got[2] is None


def test_words_of_lines_are_shuffled_once(spark):
    p = spark.createDataFrame([(1, k, f"Zeile {k} mit éinigen Wörtern") for k in range(1, 100)] + [(2, 1, " doppelt  leer ")], "doc_id long, pos int, text string")
    words = layout.laid_out(p)
    plan = layout.physical_lines(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.doc_id, (r.page - 1) * 40 + r.line): (r.text, r.x0, r.x1, r.y) for r in layout.physical_lines(words).collect()}
    assert got == {(r.doc_id, r.pos): (r.text, 0.0, 6.0 * len(r.text), (r.pos - 1) % 40 * 12.0) for r in p.collect()}


def test_lines_by_place_and_number(spark):
    """Words of one line at three heights, in order of place, then of number; heights begin a line where they leave its first."""
    data = [(1, 1, 3, 50.0, 60.0, 10.0, "c"), (1, 1, 2, 0.0, 9.0, 12.0, "a"), (1, 1, 9, 20.0, 95.0, 13.5, "b2"), (1, 1, 1, 20.0, 30.0, 11.0, "b1"), (1, 1, 4, 0.0, 5.0, 14.0, "d"), (2, 1, 1, 0.0, 5.0, 1.0, None)]
    got = layout.physical_lines(spark.createDataFrame(data, "doc_id long, page int, word int, x0 double, x1 double, y double, t string")).orderBy("doc_id", "line").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 12.0, 0.0, 95.0, "a b1 b2 c"), (1, 1, 2, 14.0, 0.0, 5.0, "d"), (2, 1, 1, 1.0, 0.0, 5.0, "")]


def test_shortcuts_of_formula_texts(spark):
    """Plain texts skip the searches; what comes out is as with them."""
    from quire.functions import mathtext

    texts = ["plain words, and more.", "a+b=c", "α=β+γ", "x / \\in  y", "a  b", "a\tb", "#head", "- #x > y", "1*2_3`4$5", "a<b&c", "back\\slash", "bad\x01", "end\n", "\n#x", "é", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    full = F.col("t")
    for a, b in mathtext.SLASHED:
        full = F.regexp_replace(full, a, b)
    y = mathtext.mark_unrenderable(F.replace(F.col("t"), F.lit("\\"), F.lit("∕")))
    y = F.regexp_replace(F.regexp_replace(y, r"([*_`$])", r"\\$1"), r"(^|[\n ])([#>])", r"$1\\$2")
    y = F.replace(F.replace(y, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    t = F.col("t")
    got = d.select(mathtext.math_chars(t), mathtext.slash_commands(t), mathtext.plain_escape(t)).collect()
    assert list(map(tuple, got)) == list(map(tuple, d.select(mathtext.count(t, mathtext.MATH_CLASS), full, y).collect()))
