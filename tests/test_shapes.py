"""Characters, spans, grids and results on small cases, nulls and empty values among them."""

import pytest
from pyspark.sql import functions as F

from quire.functions import glyphs
from quire.operators import spans, structured, vocabulary


@pytest.mark.parametrize("text, want", [("αβ x", r"\alpha \beta x"), ("∉ S", r"\notin S"), ("𝐀+𝔸", r"\mathbf{A}+\mathbb{A}"), ("x²₃", "x23"), ("λ≤Λ", r"\lambda \leq \Lambda"), ("\x10a", "⟦?⟧a"), ("ℛℯ", r"\mathcal{R}e"), ("", "")])
def test_formula(text, want):
    assert glyphs.formula(text) == want


def test_encoding(spark):
    program = "/Encoding 256 array\ndup 16 /parenleftBig put\ndup 77 /circleplusdisplay put\nreadonly def"
    d = spark.createDataFrame([(program, "VFYNJW+CMEX10", c) for c in ("\x10", "M", "P", "")] + [(program, "CMR10", "M"), (None, None, None)], "p string, font string, c string")
    got = d.select(glyphs.glyph_command(F.col("c"), F.col("font"), glyphs.encoding(F.col("p"))).alias("x"), glyphs.normal_font(F.col("font")).alias("f")).collect()
    assert [r.x for r in got] == [r"\big(", r"\bigoplus", None, None, None, None]
    assert [r.f for r in got] == ["cmex10"] * 4 + ["cmr10", ""]


def test_formula_lines(spark):
    rows = [(1, 1, 1, 1, 1, "Let", "CMR10", 10.0, 100.0, 0.0, 15.0), (1, 1, 1, 1, 2, "x", "CMMI10", 10.0, 100.0, 18.0, 23.0), (1, 1, 1, 1, 3, "i", "CMMI10", 7.0, 102.0, 23.0, 26.0), (1, 1, 1, 1, 4, "∈", "CMSY10", 10.0, 100.0, 29.0, 35.0), (1, 1, 1, 1, 5, "S", "CMMI10", 10.0, 100.0, 38.0, 45.0), (1, 1, 1, 1, 6, " ", "CMR10", 10.0, 100.0, 45.0, 48.0), (1, 1, 1, 1, 7, "hold", "CMR10", 10.0, 100.0, 45.5, 60.0), (1, 1, 1, 2, 1, " ", "CMR10", 10.0, 120.0, 0.0, 5.0)]
    d = spark.createDataFrame(rows, "doc_id long, page int, block int, line int, span int, text string, font string, size double, oy double, x0 double, x1 double")
    got = {r.line: r.text for r in spans.formula_lines(d).collect()}
    assert got == {1: r"Let$x_{i} \in S$ hold", 2: ""}
    assert spans.formula_lines(d.limit(0)).count() == 0
    assert [r.body_size for r in spans.body_size(d).collect()] == [10.0]


def test_grids(spark):
    cell = "struct<text:string,span:int>"
    d = spark.createDataFrame([(1, [[("a", 2), None], [("b", 1), ("c|d", 1)]], [["x", ""], [" ", "y"]]), (2, [[("a", 1)]], [["x", "y"]]), (3, None, None), (4, [], [])], f"k int, rows array<array<{cell}>>, said array<array<string>>")
    got = {r.k: r for r in d.select("k", structured.apply_rows(F.col("rows"), F.col("said")).alias("z"), structured.markdown(F.col("rows"), F.lit(1)).alias("m")).collect()}
    assert [[c and c.text for c in row] for row in got[1].z] == [["x", None], ["b", "y"]]
    assert got[2].z is None and got[3].z is None and got[4].z == []
    assert got[1].m == "| a |  |\n|---|---|\n| b | c\\|d |" and got[2].m == ""


def test_protocols_and_notes(spark):
    d = spark.sql("SELECT array(struct(' ' AS text, array('', ' a ') AS subs), struct('' AS text, CAST(NULL AS array<string>) AS subs)) AS steps, '  a   note ' AS note")
    r = d.select(structured.protocol(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.col("steps")).alias("p"), structured.note_accepted(F.col("note"), F.lit(None).cast("string")).alias("n"), structured.note_accepted(F.lit("-"), F.lit(None).cast("string")).alias("m")).first()
    assert r.p.title == "" and r.p.setup == [] and [(s.text, s.subs) for s in r.p.steps] == [("", ["a"])]
    assert r.n and not r.m


def test_lost_hyphens(spark):
    docs = spark.createDataFrame([(1, "a semantic-search b\nend-of-\nline well-\n")], "doc_id long, text string")
    v = vocabulary.hyphen_vocabulary(docs)
    assert {r.word for r in v.collect()} == {"semantic-search", "end-of"}
    p = spark.createDataFrame([(1, "the semanticsearch end-of")], "doc_id long, text string")
    assert [r.word for r in vocabulary.lost_hyphens(v, p).collect()] == ["semantic-search"]


def test_indented(spark):
    r = spark.sql("SELECT array(struct(10D AS x0, 'if' AS text), struct(20D AS x0, 'then' AS text)) AS l").select(structured.indented(F.col("l")).alias("l")).first()
    assert r.l == ["if", "  then"]


def test_mended_scalars(spark):
    """Prices at a stop, a comma or a dollar are money, commands and scripts are not; raised minus signs; scripts that hold the word style; environments of spaces."""
    from quire.functions import glyphs, mathtext, text

    rows = ["It costs $5.", "pays $5, or", "so $5$", r"$5\alpha", "$4.06x", "$2^{t}", "<script>a</style>b</script>c<style>x</style>d", r"\begin{matrix}\hspace{2em} & \\ \end{matrix}", r"\begin{matrix} \end{cases}", r"\begin{array}{cc} & \\ ~ \end{array}", r"\begin{cases} a \end{cases}"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = {r.k: r for r in d.select("k", mathtext.balance_dollars(F.col("t")).alias("b"), text.strip_inline(F.col("t")).alias("s"), mathtext.unrepaired(F.col("t"), F.lit(True)).alias("u")).collect()}
    assert [got[k].b for k in range(6)] == [r"It costs \$5.", r"pays \$5, or", "so $5$", r"$5\alpha", r"\$4.06x", "$2^{t}"]
    assert got[6].s == "cd"
    assert [got[k].u for k in range(7, 11)] == [["empty environment"], [], ["empty environment"], []]
    assert [glyphs.command(c) for c in "⁻₋⁺²"] == ["-", "-", "+", "2"] and glyphs.formula("⊥̸") == "⟂"
    assert list(glyphs.SYMBOLS) == sorted(glyphs.SYMBOLS)


def test_commands_of_a_font_reach_the_line(spark):
    """Code maps meet spans by document and font, with or without a subset's prefix; other fonts and documents keep placeholders."""
    program = "/Encoding 256 array dup 16 /parenleftBig put dup 17 /parenrightBig put dup 77 /circleplusdisplay put dup 80 /summationtext put dup 300 /unionsq put dup 50 /bracelefttp put"
    span = "doc_id long, page int, block int, line int, span int, text string, font string, size double, oy double, x0 double, x1 double"
    rows = []
    for doc, font in ((1, "VFYNJW+CMEX10"), (2, "CMEX10"), (3, "CMR10")):
        for k, (t, f) in enumerate([("x", "CMMI10"), ("\x10", font), ("M P", font), ("\x11", font), ("=", "CMR10"), ("y", "CMMI10")]):
            rows.append((doc, 1, 1, 1, k, t, f, 10.0, 100.0, 10.0 * k, 10.0 * k + 9))
    fonts = spark.createDataFrame([(1, "CMEX10", program), (3, "CMR10", program)], "doc_id long, font string, program string")
    got = {r.doc_id: r.text for r in spans.formula_lines(spark.createDataFrame(rows, span), fonts).collect()}
    assert all(c in got[1] for c in (r"\big(", r"\bigoplus", r"\sum", r"\big)")) and "⟦?⟧" not in got[1]
    assert "⟦?⟧" in got[2] and "⟦?⟧" in got[3] and r"\sum" not in got[2] + got[3]
