"""Unit cases of the scalars, the providers, layout and sources."""

import pytest
from pyspark.sql import functions as F

from quire.functions import mathtext, predicates, text
from quire.operators import layout, migrate, ordered, provider, quality, segment
from quire.sources import export, tables


def value(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns))
    return df.select(expression.alias("v")).first().v


@pytest.mark.parametrize(
    "expression, x, want",
    [
        (mathtext.mark_unrenderable, "a\x10b", "a⟦?⟧b"),
        (mathtext.mark_unrenderable, "", "⟦?⟧"),
        (mathtext.mark_unrenderable, "a\n\tb", "a\n\tb"),
        (mathtext.missing_glyphs, "x⟦?⟧y⟦?⟧", 2),
        (mathtext.unescaped_dollars, r"a $b$ \$4", 2),
        (mathtext.balance_dollars, "costs $4.06 each", r"costs \$4.06 each"),
        (mathtext.balance_dollars, "$2^{t}$ stays", "$2^{t}$ stays"),
        (mathtext.balance_dollars, "$2^{t}$ and $5 more", r"$2^{t}$ and \$5 more"),
        (mathtext.repair_bare_commands, r"$\sqrt$ N", r"$\sqrt{N}$"),
        (mathtext.repair_bare_commands, r"$\frac{a}$", r"$\frac{a}{\ }$"),
        (mathtext.repair_bare_commands, r"$\hat$", r"$\hat{\ }$"),
        (mathtext.escape_math_angles, "a < b $a<b$ c > d", r"a < b $a\lt{}b$ c > d"),
        (mathtext.plain_escape, "*a* <b & $", r"\*a\* &lt;b &amp; \$"),
        (mathtext.display_equation, "$a = b + c$", True),
        (mathtext.display_equation, "(3b) $a = b$", True),
        (mathtext.display_equation, "as in $a$ (4)", False),
        (mathtext.display_equation, "$a$ 4", False),
        (mathtext.slash_commands, r"x /\in A / = b /\infty", r"x \notin A \neq b /\infty"),
        (text.blank_line_paragraphs, "a\nb\n \n\n c\n", ["a\nb", "c"]),
        (mathtext.display_equation, "a long sentence with $a$", False),
        (mathtext.math_coverage, "ab $cd$", 0.5),
        (text.dedupe_pair, "LAION（LAION）", "LAION"),
        (text.dedupe_pair, "a (b)", "a (b)"),
        (text.mask, "sk-abcdefghijklmnop", "sk-abc*********mnop"),
        (lambda x: text.slug(x, 40, "doc", 4), "??", "doc-0d1b"),
        (text.normal, " a  b\n", "a b"),
        (text.split_bullets, "Uses: • one • two", ["Uses:", "• one • two"]),
        (text.split_bullets, "one • only", ["one • only"]),
        (text.tokens, "a foo Foo 12 x1", ["foo", "12", "x1"]),
        (predicates.tick_junk, "7 7 4 4", True),
        (predicates.tick_junk, "0.4 a", False),
        (predicates.caption_kind, "0.12Figure 1: Latency", "figure"),
        (predicates.caption_kind, "Fig. 2 shows", None),
        (predicates.glyph_only, "⟦?⟧ , ⟦?⟧", True),
        (tables.cut_json, 'Sure: {"a": [1]} done', '{"a": [1]}'),
        (tables.cut_json, "```json\n[1, 2]\n```", "[1, 2]"),
    ],
)
def test_scalars(spark, expression, x, want):
    got = value(spark, expression(F.col("x")), x=x)
    if want == "doc-0d1b":
        assert got.startswith("doc-") and len(got) == 8
    else:
        assert got == want


@pytest.mark.parametrize("x, flagged", [(r"$\langle ? \rangle$", True), (r"\left[\;\right]", True), (r"\begin{matrix} \\ \end{matrix}", True), (r"\begin{array}{c} \\ \end{array}", True), (r"\begin{matrix} a & b \end{matrix}", False), ("$a + b = c$", False)])
def test_unrepaired(spark, x, flagged):
    assert bool(value(spark, mathtext.unrepaired(F.col("x"), F.lit(True)), x=x)) == flagged
    assert value(spark, mathtext.unrepaired(F.col("x"), F.lit(False)), x="$?=$") == []


def test_lines_join(spark):
    join = lambda lines, known: value(spark, text.join_lines(F.col("l"), F.col("k")), l=lines, k=known)
    assert join(["an ac-", "cess and multi-", "index of key-", "frame"], ["key-frame"]) == "an access and multi-index of key-frame"
    assert join(["ends in A-", "Z", " "], ["x"]) == "ends in A- Z"


def test_batches(spark):
    got = value(spark, segment.batches_of(F.col("l").cast("array<int>"), 3, 10), l=[4, 4, 4, 20, 1, 1, 1, 1])
    assert [(b.n, b.chars) for b in got] == [(2, 8), (1, 4), (1, 20), (3, 3), (1, 1)]


def test_pseudocode(spark):
    lines = ["Algorithm 1: search", "10 for x in y do", "11 if x then", "12 return x", "Input: a Output: b"]
    assert value(spark, predicates.pseudocode_score(F.col("l")), l=lines) == 8


def test_provider_recovers_dropped_items():
    items = [{"id": i, "lang": "en", "text": "t"} for i in range(5)]

    class Drops:
        def translate(self, items, strict=False):
            return [{"id": x["id"], "zh": "z"} for k, x in enumerate(items) if k != 1 or len(items) < 3]

    assert set(provider.translate_batch(items, Drops())) == set(range(5))

    class Fails:
        def translate(self, items, strict=False):
            if len(items) > 1:
                raise ValueError
            return [{"id": items[0]["id"], "zh": "z"}]

    assert len(provider.translate_batch(items, Fails())) == 5


def test_fragments_and_holes(spark):
    p = spark.createDataFrame([(1, 1, "equation", "x$a$ ⟦?⟧⟦?⟧"), (1, 2, "text", "⟦?⟧⟦?⟧"), (1, 3, "text", "more")], "doc_id long, pos int, kind string, text string")
    out = ordered.merge_glyph_fragments(p).orderBy("pos").collect()
    assert [r.text.count("⟦?⟧") for r in out] == [4, 0]
    holes = quality.id_holes(spark.createDataFrame([(1, 1), (1, 4), (2, 7)], "k int, n int"), "k", "n").collect()
    assert sorted(map(tuple, holes)) == [(1, 2), (1, 3)]


def test_protocol_gate(spark):
    keep = quality.keeps_content(F.col("a"), F.col("b"), F.lit(3))
    assert value(spark, keep, a="take 10 cells and 20 keys", b="take 10 cells, 20 keys")
    assert not value(spark, keep, a="take 10 cells and 20 keys", b="take cells and 20 keys")


def test_layout(spark):
    words = spark.createDataFrame([(1, 1, k, float(x), float(x + 20), float(y), t) for k, (x, y, t) in enumerate([(10, 10, "Name"), (100, 10, "Use"), (10, 22, "k"), (100, 23, "key"), (10, 34, "n"), (100, 34, "size")])], "doc_id long, page int, word long, x0 double, x1 double, y double, t string")
    rules = spark.createDataFrame([(1, 1, 5.0, 0.0, 200.0), (1, 1, 40.0, 0.0, 200.0), (1, 1, 300.0, 0.0, 90.0)], "doc_id long, page int, y double, x0 double, x1 double")
    regions = layout.regions_of_rules(rules)
    assert [r.cells for r in layout.grids(words, regions).orderBy("row").collect()] == [["Name", "Use"], ["k", "key"], ["n", "size"]]
    captions = spark.createDataFrame([(1, 1, "Table 1: names", 0.0, 100.0, 45.0), (1, 1, "far", 0.0, 100.0, 400.0)], "doc_id long, page int, text string, x0 double, x1 double, y0 double")
    assert layout.nearest_caption(regions, captions).first().caption == "Table 1: names"
    blocks = [(1, 1, k, *b) for k, b in enumerate([(0, 0, 200, 10), (110, 20, 200, 30), (0, 20, 90, 30), (0, 40, 90, 50), (0, 60, 90, 70), (110, 40, 200, 50), (110, 60, 200, 70), (0, 90, 200, 99)])]
    order = layout.reading_order(spark.createDataFrame([(*b[:3], *map(float, b[3:])) for b in blocks], "doc_id long, page int, block int, x0 double, y0 double, x1 double, y1 double"), 200).orderBy("order").collect()
    assert [r.block for r in order] == [0, 2, 3, 4, 1, 5, 6, 7]


def test_sources(spark, tmp_path):
    log = spark.createDataFrame([("d", "t", "p", "s", "q")], tables.QA_SCHEMA)
    tables.append_log(log, f"{tmp_path}/log")
    tables.append_log(log, f"{tmp_path}/log")
    (tmp_path / "log" / "bad.json").write_text("{no json\n")
    assert tables.read_log(spark, f"{tmp_path}/log").count() == 2
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.k for r in tables.delete(old, new, ["k"]).collect()] == [1]
    assert tables.layered({"a": "1", "b": "2"}, None, {"b": "3", "c": ""}) == {"a": "1", "b": "3"}
    page = export.pages(spark.createDataFrame([(1, "A <title>")], "doc_id long, title string"), spark.createDataFrame([(1, 1, "p0001", "</script>")], "doc_id long, pos int, id string, text string")).first()
    assert page.name.startswith("a-title-") and page.html.count("</script>") == 1 and "&lt;title&gt;" in page.html
    done = migrate.todo(old, spark.createDataFrame([(1, "x"), (2, " ")], "k int, zh string"), ["k"], "zh").collect()
    assert [r.k for r in done] == [2]
