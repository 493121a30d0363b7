"""Blocks of rich text as HTML against a plain reader, recognised pages, and rules of exported pages."""

from pyspark.sql import functions as F

from quire.operators import blocks

TEXT = """# Title with $a*b$

- one **bold** `x<y`
- two *em* and [link](https://e.org)

1. first
2) second

> said
> so

| h1 | h2 |
|----|:--:|
| a |  |
|  | d* |

```py
if a < b: pass
```

$$x < y$$

plain \\* line
next

- half
no list

#nothing
"""


def test_rich_text(spark):
    d = spark.createDataFrame([(1, TEXT), (2, None), (3, " \n\n \n"), (4, "```\nopen only"), (5, "####### seven")], "doc_id long, text string")
    got = blocks.rich_blocks(d).withColumn("html", blocks.block_html(F.col("kind"), F.col("level"), F.col("lines"))).orderBy("doc_id", "block").collect()
    one = [g for g in got if g.doc_id == 1]
    assert [g.kind for g in one] == ["heading", "bullets", "numbers", "quote", "table", "fence", "display math", "paragraph", "paragraph", "paragraph"]
    assert one[0].html == "<h1>Title with $a*b$</h1>" and one[1].html == '<ul><li>one <strong>bold</strong> <code>x&lt;y</code></li><li>two <em>em</em> and <a href="https://e.org">link</a></li></ul>'
    assert one[2].html == "<ol><li>first</li><li>second</li></ol>" and one[3].html == "<blockquote>said<br>so</blockquote>"
    assert one[4].html == "<table><thead><tr><th>h1</th><th>h2</th></tr></thead><tbody><tr><td>a</td><td></td></tr><tr><td></td><td>d*</td></tr></tbody></table>"
    assert one[5].html == "<pre>if a &lt; b: pass\n</pre>" and one[6].html == '<div class="eq">$$x &lt; y$$</div>' and one[7].html == "<p>plain * line<br>next</p>"
    assert [(g.doc_id, g.kind) for g in got if g.doc_id > 1] == [(4, "paragraph"), (5, "paragraph")]
    pages = spark.createDataFrame([(g.doc_id * 100 + g.block, g.html) for g in got], "page_id long, html string")
    assert {r.found for r in blocks.html_report(pages).filter("rule LIKE 'even%' OR rule = 'blocks in cells'").collect()} == {0}


def test_recognised_pages(spark):
    d = spark.createDataFrame([(1, "one\ntwo.\nthree\n \t\n" + "x" * 1900 + "\n\n\n"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.pos, r.text) for r in blocks.recognised_paragraphs(d).collect()] == [(1, 1, "one two.\nthree"), (1, 2, "x" * 900), (1, 3, "x" * 900), (1, 4, "x" * 100)]


def test_nesting(spark):
    rows = [(1, "<table><tr><td>a<i><b><p>deep</p></b></i></td></tr></table><p>out</p>"), (2, "<table><tr><td>a</td></tr></table><div class='x'>"), (3, None), (4, '<TABLE data-cols="8"><td><span class="a term">t</span></td></TABLE><span class="term">o</span><br/>')]
    got = {(r.page_id, r.rule): r.found for r in blocks.html_report(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1, "blocks in cells"] == 1 and got[2, "blocks in cells"] == 0 and got[2, "even div"] == 1
    assert got[4, "terms in tables"] == 1 and got[4, "wide tables"] == 1 and got[4, "even table"] == 0
    assert {v for (p, _), v in got.items() if p == 3} == {0}
