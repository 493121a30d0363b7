"""Blocks of rich text and of recognised pages, and what an exported page must show: rules by tags and their nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.mathtext import count
from quire.functions.text import html_escape, strip
from quire.operators.review import split_math

#: What the lines of a list, a quotation and the rule under a table's head look like.
BULLET, NUMBER, QUOTE, TABLE_RULE = r"^\s*[-*•]\s+", r"^\s*[0-9]+[.)]\s+", r"^\s*>\s?", r"^\s*\|?[\s:|-]+\|[\s:|-]*$"
#: Inline marks and what they become, in order.
MARKS = ((r"`([^`]+)`", "<code>$1</code>"), (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"(^|[^*A-Za-z0-9_])\*([^*\n]+)\*", "$1<em>$2</em>"), (r"\[([^\]]+)\]\((https?:[^)\s]+)\)", '<a href="$2">$1</a>'), (r"\\([*_`$#>\[\]-])", "$1"))


def inline_html(text: Column) -> Column:
    """A line with its inline marks as HTML; formulas keep their characters, escaped."""

    def plain(t: Column) -> Column:
        t = html_escape(t)
        for mark, made in MARKS:
            t = F.regexp_replace(t, mark, made)
        return t

    formula = lambda p: p.rlike(r"(?s)^(\$.*\$|\\\(.*\\\)|\\\[.*\\\])$") & (F.length(p) > 1)
    return F.array_join(F.transform(split_math(text), lambda p: F.when(formula(p), html_escape(p)).otherwise(plain(p))), "")


def _cells(line: Column) -> Column:
    cells = F.transform(F.split(line, r"\|"), strip)
    return F.filter(cells, lambda c, i: (c != "") | ((i > 0) & (i < F.size(cells) - 1)))


def block_of(block: Column) -> Column:
    """A block as (kind, level, lines): fence, display math, heading, bullets, numbers, quote, table (lines are rows, cells parted by tabs), paragraph."""
    t, lines = strip(block), F.split(block, "\n")
    every = lambda pattern: F.forall(lines, lambda line: line.rlike(pattern))
    bare = lambda pattern: F.transform(lines, lambda line: F.regexp_replace(line, pattern, ""))
    made = lambda kind, items, level=F.lit(0): F.struct(F.lit(kind).alias("kind"), level.alias("level"), items.alias("lines"))
    table = (F.size(lines) >= 2) & F.get(lines, F.lit(0)).contains("|") & F.coalesce(F.get(lines, F.lit(1)).rlike(TABLE_RULE), F.lit(False))
    rows = F.filter(F.transform(lines, lambda line, i: F.when((i != 1) & ((i == 0) | (strip(line) != "")), F.array_join(_cells(line), "\t"))), lambda r: r.isNotNull())
    return (
        F.when(t.rlike(r"(?s)^```[\w+-]*\n?.*```$") & (F.length(t) >= 6), made("fence", F.array(F.regexp_extract(t, r"(?s)^```[\w+-]*\n?(.*?)```$", 1))))
        .when(t.rlike(r"(?s)^\$\$.*\$\$$|^\\\[.*\\\]$") & (F.length(t) >= 4), made("display math", F.array(t)))
        .when(t.rlike(r"^#{1,6}\s+\S[^\n]*$"), made("heading", F.array(F.regexp_extract(t, r"^#{1,6}\s+(.*)$", 1)), F.length(F.regexp_extract(t, "^(#+)", 1))))
        .when(every(BULLET), made("bullets", bare(r"^\s*(?:[-*•]|[0-9]+[.)])\s+")))
        .when(every(NUMBER), made("numbers", bare(r"^\s*(?:[-*•]|[0-9]+[.)])\s+")))
        .when(every(QUOTE), made("quote", bare(QUOTE)))
        .when(table, made("table", rows))
        .otherwise(made("paragraph", lines))
    )


def rich_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block from 1, kind, level, lines of every whole text, parted at blank lines; within a row."""
    whole = F.filter(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), r"\n{2,}"), lambda b: strip(b) != "")
    d = docs.select("doc_id", F.posexplode(whole).alias("_k", "_b"))
    return d.select("doc_id", (F.col("_k") + 1).alias("block"), block_of(F.col("_b")).alias("_x")).select("doc_id", "block", "_x.*")


def block_html(kind: Column, level: Column, lines: Column) -> Column:
    """A block of rich_blocks as HTML; what opens in it closes in it."""
    joined = lambda before, after: F.array_join(F.transform(lines, lambda line: F.concat(F.lit(before), inline_html(line), F.lit(after))), "")
    broken = F.array_join(F.transform(lines, inline_html), "<br>")
    first = html_escape(F.get(lines, F.lit(0)))
    tag = F.concat(F.lit("h"), F.least(F.greatest(level, F.lit(1)), F.lit(4)).cast("string"))
    row = lambda line, name: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(line, "\t"), lambda c: F.concat(F.lit(f"<{name}>"), inline_html(c), F.lit(f"</{name}>"))), ""), F.lit("</tr>"))
    table = F.concat(F.lit("<table><thead>"), row(F.get(lines, F.lit(0)), "th"), F.lit("</thead><tbody>"), F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda line: row(line, "td")), ""), F.lit("</tbody></table>"))
    return (
        F.when(kind == "fence", F.concat(F.lit("<pre>"), first, F.lit("</pre>")))
        .when(kind == "display math", F.concat(F.lit('<div class="eq">'), first, F.lit("</div>")))
        .when(kind == "heading", F.concat(F.lit("<"), tag, F.lit(">"), inline_html(F.get(lines, F.lit(0))), F.lit("</"), tag, F.lit(">")))
        .when(kind == "bullets", F.concat(F.lit("<ul>"), joined("<li>", "</li>"), F.lit("</ul>")))
        .when(kind == "numbers", F.concat(F.lit("<ol>"), joined("<li>", "</li>"), F.lit("</ol>")))
        .when(kind == "quote", F.concat(F.lit("<blockquote>"), broken, F.lit("</blockquote>")))
        .when(kind == "table", table)
        .otherwise(F.concat(F.lit("<p>"), broken, F.lit("</p>")))
    )


def rich_html(text: Column) -> Column:
    """A text with all its blocks as HTML."""
    whole = F.filter(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), r"\n{2,}"), lambda b: strip(b) != "")
    return F.array_join(F.transform(F.transform(whole, block_of), lambda b: block_html(b["kind"], b["level"], b["lines"])), "")


#: Fixed value: a first line that is the title of an algorithm or protocol.
TITLE = r"(?i)^\s*(algorithm|protocol|算法|协议)\s*[0-9]+\s*[:：]"


def algorithm_html(lines: Column, protocol: Column, source: bool) -> Column:
    """What stands in the cell of an algorithm: its protocol (title, setup, steps of text and subs, title_en, lines_en), else its lines.

    The source side shows a protocol's own lines, the other its steps, setup first; without any of these the lines follow,
    a title among them set apart. Null where there is nothing.
    """
    divs = lambda xs, name: F.array_join(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f'<div class="{name}">'), html_escape(x), F.lit("</div>"))), "")
    head = lambda t: F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit('<div class="pt">'), html_escape(t), F.lit("</div>"))).otherwise("")
    subs = lambda s: F.when(F.size(s["subs"]) > 0, F.concat(F.lit('<ol class="subs">'), F.array_join(F.transform(s["subs"], lambda x: F.concat(F.lit("<li>"), rich_html(x), F.lit("</li>"))), ""), F.lit("</ol>"))).otherwise("")
    step = lambda s: F.concat(F.lit("<li>"), rich_html(s["text"]), subs(s), F.lit("</li>"))
    box = lambda name, *parts: F.concat(F.lit(f'<div class="{name}">'), *parts, F.lit("</div>"))
    own = F.when((F.size(protocol["lines_en"]) > 0) | (F.coalesce(protocol["title_en"], F.lit("")) != ""), box("proto", head(protocol["title_en"]), divs(protocol["lines_en"], "algline")))
    steps = F.when(F.size(protocol["steps"]) > 0, box("proto", head(protocol["title"]), divs(protocol["setup"], "in"), F.lit('<ol class="steps">'), F.array_join(F.transform(protocol["steps"], step), ""), F.lit("</ol>")))
    titled = F.get(lines, F.lit(0)).rlike(TITLE)
    plain = F.when(titled, F.concat(head(strip(F.get(lines, F.lit(0)))), divs(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "algline"))).otherwise(divs(lines, "algline"))
    return F.coalesce(own if source else steps, F.when(F.size(lines) > 0, box("algobox", plain)))


def recognised_paragraphs(docs: DataFrame, most: int = 900) -> DataFrame:
    """doc_id, pos from 1, text of recognised pages (doc_id, text): parted at blank lines; long blocks in slices, in others a line without an end mark goes on."""
    blocks = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), strip), lambda b: b != "")
    slices = lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.length(b) - 1) / most).cast("int")), lambda k: F.substring(b, k * most + 1, F.lit(most)))
    whole = F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) > most, slices(b)).otherwise(F.array(F.regexp_replace(b, r"(?<![.!?:;])\n", " ")))))
    d = docs.select("doc_id", F.posexplode(whole).alias("_k", "text"))
    return d.select("doc_id", (F.col("_k") + 1).alias("pos"), "text")


#: Tags that have to be even, block elements that no cell may hold, columns from which a table is wide.
EVEN, BLOCKS, WIDE = ("div", "table", "tr", "td", "th", "ol", "li"), ("p", "div", "ul", "ol", "table"), 8
TAG = r"<(/?)([A-Za-z][A-Za-z0-9]*)([^>]*)>"


def tag_events(pages: DataFrame) -> DataFrame:
    """page_id, at, name, step (1 opens, -1 closes), attributes, in_cell, in_table of the tags of pages (page_id, html), scripts and styles aside.

    Depths are running sums of what opened and closed before; elements that close at once change nothing.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script\b.*?</script>", ""), r"(?is)<style\b.*?</style>", "")
    part = lambda k: F.regexp_extract(F.col("_t"), f"(?s)^{TAG}$", k)
    e = pages.select("page_id", F.posexplode(F.regexp_extract_all(bare, F.lit(f"(?s){TAG}"), F.lit(0))).alias("at", "_t"))
    e = e.select("page_id", "at", F.lower(part(2)).alias("name"), F.when(part(1) == "/", -1).when(part(3).endswith("/"), 0).otherwise(1).alias("step"), part(3).alias("attributes"))
    before = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    depth = lambda names: F.coalesce(F.sum(F.when(F.col("name").isin(*names), F.col("step")).otherwise(0)).over(before), F.lit(0))
    return e.withColumns({"in_cell": depth(("td", "th")), "in_table": depth(("table",))})


def html_report(pages: DataFrame) -> DataFrame:
    """page_id, rule, found: for every page and rule how often it is broken; 0 passes."""
    e = tag_events(pages)
    has = lambda name: F.col("attributes").rlike(rf'class\s*=\s*"[^"]*\b{name}\b[^"]*"')
    opens = F.col("step") >= 0
    sure = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    kind = F.when(F.col("name") == "div", F.when(has("tblbox"), "tblbox").when(has("tcap"), "tcap"))
    boxes = e.filter(opens & kind.isNotNull()).withColumn("_kind", kind).withColumn("_k", F.row_number().over(Window.partitionBy("page_id").orderBy("at")))
    order = boxes.groupBy("page_id").agg(F.when(F.count("*") >= 2, F.count_if(F.col("_kind") != F.when(F.col("_k") % 2 == 1, "tblbox").otherwise("tcap"))).otherwise(0).alias("caption order"))
    columns = F.regexp_extract("attributes", r'data-cols="([0-9]+)"', 1).try_cast("int")
    rules = {f"even {t}": F.abs(F.sum(F.when(F.col("name") == t, F.col("step")).otherwise(0))) for t in EVEN}
    rules |= {
        "blocks in cells": F.count_if(opens & F.col("name").isin(*BLOCKS) & (F.col("in_cell") > 0)),
        "wide tables": F.count_if(opens & (F.col("name") == "table") & (columns >= WIDE) & ~has("sm")),
        "terms in tables": F.count_if(opens & has("term") & (F.col("in_table") > 0)),
    }
    by_tag = e.groupBy("page_id").agg(*[v.alias(k) for k, v in rules.items()])
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, "<[^>]+>", "\n")
    formulas = F.regexp_extract_all(text, F.lit(r"\$([^$\n]{0,200})\$"), F.lit(1))
    raw = lambda m: (m.contains("<") & ~m.contains("&lt;")) | (m.contains(">") & ~m.contains("&gt;"))
    no_script = F.regexp_replace(html, r"(?is)<script\b.*?</script>", "")
    texts = {
        "even dollars": count(F.replace(html, F.lit("\\$"), F.lit("")), r"\$") % 2,
        "bare angles": F.size(F.filter(formulas, raw)),
        "tick rows": count(no_script, r'<div class="fline">\s*[0-9.]+(?:\s+[0-9.]+)+\s*</div>'),
        "bullets": count(no_script, "•"),
    }
    all_ = [*rules, "caption order", *texts]
    p = pages.select("page_id", *[v.alias(k) for k, v in texts.items()]).join(by_tag, "page_id", "left").join(order, "page_id", "left")
    return p.select("page_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), sure(F.col(f"`{r}`")).alias("found")) for r in all_])).alias("_r")).select("page_id", "_r.*")
