"""Registered queries over spans, glyphs, tables, figures and document sets, each with SQL for the same rows.

What the tables lack (fonts, sizes, boxes, results of a model) is put in by the same expression in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.catalog import PARAGRAPHS, _paragraphs
from quire.functions import glyphs, mathtext, predicates, text
from quire.operators import quality, spans, structured
from quire.registry import query
from quire.sources import tables
from quire.sources.tables import table

#: Paragraphs of plain letters, commas and stops, without those that nothing is left of.
LETTERS = f"""{PARAGRAPHS}, letters AS (SELECT * FROM (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(text, '[^A-Za-z.,]+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS t FROM paragraphs) WHERE t <> ''),
words AS (SELECT doc_id, pos, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) - 1 AS k FROM letters)"""


def _letters(spark, sf_dir) -> DataFrame:
    p = _paragraphs(spark, sf_dir).withColumn("t", F.trim(F.regexp_replace("text", "[^A-Za-z.,]+", " ")))
    return p.filter("t <> ''")


def _spans(spark, sf_dir) -> DataFrame:
    """Each word a span, 16 to a line: every fourth one small and raised at the one before, every eighth a Greek letter."""
    w = _letters(spark, sf_dir).select("doc_id", "pos", F.posexplode(F.split("t", " ")).alias("span", "w"))
    raised, greek = F.col("span") % 4 == 3, F.col("span") % 8 == 5
    x0 = F.col("span") * 100.0 - F.when(raised, 40.0).otherwise(0.0)
    return w.select("doc_id", F.lit(1).alias("page"), F.col("pos").alias("block"), F.floor(F.col("span") / 16).cast("int").alias("line"), "span", F.when(greek, "α").otherwise(F.col("w")).alias("text"), F.when(greek, "ABCDEF+CMMI10").otherwise(F.lit("CMR10")).alias("font"), F.when(raised, 6.0).otherwise(10.0).alias("size"), F.when(raised, 96.0).otherwise(100.0).alias("oy"), x0.alias("x0"), (x0 + 60.0).alias("x1"))


@query(f"""WITH {LETTERS} SELECT doc_id, CAST(pos AS INTEGER) AS block, CAST(k // 16 AS INTEGER) AS line, md5(string_agg(CASE WHEN k % 4 = 3 THEN '$^{{' || w || '}}$'
  WHEN k % 8 = 5 THEN '$\\alpha$' WHEN k % 16 = 0 THEN w ELSE ' ' || w END, '' ORDER BY k)) AS text FROM words GROUP BY doc_id, pos, k // 16""")
def dec_formula_lines(spark, sf_dir):
    return spans.formula_lines(_spans(spark, sf_dir)).select("doc_id", "block", "line", F.md5("text").alias("text"))


@query(f"""WITH {LETTERS}, s AS (SELECT doc_id, CASE WHEN k % 4 = 3 THEN 6.0 ELSE 10.0 END AS size, sum(CASE WHEN k % 8 = 5 THEN 1 ELSE length(w) END) AS n, min(pos * 1000000 + k) AS first FROM words GROUP BY ALL)
SELECT doc_id, CAST(arg_max(size, (n, -first)) AS DOUBLE) AS body_size FROM s GROUP BY doc_id""")
def dec_body_size(spark, sf_dir):
    return spans.body_size(_spans(spark, sf_dir))


@query(f"""WITH {LETTERS}, s AS (SELECT doc_id, pos, CASE WHEN k % 4 = 3 THEN 6.0 ELSE 10.0 END AS size, count(*) AS n, min(k) AS first FROM words GROUP BY ALL)
SELECT doc_id, CAST(pos AS INTEGER) AS block, CAST(arg_max(size, (n, -first)) AS DOUBLE) AS size, false AS bold FROM s GROUP BY doc_id, pos""")
def dec_block_sizes(spark, sf_dir):
    return spans.block_sizes(_spans(spark, sf_dir)).select("doc_id", "block", "size", "bold")


#: Blocks with gaps of 2 to 17 and two sizes; every third begins in lower case.
@query(f"""WITH {LETTERS}, b AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN lower(t) ELSE t END AS t, CASE WHEN pos % 7 = 0 THEN 14 ELSE 10 END AS size, pos * 20 AS y0, pos * 20 + 18 - (pos * 5) % 16 AS y1 FROM letters),
f AS (SELECT *, CASE WHEN size = lag(size) OVER w AND y0 - lag(y1) OVER w < 1.6 * size AND (regexp_matches(t, '^[a-z(]') OR (NOT regexp_matches(lag(t) OVER w, '[.:;!?]$') AND y0 - lag(y1) OVER w < 0.9 * size)) THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM f)
SELECT doc_id, CAST(part AS INTEGER) AS part, md5(string_agg(t, ' ' ORDER BY pos)) AS text, CAST(min(y0) AS DOUBLE) AS y0, CAST(arg_max(y1, pos) AS DOUBLE) AS y1, count(*) AS blocks FROM i GROUP BY doc_id, part""")
def dec_block_merge(spark, sf_dir):
    pos = F.col("pos")
    b = _letters(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), pos.alias("block"), F.when(pos % 3 == 0, F.lower("t")).otherwise(F.col("t")).alias("text"), F.when(pos % 7 == 0, 14.0).otherwise(10.0).alias("size"), (pos * 20.0).alias("y0"), (pos * 20.0 + 18 - (pos * 5) % 16).alias("y1"))
    m = spans.merge_blocks(b)
    return m.select("doc_id", "part", F.md5("text").alias("text"), "y0", "y1", F.col("blocks").cast("long").alias("blocks"))


@query(f"""WITH {PARAGRAPHS}, w AS (SELECT doc_id, pos, length(text) AS size, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM paragraphs),
e AS (SELECT *, sum(length(w) + 1) OVER o - 1 AS place, sum(length(w) - length(replace(w, '$', ''))) OVER o AS dollars FROM w WINDOW o AS (PARTITION BY doc_id, pos ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(coalesce(arg_min(place, abs(place - size // 2) * 1000000000 + place) FILTER (dollars % 2 = 0 AND place < size AND size >= 2), any_value(size) // 2) AS INTEGER) AS split FROM e GROUP BY doc_id, pos""")
def snap_splits(spark, sf_dir):
    half = F.floor(F.length("text") / 2).cast("int")
    return _paragraphs(spark, sf_dir).select("doc_id", "pos", spans.snap_split(F.col("text"), half).cast("int").alias("split"))


@query(f"""WITH {LETTERS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(rtrim(replace(replace(replace(t, 'a', '\\alpha '), 'e', '\\leq '), '  ', ' '), ' ')) AS tex FROM letters""")
def dec_latex(spark, sf_dir):
    return _letters(spark, sf_dir).select("doc_id", "pos", F.md5(glyphs.as_formula(F.translate("t", "ae", "α≤"))).alias("tex"))


FONTS = ("CMMI10", "CMR10", "Times-Bold", "STIXMath-Regular", "CambriaMath", "ArialMT-Black", "LiberationSerif", "Euler-Medium")


@query("SELECT p_partkey, lower(['CMMI10', 'CMR10', 'Times-Bold', 'STIXMath-Regular', 'CambriaMath', 'ArialMT-Black', 'LiberationSerif', 'Euler-Medium'][p_partkey % 8 + 1]) AS font, p_partkey % 8 IN (0, 3, 4, 7) AS math, p_partkey % 8 IN (2, 5) AS bold FROM part")
def dec_fonts(spark, sf_dir):
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "VFYNJW+").otherwise(""), F.get(F.array(*map(F.lit, FONTS)), (F.col("p_partkey") % 8).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", glyphs.normal_font(name).alias("font"), glyphs.math_font(name).alias("math"), glyphs.bold_font(name).alias("bold"))


@query(r"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 256 = 65 THEN '\sum' WHEN c_custkey % 5 = 0 THEN '\big(' WHEN c_custkey % 5 = 1 THEN '\sum' END AS command FROM customer""")
def dec_glyph_commands(spark, sf_dir):
    key = F.col("c_custkey")
    code = F.pmod(key, F.lit(256))
    at = F.when(key % 5 == 1, code).otherwise(65)
    program = F.concat(F.lit("%!PS /Encoding 256 array dup "), F.when(key % 5 == 0, code).otherwise(300).cast("string"), F.lit(" /parenleftBig put\ndup "), at.cast("string"), F.lit(" /summationdisplay put dup 301 /unknown put"))
    char = F.char(code)
    d = table(spark, sf_dir, "customer").select("c_custkey", F.when(code == 0, "\0").when(code < 128, char).otherwise(F.expr("decode(encode(char(c_custkey % 256), 'ISO-8859-1'), 'ISO-8859-1')")).alias("c"), F.when(key % 3 == 2, "CMR10").otherwise(F.lit("CMEX10")).alias("font"), glyphs.encoding(program).alias("codes"))
    return d.select("c_custkey", glyphs.glyph_command(F.col("c"), F.col("font"), F.col("codes")).alias("command"))


#: An order's lines as a grid under a header; every fifth comment cell is blank.
GRID = """cells AS (SELECT l_orderkey, l_linenumber, 'f|' || l_returnflag AS flag, CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE l_linestatus END AS status FROM lineitem)"""


def _grids(spark, sf_dir) -> DataFrame:
    cell = lambda c: F.struct(c.cast("string").alias("text"), F.lit(1).alias("span"))
    row = F.array(cell(F.col("l_linenumber")), cell(F.concat(F.lit("f|"), "l_returnflag")), cell(F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(F.col("l_linestatus"))))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", row.alias("r")))).alias("_l"))
    head = F.array(*[cell(F.lit(t)) for t in ("line", "flag", "status")])
    return g.select("l_orderkey", F.concat(F.array(head), F.transform("_l", lambda x: x["r"])).alias("rows"))


@query(f"""WITH {GRID} SELECT l_orderkey, md5('| line | flag | status |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || replace(flag, '|', '\\|') || ' | ' || status || ' |', chr(10) ORDER BY l_linenumber, flag, status)) AS markdown,
  true AS tabular FROM cells GROUP BY l_orderkey""")
def grid_markdown(spark, sf_dir):
    g = _grids(spark, sf_dir)
    return g.select("l_orderkey", F.md5(structured.markdown(F.col("rows"), F.lit(1))).alias("markdown"), structured.looks_like_table(F.col("rows"), F.lit(3)).alias("tabular"))


#: A model's cells: orders by 5 lose a row, orders by 7 a column; blank cells come back for every fourth line.
@query(f"""WITH {GRID} SELECT l_orderkey, CASE WHEN l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 0 THEN md5('zh:line,zh:flag,zh:status,' || string_agg(CASE WHEN l_linenumber = 4 THEN concat_ws(',', l_linenumber, flag, status) ELSE 'zh:' || l_linenumber || ',zh:' || flag || ',zh:' || status END, ',' ORDER BY l_linenumber, flag, status)) END AS cells FROM cells GROUP BY l_orderkey""")
def dec_table_zip(spark, sf_dir):
    key = F.col("l_orderkey")
    said = F.transform("rows", lambda r: F.transform(r, lambda c: F.when(r[0]["text"] == "4", " ").otherwise(F.concat(F.lit("zh:"), c["text"]))))
    said = F.when(key % 5 == 0, F.slice(said, 2, F.size(said))).when(key % 7 == 0, F.transform(said, lambda r: F.slice(r, 1, 2))).otherwise(said)
    zipped = F.flatten(structured.apply_rows(F.col("rows"), said))
    return _grids(spark, sf_dir).select("l_orderkey", F.md5(F.array_join(F.transform(zipped, lambda c: c["text"]), ",")).alias("cells"))


@query("SELECT l_orderkey, l_orderkey % 4 = 0 OR l_orderkey % 6 = 0 AS stale, CASE WHEN l_orderkey % 3 = 0 THEN 'no result' WHEN l_orderkey % 4 = 0 THEN 'columns' WHEN l_orderkey % 5 = 0 THEN 'numbers' ELSE '' END AS conformance FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def dec_stale_tables(spark, sf_dir):
    key = F.col("l_orderkey")
    columns = F.when(key % 4 == 0, 4).otherwise(3)
    result = F.when(key % 6 == 0, F.slice("rows", 2, F.size("rows"))).otherwise(F.col("rows"))
    g = _grids(spark, sf_dir)
    stale = structured.stale_table(F.lit(3), F.col("rows"), columns, result)
    said = lambda c: F.when(key % 5 == 0, F.translate(c["text"], "1234567", "")).otherwise(c["text"])
    numbers = lambda r, f: quality.numbers(F.array_join(F.transform(F.flatten(r), f), " "))
    lost = F.size(F.array_except(numbers(F.col("rows"), lambda c: c["text"]), numbers(result, said))) > 0
    return g.select("l_orderkey", stale.alias("stale"), F.when(key % 3 == 0, "no result").when(columns != 3, "columns").when(lost, "numbers").otherwise("").alias("conformance"))


#: Turns as an algorithm's lines; a reply repeats them, changes them or drops the last one.
TURNS = "SELECT conv_id, list(text ORDER BY turn, text) AS lines FROM conversations GROUP BY conv_id"
PROSE2, PROSE4 = "[A-Za-z]{3,}[ \\t\\n\\x0B\\f\\r]+[A-Za-z]{3,}", "([A-Za-z][A-Za-z''-]*[ \\t]+){3,}[A-Za-z][A-Za-z''-]*"


def _turns(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("lines"))
    key = F.col("conv_id") % 3
    reply = F.when(key == 0, F.col("lines")).when(key == 1, F.transform("lines", lambda x: F.concat(F.lit("译"), x))).otherwise(F.slice("lines", 2, F.size("lines")))
    return t.withColumn("reply", reply)


@query(f"""WITH t AS ({TURNS}) SELECT conv_id, CASE WHEN conv_id % 3 = 1 THEN len(lines) WHEN conv_id % 3 = 0 AND NOT list_bool_or(list_transform(lines, lambda x: regexp_matches(x, '{PROSE2}'))) THEN len(lines) ELSE 0 END AS lines,
  CASE WHEN conv_id % 3 = 0 THEN list_bool_or(list_transform(lines, lambda x: regexp_matches(x, '{PROSE4}'))) WHEN conv_id % 3 = 1 THEN false ELSE len(lines) > 1 END AS stale FROM t""")
def dec_algorithm_zip(spark, sf_dir):
    done = structured.apply_lines(F.col("lines"), F.col("reply"))
    return _turns(spark, sf_dir).select("conv_id", F.coalesce(F.size(done), F.lit(0)).cast("long").alias("lines"), structured.stale_algorithm(F.col("lines"), F.col("reply")).alias("stale"))


@query("""WITH t AS (SELECT conv_id, list(text ORDER BY turn, text) AS lines FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 4 IN (0, 1) THEN 'Figure ' || conv_id ELSE NULL END AS caption, CASE WHEN conv_id % 4 IN (0, 1) THEN 'LAION' END AS first_item, CASE WHEN conv_id % 4 IN (0, 1) THEN 1 END AS groups FROM t""")
def dec_figures(spark, sf_dir):
    key = F.col("conv_id")
    caption = F.when(key % 4 == 2, " ").otherwise(F.concat(F.lit(" Figure "), key.cast("string")))
    note = F.when(key % 4 == 3, "").otherwise(F.lit("note"))
    groups = F.array(F.struct(F.lit("data").alias("label"), F.array(F.lit("LAION（laion）"), F.lit(" ")).alias("items")), F.struct(F.lit(" ").alias("label"), F.array(F.lit("x")).alias("items")), F.struct(F.lit("empty").alias("label"), F.array(F.lit("")).alias("items")))
    done = structured.apply_figure(F.col("lines"), caption, note, F.lit(None).cast("array<string>"), groups)
    d = _turns(spark, sf_dir).select("conv_id", done.alias("f"))
    return d.select("conv_id", "f.caption", F.get(F.get("f.groups", F.lit(0))["items"], F.lit(0)).alias("first_item"), F.when(F.col("f").isNotNull(), F.size("f.groups")).cast("int").alias("groups"))


@query("""WITH t AS (SELECT conv_id, list(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS c FROM conversations GROUP BY conv_id)
SELECT conv_id, 'Figure ' || conv_id || CASE WHEN NOT list_bool_or(list_transform(c, lambda x: length(x) > 30 OR regexp_matches(x, '[.。;；]$'))) THEN ' (diagram)' WHEN conv_id % 2 = 0 THEN ' (plot)' ELSE ' (reproduced)' END AS mark FROM t""")
def dec_figure_marks(spark, sf_dir):
    labels = F.when(F.col("conv_id") % 2 == 0, F.array(*map(F.lit, ("0.1", "0.2", "3 4", "5", "a", "b")))).otherwise(F.array(F.lit("7"), F.lit("x")))
    caption = F.concat(F.lit("Figure "), F.col("conv_id").cast("string"), F.lit(": turns"))
    return _turns(spark, sf_dir).select("conv_id", structured.figure_mark(caption, F.col("lines"), labels).alias("mark"))


@query(f"""WITH {PARAGRAPHS}, w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}'))) AS word FROM paragraphs) SELECT doc_id, word, count(*) AS n FROM w GROUP BY doc_id, word HAVING count(*) >= 2""")
def word_vocabulary(spark, sf_dir):
    w = _paragraphs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w"))
    return w.groupBy("doc_id", F.lower("w").alias("word")).agg(F.count("*").alias("n")).filter("n >= 2")


#: Commas made hyphens; a compound at the end of a line is no proof of its hyphen, one inside a line is.
def _hyphens(spark, sf_dir) -> DataFrame:
    from quire.operators.vocabulary import hyphen_vocabulary

    return hyphen_vocabulary(table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit("-")).alias("text")))


@query(f"""WITH d AS (SELECT doc_id, replace(text, ', ', '-') AS t FROM documents), m AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-z]{{2,}}-[A-Za-z]{{2,}}\\n?')) AS m FROM d)
SELECT DISTINCT doc_id, lower(m) AS word FROM m WHERE NOT ends_with(m, chr(10))""")
def dec_hyphen_vocabulary(spark, sf_dir):
    return _hyphens(spark, sf_dir)


@query("""WITH n AS (SELECT item_id, text FROM benchmark) SELECT item_id, item_id % 3 <> 0 OR NOT regexp_matches(text, '[0-9]') AS numbers_kept, item_id % 4 <> 1 AS steps_kept FROM n""")
def dec_protocol_gate(spark, sf_dir):
    from quire.operators.quality import lost_numbers

    key = F.col("item_id")
    out = F.when(key % 3 == 0, F.regexp_replace("text", "[0-9]+(\\.[0-9]+)?", "")).otherwise(F.col("text"))
    steps = F.when(key % 4 == 1, F.array(F.struct(F.lit(" ").alias("text"), F.array(F.lit("")).alias("subs")))).otherwise(F.array(F.struct(out.alias("text"), F.array().cast("array<string>").alias("subs"))))
    made = structured.protocol(F.lit("t"), F.array(F.lit("s"), F.lit(" ")), steps)
    return table(spark, sf_dir, "benchmark").select("item_id", (F.size(lost_numbers(F.col("text"), out)) == 0).alias("numbers_kept"), made.isNotNull().alias("steps_kept"))


@query("SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS squashed FROM documents")
def squashed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.squash(F.col("text"))).alias("squashed"))


@query("SELECT o_orderkey, CAST(o_orderkey % 50 AS INTEGER) AS first, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 + 3 ELSE o_orderkey % 50 END AS INTEGER) AS last FROM orders")
def dec_page_bounds(spark, sf_dir):
    page = F.col("o_orderkey") % 50
    spec = F.concat(page.cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("-"), (page + 3).cast("string"))).otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.page_bounds(spec).alias("b")).select("o_orderkey", "b.first", "b.last")


@query("""WITH d AS (SELECT p_partkey, p_brand AS a, CASE p_partkey % 4 WHEN 0 THEN lower(p_brand) WHEN 1 THEN p_type WHEN 2 THEN upper(p_brand) || ' ' ELSE substr(p_brand, 2) END AS b, CASE WHEN p_partkey % 3 = 0 THEN '（' ELSE ' (' END AS o, CASE WHEN p_partkey % 3 = 0 THEN '）' ELSE ')' END AS c FROM part)
SELECT p_partkey, CASE WHEN lower(trim(a)) = lower(trim(b)) AND trim(a) <> '' THEN trim(a) ELSE a || o || b || c END AS name FROM d""")
def dec_pairs(spark, sf_dir):
    k = F.col("p_partkey")
    other = F.when(k % 4 == 0, F.lower("p_brand")).when(k % 4 == 1, F.col("p_type")).when(k % 4 == 2, F.concat(F.upper("p_brand"), F.lit(" "))).otherwise(F.expr("substr(p_brand, 2)"))
    pair = F.concat("p_brand", F.when(k % 3 == 0, "（").otherwise(" ("), other, F.when(k % 3 == 0, "）").otherwise(")"))
    return table(spark, sf_dir, "part").select("p_partkey", text.dedupe_pair(pair).alias("name"))


#: Letters with marks that may show a covered placeholder: they meet, or don't, as the text's commas and stops fall.
@query(r"""WITH """ + LETTERS + r""", d AS (SELECT doc_id, pos, pos % 3 > 0 AS had, CASE WHEN pos % 7 = 0 THEN '⟦?⟧' ELSE '' END || '$' || replace(replace(substr(t, 1, 60), ',', CASE WHEN pos % 2 = 0 THEN '$ ? $' ELSE ' ? ' END), '.', '') || '$' || CASE pos % 5 WHEN 0 THEN ' \left(~\right)' WHEN 1 THEN ' \begin{cases} & \\ \end{cases}' WHEN 2 THEN ' \begin{cases} a \end{cases}' WHEN 3 THEN ' \quad ?' ELSE '' END AS x FROM letters)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, array_to_string(list_filter([CASE WHEN contains(x, '⟦?⟧') THEN 'placeholder' END, CASE WHEN had AND (len(list_filter(regexp_extract_all(x, '\$.+?\$'), lambda m: contains(m, '?'))) > 0 OR regexp_matches(x, '\\[A-Za-z]{2,}\s*\?|\?\s*\\[A-Za-z]{2,}')) THEN 'question mark' END,
 CASE WHEN had AND regexp_matches(x, '\\left\(~\\right\)') THEN 'empty delimiters' END, CASE WHEN had AND regexp_matches(x, '\\begin\{cases\}[ &\\]*\\end\{cases\}') THEN 'empty environment' END], lambda r: r IS NOT NULL), ',') AS reason FROM d""")
def dec_unrepaired(spark, sf_dir):
    pos = F.col("pos")
    mark = F.when(pos % 2 == 0, "$ ? $").otherwise(" ? ")
    tail = F.when(pos % 5 == 0, r" \left(~\right)").when(pos % 5 == 1, r" \begin{cases} & \\ \end{cases}").when(pos % 5 == 2, r" \begin{cases} a \end{cases}").when(pos % 5 == 3, r" \quad ?").otherwise("")
    body = F.replace(F.replace(F.substring("t", 1, 60), F.lit(","), mark), F.lit("."), F.lit(""))
    x = F.concat(F.when(pos % 7 == 0, mathtext.MISSING).otherwise(""), F.lit("$"), body, F.lit("$"), tail)
    return _letters(spark, sf_dir).select("doc_id", "pos", F.array_join(mathtext.unrepaired(x, pos % 3 > 0), ",").alias("reason"))


@query(r"""SELECT doc_id, md5(replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '∕'), '[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{E000}-\x{F8FF}]', '⟦?⟧', 'g'), '([*_`$])', '\\\1', 'g'), '(^|[\n ])([#>])', '\1\\\2', 'g'), '&', '&amp;'), '<', '&lt;')) AS escaped FROM documents""")
def plain_escapes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(mathtext.plain_escape(F.col("text"))).alias("escaped"))


@query("SELECT c_custkey, sha1(trim(c_mktsegment)) IN (SELECT sha1(t) FROM (VALUES ('BUILDING'), ('MACHINERY')) AS v(t)) AS is_default FROM customer")
def default_fingerprints(spark, sf_dir):
    known = [F.sha1(F.lit(t)) for t in ("BUILDING", "MACHINERY")]
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_contains(F.array(*known), F.sha1(F.trim("c_mktsegment"))).alias("is_default"))


#: A stream's lines: every tenth ends it, every seventh is cut short.
@query("SELECT user_id, count(*) FILTER (event_id % 10 <> 0 AND event_id % 7 <> 0) AS pieces, count(*) FILTER (event_id % 10 = 0) AS ends FROM events GROUP BY user_id")
def dec_stream_lines(spark, sf_dir):
    key = F.col("event_id")
    line = F.when(key % 10 == 0, "data: [DONE]").when(key % 7 == 0, F.concat(F.lit("data: "), F.expr("substr(props, 2)"))).otherwise(F.concat(F.lit("data: "), "props"))
    data = F.regexp_extract(line, "(?s)^data: (.*)$", 1)
    e = table(spark, sf_dir, "events").select("user_id", tables.tolerant_json(data, "map<string,string>").isNotNull().alias("piece"), (data == "[DONE]").alias("end"))
    return e.groupBy("user_id").agg(F.count(F.when(F.col("piece") & ~F.col("end"), 1)).alias("pieces"), F.count(F.when(F.col("end"), 1)).alias("ends"))


@query(f"""WITH {LETTERS}, w2 AS (SELECT doc_id, lower(w) AS en, min(pos * 1000000 + k) AS first FROM words GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS n FROM w2 WHERE length(en) % 3 <> 0)
SELECT doc_id, (n - 1) // 25 AS batch, count(*) AS terms, md5(string_agg(en, ',' ORDER BY n)) AS en FROM r GROUP BY ALL""")
def note_batches(spark, sf_dir):
    """Terms without an explanation, 25 at a time; those whose length divides by three have one."""
    from quire.operators.vocabulary import batched

    w = _letters(spark, sf_dir).select("doc_id", "pos", F.posexplode(F.split("t", " ")).alias("k", "w"))
    terms = w.groupBy("doc_id", F.lower("w").alias("en")).agg(F.min(F.struct("pos", "k")).alias("first")).withColumn("note", F.when(F.length("en") % 3 == 0, "note"))
    return batched(terms.filter("note IS NULL"), ["doc_id"], "first", "en", 25).select("doc_id", "batch", F.size("en").cast("long").alias("terms"), F.md5(F.array_join("en", ",")).alias("en"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN false WHEN c_custkey % 6 = 1 THEN false WHEN c_custkey % 6 = 2 THEN false ELSE true END AS accepted FROM customer""")
def dec_notes(spark, sf_dir):
    key = F.col("c_custkey") % 6
    note = F.when(key == 0, " 术语 ").when(key == 1, F.repeat("c_name", 6)).otherwise(F.concat("c_name", F.lit("  explained")))
    return table(spark, sf_dir, "customer").select("c_custkey", structured.note_accepted(note, F.when(key == 2, "old")).alias("accepted"))


@query(f"""WITH {PARAGRAPHS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN regexp_matches(text, '(?i)^(arxiv:|https?://|www\\.|doi:|©|copyright|[0-9]{{1,4}}$|[0-9]+[ \t\n\f\r]*\\|[ \t\n\f\r]*page|proceedings of|downloaded from)') THEN 'furniture' ELSE 'body' END AS zone FROM paragraphs""")
def furniture_lines(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("doc_id", "pos", F.when(predicates.is_furniture(F.col("text")), "furniture").otherwise("body").alias("zone"))


@query("SELECT source AS owner, count(*) AS documents, count(l.doc_id) AS translated FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id) WHERE coalesce(source, '') <> '' GROUP BY source")
def owned_documents(spark, sf_dir):
    """Documents of each owner, listed, and how many have a result."""
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("owner"))
    done = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")).distinct().withColumn("done", F.lit(1))
    listed = tables.list_documents(meta).filter("owner <> ''").join(done, "id", "left")
    return listed.groupBy("owner").agg(F.count("*").alias("documents"), F.count("done").alias("translated"))


@query("SELECT doc_id, coalesce(nullif(source, ''), 'me') AS owner FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def claimed_after_delete(spark, sf_dir):
    meta = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("owner"))
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return tables.claim(tables.delete(meta, gone, ["doc_id"]), "me").select("doc_id", "owner")
