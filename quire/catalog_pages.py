"""Registered queries over pages that are laid out from the documents' paragraphs: lines, order, regions, grids, figures, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.catalog import PARAGRAPHS, _paragraphs
from quire.catalog_shapes import LETTERS, _letters
from quire.operators import figures, layout, ordered, structured, vocabulary
from quire.registry import query
from quire.sources.tables import table

#: Boxes of paragraphs, ten to a page: every fifth spans the page, the others alternate between two columns.
BOXES = f"""{PARAGRAPHS}, boxes AS (SELECT doc_id, CAST((pos - 1) // 10 + 1 AS INTEGER) AS page, CAST(pos AS INTEGER) AS block, text,
  CASE WHEN pos % 5 = 0 THEN 50.0 WHEN pos % 2 = 0 THEN 320.0 ELSE 50.0 END AS x0, CASE WHEN pos % 5 = 0 OR pos % 2 = 0 THEN 560.0 ELSE 290.0 END AS x1, ((pos * 7) % 10) * 60.0 + 40 AS y0, ((pos * 7) % 10) * 60.0 + 70 AS y1 FROM paragraphs)"""


def _boxes(spark, sf_dir) -> DataFrame:
    pos = F.col("pos")
    y0 = ((pos * 7) % 10) * 60.0 + 40
    return _paragraphs(spark, sf_dir).select("doc_id", (F.floor((pos - 1) / 10) + 1).cast("int").alias("page"), pos.alias("block"), "text", F.when(pos % 5 == 0, 50.0).when(pos % 2 == 0, 320.0).otherwise(50.0).alias("x0"), F.when((pos % 5 == 0) | (pos % 2 == 0), 560.0).otherwise(290.0).alias("x1"), y0.alias("y0"), (y0 + 30).alias("y1"))


@query(f"""WITH {BOXES}, s AS (SELECT *, CASE WHEN x1 <= 310 THEN 'left' WHEN x0 >= 300 THEN 'right' ELSE 'span' END AS side FROM boxes),
p AS (SELECT *, count(*) FILTER (side = 'left') OVER w >= 3 AND count(*) FILTER (side = 'right') OVER w >= 3 AS two, min(y0) FILTER (side <> 'span') OVER w AS top FROM s WINDOW w AS (PARTITION BY doc_id, page))
SELECT doc_id, page, block, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN NOT two THEN 0 WHEN side = 'span' AND y0 <= top THEN 1 WHEN side = 'left' THEN 2 WHEN side = 'right' THEN 3 ELSE 4 END, y0, x0, block) AS INTEGER) AS "order" FROM p""")
def dec_reading_order(spark, sf_dir):
    return layout.reading_order(_boxes(spark, sf_dir), 610.0).select("doc_id", "page", "block", "order")


#: Rules above and below every order's lines, each order a region on its customer's page.
@query("""SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY top, x0) AS INTEGER) AS region, top, bottom, CAST(3 AS INTEGER) AS rules FROM (
  SELECT o_custkey, CAST(o_orderkey % 1000 AS DOUBLE) AS top, CAST(o_orderkey % 1000 + 60 AS DOUBLE) AS bottom, CAST(o_orderkey AS DOUBLE) AS x0 FROM orders)""")
def dec_regions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    top = (F.col("o_orderkey") % 1000).cast("double")
    r = o.select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(top, top + 3, top + 20, top + 60)).alias("y"), F.col("o_orderkey").cast("double").alias("x0"), (F.col("o_orderkey") + 100.0).alias("x1"))
    return layout.regions_of_rules(r).select("doc_id", "region", "top", "bottom", "rules")


@query("""SELECT o_custkey AS doc_id, CAST(o_orderkey AS INTEGER) AS region, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Table ' || o_orderkey || CASE WHEN o_orderkey % 3 = 1 THEN ' below' ELSE ' above' END END AS caption FROM orders""")
def dec_nearest_captions(spark, sf_dir):
    """Regions of orders stand 1,000 apart on their customer's page; captions above and below, or out of reach."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), key.cast("int").alias("region"), F.lit(0.0).alias("x0"), F.lit(100.0).alias("x1"), (key * 1000.0).alias("top"), (key * 1000.0 + 100).alias("bottom"))
    n = F.col("region")
    above = o.select("doc_id", "page", F.concat(F.lit("Table "), n.cast("string"), F.lit(" above")).alias("text"), "x0", "x1", (F.col("top") - F.when(n % 3 == 0, 200.0).otherwise(20.0)).alias("y0"))
    below = o.filter(n % 3 == 1).select("doc_id", "page", F.concat(F.lit("Table "), n.cast("string"), F.lit(" below")).alias("text"), "x0", "x1", (F.col("bottom") + 30).alias("y0"))
    return layout.nearest_caption(o, above.unionByName(below)).select("doc_id", "region", "caption")


@query("""SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS INTEGER) AS row, [l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)]::VARCHAR AS cells FROM lineitem""")
def dec_grids(spark, sf_dir):
    """Each order's lines as words in three columns of one region, found again as a grid."""
    y = F.row_number().over(_by_order()) * 12.0
    w = table(spark, sf_dir, "lineitem").withColumn("y", y).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "y", F.posexplode(F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))).alias("word", "t"))
    w = w.withColumns({"x0": F.col("word") * 100.0, "x1": F.col("word") * 100.0 + 10})
    regions = w.groupBy("doc_id", "page").agg(F.lit(1).alias("region"), F.lit(0.0).alias("x0"), F.lit(300.0).alias("x1"), F.lit(0.0).alias("top"), F.lit(1e6).alias("bottom"))
    return layout.grids(w, regions).select("doc_id", "row", F.concat(F.lit("["), F.array_join("cells", ", "), F.lit("]")).alias("cells"))


def _by_order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")


#: Header cells of each order: with a wide cell over two narrow ones, or plain.
@query("""SELECT o_orderkey AS doc_id, CAST(r AS INTEGER) AS row, CAST(start AS INTEGER) AS start, CAST(span AS INTEGER) AS span, text FROM orders, LATERAL (
  SELECT * FROM (VALUES (0, 1, 0, 1, 'Model (' || o_orderstatus || ')'), (0, 1, 1, 1, 'Time (s)'), (1, 1, 0, 1, 'Name'), (1, 1, 1, 2, o_orderpriority || ' (larger is better)'), (1, 2, 1, 1, 'Float'), (1, 2, 2, 1, 'Fixed')) AS v(wide, r, start, span, text) WHERE wide = o_orderkey % 2)""")
def dec_headers(spark, sf_dir):
    cell = lambda line, start, span, text: F.struct(F.lit(line).alias("line"), F.lit(start).alias("start"), F.lit(span).alias("span"), text.alias("text"))
    plain = F.array(cell(1, 0, 1, F.lit("Model")), cell(1, 1, 1, F.lit("Time")), cell(2, 0, 1, F.concat(F.lit("("), "o_orderstatus", F.lit(")"))), cell(2, 1, 1, F.lit("(s)")))
    wide = F.array(cell(1, 0, 1, F.lit("Name")), cell(1, 1, 2, F.col("o_orderpriority")), cell(2, 1, 2, F.lit("(larger is better)")), cell(3, 1, 1, F.lit("Float")), cell(3, 2, 1, F.lit("Fixed")))
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("region"), F.explode(F.when(F.col("o_orderkey") % 2 == 1, wide).otherwise(plain)).alias("c"))
    return figures.headers(cells.select("doc_id", "page", "region", "c.*")).select("doc_id", "row", "start", "span", "text")


#: A caption at 400 and drawings above it: the third lies too far up for orders by three, and is reached for the others.
@query("""SELECT o_orderkey AS doc_id, 40::DOUBLE AS x0, 210::DOUBLE AS x1, CASE WHEN o_orderkey % 3 = 0 THEN 280 ELSE 190 END::DOUBLE AS top, 398::DOUBLE AS bottom, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '0.5,' || o_orderstatus END AS labels FROM orders""")
def dec_figure_areas(spark, sf_dir):
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.lit(1).alias("page"), "o_orderstatus")
    captions = o.select("doc_id", "page", F.lit("Figure 1").alias("caption"), F.lit(50.0).alias("x0"), F.lit(200.0).alias("x1"), F.lit(400.0).alias("y0"), F.lit(410.0).alias("y1"))
    far = F.when(F.col("doc_id") % 3 == 0, 70.0).otherwise(30.0)
    box = lambda x0, x1, y0, y1: F.struct(F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), y0.alias("y0"), y1.alias("y1"))
    drawn = F.array(box(40.0, 120.0, F.lit(340.0), F.lit(390.0)), box(100.0, 210.0, F.lit(280.0), F.lit(330.0)), box(60.0, 90.0, 250.0 - far - 30, 280.0 - far))
    boxes = o.select("doc_id", "page", F.explode(drawn).alias("b")).select("doc_id", "page", "b.*")
    boxes = boxes.withColumn("y0", F.when((F.col("x0") == 60.0) & (F.col("doc_id") % 3 != 0), 190.0).otherwise(F.col("y0")))
    areas = figures.figure_areas(captions, boxes)
    short = F.array(F.struct(F.lit(1).alias("block"), F.lit("0.5").alias("text"), F.lit(200.0).alias("y0")), F.struct(F.lit(2).alias("block"), F.col("o_orderstatus").alias("text"), F.lit(300.0).alias("y0")))
    blocks = o.select("doc_id", "page", F.explode(short).alias("b")).select("doc_id", "page", "b.*", F.lit("text").alias("kind"), F.lit(70.0).alias("x0"), F.lit(80.0).alias("x1"), (F.col("b.y0") + 5).alias("y1"))
    return areas.join(figures.absorb_labels(areas, blocks), ["doc_id", "page", "caption"], "left").select("doc_id", "x0", "x1", "top", "bottom", F.array_join("labels", ",").alias("labels"))


#: Customers as authors, twelve to a document and three beside each other; names over affiliations, the row's third lower by up to four.
@query("""WITH c AS (SELECT c_custkey // 12 AS doc_id, c_custkey % 12 AS n, c_name, c_mktsegment FROM customer), d AS (SELECT *, n % 3 * 110 AS x0, n // 3 * 12 + CASE WHEN n % 3 = 2 THEN doc_id % 5 ELSE 0 END AS y0, CASE WHEN n % 3 = 2 AND doc_id % 5 > 3 THEN n // 3 * 2 + 1 ELSE n // 3 * 2 END AS r FROM c),
e AS (SELECT doc_id, r, string_agg(c_name || ' (' || c_mktsegment || ')', ', ' ORDER BY y0, x0) AS text, count(*) AS blocks FROM d GROUP BY doc_id, r)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) AS INTEGER) AS row, text, CAST(blocks AS INTEGER) AS blocks FROM e""")
def dec_author_rows(spark, sf_dir):
    doc, n = F.floor(F.col("c_custkey") / 12).cast("long"), F.col("c_custkey") % 12
    c = table(spark, sf_dir, "customer")
    b = c.select(doc.alias("doc_id"), n.alias("block"), F.concat("c_name", F.lit("\n"), "c_mktsegment").alias("text"), F.lit(2).alias("lines"), ((n % 3) * 110.0).alias("x0"), ((n % 3) * 110.0 + 90).alias("x1"), (F.floor(n / 3) * 12.0 + F.when(n % 3 == 2, doc % 5).otherwise(0)).alias("y0"))
    return figures.author_rows(b.withColumn("y1", F.col("y0") + 10), 1e9)


@query(f"""WITH {PARAGRAPHS} SELECT doc_id, md5(string_agg(repeat(' ', CAST(pos % 4 AS INTEGER)) || text, chr(10) ORDER BY pos)) AS lines FROM paragraphs GROUP BY doc_id""")
def dec_algorithm_lines(spark, sf_dir):
    """Paragraphs as lines of an algorithm; each stands up to three blanks right of its document's leftmost one."""
    p = _paragraphs(spark, sf_dir).unionByName(table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), F.lit("").alias("id"), F.lit("").alias("text")).dropDuplicates(["doc_id"]), allowMissingColumns=True)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: F.struct(((x["pos"] % 4) * 5.2 + 50).alias("x0"), x["text"].alias("text")))
    d = p.groupBy("doc_id").agg(lines.alias("lines"), F.max("pos").alias("n")).filter("n > 0")
    return d.select("doc_id", F.md5(F.array_join(F.slice(structured.indented(F.col("lines")), 2, F.size("lines")), "\n")).alias("lines"))


@query(f"""WITH {LETTERS}, v AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(t, '[A-Za-z]{{2,}} [A-Za-z]{{2,}}'))) AS pair FROM letters),
g AS (SELECT DISTINCT doc_id, replace(pair, ' ', '-') AS word, replace(pair, ' ', '') AS glued FROM v WHERE length(pair) >= 8), t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM paragraphs),
k AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}-[a-z]{{2,}}')) AS w FROM paragraphs)
SELECT doc_id, word FROM g WHERE (doc_id, glued) IN (SELECT doc_id, w FROM t) AND (doc_id, word) NOT IN (SELECT doc_id, w FROM k)""")
def dec_lost_hyphens(spark, sf_dir):
    """Pairs of words as a vocabulary of compounds; those that a document holds glued only."""
    pairs = F.regexp_extract_all(F.lower("t"), F.lit("[a-z]{2,} [a-z]{2,}"), F.lit(0))
    v = _letters(spark, sf_dir).select("doc_id", F.explode(pairs).alias("p")).select("doc_id", F.replace("p", F.lit(" "), F.lit("-")).alias("word")).distinct()
    return vocabulary.lost_hyphens(v, _paragraphs(spark, sf_dir))


@query("""WITH p AS (SELECT page_id, html, replace(html, '\\$', '') AS bare FROM pages) SELECT page_id, (length(bare) - length(replace(bare, '$', ''))) % 2 = 0 AS dollars_even, contains(html, '•') AS bullets, len(regexp_extract_all(html, '(?is)<t[dh][^>]*>[ \t\r\n]*<(p|div|ul|table)')) AS blocks_in_cells FROM p""")
def export_checks(spark, sf_dir):
    """What an exported page must not show: dollars left open, bullets, block elements in cells."""
    from quire.functions.mathtext import count

    bare = F.replace("html", F.lit("\\$"), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", (count(bare, r"\$") % 2 == 0).alias("dollars_even"), F.col("html").contains("•").alias("bullets"), count(F.col("html"), r"(?is)<t[dh][^>]*>[ \t\r\n]*<(p|div|ul|table)").alias("blocks_in_cells"))


@query(f"""WITH {PARAGRAPHS}, d AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 1 THEN pos || '. Part ' || CASE WHEN length(text) < 60 THEN rtrim(text, '.。:') ELSE 'x' END ELSE 'text ' || text END AS t FROM paragraphs)
SELECT doc_id, count(*) FILTER (pos % 4 = 1) AS headings, count(*) FILTER (pos % 4 <> 1) AS texts, coalesce(md5(string_agg(substr(t, 1, 90), chr(10) ORDER BY pos) FILTER (pos % 4 = 1)), '') AS contents FROM d GROUP BY doc_id""")
def dec_contents(spark, sf_dir):
    """Kinds counted and the table of contents, labels cut to 90."""
    text = F.col("text")
    t = F.when(F.col("pos") % 4 == 1, F.concat(F.col("pos").cast("string"), F.lit(". Part "), F.when(F.length(text) < 60, F.regexp_replace(text, "[.。:]+$", "")).otherwise("x"))).otherwise(F.concat(F.lit("text "), text))
    p = ordered.classified(_paragraphs(spark, sf_dir).withColumn("text", t))
    heads = F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "heading", F.struct("pos", F.substring("text", 1, 90).alias("t"))))), lambda x: x["t"])
    d = p.groupBy("doc_id").agg(F.count(F.when(F.col("kind") == "heading", 1)).alias("headings"), F.count(F.when(F.col("kind") == "text", 1)).alias("texts"), heads.alias("h"))
    return d.select("doc_id", "headings", "texts", F.when(F.size("h") > 0, F.md5(F.array_join("h", "\n"))).otherwise("").alias("contents"))
