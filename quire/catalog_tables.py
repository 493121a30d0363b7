"""Registered queries over pages laid out from orders and their lines: regions, slots, boxes, figures, whole pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import page_tables
from quire.registry import query
from quire.sources.tables import table


def _lines(spark, sf_dir) -> DataFrame:
    """Lines of orders, k from 1 in each order; what follows by doc_id keeps the partitioning of this window."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"))
    return l.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "p", "s")))


LINES = "l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)"


#: Order lines as lines of a table; widths follow the values, some columns move from line to line, every fourth line lacks a word.
@query(f"""WITH {LINES},
w AS (SELECT doc_id, k, x0, x0 + 6 * length(t) AS x1 FROM (SELECT doc_id, k, unnest([{{'x0': n % 3, 't': 'a' || n}}, {{'x0': CASE WHEN doc_id % 5 = 0 THEN 15 + p * 37 % 50 ELSE 40 + p % 3 END, 't': CAST(p AS VARCHAR)}}, {{'x0': 110 + q % 9, 't': CASE WHEN s % 4 = 0 THEN NULL ELSE CAST(s AS VARCHAR) END}}, {{'x0': 150 + s % 5, 't': 'q' || q}}, {{'x0': 150 + s % 5 + 6 * length('q' || q) + 2, 't': 'of'}}], recursive := true) FROM l) WHERE t IS NOT NULL),
g AS (SELECT doc_id, k, lag(x1) OVER (PARTITION BY doc_id, k ORDER BY x0, x1) AS a, x0 AS b FROM w),
r AS (SELECT doc_id, min(x0) AS lo, max(x1) AS hi, count(DISTINCT k) AS n FROM w GROUP BY doc_id),
x AS (SELECT doc_id, n, lo + unnest(range(CAST(hi - lo + 2 AS BIGINT))) AS x FROM r),
c AS (SELECT x.doc_id, x.x, x.n, count(DISTINCT g.k) AS free FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.b > g.a AND x.x BETWEEN g.a - 0.5 AND g.b + 0.5 GROUP BY ALL),
o AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY x) AS i FROM c WHERE free >= greatest(1, ceil(0.9 * n - 1e-9))),
m AS (SELECT doc_id, 2 * min(x) + count(*) AS bound FROM o GROUP BY doc_id, x - i HAVING count(*) >= 3),
f AS (SELECT doc_id, k, count(*) AS words FROM w GROUP BY ALL), h AS (SELECT doc_id, first(k ORDER BY words DESC, k) AS k FROM f GROUP BY doc_id),
e AS (SELECT doc_id, a + b AS bound FROM g JOIN h USING (doc_id, k) WHERE a IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM m) UNION ALL SELECT * FROM m),
z AS (SELECT doc_id, min(x0) AS lo, max(x1) AS hi FROM w JOIN h USING (doc_id, k) GROUP BY doc_id)
SELECT r.doc_id, count(bound) + 1 AS slots, concat_ws(',', CASE WHEN r.doc_id IN (SELECT doc_id FROM m) THEN 2 * r.lo ELSE 2 * z.lo END - 16, string_agg(CAST(CAST(bound AS BIGINT) AS VARCHAR), ',' ORDER BY bound), CASE WHEN r.doc_id IN (SELECT doc_id FROM m) THEN 2 * r.hi ELSE 2 * z.hi END + 16) AS halves
FROM r JOIN z USING (doc_id) LEFT JOIN e USING (doc_id) GROUP BY r.doc_id, r.lo, r.hi, z.lo, z.hi""")
def dec_table_slots(spark, sf_dir):
    """Bounds in half points. Words and a region in, lines and slots out."""
    text = lambda c: c.cast("string")
    at = F.when(F.col("doc_id") % 5 == 0, 15 + F.col("p") * 37 % 50).otherwise(40 + F.col("p") % 3)
    q = F.concat(F.lit("q"), text(F.col("q")))
    word = lambda x0, t: F.struct(x0.cast("double").alias("x0"), t.alias("t"))
    parts = F.array(word(F.col("n") % 3, F.concat(F.lit("a"), text(F.col("n")))), word(at, text(F.col("p"))), word(110 + F.col("q") % 9, F.when(F.col("s") % 4 != 0, text(F.col("s")))), word(150 + F.col("s") % 5, q), word(150 + F.col("s") % 5 + 6 * F.length(q) + 2, F.lit("of")))
    w = _lines(spark, sf_dir).select("doc_id", "page", (F.col("k") * 12.0).alias("y"), F.explode(parts).alias("w")).filter("w.t IS NOT NULL").select("doc_id", "page", "y", "w.x0", (F.col("w.x0") + 6 * F.length("w.t")).alias("x1"), "w.t")
    regions = w.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(1).alias("region"), F.lit(-100.0).alias("x0"), F.lit(1000.0).alias("x1"), F.array(F.lit(0.0), F.lit(1e6)).alias("ys"))
    s = page_tables.slots_of_lines(page_tables.region_lines(regions, w))
    bounds = F.concat(F.transform("slots", lambda x: x["a"]), F.array(F.element_at("slots", -1)["b"]))
    return s.select("doc_id", F.size("slots").cast("long").alias("slots"), F.array_join(F.transform(bounds, lambda b: (2 * b).cast("long").cast("string")), ",").alias("halves"))


#: A rule under each order line; between two rules nothing, a caption, text, or both, by the line's part.
@query(f"""WITH {LINES}, c AS (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY k) AS above FROM l), d AS (SELECT *, sum(CASE WHEN k > 1 AND above % 4 < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS part FROM c),
g AS (SELECT doc_id, part, min(k) * 20 AS top, max(k) * 20 AS bottom, count(*) AS rules FROM d GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY top) AS INTEGER) AS region, CAST(top AS DOUBLE) AS top, CAST(bottom AS DOUBLE) AS bottom, rules FROM g""")
def dec_region_cuts(spark, sf_dir):
    l = _lines(spark, sf_dir)
    rules = l.select("doc_id", "page", (F.col("k") * 20.0).alias("y"), F.lit(10.0).alias("x0"), F.lit(200.0).alias("x1"))
    caption, text = F.array(*map(F.lit, ("Table", "3:", "sums"))), F.array(F.lit("plain"), F.lit("words"))
    says = F.when(F.col("p") % 4 == 1, caption).when(F.col("p") % 4 == 2, text).when(F.col("p") % 4 == 3, F.concat(caption, text))
    words = l.select("doc_id", "page", "k", F.posexplode(says).alias("i", "t"))
    # the text after a caption stands on a line of its own
    lower = F.when(F.col("i") >= 3, 12).otherwise(5)
    words = words.select("doc_id", "page", (F.col("k") * 20.0 + lower).alias("y"), (F.col("i") * 30.0 + 12).alias("x0"), (F.col("i") * 30.0 + 36).alias("x1"), "t")
    r = page_tables.table_regions(rules, words)
    return r.select("doc_id", "region", F.get("ys", F.lit(0)).alias("top"), F.element_at("ys", -1).alias("bottom"), F.size("ys").cast("long").alias("rules"))


#: Order lines as rows of boxes under a wide head; in every third line the second and third cell are one, and where all are, there is no border between; the last cell spans two rows where lines come in pairs.
@query(f"""WITH {LINES}, o AS (SELECT doc_id, bool_or(p % 3 <> 0) AS parted FROM l GROUP BY doc_id),
r AS (SELECT doc_id, k + 1 AS row, concat_ws('|', 'n' || n || ':1', CASE WHEN p % 3 = 0 THEN 'p' || p || ' and more' || CASE WHEN parted THEN ':2|-' ELSE ':1' END ELSE 'p' || p || ':1|s' || s || ':1' END, CASE WHEN k % 2 = 1 THEN 'q' || q || ':1' WHEN doc_id % 2 = 0 THEN '-' ELSE 'q' || q || ':1' END) AS cells FROM l JOIN o USING (doc_id))
SELECT doc_id, CAST(1 AS INTEGER) AS row, 'order ' || doc_id || CASE WHEN parted THEN ':4|-|-|-' ELSE ':3|-|-' END AS cells FROM o UNION ALL SELECT doc_id, CAST(row AS INTEGER), cells FROM r""")
def dec_boxed_tables(spark, sf_dir):
    l = _lines(spark, sf_dir)
    box = lambda x0, x1, y0, y1: F.struct(*[(v if hasattr(v, "cast") else F.lit(v)).cast("double").alias(n) for n, v in (("x0", x0), ("x1", x1), ("y0", y0), ("y1", y1))])
    word = lambda x0, y, t: F.struct(F.lit(x0).cast("double").alias("x0"), F.lit(x0 + 40).cast("double").alias("x1"), y.cast("double").alias("y"), t.alias("t"))
    k, y, none = F.col("k"), F.col("k") * 20, F.array().cast("array<struct<x0:double,x1:double,y0:double,y1:double>>")
    even, last = F.col("doc_id") % 2 == 0, F.max("k").over(Window.partitionBy("doc_id"))
    l = l.withColumn("_last", last)
    wide = F.col("p") % 3 == 0
    middle = F.when(wide, F.array(box(100, 300, y, y + 20))).otherwise(F.array(box(100, 200, y, y + 20), box(200, 300, y, y + 20)))
    tall = F.when(even & (k % 2 == 1) & (k < F.col("_last")), F.array(box(300, 400, y, y + 40))).when(even & (k % 2 == 0), none).otherwise(F.array(box(300, 400, y, y + 20)))
    boxes = F.concat(F.array(box(0, 100, y, y + 20)), middle, tall, F.when(k == 1, F.array(box(0, 400, 0, 20))).otherwise(none))
    texts = F.array(word(10, y + 4, F.concat(F.lit("n"), F.col("n").cast("string"))), word(110, y + 4, F.concat(F.lit("p"), F.col("p").cast("string"))), word(160, F.when(wide, y + 4), F.lit("and")), word(220, F.when(wide, y + 4), F.lit("more")), word(210, F.when(~wide, y + 4), F.concat(F.lit("s"), F.col("s").cast("string"))), word(310, F.when(~even | (k % 2 == 1), y + 4), F.concat(F.lit("q"), F.col("q").cast("string"))), word(20, F.when(k == 1, F.lit(4)), F.lit("order")), word(70, F.when(k == 1, F.lit(4)), F.col("doc_id").cast("string")))
    drawings = l.select("doc_id", "page", F.explode(boxes).alias("b")).select("doc_id", "page", "b.*")
    words = l.select("doc_id", "page", F.explode(texts).alias("w")).select("doc_id", "page", "w.*").filter("y IS NOT NULL")
    t = page_tables.boxed_tables(drawings, words).select("doc_id", F.posexplode("rows").alias("_k", "r"))
    shown = F.array_join(F.transform("r", lambda c: F.coalesce(F.concat(c["text"], F.lit(":"), c["span"].cast("string")), F.lit("-"))), "|")
    return t.select("doc_id", (F.col("_k") + 1).alias("row"), shown.alias("cells"))


#: Orders as figures whose top is at 300; their lines as labels above, places by part; another caption above in every third.
@query(f"""WITH RECURSIVE {LINES}, b AS (SELECT doc_id, k, 300 - p * 7 % 90 - s % 8 AS y0, 300 - p * 7 % 90 AS y1 FROM l WHERE q % 5 <> 0 AND p % 6 <> 0),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, count(*) OVER (PARTITION BY doc_id) AS n, y0, y1 FROM b),
a AS (SELECT DISTINCT doc_id, greatest(220, CASE WHEN doc_id % 3 = 0 THEN 240 + doc_id % 50 ELSE 0 END) AS ceiling FROM l),
s AS (SELECT doc_id, ceiling, CAST(0 AS BIGINT) AS step, CAST(300 AS BIGINT) AS top FROM a
  UNION ALL SELECT s.doc_id, ceiling, step + 1, CASE WHEN y1 <= top + 2 AND top - y1 <= 18 AND y1 >= ceiling AND y0 < top THEN y0 ELSE top END FROM s JOIN n ON n.doc_id = s.doc_id AND n.i = step % n.n + 1 AND step < n.n * n.n)
SELECT doc_id, CAST(min(top) AS DOUBLE) AS top FROM s GROUP BY doc_id""")
def dec_label_growth(spark, sf_dir):
    """Labels to the right of a figure and sentences do not count."""
    l = _lines(spark, sf_dir)
    areas = l.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(1).alias("caption"), F.lit(50.0).alias("x0"), F.lit(200.0).alias("x1"), F.lit(300.0).alias("top"), F.lit(400.0).alias("bottom"))
    x0 = F.when(F.col("q") % 5 == 0, 230.0).otherwise(60.0)
    y1 = 300.0 - F.col("p") * 7 % 90
    blocks = l.select("doc_id", "page", F.col("k").alias("block"), F.when(F.col("p") % 6 == 0, "It is so. And so").otherwise("legend").alias("text"), x0.alias("x0"), (x0 + 40).alias("x1"), (y1 - F.col("s") % 8).alias("y0"), y1.alias("y1"))
    edge = F.when(F.col("doc_id") % 3 == 0, 240.0 + F.col("doc_id") % 50)
    captions = areas.select("doc_id", "page", F.lit("Figure 1: other").alias("text"), F.lit(0.0).alias("x0"), F.lit(90.0).alias("x1"), edge.alias("y1")).filter("y1 IS NOT NULL").withColumn("y0", F.col("y1") - 8)
    return page_tables.grown_areas(areas, blocks, captions).select("doc_id", "top")


#: Orders as pages: a table with its caption, an algorithm, or a figure with labels, by order; each takes its words from the lines.
@query(f"""WITH {LINES}, t AS (SELECT doc_id, k, string_agg('p' || p || '|s' || s, '' ) AS x FROM l GROUP BY ALL), n AS (SELECT doc_id, max(k) AS n FROM l GROUP BY doc_id)
SELECT doc_id, CAST(1 AS INTEGER) AS number, CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'algorithm' ELSE 'figure' END AS kind,
  CASE doc_id % 3 WHEN 0 THEN 'Part|Supplier;' || (SELECT string_agg(x, ';' ORDER BY k) FROM t WHERE t.doc_id = n.doc_id) WHEN 1 THEN 'Algorithm 1: ORDER(x);' || (SELECT string_agg(k || repeat(' ', CAST(1 + k % 3 AS INTEGER)) || 'for if p' || p || ' do return', ';' ORDER BY k) FROM l WHERE l.doc_id = n.doc_id)
  ELSE coalesce((SELECT string_agg('p' || p || ' s' || s, ';' ORDER BY k) FROM l WHERE l.doc_id = n.doc_id), '') END AS content,
  CASE doc_id % 3 WHEN 0 THEN 'Table ' || doc_id || ': parts' WHEN 1 THEN '' ELSE 'Figure ' || doc_id || ': parts' END AS caption FROM n WHERE n > 2""")
def dec_page_blocks(spark, sf_dir):
    n = F.max("k").over(Window.partitionBy("doc_id"))
    l = _lines(spark, sf_dir).withColumn("_n", n).filter("_n > 2")
    kind, k = F.col("doc_id") % 3, F.col("k")
    y = k * 14.0 + 100
    word = lambda x0, t, y_=y: F.struct(F.lit(x0).cast("double").alias("x0"), (F.lit(x0) + 5.0 * F.length(t)).alias("x1"), y_.alias("y"), t.alias("t"))
    p, s = F.concat(F.lit("p"), F.col("p").cast("string")), F.concat(F.lit("s"), F.col("s").cast("string"))
    code = F.concat(k.cast("string"), F.repeat(F.lit(" "), (1 + k % 3).cast("int")), F.lit("for if "), p, F.lit(" do return"))
    words = F.when(kind == 1, F.array(word(76, code))).otherwise(F.array(word(76, p), word(180, s)))
    row = l.select("doc_id", "page", F.explode(words).alias("w"))
    head = F.when(kind == 0, F.array(word(76, F.lit("Part"), F.lit(100.0)), word(180, F.lit("Supplier"), F.lit(100.0)))).when(kind == 1, F.array(word(76, F.lit("Algorithm 1: ORDER(x)"), F.lit(100.0)))).otherwise(F.array().cast("array<struct<x0:double,x1:double,y:double,t:string>>"))
    first = l.filter("k = 1")
    words = row.unionByName(first.select("doc_id", "page", F.explode(head).alias("w"))).select("doc_id", "page", "w.*")
    end = F.col("_n") * 14.0 + 116
    rules = F.array(F.lit(96.0), F.when(kind == 0, 112.0), end)
    drawings = first.select("doc_id", "page", F.explode(rules).alias("y0")).filter("y0 IS NOT NULL").select("doc_id", "page", F.lit(70.0).alias("x0"), F.lit(300.0).alias("x1"), "y0", (F.col("y0") + 1).alias("y1"))
    says = F.concat(F.when(kind == 0, "Table ").otherwise("Figure "), F.col("doc_id").cast("string"), F.lit(": parts"))
    captions = first.filter(kind != 1).select("doc_id", "page", says.alias("text"), F.lit(80.0).alias("x0"), F.lit(200.0).alias("x1"), (end + 20).alias("y0"), (end + 30).alias("y1"))
    blocks = captions.select("doc_id", "page", F.lit(1).alias("block"), "text", "x0", "x1", "y0", "y1")
    got = page_tables.page_blocks(words, drawings, captions, blocks)
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: c["text"]), "|")), ";")
    return got.select("doc_id", "number", "kind", F.coalesce(cells, F.array_join("lines", ";"), F.array_join("content", ";")).alias("content"), F.coalesce("caption", F.lit("")).alias("caption"))
