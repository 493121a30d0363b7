"""Registered queries that review a document set: repairs, coverage, payloads, sites; each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import PARAGRAPHS, _paragraphs
from quire.catalog_shapes import LETTERS, _letters
from quire.functions import mathtext, predicates, text
from quire.operators import ordered, review
from quire.registry import query
from quire.sources.tables import table


@query(f"""WITH {PARAGRAPHS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?'), lambda x: length(x) >= 2), lambda x: lower(x)))), ' ')) AS tokens FROM paragraphs""")
def token_sets(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("doc_id", "pos", F.md5(F.array_join(F.array_sort(text.tokens(F.col("text"))), " ")).alias("tokens"))


#: Turns as the lines of a region: under every third conversation an algorithm's frame around words of its turns.
@query("""WITH t AS (SELECT conv_id, list(CASE WHEN conv_id % 3 = 0 AND n = 1 THEN 'Algorithm 1 Input: x Output: y' WHEN conv_id % 3 = 0 THEN (n - 1) || '   while ' || coalesce(text, '') ELSE coalesce(text, '') END ORDER BY n) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) GROUP BY conv_id), j AS (SELECT *, lower(array_to_string(lines, ' ')) AS s FROM t)
SELECT conv_id, CAST(CASE WHEN contains(substr(s, 1, 80), 'algorithm') THEN 3 ELSE 0 END + CASE WHEN len(list_filter(lines, lambda x: regexp_matches(trim(substr(trim(x), 1, 3)), '^[0-9]+$'))) >= 3 THEN 2 ELSE 0 END
 + CASE WHEN len(list_filter(['for', 'foreach', 'while', 'if', 'then', 'do', 'return', 'elif', 'else', '←', '<-'], lambda k: contains(s, k))) >= 3 THEN 2 ELSE 0 END + CASE WHEN contains(s, 'input:') AND contains(s, 'output:') THEN 1 ELSE 0 END AS INTEGER) AS score FROM j""")
def dec_pseudocode(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    said = F.coalesce("text", F.lit(""))
    line = F.when(F.col("conv_id") % 3 != 0, said).when(F.col("n") == 1, "Algorithm 1 Input: x Output: y").otherwise(F.concat((F.col("n") - 1).cast("string"), F.lit("   while "), said))
    t = table(spark, sf_dir, "conversations").withColumn("n", n).withColumn("line", line)
    g = t.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    return g.select("conv_id", predicates.pseudocode_score(F.col("lines")).cast("int").alias("score"))


#: A formula put into paragraphs, its share of the letters by the paragraph's length; boxed from 55 % on.
@query(f"""WITH {LETTERS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(replace(t, ' ', '')) <= 22 AS boxed, t AS tag FROM letters""")
def dec_equation_cells(spark, sf_dir):
    t = F.concat(F.lit("$" + "x" * 25 + "$ "), "t")
    return _letters(spark, sf_dir).select("doc_id", "pos", review.equation_cell(t).alias("e")).select("doc_id", "pos", "e.boxed", "e.tag")


#: Every comma opens or closes a formula; an odd last one is a dollar alone.
@query(f"""WITH {LETTERS}, d AS (SELECT doc_id, pos, replace(t, ',', ' $ ') AS x FROM letters), f AS (SELECT *, regexp_extract_all(x, '\\$[^$]+\\$') AS m FROM d)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(len(m) + len(list_filter(regexp_split_to_array(x, '\\$[^$]+\\$'), lambda p: p <> '')) AS INTEGER) AS parts, md5(array_to_string(m, '')) AS formulas,
 length(substr(x, 1, length(x) // 2)) - length(replace(substr(x, 1, length(x) // 2), '$', '')) AS dollars, (length(substr(x, 1, length(x) // 2)) - length(replace(substr(x, 1, length(x) // 2), '$', ''))) % 2 = 1 AS inside FROM f""")
def dec_math_splits(spark, sf_dir):
    """Texts parted at their formulas, and whether their middle stands inside one."""
    x = F.replace("t", F.lit(","), F.lit(" $ "))
    parts = review.split_math(x)
    half = F.floor(F.length(x) / 2).cast("int")
    formulas = F.filter(parts, lambda p: p.rlike(r"(?s)^\$[^$]+\$$"))
    return _letters(spark, sf_dir).select("doc_id", "pos", F.size(parts).cast("int").alias("parts"), F.md5(F.array_join(formulas, "")).alias("formulas"), mathtext.unescaped_dollars(F.substring(x, F.lit(1), half)).alias("dollars"), review.inside_math(x, half + 1).alias("inside"))


@query(f"""WITH {PARAGRAPHS}, d AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN '⟦?⟧' WHEN pos % 4 = 3 THEN 'E ' || text ELSE text END AS t, CASE WHEN pos % 4 = 3 THEN 'equation' ELSE 'text' END AS kind FROM paragraphs),
m AS (SELECT doc_id, pos, kind, t || CASE WHEN pos % 4 = 3 AND lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL THEN ' ⟦?⟧' ELSE '' END AS t FROM d)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, kind, md5(t) AS text FROM m WHERE pos % 4 <> 0""")
def dec_fragment_merge(spark, sf_dir):
    pos = F.col("pos") % 4
    p = _paragraphs(spark, sf_dir).select("doc_id", "pos", F.when(pos == 3, "equation").otherwise("text").alias("kind"), F.when(pos == 0, mathtext.MISSING).when(pos == 3, F.concat(F.lit("E "), "text")).otherwise(F.col("text")).alias("text"))
    return ordered.merge_glyph_fragments(p).withColumn("text", F.md5("text")).drop("fragments")


@query(f"""WITH {PARAGRAPHS}, d AS (SELECT doc_id, pos, length(text) - length(replace(text, 'q', '')) AS n FROM paragraphs) SELECT doc_id, CAST(sum(n) AS BIGINT) AS issues, coalesce(string_agg(printf('p%04d', pos), ',' ORDER BY pos) FILTER (n > 0), '') AS ids FROM d GROUP BY doc_id""")
def dec_glyph_totals(spark, sf_dir):
    """What cannot be shown, counted by document, and the paragraphs it stands in."""
    marked = mathtext.missing_glyphs(F.replace("text", F.lit("q"), F.lit(mathtext.MISSING)))
    p = _paragraphs(spark, sf_dir).withColumn("n", marked)
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("pos", "id")))), lambda x: x["id"])
    return p.groupBy("doc_id").agg(F.sum("n").alias("issues"), F.array_join(ids, ",").alias("ids"))


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'extracted' WHEN toxic = 1 THEN 'error' WHEN quality = 1 THEN 'ready' ELSE 'partial' END AS status FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)""")
def document_status(spark, sf_dir):
    """Labels as what a run left: failed ones are errors, whole ones ready, others partial, none only extracted."""
    done = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(done, "doc_id", "left")
    wanted, made = F.when(F.col("quality").isNotNull(), 1).otherwise(0), F.coalesce("quality", F.lit(0))
    return d.select("doc_id", review.status(wanted, made, F.col("toxic") == 1).alias("status"))


@query(f"""WITH {PARAGRAPHS}, b AS (SELECT *, (pos - 1) // 8 AS batch FROM paragraphs) SELECT doc_id, CAST(batch AS INTEGER) AS batch, count(*) AS items, CAST(sum(length(text)) AS BIGINT) AS chars FROM b GROUP BY ALL""")
def batch_payloads(spark, sf_dir):
    """Requests of eight paragraphs as JSON, read back: items and characters."""
    p = _paragraphs(spark, sf_dir).select("doc_id", F.floor((F.col("pos") - 1) / 8).cast("int").alias("batch"), "pos", "id", "text")
    payload = review.payloads(p)
    items = F.from_json("payload", "items array<struct<id:string,text:string>>")["items"]
    return payload.select("doc_id", "batch", F.size(items).cast("long").alias("items"), F.aggregate(items, F.lit(0), lambda a, x: a + F.length(x["text"])).cast("long").alias("chars"))


#: Replies that name the result in one of four ways, or not at all.
@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_type END AS zh FROM events")
def dec_reply_aliases(spark, sf_dir):
    key = F.get(F.array(*map(F.lit, ("zh", "translation", "text_zh", "target", "other"))), (F.col("event_id") % 5).cast("int"))
    reply = F.to_json(F.create_map(key, F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", review.reply_text(reply).alias("zh"))


@query("""WITH s AS (SELECT source, lang, min(doc_id) AS first FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang) AS n FROM s)
SELECT source, 'Chapters: ' || string_agg(lang, ' → ' ORDER BY lang) || chr(10) || 'Terms: ' || string_agg(lang || '→' || first, ', ' ORDER BY lang) AS prefix FROM r WHERE n <= 40 GROUP BY source""")
def outline_prefixes(spark, sf_dir):
    """Each source's languages as chapters and as terms, as the prefix of a request."""
    s = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND lang IS NOT NULL").groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    g = s.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("lang").alias("en"), F.col("first").cast("string").alias("zh")))).alias("terms"))
    prefix = review.outline_prefix({"Chapters": (F.transform("terms", lambda x: x["en"]), " → ", 40)}, F.col("terms"))
    return g.select("source", prefix.alias("prefix"))


@query("SELECT doc_id, len(regexp_extract_all(text, '</')) AS tags, true AS closed FROM documents WHERE text IS NOT NULL")
def embedded_json(spark, sf_dir):
    """Texts as JSON inside a page: none of their ends of tags can end the script; all are read back."""
    j = text.embed_json(F.to_json(F.struct("text")))
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text", j.alias("j"))
    return d.select("doc_id", mathtext.count(F.from_json("j", "text string")["text"], "</").alias("tags"), (~F.col("j").contains("</") & (F.from_json("j", "text string")["text"] == F.col("text"))).alias("closed"))


@query("""SELECT doc_id, md5(regexp_replace(replace(text, '$', '$ $'), '\\$[^$]*\\$', '', 'g')) AS bare FROM documents""")
def dec_strip_math(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_math(F.replace("text", F.lit("$"), F.lit("$ $")))).alias("bare"))


@query(f"""WITH {PARAGRAPHS}, p AS (SELECT doc_id, pos, text, pos AS page, (pos * 37) % 100 AS y0 FROM paragraphs), z AS (SELECT *, trim(regexp_replace(lower(text), '[0-9]+', '#', 'g')) AS key FROM p WHERE y0 + 2 <= 6.2 OR y0 >= 94.5),
k AS (SELECT doc_id, key FROM z GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM z WHERE (doc_id, key) IN (SELECT doc_id, key FROM k) OR regexp_matches(text, '^[0-9]{{1,4}}$')""")
def dec_zone_furniture(spark, sf_dir):
    """Paragraphs in a page's top or bottom zone that repeat there, or are a number."""
    y0 = (F.col("pos") * 37) % 100
    p = _paragraphs(spark, sf_dir).select("doc_id", "pos", "text", y0.cast("double").alias("y0"), (y0 + 2.0).alias("y1"))
    return review.zone_furniture(p, 100.0).select("doc_id", "pos")
