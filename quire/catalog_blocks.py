"""Registered queries over whole texts and pages as blocks: rich text, recognised pages, rules of exported pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import NORMAL, PARAGRAPHS, _paragraphs
from quire.operators import blocks, conformance, ordered
from quire.registry import SQL, query
from quire.sources import export
from quire.sources.tables import table

#: Paragraphs of each document joined to a text whose blocks are, by position, lists, quotes, tables, headings, fences, formulas and plain lines.
RICH = """rich AS (SELECT doc_id, string_agg(CASE pos % 9 WHEN 1 THEN '## ' || text WHEN 2 THEN '- one' || chr(10) || '* ' || text WHEN 3 THEN '1. ' || text || chr(10) || '2) two' WHEN 4 THEN '> ' || text || chr(10) || '> end'
  WHEN 5 THEN '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || replace(text, '|', '/') || ' | 2 |' WHEN 6 THEN '```py' || chr(10) || replace(text, '`', '') || chr(10) || '```' WHEN 7 THEN '$$' || replace(text, '$', '') || '$$' WHEN 8 THEN '- half' || chr(10) || text ELSE text END, chr(10) || chr(10) ORDER BY pos) AS text FROM paragraphs GROUP BY doc_id)"""


def _rich(spark, sf_dir):
    text, pos = F.col("text"), F.col("pos") % 9
    lines = lambda *parts: F.concat_ws("\n", *[p if hasattr(p, "cast") else F.lit(p) for p in parts])
    put = lambda a, b=text: F.concat(F.lit(a), b)
    forms = [put("## "), lines("- one", put("* ")), lines(put("1. "), "2) two"), lines(put("> "), "> end"), lines("| a | b |", "|---|:-:|", F.concat(F.lit("| "), F.replace(text, F.lit("|"), F.lit("/")), F.lit(" | 2 |"))), lines("```py", F.replace(text, F.lit("`"), F.lit("")), "```"), F.concat(F.lit("$$"), F.replace(text, F.lit("$"), F.lit("")), F.lit("$$")), lines("- half", text)]
    form = text
    for k, f in enumerate(forms, 1):
        form = F.when(pos == k, f).otherwise(form)
    p = _paragraphs(spark, sf_dir).select("doc_id", F.struct("pos", form.alias("t")).alias("x"))
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("text"))


@query(rf"""WITH {PARAGRAPHS}, {RICH}, b AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\n\n+'), lambda x: trim(x, e' \n\t') <> '')) AS b FROM rich),
k AS (SELECT doc_id, b, len(string_split(b, chr(10))) AS n, len(list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '^\s*[-*•]\s+'))) AS bullets, len(list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '^\s*[0-9]+[.)]\s+'))) AS numbers, len(list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '^\s*>'))) AS quotes FROM b)
SELECT doc_id, CASE WHEN starts_with(b, '```') AND ends_with(b, '```') THEN 'fence' WHEN starts_with(b, '$$') AND ends_with(b, '$$') AND length(b) >= 4 THEN 'display math' WHEN regexp_matches(b, '^#{{1,6}}\s+\S') AND n = 1 THEN 'heading' WHEN bullets = n THEN 'bullets' WHEN numbers = n THEN 'numbers' WHEN quotes = n THEN 'quote'
  WHEN n >= 2 AND contains(string_split(b, chr(10))[1], '|') AND regexp_matches(string_split(b, chr(10))[2], '^\s*\|?[\s:|-]+\|[\s:|-]*$') THEN 'table' ELSE 'paragraph' END AS kind, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS source_lines FROM k GROUP BY ALL""")
def dec_rich_blocks(spark, sf_dir):
    """Blocks of whole documents by kind, with the lines that they stood on."""
    b = blocks.rich_blocks(_rich(spark, sf_dir))
    stood = F.when(F.col("kind") == "fence", F.size(F.split(F.get("lines", F.lit(0)), "\n")) + 1).when(F.col("kind") == "table", F.size("lines") + 1).when(F.col("kind") == "display math", F.size(F.split(F.get("lines", F.lit(0)), "\n"))).otherwise(F.size("lines"))
    return b.groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"), F.sum(stood).cast("long").alias("source_lines"))


#: After every third line of a text comes a blank line, so that blocks of several lines come out.
@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
d AS (SELECT doc_id, string_agg(line || CASE WHEN n % 3 = 0 THEN chr(10) ELSE '' END, chr(10) ORDER BY n) AS text FROM l GROUP BY doc_id),
g AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS t, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) AS b FROM d),
o AS (SELECT doc_id, b, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM g),
s AS (SELECT doc_id, b, length(t) AS size, unnest(range(0, CASE WHEN length(t) > 900 THEN (length(t) - 1) // 900 + 1 ELSE 1 END)) AS k, t FROM o WHERE t <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b, k) AS INTEGER) AS pos, CASE WHEN size > 900 THEN substr(t, k * 900 + 1, 900) ELSE replace(replace(regexp_replace(t, '([.!?:;])\n', '\1' || chr(1), 'g'), chr(10), ' '), chr(1), chr(10)) END AS text FROM s""")
def dec_recognised_paragraphs(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.when((k + 1) % 3 == 0, F.concat(x, F.lit("\n"))).otherwise(x))
    return blocks.recognised_paragraphs(table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text")))


#: Pages with what an export must not hold put after them, by page.
TAILS = ('<table><tr><td>x<b><div>deep</div></b></td></tr></table><div class="fline"> 3 3.5 </div>', '<table class="t" data-cols="9"><tr><th>$a<b$ </th></tr></table><div class="tcap">c</div><div class="tblbox">t</div>', '<div class="tblbox"><table class="t sm" data-cols="12"><tr><td><span class="term">w</span></td></tr></table></div><div class="tcap">c</div>', "<ul><li>• one</li></ul> $x &lt; y$ \\$5 $", "<script>if (a) '<div>•'</script><ol><li>")


@query("WITH t AS (SELECT page_id, html || [" + ", ".join("'" + t.replace("'", "''") + "'" for t in TAILS) + r"""][page_id % 5 + 1] AS html FROM pages), s AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g') AS bare FROM t),
e AS (SELECT page_id, unnest(regexp_extract_all(bare, '(?s)</?[A-Za-z][A-Za-z0-9]*[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(bare, '(?s)</?[A-Za-z][A-Za-z0-9]*[^>]*>'), 1) AS place FROM s),
n AS (SELECT page_id, place, tag, lower(regexp_extract(tag, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS name, CASE WHEN starts_with(tag, '</') THEN -1 WHEN ends_with(tag, '/>') THEN 0 ELSE 1 END AS step FROM e),
d AS (SELECT *, coalesce(sum(CASE WHEN name IN ('td', 'th') THEN step ELSE 0 END) OVER w, 0) AS cells, coalesce(sum(CASE WHEN name = 'table' THEN step ELSE 0 END) OVER w, 0) AS tables FROM n WINDOW w AS (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT page_id, CASE WHEN contains(tag, '"tblbox"') THEN 0 ELSE 1 END AS kind, row_number() OVER (PARTITION BY page_id ORDER BY place) AS k FROM d WHERE name = 'div' AND step >= 0 AND (contains(tag, '"tblbox"') OR contains(tag, '"tcap"'))),
o AS (SELECT page_id, CASE WHEN count(*) >= 2 THEN count(*) FILTER (kind <> (k + 1) % 2) ELSE 0 END AS found FROM b GROUP BY page_id)
""" + " UNION ALL ".join(f"SELECT t.page_id, 'even {x}' AS rule, CAST(abs(coalesce((SELECT sum(step) FROM n WHERE n.page_id = t.page_id AND name = '{x}'), 0)) AS BIGINT) AS found FROM t" for x in blocks.EVEN) + r"""
UNION ALL SELECT page_id, 'blocks in cells', (SELECT count(*) FROM d WHERE d.page_id = t.page_id AND name IN ('p', 'div', 'ul', 'ol', 'table') AND step >= 0 AND cells > 0) FROM t
UNION ALL SELECT page_id, 'wide tables', (SELECT count(*) FROM d WHERE d.page_id = t.page_id AND name = 'table' AND step >= 0 AND TRY_CAST(regexp_extract(tag, 'data-cols="([0-9]+)"', 1) AS INTEGER) >= 8 AND NOT regexp_matches(tag, 'class="[^"]*\bsm\b')) FROM t
UNION ALL SELECT page_id, 'terms in tables', (SELECT count(*) FROM d WHERE d.page_id = t.page_id AND step >= 0 AND tables > 0 AND regexp_matches(tag, 'class\s*=\s*"[^"]*\bterm\b')) FROM t
UNION ALL SELECT page_id, 'caption order', coalesce((SELECT found FROM o WHERE o.page_id = t.page_id), 0) FROM t
UNION ALL SELECT page_id, 'even dollars', (length(replace(html, '\$', '')) - length(replace(replace(html, '\$', ''), '$', ''))) % 2 FROM t
UNION ALL SELECT page_id, 'bare angles', len(list_filter(regexp_extract_all(regexp_replace(html, '<[^>]+>', chr(10), 'g'), '\$([^$\n]{0,200})\$', 1), lambda m: (contains(m, '<') AND NOT contains(m, '&lt;')) OR (contains(m, '>') AND NOT contains(m, '&gt;')))) FROM t
UNION ALL SELECT page_id, 'tick rows', len(regexp_extract_all(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '<div class="fline">\s*[0-9.]+(?:\s+[0-9.]+)+\s*</div>')) FROM t
UNION ALL SELECT page_id, 'bullets', length(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g')) - length(replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '•', '')) FROM t""")
def dec_html_report(spark, sf_dir):
    tail = F.get(F.array(*map(F.lit, TAILS)), (F.col("page_id") % 5).cast("int"))
    return blocks.html_report(table(spark, sf_dir, "pages").select("page_id", F.concat("html", tail).alias("html")))


@query(SQL["glossary_first_wins"])
def glossary_state(spark, sf_dir):
    """The glossary of conversations as keyed state of a stream, read back from the state store."""
    import uuid

    from quire.sources.tables import shared_dir
    from quire.streaming.glossary_state import glossary_of_state, run_glossary

    path = f"{sf_dir}/conversations.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(f"{path[:-1]}[{path[-1]}]")
    checkpoint = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    run_glossary(source.select(F.col("conv_id").alias("doc_id"), F.get(F.split("text", " "), F.lit(0)).alias("en"), F.col("role").alias("zh"), F.col("turn").alias("pos")), checkpoint)
    return glossary_of_state(spark, checkpoint)


#: Turns in parts of eight; a third of the parts gets no answer, others lose the turns by seven.
@query("""WITH t AS (SELECT conv_id AS doc_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations), p AS (SELECT *, (pos - 1) // 8 + 1 AS part FROM t),
a AS (SELECT *, (doc_id + part) % 3 <> 0 AND (doc_id + pos) % 7 <> 0 AS got FROM p),
n AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (NOT got) OVER w AS missing FROM a WINDOW w AS (PARTITION BY doc_id, part)),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY pos) AS place FROM n WHERE NOT got AND n > 1)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, part || '.' || CASE WHEN missing < n THEN 'p' || pos WHEN place <= n // 2 THEN 'a' ELSE 'b' END AS part FROM x""")
def dec_retry_frontier(spark, sf_dir):
    from pyspark.sql import Window

    from quire.streaming import runs

    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), pos.alias("pos"), "text")
    t = t.withColumns({"id": F.col("pos").cast("string"), "part": (F.floor((F.col("pos") - 1) / 8) + 1).cast("string")}).select(*runs.ITEM)
    fails = (F.col("doc_id") + F.col("part").cast("int")) % 3 == 0
    answer = F.struct("id", F.when((F.col("doc_id") + F.col("pos")) % 7 == 0, " ").otherwise("zh").alias("zh"), F.lit("").alias("en"), F.array().cast(runs.TERMS).alias("terms"))
    replies = t.groupBy("doc_id", "part").agg(F.collect_list(answer).alias("answers")).withColumn("answers", F.when(fails, F.slice("answers", F.lit(1), F.lit(0))).otherwise(F.col("answers")))
    return runs.next_frontier(t, replies).select("doc_id", "pos", "part")


#: Paragraphs with results by position: some missing, some with bare commands on either side, every ninth left as it was; terms and glossaries by document.
@query(rf"""WITH {PARAGRAPHS}, r AS (SELECT doc_id, pos, 'p' || lpad(CAST(pos AS VARCHAR), CAST(greatest(4, length(CAST(pos AS VARCHAR))) AS INTEGER), '0') AS id, text, pos % 5 <> 0 AS made, CASE WHEN pos % 9 = 1 THEN text WHEN pos % 7 = 0 THEN '$\frac x$ 甲' WHEN pos % 13 = 0 THEN '⟦?⟧' ELSE '译文 ' || pos END AS zh, CASE WHEN pos % 4 = 0 THEN '$\sqrt$ \hat{{a}} \bar' ELSE text END AS en FROM paragraphs),
l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(zh, '[^A-Za-z'' \t\n\x0B\f\r-]+'), lambda line: {NORMAL}), lambda x: length(x) > 24 AND len(string_split(x, ' ')) >= 4)[1] AS phrase FROM r WHERE made),
s AS (SELECT doc_id, pos, id, unnest([{{'o': 0, 's': 'text', 't': text}}, {{'o': 1, 's': 'en', 't': CASE WHEN made THEN en END}}, {{'o': 2, 's': 'zh', 't': CASE WHEN made THEN zh END}}], recursive := true) FROM r),
c AS (SELECT doc_id, pos, id, o, s, unnest(regexp_extract_all(t, '\\(sqrt|frac|bar|hat)(?:[^A-Za-z\[{{]|$)', 1)) AS c, generate_subscripts(regexp_extract_all(t, '\\(sqrt|frac|bar|hat)(?:[^A-Za-z\[{{]|$)', 1), 1) AS k FROM s),
b AS (SELECT doc_id, 'not translated' AS rule, pos, 0 AS o, 0 AS k, id AS what FROM r WHERE NOT made UNION ALL SELECT doc_id, 'latin left', pos, 0, 0, id || ': ' || substr(phrase, 1, 40) FROM l WHERE len(list_filter(string_split(phrase, ' '), lambda w: regexp_matches(w, '^[a-z]'))) >= 2
  UNION ALL SELECT doc_id, 'command without argument', pos, o, k, id || '/' || s || ':\' || c FROM c UNION ALL SELECT doc_id, 'unrepaired', pos, 0, 0, id || ': placeholder' FROM r WHERE made AND contains(zh, '⟦?⟧')),
f AS (SELECT doc_id, rule, count(*) AS found, list(what ORDER BY pos, o, k)[1:4] AS examples FROM b GROUP BY ALL),
d AS (SELECT doc_id, count(*) FILTER (made AND pos % 10 = 1) AS terms FROM r GROUP BY doc_id),
g AS (SELECT doc_id, unnest(['not translated', 'latin left', 'command without argument', 'unrepaired', 'no terms', 'no glossary']) AS rule, terms FROM d)
SELECT g.doc_id, g.rule, coalesce(found, CASE WHEN g.rule = 'no terms' AND terms = 0 OR g.rule = 'no glossary' AND g.doc_id % 3 = 0 THEN 1 ELSE 0 END) = 0 AS passes, coalesce(found, CASE WHEN g.rule = 'no terms' AND terms = 0 OR g.rule = 'no glossary' AND g.doc_id % 3 = 0 THEN 1 ELSE 0 END) AS found, array_to_string(coalesce(examples, []), '; ') AS examples
FROM g LEFT JOIN f ON f.doc_id = g.doc_id AND f.rule = g.rule""")
def dec_conformance(spark, sf_dir):
    p = _paragraphs(spark, sf_dir)
    pos = F.col("pos")
    zh = F.when(pos % 9 == 1, F.col("text")).when(pos % 7 == 0, r"$\frac x$ 甲").when(pos % 13 == 0, "⟦?⟧").otherwise(F.concat(F.lit("译文 "), pos.cast("string")))
    en = F.when(pos % 4 == 0, r"$\sqrt$ \hat{a} \bar").otherwise(F.col("text"))
    term = F.struct(F.lit("a").alias("en"), F.lit("b").alias("zh"))
    records = p.filter(pos % 5 != 0).select("doc_id", "id", zh.alias("zh"), en.alias("en"), F.when(pos % 10 == 1, F.array(term)).otherwise(F.slice(F.array(term), F.lit(1), F.lit(0))).alias("terms"))
    glossary = p.filter((F.col("doc_id") % 3 != 0) & (pos == 1)).select("doc_id", F.lit("a").alias("en"))
    return conformance.report(p, records, glossary).withColumn("examples", F.array_join("examples", "; "))


@query("""WITH d AS (SELECT doc_id, coalesce(substr(text, 1, 60), '') AS title FROM documents), c AS (SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (quality = 1) AS translated FROM labels GROUP BY doc_id),
s AS (SELECT doc_id, title, substr(lower(regexp_replace(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 56) AS s FROM d)
SELECT s.doc_id, title, CASE WHEN s = '' THEN 'paper' ELSE s END || '-' || substr(md5(title), 1, 6) || '.html' AS name, translated, paragraphs, CASE WHEN translated >= paragraphs THEN 'complete' WHEN translated > 0 THEN 'partial' ELSE 'source only' END AS badge FROM s LEFT JOIN c USING (doc_id)""")
def site_index_rows(spark, sf_dir):
    """The index of a site with the documents' first characters as titles and their labels as coverage."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.substring("text", 1, 60), F.lit("")).alias("title"))
    c = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("quality") == 1).alias("translated"))
    return export.site_index(d, c)


#: Paragraphs with boxes by position: every third is placeholders alone, beside or over the one before; some of those before are equations.
@query(f"""WITH {PARAGRAPHS}, d AS (SELECT doc_id, pos, pos % 3 = 0 OR pos % 7 = 5 AS f, CASE WHEN pos % 3 = 0 OR pos % 7 = 5 THEN '⟦?⟧' ELSE text || ' a' END AS t, CASE WHEN pos % 5 = 1 THEN 'equation' ELSE 'text' END AS kind, CASE WHEN pos % 4 = 3 THEN 500 ELSE 0 END AS x0 FROM paragraphs),
h AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM d),
a AS (SELECT *, lag(kind) OVER w AS k1, lag(x0) OVER w AS x1, lag(f) OVER w AS f1, lag(kind, 2) OVER w AS k2, lag(x0, 2) OVER w AS x2 FROM h WINDOW w AS (PARTITION BY doc_id, g ORDER BY pos)),
j AS (SELECT *, CASE WHEN NOT f OR k1 IS NULL THEN 0 WHEN NOT f1 OR k2 IS NULL THEN CAST(k1 = 'equation' OR x1 = x0 AS INTEGER) WHEN k2 = 'equation' OR x2 = x1 THEN CAST(k2 = 'equation' OR x2 = x0 AS INTEGER) ELSE CAST(k1 = 'equation' OR x1 = x0 AS INTEGER) END AS joins FROM a),
i AS (SELECT *, sum(1 - joins) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM j)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, first(kind ORDER BY pos) AS kind, md5(string_agg(t, ' ' ORDER BY pos)) AS text, CAST(count(*) - 1 AS INTEGER) AS fragments FROM i GROUP BY doc_id, island""")
def dec_fragment_boxes(spark, sf_dir):
    pos = F.col("pos")
    alone = (pos % 3 == 0) | (pos % 7 == 5)
    x0 = F.when(pos % 4 == 3, 500.0).otherwise(0.0)
    p = _paragraphs(spark, sf_dir).select("doc_id", "pos", F.when(pos % 5 == 1, "equation").otherwise("text").alias("kind"), F.when(alone, "⟦?⟧").otherwise(F.concat("text", F.lit(" a"))).alias("text"), x0.alias("x0"), (x0 + 100).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"))
    return ordered.merge_glyph_fragments(p).select("doc_id", "pos", "kind", F.md5("text").alias("text"), F.size("fragments").alias("fragments"))


#: Documents as algorithms: their paragraphs as lines, a title before them in every second, a protocol for every third.
@query(f"""WITH {PARAGRAPHS}, e AS (SELECT doc_id, pos, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM paragraphs),
l AS (SELECT doc_id, string_agg('<div class="algline">' || t || '</div>', '' ORDER BY pos) AS lines, count(*) AS n FROM e GROUP BY doc_id)
SELECT doc_id, md5('<div class="algobox">' || CASE WHEN doc_id % 2 = 0 THEN '<div class="pt">Algorithm ' || doc_id || ': go</div>' ELSE '' END || lines || '</div>') AS source,
  md5(CASE WHEN doc_id % 3 = 0 THEN '<div class="proto"><div class="pt">t ' || doc_id || '</div><div class="in">in &lt;x&gt;</div><ol class="steps"><li><p>step <strong>' || n || '</strong></p></li><li><p>last</p><ol class="subs"><li><p>sub</p></li></ol></li></ol></div>'
  ELSE '<div class="algobox">' || CASE WHEN doc_id % 2 = 0 THEN '<div class="pt">Algorithm ' || doc_id || ': go</div>' ELSE '' END || lines || '</div>' END) AS target FROM l""")
def dec_algorithm_cells(spark, sf_dir):
    p = _paragraphs(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("l"))
    title = F.concat(F.lit(" Algorithm "), F.col("doc_id").cast("string"), F.lit(": go"))
    lines = F.when(F.col("doc_id") % 2 == 0, F.concat(F.array(title), "l")).otherwise(F.col("l"))
    step = lambda text, subs: F.struct(text.alias("text"), subs.cast("array<string>").alias("subs"))
    steps = F.array(step(F.concat(F.lit("step **"), F.size("l").cast("string"), F.lit("**")), F.array()), step(F.lit("last"), F.array(F.lit("sub"))))
    protocol = F.struct(F.concat(F.lit("t "), F.col("doc_id").cast("string")).alias("title"), F.array(F.lit("in <x>")).alias("setup"), F.when(F.col("doc_id") % 3 == 0, steps).alias("steps"), F.lit("").alias("title_en"), F.array().cast("array<string>").alias("lines_en"))
    p = p.select("doc_id", lines.alias("lines"), protocol.alias("protocol"))
    return p.select("doc_id", F.md5(blocks.algorithm_html(F.col("lines"), F.col("protocol"), True)).alias("source"), F.md5(blocks.algorithm_html(F.col("lines"), F.col("protocol"), False)).alias("target"))
