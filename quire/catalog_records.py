"""Registered queries over records, blocks and pages: repairs, classes, furniture, lists, tables, moves; with SQL for the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import PARAGRAPHS, REMATCH, W, _paragraphs, _shifted
from quire.functions import mathtext, predicates, text
from quire.operators import grids, migrate, ordered, quality, records, review
from quire.registry import query
from quire.sources import tables
from quire.sources.tables import table


#: Struck-out relations put where commas, full stops and "the" stand.
@query(rf"""WITH {PARAGRAPHS}, d AS (SELECT doc_id, pos, replace(replace(replace(text, ', ', ' /  \in '), '. ', '/= '), ' the ', ' / \equiv /\subset ') AS t FROM paragraphs)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '/\s*\\in\b', '\\notin', 'g'), '/\s*\\subset\b', '\\not\\subset', 'g'), '/\s*\\equiv\b', '\\not\\equiv', 'g'), '/\s*=', '\\neq ', 'g'), '[ \t]{{2,}}', ' ', 'g')) AS text FROM d""")
def dec_slash_relations(spark, sf_dir):
    t = F.col("text")
    for a, b in ((", ", r" /  \in "), (". ", "/= "), (" the ", r" / \equiv /\subset ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return _paragraphs(spark, sf_dir).select("doc_id", "pos", F.md5(mathtext.slash_commands(t)).alias("text"))


#: Paragraphs in four frames of a formula.
FRAMED = f"""{PARAGRAPHS}, plain AS (SELECT doc_id, pos, regexp_replace(text, '[$\\\\]', '', 'g') AS s FROM paragraphs),
framed AS (SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN '(' || pos || 'b) $' || s || '$' WHEN 1 THEN '$' || s || '$ (' || pos || ')' WHEN 2 THEN '$' || s || '$ ' || pos WHEN 3 THEN '$' || s || '$ ' || substr(s, 1, length(s) // 2) ELSE s || ' $x$' END AS t FROM plain)"""
SHARE = "CASE WHEN strlen(regexp_replace(t, '[ \\x{{00A0}}$]', '', 'g')) = 0 THEN 0 ELSE least(1.0, coalesce(list_sum(list_transform(regexp_extract_all(t, '(?s)\\$\\$.+?\\$\\$|\\$.+?\\$'), lambda m: length(regexp_replace(m, '[ \\x{{00A0}}$]', '', 'g')))), 0) / length(regexp_replace(t, '[ \\x{{00A0}}$]', '', 'g'))) END".replace("{{", "{").replace("}}", "}")


def _framed(spark, sf_dir):
    pos, s = F.col("pos"), F.regexp_replace("text", r"[$\\]", "")
    n, d = pos.cast("string"), F.lit("$")
    t = F.when(pos % 5 == 0, F.concat(F.lit("("), n, F.lit("b) $"), s, d)).when(pos % 5 == 1, F.concat(d, s, F.lit("$ ("), n, F.lit(")"))).when(pos % 5 == 2, F.concat(d, s, F.lit("$ "), n))
    t = t.when(pos % 5 == 3, F.concat(d, s, F.lit("$ "), F.substring(s, F.lit(1), F.floor(F.length(s) / 2).cast("int")))).otherwise(F.concat(s, F.lit(" $x$")))
    return _paragraphs(spark, sf_dir).select("doc_id", "pos", t.alias("t"))


@query(rf"""WITH {FRAMED} SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM framed
WHERE length(trim(t)) BETWEEN 1 AND 500 AND ({SHARE} >= 0.6 OR regexp_full_match(trim(t), '\([0-9]+[a-z]?\)\s*\$[^$]+\$') OR regexp_full_match(trim(t), '\$[^$]+\$\s*\([0-9]+[a-z]?\)'))""")
def dec_display_equations(spark, sf_dir):
    """Paragraphs as formulas with a number in brackets before or after them, with a bare number, beside half as much text, or only a letter."""
    return _framed(spark, sf_dir).filter(mathtext.display_equation(F.col("t"))).select("doc_id", "pos")


#: Blocks whose size and face come from their place; every 29th becomes the heading of the references.
CLASSED = f"""{PARAGRAPHS}, c AS (SELECT doc_id, pos, (pos - 1) // 6 + 1 AS page, CASE WHEN pos % 29 = 0 THEN 'References' WHEN pos % 7 = 0 THEN (pos % 4) || CASE WHEN pos % 2 = 0 THEN '.2 ' ELSE ' ' END || substr(text, 1, 30) WHEN pos % 11 = 0 THEN 'Figure 3: ' || text WHEN pos % 13 = 0 THEN 'Abstract ' || text WHEN pos % 17 = 0 THEN '(4) $' || regexp_replace(substr(text, 1, 40), '[$\\\\]', '', 'g') || '$' ELSE substr(text, 1, 100) END AS text,
  10.0 + (pos * 3 % 8) AS size, pos % 5 = 0 AS bold FROM paragraphs),
r AS (SELECT *, trim(text) AS t, rtrim(regexp_replace(trim(text), '\\$[\\^_]\\{{[^}}]*\\}}\\$', '', 'g')) AS tail, coalesce(max(CASE WHEN regexp_matches(text, '^(?i)(references|bibliography|参考文献)$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS refs,
  regexp_matches(trim(text), '^([0-9]+(\\.[0-9]+)*\\.?|[A-Z]\\.)[ \\t]+[^ \\t]') AS section, regexp_matches(trim(text), '^(?i)(references|bibliography|参考文献)$') AS head FROM c),
k AS (SELECT *, length(t) < 90 AS short, length(t) < 90 AND (size >= 11.4 OR (bold AND size >= 9.8)) AS candidate, CASE WHEN contains(split_part(t, ' ', 1), '.') THEN 2 ELSE 1 END AS numbered FROM r)"""
PLAIN_SHARE = SHARE.replace("(t,", "(text,")


@query(f"""WITH {CLASSED}, f AS (SELECT *, CASE WHEN refs AND NOT head THEN 'reference 0' WHEN head THEN 'heading 1'
 WHEN length(t) BETWEEN 1 AND 500 AND ({PLAIN_SHARE} >= 0.6 OR regexp_full_match(t, '\\([0-9]+[a-z]?\\)\\s*\\$[^$]+\\$') OR regexp_full_match(t, '\\$[^$]+\\$\\s*\\([0-9]+[a-z]?\\)')) THEN 'equation 0'
 WHEN regexp_matches(t, '^(?i)(abstract|摘要)([^A-Za-z0-9_]|$)') THEN 'abstract 0'
 WHEN regexp_matches(t, '^(?i)(figure|fig\\.|table|algorithm|listing|scheme|eq\\.)[ \\t]*[0-9]+') AND size <= 10.2 THEN 'caption 0'
 WHEN candidate AND size >= 16 AND page = 1 THEN 'title 0' WHEN candidate AND section AND NOT regexp_matches(tail, '[.。:,]$') THEN 'heading ' || numbered
 WHEN candidate AND size >= 11.5 THEN 'heading 1' WHEN candidate AND bold AND NOT regexp_matches(tail, '[.。:]$') THEN 'heading 2'
 WHEN short AND section AND NOT regexp_matches(tail, '[.。:]$') THEN 'heading ' || numbered ELSE 'text 0' END AS made FROM k)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, split_part(made, ' ', 1) AS kind, CAST(split_part(made, ' ', 2) AS INTEGER) AS level FROM f""")
def dec_block_kinds(spark, sf_dir):
    """Classes and levels of blocks by text, size, face, page and order."""
    pos, t = F.col("pos"), F.col("text")
    number = F.concat((pos % 4).cast("string"), F.when(pos % 2 == 0, ".2 ").otherwise(" "), F.substring(t, 1, 30))
    made = F.when(pos % 29 == 0, "References").when(pos % 7 == 0, number).when(pos % 11 == 0, F.concat(F.lit("Figure 3: "), t)).when(pos % 13 == 0, F.concat(F.lit("Abstract "), t))
    made = made.when(pos % 17 == 0, F.concat(F.lit("(4) $"), F.regexp_replace(F.substring(t, 1, 40), r"[$\\]", ""), F.lit("$"))).otherwise(F.substring(t, 1, 100))
    blocks = _paragraphs(spark, sf_dir).select("doc_id", "pos", (F.floor((pos - 1) / 6) + 1).alias("page"), made.alias("text"), (F.lit(10.0) + pos * 3 % 8).alias("size"), F.lit(10.0).alias("body"), (pos % 5 == 0).alias("bold"))
    return ordered.classified_blocks(blocks).select("doc_id", "pos", "kind", "level")


#: Paragraphs as blocks at places from top to bottom; every ninth is its page's running head, every eleventh a number or a numeral.
ZONED = f"""{PARAGRAPHS}, z AS (SELECT doc_id, pos, (pos - 1) // 4 + 1 AS page, CASE WHEN pos % 9 = 0 THEN 'Section ' || pos || ' of ' || substr(text, 1, 4) WHEN pos % 11 = 0 THEN CASE WHEN pos % 2 = 0 THEN CAST(pos AS VARCHAR) ELSE 'XIV' END ELSE text END AS text, pos * 29 % 100 AS y0 FROM paragraphs)"""


@query(f"""WITH {ZONED}, e AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '{W}+', ' ', 'g')) AS key, y0 + 3 <= 6.2 OR y0 >= 94.5 AS edge, max(page) OVER (PARTITION BY doc_id) AS pages FROM z),
n AS (SELECT *, count(*) FILTER (edge) OVER (PARTITION BY doc_id, key) AS often FROM e)
SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM n WHERE (edge AND (often >= greatest(2, CAST(floor(0.3 * pages) AS INTEGER)) OR regexp_matches(text, '^(?i)(arxiv:|https?://|www\\.|doi:|©|copyright|[0-9]{{1,4}}$|[0-9]+\\s*\\|\\s*page|proceedings of|downloaded from)') OR regexp_matches(text, '^[0-9]{{1,4}}$')))
 OR (regexp_matches(text, '^[0-9IVXivx]{{1,4}}$') AND length(text) * 20 < 72)""")
def dec_page_furniture(spark, sf_dir):
    """What repeats on three pages in ten, known furniture, and page numbers."""
    pos, t = F.col("pos"), F.col("text")
    made = F.when(pos % 9 == 0, F.concat(F.lit("Section "), pos.cast("string"), F.lit(" of "), F.substring(t, 1, 4))).when(pos % 11 == 0, F.when(pos % 2 == 0, pos.cast("string")).otherwise("XIV")).otherwise(t)
    b = _paragraphs(spark, sf_dir).select("doc_id", "pos", (F.floor((pos - 1) / 4) + 1).alias("page"), made.alias("text"), F.lit(1).alias("lines"), F.lit(0.0).alias("x0"), (pos * 29 % 100).cast("double").alias("y0"))
    b = b.withColumns({"x1": F.length("text") * 20.0, "y1": F.col("y0") + 3})
    return review.page_furniture(b, 100.0, 600.0).select("doc_id", "pos")


@query(f"""WITH {PARAGRAPHS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, text FROM paragraphs WHERE (pos - 1) // 6 + 1 BETWEEN greatest(2, 1) AND 3""")
def page_range(spark, sf_dir):
    """Pages of six paragraphs, from the second to the third, as far as a document has them."""
    bounds = text.page_bounds(F.lit("2-3"))
    page = F.floor((F.col("pos") - 1) / 6) + 1
    return _paragraphs(spark, sf_dir).filter(page.between(F.greatest(bounds["first"], F.lit(1)), bounds["last"])).select("doc_id", "pos", "text")


@query(f"""WITH {PARAGRAPHS} SELECT doc_id, CAST((pos - 1) // 3 + 1 AS INTEGER) AS page, CAST(sum(length(text)) AS BIGINT) AS chars FROM paragraphs GROUP BY ALL HAVING sum(length(text)) < 40""")
def scanned_pages(spark, sf_dir):
    """Pages of three paragraphs with so little text that they would be read by character recognition."""
    pages = _paragraphs(spark, sf_dir).withColumn("page", (F.floor((F.col("pos") - 1) / 3) + 1).cast("int"))
    return review.scanned_pages(pages).select("doc_id", "page", "chars")


@query("""SELECT page_id, CASE WHEN ends_with(lower(url || CASE WHEN page_id % 5 = 0 THEN '.PDF' ELSE '' END), '.pdf') OR starts_with(CASE WHEN page_id % 7 = 0 THEN '%PDF-1.7' || html ELSE html END, '%PDF') THEN 'pdf' ELSE 'other' END AS kind FROM pages""")
def dec_source_types(spark, sf_dir):
    n = F.col("page_id")
    name, content = F.concat("url", F.when(n % 5 == 0, ".PDF").otherwise("")), F.concat(F.when(n % 7 == 0, "%PDF-1.7").otherwise(""), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", text.source_type(name, content).alias("kind"))


@query(rf"""WITH {PARAGRAPHS}, d AS (SELECT doc_id, pos, replace(replace(text, ', ', ' • '), ' of ', ': of ') AS t FROM paragraphs),
i AS (SELECT doc_id, pos, list_filter(list_transform(string_split(t, '•')[2:], lambda x: regexp_replace(x, '^{W}+|{W}+$', '', 'g')), lambda x: x <> '') AS items FROM d), u AS (SELECT doc_id, pos, unnest(range(1, len(items) + 1)) AS item, items FROM i)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(item AS INTEGER) AS item, nullif(regexp_extract(items[item], '^([^:：]{{1,42}})[:：]', 1), '') AS label,
 CASE WHEN regexp_matches(items[item], '^([^:：]{{1,42}})[:：]') THEN regexp_replace(substr(items[item], length(regexp_extract(items[item], '^([^:：]{{1,42}})[:：]', 1)) + 2), '^{W}+|{W}+$', '', 'g') ELSE items[item] END AS text FROM u""")
def dec_list_items(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit(", "), F.lit(" • ")), F.lit(" of "), F.lit(": of "))
    d = _paragraphs(spark, sf_dir).select("doc_id", "pos", F.posexplode(text.list_items(t)["items"]).alias("item", "x"))
    return d.select("doc_id", "pos", (F.col("item") + 1).alias("item"), "x.label", "x.text")


@query(rf"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(replace(text, '. ', chr(10) || ' ' || chr(10)), '\n[ \t\r]*\n\s*'), lambda x: regexp_replace(x, '^{W}+|{W}+$', '', 'g')), lambda x: x <> ''), '¶')) AS paragraphs FROM documents WHERE text IS NOT NULL""")
def dec_blank_line_paragraphs(spark, sf_dir):
    """Documents with a blank line after each sentence, parted at their blank lines."""
    t = F.replace("text", F.lit(". "), F.lit("\n \n"))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(F.array_join(text.blank_line_paragraphs(t), "¶")).alias("paragraphs"))


#: Orders as tables of four columns; the third is blank in every second order, and every third line is blank throughout.
TABLED = """l AS (SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN ['', ' ', '', ''] ELSE [CAST(l_linenumber AS VARCHAR), l_returnflag || '|' || l_linestatus, CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'x' END, CAST(l_partkey AS VARCHAR)] END AS r, l_linenumber, l_partkey FROM lineitem),
g AS (SELECT l_orderkey, list(r ORDER BY l_linenumber, l_partkey, r) AS rows FROM l GROUP BY l_orderkey)"""


def _tabled(spark, sf_dir):
    """What the rows are made of is shuffled, the rows are put together after that."""
    blank = F.array(F.lit(""), F.lit(" "), F.lit(""), F.lit(""))
    third = F.when(F.col("l_orderkey") % 2 == 0, "").otherwise("x")
    ordered_rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", F.lit("|"), "l_linestatus").alias("status"))))
    row = lambda x: F.when(x["l_linenumber"] % 3 == 0, blank).otherwise(F.array(x["l_linenumber"].cast("string"), x["status"], third, x["l_partkey"].cast("string")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ordered_rows.alias("_l")).select("l_orderkey", F.transform("_l", row).alias("rows"))


@query(rf"""WITH {TABLED}, k AS (SELECT l_orderkey, list_filter(rows, lambda r: len(list_filter(r, lambda c: trim(c) <> '')) > 0) AS kept FROM g),
c AS (SELECT *, list_filter([1, 2, 3, 4], lambda j: len(list_filter(kept, lambda r: trim(r[j]) <> '')) > 0) AS cols FROM k),
t AS (SELECT l_orderkey, list_transform(kept, lambda r: '| ' || array_to_string(list_transform(cols, lambda j: replace(trim(r[j]), '|', '\|')), ' | ') || ' |') AS lines, len(cols) AS n FROM c WHERE len(kept) >= 2 AND len(cols) >= 2)
SELECT l_orderkey, md5(array_to_string(list_concat(list_concat(lines[1:1], ['|' || repeat(' --- |', n)]), lines[2:]), chr(10))) AS markdown FROM t""")
def dec_markdown_tables(spark, sf_dir):
    # exploded, so that the filter does not work the table out a second time
    return _tabled(spark, sf_dir).select("l_orderkey", F.explode(F.array(F.md5(text.markdown_table(F.col("rows"))))).alias("markdown")).filter("markdown IS NOT NULL")


@query(f"""WITH {TABLED} SELECT l_orderkey, md5(array_to_string(list_transform(rows, lambda r: array_to_string(r, chr(9))), chr(10))) AS tsv FROM g""")
def dec_tab_separated(spark, sf_dir):
    return _tabled(spark, sf_dir).select("l_orderkey", F.md5(text.tab_separated(F.col("rows"))).alias("tsv"))


#: Replies with JSON in a fence, among words, as a list, or cut off.
@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 OR event_type IS NULL THEN NULL ELSE md5(CASE WHEN event_id % 4 = 2 THEN '[1, "' || event_type || '"]' ELSE '{"zh": "' || event_type || '"}' END) END AS json FROM events""")
def dec_cut_json(spark, sf_dir):
    n, inner = F.col("event_id") % 4, F.concat(F.lit('{"zh": "'), "event_type", F.lit('"}'))
    reply = F.when(n == 0, F.concat(F.lit("```json\n"), inner, F.lit("\n```"))).when(n == 1, F.concat(F.lit("Here it is: "), inner, F.lit(" as asked"))).when(n == 2, F.concat(F.lit('The list: [1, "'), "event_type", F.lit('"]'))).otherwise(F.concat(F.lit('{"zh": "'), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.md5(tables.cut_json(reply)).alias("json"))


@query("""SELECT doc_id FROM documents d WHERE doc_id % 3 <> 0 AND (lang = 'en' OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def restore_todo(spark, sf_dir):
    """Documents of a wanted set whose record has no restored text yet; forced ones would come anyway."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels")
    only = d.filter("lang = 'en'").select("doc_id").unionByName(labels.filter("toxic = 1").select("doc_id"))
    return migrate.todo(d, labels.select("doc_id", F.when(F.col("quality") == 1, "en").alias("en")), ["doc_id"], "en", only).select("doc_id")


@query(f"""WITH {REMATCH} SELECT m.doc_id, CAST(old_pos AS INTEGER) AS old_pos, CAST(new_pos AS INTEGER) AS new_pos FROM matches m JOIN paragraphs o ON o.doc_id = m.doc_id AND o.pos = m.old_pos JOIN shifted n ON n.doc_id = m.doc_id AND n.pos = m.new_pos
WHERE n.text <> o.text AND starts_with(n.text, rtrim(o.text))""")
def stale_records(spark, sf_dir):
    """Records whose paragraph grew, so that they cover only its beginning."""
    p = _paragraphs(spark, sf_dir).select("doc_id", "pos", "text")
    return migrate.stale(migrate.rematch(p, _shifted(spark, sf_dir)), p, _shifted(spark, sf_dir))


#: Turns as records of nested strings.
def _records(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    cells = F.transform(F.split(t, r"\. "), lambda c: F.struct(c.alias("text"), F.lit(1).alias("span")))
    record = F.struct(t.alias("zh"), F.split(t, ", ").alias("lines"), F.struct(F.col("role").alias("caption"), F.array(cells).alias("rows")).alias("table"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), record.alias("record"))


@query()  # formulas need a scan by characters; the tests hold each string against the scalar repairs and a plain version
def dec_record_repairs(spark, sf_dir):
    """Records with a price, a formula with an angle and a bare command in every string, repaired throughout."""
    r = _records(spark, sf_dir)
    broken = records.over_strings(F.col("record"), r.schema["record"].dataType, lambda s: F.concat(s, F.lit(r" at $5 or $a<b$ and $\hat$")))
    return records.repair_results(r.withColumn("record", broken), ["record"]).select("doc_id", "pos", F.md5(F.to_json("record")).alias("record"))


@query("""WITH s AS (SELECT conv_id AS doc_id, turn AS pos, coalesce(text, '') AS t, role FROM conversations),
u AS (SELECT doc_id, pos, t, role, replace(replace(t, 'the ', 'one '), ' a', ' b') AS zh, (length(t) - length(replace(t, 'the ', ''))) // 4 AS n1, (length(replace(t, 'the ', 'one ')) - length(replace(replace(t, 'the ', 'one '), ' a', ''))) // 2 AS n2 FROM s)
SELECT doc_id, pos, md5(zh) AS zh, role AS caption, n1 + n2 AS replaced FROM u""")
def dec_unified_records(spark, sf_dir):
    """Two replacements in every string of each record, the longer one first, and how often they were made."""
    r = _records(spark, sf_dir).select("doc_id", "pos", F.struct(F.col("record.zh").alias("zh"), F.array(F.struct(F.col("record.table.caption").alias("caption"))).alias("notes")).alias("record"))
    pairs = F.array(F.struct(F.lit(" a").alias("zh"), F.lit(" b").alias("best")), F.struct(F.lit("the ").alias("zh"), F.lit("one ").alias("best")))
    plan = r.select("doc_id").distinct().select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.zh", "p.best")
    u = records.unify(r, ["record"], plan)
    return u.select("doc_id", "pos", F.md5("record.zh").alias("zh"), F.get("record.notes", F.lit(0))["caption"].alias("caption"), "replaced")


@query("""WITH t AS (SELECT conv_id AS doc_id, split_part(text, ' ', 1) AS en, min(role) AS zh FROM conversations WHERE text <> '' GROUP BY ALL), n AS (SELECT doc_id, lower(en) AS k, min('note of ' || zh) AS note FROM t WHERE length(en) % 2 = 0 GROUP BY ALL),
r AS (SELECT t.doc_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY lower(t.en), t.en, zh) AS rank, t.en, t.zh, n.note FROM t LEFT JOIN n ON n.doc_id = t.doc_id AND n.k = lower(t.en))
SELECT doc_id, CAST(rank AS INTEGER) AS rank, en, zh, note FROM r WHERE rank <= 120""")
def glossary_notes(spark, sf_dir):
    """A glossary built anew from first words, with the notes that an earlier one held in another case."""
    c = table(spark, sf_dir, "conversations").filter("text <> ''")
    terms = c.groupBy(F.col("conv_id").alias("doc_id"), F.get(F.split("text", " "), F.lit(0)).alias("en")).agg(F.min("role").alias("zh"))
    earlier = terms.filter(F.length("en") % 2 == 0).select("doc_id", F.upper("en").alias("en"), F.concat(F.lit("note of "), "zh").alias("note"))
    return records.keep_notes(terms, earlier)


@query(f"""WITH {PARAGRAPHS}, d AS (SELECT doc_id, pos, pos % 2 = 0 AS had, CASE pos % 4 WHEN 0 THEN '' WHEN 1 THEN text || ' ⟦?⟧' ELSE text || ' \\sqrt ?' END AS zh FROM paragraphs WHERE NOT contains(text, '$') AND NOT contains(text, chr(92)))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN contains(zh, '⟦?⟧') THEN 'placeholder' ELSE 'question mark' END AS reasons FROM d WHERE trim(zh) <> '' AND (contains(zh, '⟦?⟧') OR (had AND regexp_matches(zh, '\\\\[A-Za-z]{{2,}}\\s*\\?')))""")
def dec_needs_repair(spark, sf_dir):
    """Results that kept a placeholder or covered one up; a question mark counts only where the source had one. Texts with formulas of their own stay out of this comparison."""
    pos = F.col("pos")
    p = _paragraphs(spark, sf_dir).filter(~F.col("text").contains("$") & ~F.col("text").contains("\\"))
    sources = p.select("doc_id", "pos", F.when(pos % 2 == 0, F.concat("text", F.lit(mathtext.MISSING))).otherwise(F.col("text")).alias("text"))
    results = p.select("doc_id", "pos", F.when(pos % 4 == 0, "").when(pos % 4 == 1, F.concat("text", F.lit(" " + mathtext.MISSING))).otherwise(F.concat("text", F.lit(r" \sqrt ?"))).alias("zh"))
    return records.needs_repair(sources, results).select("doc_id", "pos", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {PARAGRAPHS}, s AS (SELECT doc_id, pos, text, list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS n FROM paragraphs), l AS (SELECT *, lead(text) OVER w AS other FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT doc_id, pos, list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?'), lambda x: length(x) >= 2), lambda x: lower(x))) AS a, list_distinct(list_transform(list_filter(regexp_extract_all(other, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?'), lambda x: length(x) >= 2), lambda x: lower(x))) AS b, n, list_distinct(regexp_extract_all(other, '[0-9]+(?:\\.[0-9]+)?')) AS m FROM l WHERE other IS NOT NULL)
SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM k WHERE len(list_filter(n, lambda x: NOT list_contains(m, x))) = 0 AND pos % 5 >= 2 AND len(list_intersect(a, b)) / greatest(len(a), 1) >= 0.45""")
def kept_content(spark, sf_dir):
    """Paragraphs whose follower would pass as their rewriting: all numbers, two steps and near half of the tokens."""
    from pyspark.sql import Window

    p = _paragraphs(spark, sf_dir).withColumn("other", F.lead("text").over(Window.partitionBy("doc_id").orderBy("pos"))).filter("other IS NOT NULL")
    return p.filter(quality.keeps_content(F.col("text"), F.col("other"), F.col("pos") % 5)).select("doc_id", "pos")


@query("""WITH o AS (SELECT user_id, event_type, min(event_id) AS first FROM events WHERE event_id % 2 = 0 GROUP BY ALL), n AS (SELECT user_id, event_type, max(event_id) AS first FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT user_id, event_type, coalesce(n.first, o.first) AS first FROM o FULL JOIN n USING (user_id, event_type)""")
def keyed_upsert(spark, sf_dir):
    """Records of one run with those of a later run in place of the same keys."""
    e = table(spark, sf_dir, "events")
    old = e.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    new = e.filter("event_id % 3 = 0").groupBy("user_id", "event_type").agg(F.max("event_id").alias("first"))
    return tables.upsert(old, new, ["user_id", "event_type"])


@query(f"""WITH {PARAGRAPHS}, s AS (SELECT doc_id, CAST(pos AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS x, 'text' AS kind, CAST(NULL AS BIGINT) AS item FROM paragraphs UNION ALL SELECT conv_id, turn + 0.5, 1, 'turn', turn FROM conversations)
SELECT doc_id, kind, item, y, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, kind, item) AS place FROM s""")
def joined_sources(spark, sf_dir):
    """Text blocks and structured blocks of a document, with what each lacks as nulls, in the order of y and x."""
    p = _paragraphs(spark, sf_dir).select("doc_id", F.col("pos").cast("double").alias("y"), F.lit(0.0).alias("x"), F.lit("text").alias("kind"))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 0.5).alias("y"), F.lit(1.0).alias("x"), F.lit("turn").alias("kind"), F.col("turn").cast("long").alias("item"))
    return ordered.in_place(p.unionByName(c, allowMissingColumns=True)).select("doc_id", "kind", "item", "y", "place")


@query("""SELECT l.doc_id, quality, toxic FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def kept_records(spark, sf_dir):
    """Records of the documents that are kept."""
    d = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id")
    return table(spark, sf_dir, "labels").join(d, "doc_id", "left_semi").select("doc_id", "quality", "toxic")


@query(f"""WITH {PARAGRAPHS} SELECT doc_id, regexp_replace(text, '\\$[^$]*\\$', '', 'g') AS authors FROM paragraphs WHERE pos = 2 AND length(text) < 400""")
def author_lines(spark, sf_dir):
    p = _paragraphs(spark, sf_dir).filter((F.col("pos") == 2) & (F.length("text") < 400))
    return p.select("doc_id", text.strip_math(F.col("text")).alias("authors"))


@query("""SELECT source, count(*) AS documents, count(*) FILTER (quality IS NOT NULL) AS restored, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS chars, count(quality) = count(*) AND count(*) FILTER (toxic = 1) = 0 AS passes FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source""")
def display_statistics(spark, sf_dir):
    """Counts of a source's records with fallbacks, and whether all are there and none failed."""
    done = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(done, "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.count("quality").alias("restored"), F.sum(F.coalesce("n_chars", F.lit(0))).cast("long").alias("chars"), ((F.count("quality") == F.count("*")) & (F.count_if(F.col("toxic") == 1) == 0)).alias("passes"))


#: Marks of combining characters: a stroke through a relation, an accent on a letter.
@query(f"""WITH {PARAGRAPHS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(text) - length(replace(text, 'e', '')) AS accents, length(text) - length(replace(text, '=', '')) AS strokes FROM paragraphs""")
def dec_combining_marks(spark, sf_dir):
    """Letters under an accent go with it, a struck-out equals sign is one relation: counted by what they leave."""
    from quire.functions import glyphs

    solid = F.regexp_replace("text", "[^A-Za-z=]", "")
    marked = F.replace(F.replace(solid, F.lit("e"), F.lit("e\u0301")), F.lit("="), F.lit("=\u0338"))
    p = _paragraphs(spark, sf_dir).select("doc_id", "pos", F.length(solid).alias("n"), F.concat(glyphs.latex(marked), F.lit(" ")).alias("made"))
    bare = F.regexp_replace(F.replace("made", F.lit(r"\neq "), F.lit("=")), " $", "")
    strokes = (F.length("made") - F.length(F.replace("made", F.lit(r"\neq "), F.lit("")))) / 5
    return p.select("doc_id", "pos", (F.col("n") - F.length(bare)).cast("long").alias("accents"), strokes.cast("long").alias("strokes"))


#: Orders as tables of three columns under a wide head and, in every fifth, a caption; in every fourth the second cell is wide; every third line continues the row above.
@query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
r AS (SELECT *, sum(CASE WHEN n % 3 = 0 AND k > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY o ORDER BY k) AS g FROM l),
c AS (SELECT o, g, string_agg('a' || n, ' ' ORDER BY k) AS a, string_agg('b' || p, ' ' ORDER BY k) AS b, string_agg('c' || k, ' ' ORDER BY k) AS c, string_agg('b' || p || ' c' || k, ' ' ORDER BY k) AS bc FROM r GROUP BY o, g)
SELECT o AS doc_id, CAST(1 AS INTEGER) AS row, 'wide:3|-|-' AS cells FROM (SELECT DISTINCT o FROM l)
UNION ALL SELECT o, CAST(g + 1 AS INTEGER), a || ':1|' || CASE WHEN o % 4 = 1 THEN bc || ':2|-' ELSE b || ':1|' || c || ':1' END FROM c""")
def dec_span_grids(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    word = lambda x0, x1, t: F.struct(F.lit(x0).cast("double").alias("x0") if not hasattr(x0, "cast") else x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), t.alias("t"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), k.alias("k"))
    gap = F.when((F.col("n") % 3 == 0) & (F.col("k") > 1), 5.0).otherwise(12.0)
    l = l.withColumn("y", F.sum(gap).over(Window.partitionBy("doc_id").orderBy("k")))
    wide = F.col("doc_id") % 4 == 1
    words = F.array(word(10.0, F.lit(60.0), F.concat(F.lit("a"), F.col("n").cast("string"))), word(110.0, F.when(wide, 280.0).otherwise(150.0), F.concat(F.lit("b"), F.col("p").cast("string"))), word(210.0, F.lit(250.0), F.concat(F.lit("c"), F.col("k").cast("string"))))
    lines = F.collect_list(F.struct("y", words.alias("words")))
    head = F.array(F.struct(F.lit(0.0).alias("y"), F.array(word(40.0, F.lit(260.0), F.lit("wide"))).alias("words")))
    caption = F.array(F.struct(F.lit(-20.0).alias("y"), F.array(word(40.0, F.lit(80.0), F.lit("Table")), word(90.0, F.lit(100.0), F.lit("3:"))).alias("words")))
    none = F.slice(caption, F.lit(1), F.lit(0))
    g = l.groupBy("doc_id").agg(lines.alias("_l")).withColumn("_l", F.concat(F.when(F.col("doc_id") % 5 == 0, caption).otherwise(none), head, "_l"))
    slots = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(a + 100.0).alias("b")) for a in (0.0, 100.0, 200.0)])
    rows = g.select("doc_id", F.posexplode(grids.span_grid(F.col("_l"), slots, F.lit(10.0))).alias("_k", "r"))
    text_of = F.array_join(F.transform("r", lambda c: F.coalesce(F.concat(c["text"], F.lit(":"), c["span"].cast("string")), F.lit("-"))), "|")
    return rows.select("doc_id", (F.col("_k") + 1).alias("row"), text_of.alias("cells"))


#: Parts as drawings on their size's page: thin or thick, wide or narrow.
@query("""SELECT DISTINCT CAST(p_size AS BIGINT) AS doc_id, CAST(round(p_partkey % 50 + 0.04, 1) AS DOUBLE) AS y, CAST(round(p_partkey % 7 + 0.26, 1) AS DOUBLE) AS x0, CAST(round(p_partkey % 7 + 0.26 + p_partkey % 60, 1) AS DOUBLE) AS x1 FROM part WHERE p_partkey % 4 < 2 AND p_partkey % 60 >= 30""")
def dec_rules(spark, sf_dir):
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("doc_id"), F.lit(1).alias("page"), (k % 7 + 0.26).alias("x0"), (k % 7 + 0.26 + k % 60).alias("x1"), (k % 50 + 0.04).alias("y0"), (k % 50 + 0.04 + k % 4 * 1.5).alias("y1"))
    return grids.rules(d).select("doc_id", "y", "x0", "x1")


#: Orders as blocks and boxes of their customer's page, places by their keys.
BOXED = """b AS (SELECT o_custkey AS doc_id, o_orderkey AS block, o_orderkey * 37 % 500 AS x0, o_orderkey * 37 % 500 + 40 AS x1, o_orderkey * 53 % 300 AS y0, o_orderkey * 53 % 300 + 12 AS y1 FROM orders WHERE o_orderkey % 3 <> 0),
t AS (SELECT o_custkey AS doc_id, o_orderkey AS region, o_orderkey * 29 % 300 AS x0, o_orderkey * 29 % 300 + 220 AS x1, o_orderkey * 31 % 200 AS y0, o_orderkey * 31 % 200 + 90 AS y1 FROM orders WHERE o_orderkey % 3 = 0)"""


def _boxed(spark, sf_dir):
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    place = lambda a, m, d, name: [(k * a % m).cast("double").alias(f"{name}0"), (k * a % m + d).cast("double").alias(f"{name}1")]
    b = o.filter("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), k.alias("block"), *place(37, 500, 40, "x"), *place(53, 300, 12, "y"), F.concat(F.when(k % 2 == 0, "Table ").otherwise("Note "), k.cast("string"), F.lit(": t")).alias("text"))
    t = o.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), k.alias("region"), *place(29, 300, 220, "x"), *place(31, 200, 90, "y"))
    return b, t


@query(f"""WITH {BOXED} SELECT doc_id, block FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = b.doc_id AND b.x0 >= t.x0 - 3 AND b.x1 <= t.x1 + 3 AND b.y0 >= t.y0 - 3 AND b.y1 <= t.y1 + 3)""")
def dec_blocks_outside(spark, sf_dir):
    b, t = _boxed(spark, sf_dir)
    return grids.outside(b, t).select("doc_id", "block")


@query(f"""WITH {BOXED} SELECT DISTINCT b.doc_id, block FROM b JOIN t USING (doc_id) WHERE least(b.x1, t.x1) > greatest(b.x0, t.x0) AND least(b.y1, t.y1) > greatest(b.y0, t.y0) AND (least(b.x1, t.x1) - greatest(b.x0, t.x0)) * (least(b.y1, t.y1) - greatest(b.y0, t.y0)) >= 0.5 * least(40 * 12, 220 * 90)""")
def dec_overlaps(spark, sf_dir):
    b, t = _boxed(spark, sf_dir)
    return grids.overlapping(b, t).select("doc_id", "block")


@query(f"""WITH {BOXED}, n AS (SELECT t.doc_id, region, block, greatest(t.y0 - b.y1, b.y0 - t.y1, 0) AS far FROM t JOIN b USING (doc_id) WHERE block % 2 = 0)
SELECT doc_id, region, block, 'Table ' || block || ': t' AS caption FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, region ORDER BY far, block) AS k FROM n WHERE far <= 40) WHERE k = 1""")
def dec_absorbed_captions(spark, sf_dir):
    b, t = _boxed(spark, sf_dir)
    return grids.absorbed_captions(t, b).select("doc_id", "region", "block", "caption")


@query(f"""WITH {PARAGRAPHS}, p AS (SELECT doc_id, (pos - 1) // 50 AS region, pos, text FROM paragraphs)
SELECT doc_id, CAST(region AS INTEGER) AS region, CAST(least(count(*), 40) AS INTEGER) AS lines, md5(string_agg(text, chr(10) ORDER BY pos) FILTER ((pos - 1) % 50 < 40)) AS text FROM p GROUP BY doc_id, region HAVING sum(len(string_split(text, ' '))) >= 3""")
def dec_figure_texts(spark, sf_dir):
    """Fifty paragraphs as the lines of a figure: at most forty count, and too few words are none."""
    words = F.transform(F.split("text", " "), lambda t, i: F.struct(i.cast("double").alias("x0"), (i + 1).cast("double").alias("x1"), t.alias("t")))
    p = _paragraphs(spark, sf_dir).select("doc_id", F.floor((F.col("pos") - 1) / 50).cast("int").alias("region"), F.struct(F.col("pos").cast("double").alias("y"), words.alias("words")).alias("line"))
    g = p.groupBy("doc_id", "region").agg(F.collect_list("line").alias("lines")).withColumn("t", grids.figure_text(F.col("lines"))).filter("t IS NOT NULL")
    return g.select("doc_id", "region", F.size("t").alias("lines"), F.md5(F.array_join("t", "\n")).alias("text"))


@query(f"""WITH {PARAGRAPHS}, n AS (SELECT unnest(['language', 'age', 'the langu', 'and', 'an']) AS term), m AS (SELECT doc_id, pos, lower(unnest(regexp_extract_all(regexp_replace(text, '\\$[^$]*\\$', ' ', 'g'), '(?i)the langu|language|age|and|an'))) AS term FROM paragraphs WHERE pos % 6 <> 0)
SELECT doc_id, term, CAST(min(pos) AS INTEGER) AS pos FROM m GROUP BY doc_id, term""")
def dec_term_marks(spark, sf_dir):
    """Where each term is marked first: longer terms before shorter ones, none inside formulas, every sixth paragraph being a table."""
    p = _paragraphs(spark, sf_dir).select("doc_id", "pos", "text", F.when(F.col("pos") % 6 == 0, "table").otherwise("text").alias("kind"))
    terms = p.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, ("an", "and", "age", "language", "the langu")))).alias("term"))
    return ordered.term_marks(p, terms)
