"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LOWER, UPPER, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality_rules import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.line_dedup import apply_bitmaps, keep_bitmaps

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = apply_bitmaps(docs, keep_bitmaps(docs))
    return d.select("doc.doc_id", F.size("lines").cast("long").alias("n_lines"), "n_dropped", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.url_filters import canonical, host_of, path_of, url_verdicts

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # the list: the canonical URLs whose number is a document that is labelled toxic
    number = F.try_to_number(F.nullif(F.regexp_extract("url", r"/([0-9]{1,18})(?:[/.?#].*)?$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("_n"))
    of_page = pages.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key"), number.alias("_n"))
    return url_verdicts(pages, of_page.join(toxic, "_n", "left_semi").select("key"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.factorisation import quality_scores

    held_out = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)")
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    scores = quality_scores(table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_shingles")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.secret_scan import scan

    spans = scan(table(spark, sf_dir, "documents"))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.language_id import predict_language

    held_out = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)")
    docs = table(spark, sf_dir, "documents")
    got = predict_language(docs.select("doc_id", "text"), docs.filter(~held_out).select("text", "lang"))
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.conversation_repair import damaged, repair_report

    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, damaged(conversations))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_lm_scoring, op4_packing, op5_quality_classifier, op6_mixing, op7_url_filters, op8_ngram_jaccard_join, op9_secret_scans, op10_exact_top_k, op11_ranked_search, op12_language_id, op13_conversation_repair)}


OP2 = rf"""WITH l AS (SELECT doc_id, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
f AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key),
d AS (SELECT l.*, coalesce(l.doc_id > f.first, false) AS gone FROM l LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""

_FITS = "((host = '{1}' OR ends_with(host, '.{1}')) AND starts_with(path, '{2}'))"


def _op7() -> str:
    from quire.llm.url_filters import RULES

    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    pick = lambda f: "CASE " + " ".join(f"WHEN {_FITS.format(*r)} THEN '{f(r)}'" for r in longest) + " END"
    canonical = "regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html)$', '')"
    return f"""WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
listed AS (SELECT DISTINCT {canonical} AS key FROM p WHERE TRY_CAST(nullif(regexp_extract(url, '/([0-9]{{1,18}})(?:[/.?#].*)?$', 1), '') AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT page_id, host, path, {pick(lambda r: r[1] + r[2])} AS rule, coalesce({pick(lambda r: r[0])}, CASE WHEN host <> '' AND {canonical} IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
  {pick(lambda r: r[0])} IS NULL AND host <> '' AND {canonical} IN (SELECT key FROM listed) AS listed FROM p"""


OP10 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


OP11 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t)) AS n_terms FROM d),
q AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, n_docs),
v AS (SELECT r, doc_id, CAST(75 + (25 * len(t) * n_docs) // n_terms AS BIGINT) AS m FROM d, c WHERE len(t) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(n * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN v USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""


def _op13() -> str:
    """The four states row by row in a recursive query, each with its cost and audit; structs compare by cost, then audit."""
    plus = lambda s, cost, letters: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letters}'}}"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    keep = lambda s, role: f"CASE WHEN role = '{role}' AND fault NOT IN (1, 2) THEN {plus(s, 'late', 'K')} END"
    rerole = lambda s: f"CASE WHEN fault NOT IN (1, 2) THEN {plus(s, '1 + late', 'R')} END"
    nothing = "{'c': 1000000000000, 'a': ''}"
    before_user, before_assistant = least("u", plus("z", 5, "I"), plus("s", 5, "I"), plus("a", 5, "I")), least("a", plus("u", 5, "I"), plus("z", 10, "II"), plus("s", 10, "II"))
    return rf"""WITH RECURSIVE table_ AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM n, table_),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault,
  left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM f GROUP BY conv_id),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS z, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM g
  UNION ALL SELECT conv_id, pos, least_z, least_s, least_u, least_a FROM (SELECT conv_id, pos, {plus('z', 2, 'D')} AS least_z, {least(plus('s', 2, 'D'), keep('z', 's'))} AS least_s,
    {least(plus('pu', 2, 'D'), keep('z', 'u'), keep('s', 'u'), keep('pa', 'u'), rerole('z'), rerole('s'), rerole('pa'))} AS least_u, {least(plus('pa', 2, 'D'), keep('pu', 'a'), rerole('pu'))} AS least_a
    FROM (SELECT f.conv_id, f.pos, f.initial AS role, f.fault, CASE WHEN f.fault = 3 THEN 5 ELSE 0 END AS late, z, s, u, a, {before_user} AS pu, {before_assistant} AS pa FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos + 1))),
e AS (SELECT r.conv_id, {least('z', 'a', plus('u', 5, 'I'), plus('s', 10, 'II'))} AS best FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.n = r.pos),
l AS (SELECT conv_id, unnest(string_split(best.a, '')) AS letter, unnest(range(length(best.a))) AS spot FROM e WHERE best.a <> ''),
m AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w AS place FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY spot)),
p AS (SELECT m.conv_id, m.spot, m.letter, m.place, f.role, f.text, bool_or(m.letter = 'K' AND m.place = 1 AND f.initial = 's') OVER (PARTITION BY m.conv_id) AS system FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.pos = m.pos AND m.letter <> 'I' WHERE m.letter <> 'D'),
x AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - CAST(coalesce(system, false) AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY spot) AS joined FROM p GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(joined, '')) AS repaired_sha256
FROM ids LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM ids.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op13_conversation_repair": _op13(), "op11_ranked_search": OP11, "op2_line_dedup": OP2, "op7_url_filters": _op7(), "op10_exact_top_k": OP10}
