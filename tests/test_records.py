"""Records of nested strings, moves of results, and the plans that joins replace, against plain versions."""

import collections
import random
import re

from pyspark.sql import functions as F

from quire import catalog_records
from quire.functions import glyphs, mathtext
from quire.operators import figures, migrate, quality, records, votes

NESTED = "doc_id long, pos int, record struct<a:string,b:array<string>,c:map<string,string>,d:array<struct<e:string,n:int>>>"


def test_every_string_changes(spark):
    data = [(1, 1, ("x", ["y", None], {"k": "z"}, [("u", 1), (None, 2), None])), (1, 2, None), (2, 1, (None, None, None, None))]
    df = spark.createDataFrame(data, NESTED)
    kind = df.schema["record"].dataType
    got = df.select(records.over_strings(F.col("record"), kind, F.upper).alias("r"), records.strings_of(F.col("record"), kind).alias("s")).collect()
    assert got[0].r.asDict(True) == {"a": "X", "b": ["Y", None], "c": {"k": "Z"}, "d": [{"e": "U", "n": 1}, {"e": None, "n": 2}, None]}
    assert got[1].r is None and got[2].r.asDict() == {"a": None, "b": None, "c": None, "d": None}
    assert [g.s for g in got] == [["x", "y", "z", "u"], [], []]


def test_repairs_reach_every_string(spark):
    broken = r"where $a<b$ and $\frac{a}$, costs $5"
    df = spark.createDataFrame([(1, 1, (broken, [broken, "plain"], {"k": broken}, [(broken, 1)]))], NESTED)
    for repair, want in ((records.repair_results, r"where $a\lt{}b$ and $\frac{a}{\ }$, costs \$5"), (records.repair_sources, None)):
        r = repair(df, ["record"]).first().record
        each = {r.a, r.b[0], r.c["k"], r.d[0].e}
        assert len(each) == 1 and r.b[1] == "plain" and r"\frac{a}{\ }" in r.a
        assert want is None or r.a == want
    once = records.repair_results(df, ["record"])
    assert records.repair_results(once, ["record"]).collect() == once.collect()


def test_record_query_repairs_all(spark):
    assert catalog_records.dec_record_repairs(spark, "/root/testdata/sf0.001").count() > 0


def test_migrate_leaves_out_what_grew(spark):
    old = spark.createDataFrame([(1, 1, "alpha beta gamma"), (1, 2, "delta epsilon"), (1, 3, "zeta eta")], "doc_id long, pos int, text string")
    new = spark.createDataFrame([(1, 1, "alpha beta gamma and more"), (1, 2, "delta epsilon"), (1, 4, "zeta eta")], "doc_id long, pos int, text string")
    rows = [(1, 1, "a", None, None), (1, 2, " b ", "B", [("T", "t"), ("t", "u"), (None, "v")]), (1, 3, None, "C", [])]
    recs = spark.createDataFrame(rows, "doc_id long, pos int, zh string, en string, terms array<struct<en:string,zh:string>>")
    m = spark.createDataFrame([(1, 1, 1, "exact"), (1, 2, 2, "exact"), (1, 3, 2, "x")], "doc_id long, old_pos int, new_pos int, how string")
    got = migrate.migrate(recs, m, old, new).collect()
    assert [(r.pos, r.zh, r.en, [tuple(t) for t in r.terms], r.merged, r.moved) for r in got] == [(2, "b", "B C", [("T", "t")], 2, False)]
    assert [tuple(r) for r in migrate.stale(m, old, new).collect()] == [(1, 1, 1)]


def test_unify_applies_the_longest_first(spark):
    r = spark.createDataFrame([(1, ["abcab", None], "ab"), (2, ["ab"], "x")], "doc_id long, lines array<string>, zh string")
    plan = spark.createDataFrame([(1, "ab", "X"), (1, "abc", "Y")], "doc_id long, zh string, best string")
    got = {g.doc_id: (g.lines, g.zh, g.replaced) for g in records.unify(r, ["lines", "zh"], plan).collect()}
    assert got == {1: (["YX", None], "X", 3), 2: (["ab"], "x", 0)}


def test_fidelity_by_seeds(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(120)) for _ in range(60)] + [None, "", "short"]
    needles = [t[40 * k : 40 * k + 150] for k, t in enumerate(texts[:20])] + [texts[0][:90], texts[0][:90], None, "tiny"]
    squash = lambda x: re.sub("[^a-z0-9]", "", (x or "").lower())
    want = collections.Counter((i, d) for i, n in enumerate(needles) if len(squash(n)) >= 40 for d, t in enumerate(texts) if squash(n)[:40] in squash(t))
    n = spark.createDataFrame(list(enumerate(needles)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert collections.Counter((r.item_id, r.doc_id) for r in quality.fidelity(n, d).collect()) == want and want


def test_replacement_plan_by_grams(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    data = [(f"t{rng.randrange(60)}", w, rng.randint(1, 5), k) for k, w in enumerate(words)]
    counts = spark.createDataFrame(data, "term string, zh string, n long, first long").dropDuplicates(["term", "zh"])
    best = {r.term: r.best for r in votes.majority(counts).filter("renderings > 1").collect()}
    plan = collections.defaultdict(list)
    for r in counts.collect():
        if r.term in best and r.zh != best[r.term] and len(r.zh) >= 2:
            plan[r.zh].append(best[r.term])
    want = {z: max(b) for z, b in plan.items() if not any(z != c and z in c for c in best.values())}
    assert {r.zh: r.best for r in votes.replacement_plan(counts).collect()} == want


def test_author_rows_by_windows(spark):
    rng = random.Random(6)
    data = [(d, b, rng.choice(["A", "B\nC", "D" * 130]), rng.choice([1, 2, 2, 3]), float(x), x + 30.0, y + rng.choice([0, 0, 1, 4]), y + 9.0) for d in range(12) for b, (x, y) in enumerate((60 * (k % 3), 20.0 * (k // 3)) for k in range(14))]
    got = collections.defaultdict(list)
    for r in figures.author_rows(spark.createDataFrame(data, "doc_id long, block int, text string, lines int, x0 double, x1 double, y0 double, y1 double"), 250.0).collect():
        got[r.doc_id].append((r.row, r.text, r.blocks))
    for d in range(12):
        part = sorted((b for b in data if b[0] == d and b[6] <= 75 and len(b[2]) <= 120 and b[3] <= 2), key=lambda b: (b[6], b[4], b[1]))
        rows, base, right = [], None, None
        for b in part:
            if base is None or abs(b[6] - base) > 3 or not -2 <= b[4] - right <= 40:
                rows.append([])
                base, right = b[6], b[5]
            right = max(right, b[5])
            rows[-1].append(b[2].replace("\n", " (", 1) + (")" if "\n" in b[2] else ""))
        assert sorted(got[d]) == [(k + 1, ", ".join(r), len(r)) for k, r in enumerate(rows)]


def test_symbols_and_fonts():
    assert [glyphs.command(c) for c in "∬⊚⨀⇑↩ℶ✗"] == [r"\iint", r"\circledcirc", r"\bigodot", r"\Uparrow", r"\hookleftarrow", r"\beth", r"\times"]
    assert glyphs.formula("e\u0301x=\u0338y") == r"x\neq y" and mathtext.MISSING == glyphs.command("\ue001")
