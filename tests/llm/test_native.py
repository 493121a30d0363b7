"""Quality rules, line dedup, mixing and URL filters against plain versions, and their edge cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import line_dedup, mixing, quality_rules, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, key string, size int, n_words int, line string, source_size string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", 1, 2, "z", "s") for r in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["the", "a", "of", "river", "stone", "walks", "under", "light", "green", "seven"]) + rng.choice(["", "er", "ing", "s"]) for _ in range(n))


EDGES = [(None, "no id at all here", "en", None), (900, None, None, "s1"), (901, "", "en", "s1"), (902, "\n\n", None, None), (903, "word " * 30_000, "en", "s1"), (904, " \t\r\n x", "de", "s2"), (905, "é" * 12 + "\nABCdefghijk\nabcDEFGHIJK ", "de", "s2")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, "\n".join(prose(rng, rng.randint(8, 60)) for _ in range(rng.randint(1, 6))), rng.choice(["en", "en", "de"]), rng.choice(["s1", "s2", None])) for i in range(300)]
    out += [(300 + i, "\n".join(out[i][1].split("\n") + [prose(rng, 12)]), "en", "s1") for i in range(40)]
    out += [(400 + i, " ".join(prose(rng, 1).upper() + "###$$$" for _ in range(80)), "en", "s1") for i in range(12)]
    return out + EDGES + [out[3], out[3]]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark, rows):
    got = quality_rules.quality_verdicts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = collections.Counter((r[0], *base(r[1])) for r in rows)
    assert collections.Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words)
        assert not (g.base_failed and g.kept)
        if g.doc_id is not None and 400 <= g.doc_id < 412:
            assert not g.kept
        if g.doc_id is not None and g.doc_id < 300 and not g.base_failed:
            assert g.kept


def test_symbols_and_repeated_lines_count(spark):
    """Text cut up by bars, and text of repeated short lines, are outliers among plain documents; the cutoff is the chi-square law's."""
    rng = random.Random(2)
    plain = [(i, "\n".join(prose(rng, rng.randint(8, 20)) + "." for _ in range(6)), "en", "s") for i in range(300)]
    bars = [(1000 + i, " | ".join(prose(rng, 3) for _ in range(25)), "en", "s") for i in range(8)]
    again = [(2000 + i, "\n".join(x for k in range(9) for x in ("light walks", "seven stones", prose(rng, 10))), "en", "s") for i in range(8)]
    got = {g.doc_id: g for g in quality_rules.quality_verdicts(frame(spark, plain + bars + again)).collect()}
    assert all(got[i].kept for i in range(300))
    junk = [got[i] for i in [*range(1000, 1008), *range(2000, 2008)]]
    assert not any(g.kept for g in junk) and sum(not g.base_failed for g in junk) >= 14
    assert quality_rules.chi2_cdf(quality_rules.chi2_quantile(1 - quality_rules.CLEAN_LOST, 7), 7) == pytest.approx(0.9999)


def test_small_sources_have_estimates_of_their_own(spark):
    """No size of a source switches its estimate: a document more or less moves its distances little, and junk of a source of four is told by its language."""
    rng = random.Random(12)
    plain = [(i, prose(rng, rng.randint(40, 90)) + ".", "en", "large") for i in range(300)]
    few = [(1000 + i, prose(rng, rng.randint(40, 90)) + ".", "en", "few") for i in range(51)]
    junk = [(2000, " | ".join(prose(rng, 2) for _ in range(40)), "en", "few"), (2001, " | ".join(prose(rng, 2) for _ in range(40)), "en", "four")]
    four = [(3000 + i, prose(rng, 60), "en", "four") for i in range(3)]
    runs = []
    for n in (49, 51):
        runs.append({g.doc_id: g for g in quality_rules.quality_verdicts(frame(spark, plain + few[:n] + junk + four)).collect()})
    for a in runs:
        assert not a[2000].kept and not a[2001].kept and all(a[i].kept and a[i].distance2 is not None for i in range(3000, 3003))
        assert all(abs(a[i].distance2 - runs[0][i].distance2) < 0.1 * (3 + runs[0][i].distance2) for i in range(1000, 1049))


def test_quality_distances_against_plain_estimates(spark):
    """One group, the same concentration without bins."""
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(30, 300)) + "." * rng.randint(0, 3), "en", "s") for i in range(400)] + [(1000 + i, "#" * 40 + " " + " ".join(["$$$$"] * 40), "en", "s") for i in range(30)]
    got = {g.doc_id: g for g in quality_rules.quality_verdicts(frame(spark, rows)).filter("NOT base_failed").collect()}
    ids = sorted(got)
    g = [got[i] for i in ids]
    x = np.array([[np.log1p(r.n_words), np.log(r.word_chars / r.n_words), (r.n_marks / r.word_chars) ** 0.5, (r.n_capitals / r.word_chars) ** 0.5, (r.n_repeat_words / r.n_words) ** 0.5] for r in g])
    floors = np.diag(np.array(quality_rules.FLOORS) ** 2)
    inverse = lambda part, f: np.linalg.inv(f * np.cov(part.T, bias=True) + floors)
    distance = lambda m, inv: np.einsum("ij,jk,ik->i", x - m, inv, x - m)
    m, inv = np.median(x, 0), np.linalg.inv(np.diag(x.std(0) ** 2) + floors)
    for _ in range(20):
        near = np.argsort(distance(m, inv))[: int(0.75 * len(x))]
        m, inv = x[near].mean(0), inverse(x[near], quality_rules.consistency(0.75))
    near = distance(m, inv) <= quality_rules.chi2_quantile(0.975, 5)
    want = distance(x[near].mean(0), inverse(x[near], quality_rules.consistency(0.975)))
    have = np.array([r.distance2 for r in g])
    assert np.median(np.abs(have - want) / (1 + want)) < 0.05
    assert all((w > 35) == (not r.kept) for w, r in zip(want, g, strict=True) if abs(w - 35) > 7)


def test_quality_estimates_and_their_plans(spark, monkeypatch):
    """Roots of shrunk sums against numpy's; no table's plan has the root written out, as the driver plans each again and again."""
    rng = np.random.default_rng(5)
    x = [rng.normal(size=(n, 7)) + k for k, n in enumerate((30, 90, 400))]
    sums = [np.array([[len(v), *v.sum(0), *[(v[:, i] * v[:, j]).sum() for i, j in quality_rules.PAIRS]]]) for v in x]
    shrunk = spark.createDataFrame([("g", 0, *[x[0].tolist() for x in sums])], "_group string, _start int, _v array<double>, _of_lang array<double>, _of_all array<double>")
    [got] = quality_rules._roots(shrunk, 1.3, 50.0).collect()
    mixed = lambda a, b: a + 50 * b / b[0]
    v = mixed(sums[0][0], mixed(sums[1][0], sums[2][0]))
    v /= v[0]
    second = np.zeros((7, 7))
    for k, (i, j) in enumerate(quality_rules.PAIRS):
        second[i, j] = second[j, i] = v[8 + k]
    root = np.linalg.cholesky(1.3 * (second - np.outer(v[1:8], v[1:8])) + np.diag(np.array(quality_rules.LEAST) ** 2))
    assert got._e[:7] == pytest.approx(v[1:8].tolist()) and got._det == pytest.approx(np.linalg.slogdet(root)[1])
    assert got._e[7:] == pytest.approx([np.linalg.inv(root)[i, j] for i, j in quality_rules.PAIRS])
    plans, written = {}, quality_rules.written
    monkeypatch.setattr(quality_rules, "written", lambda df, name: plans.update({name: len(df._jdf.queryExecution().optimizedPlan().toString())}) or written(df, name))
    rng = random.Random(6)
    got = quality_rules.quality_verdicts(frame(spark, [(i, prose(rng, 40), "en", f"s{i % 3}") for i in range(60)])).collect()
    assert len(got) == 60 and all(g.distance2 >= 0 for g in got)
    assert max(plans.values()) < 12_000, plans  # up to 16,000 with a column for each part of a root


def test_empty_tables(spark):
    empty = frame(spark, []).filter("false")
    assert quality_rules.quality_verdicts(empty).count() == 0
    assert line_dedup.keep_bitmaps(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.url_verdicts(pages, pages.selectExpr("url AS key")).count() == 0


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def test_line_dedup(spark, rows):
    last = 1 << 60
    first = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), last), last if i is None else i)
    docs = frame(spark, rows)
    bitmaps = line_dedup.keep_bitmaps(docs)
    got = collections.Counter((g.doc_id, len(g.lines), g.n_dropped, "\n".join(g.kept)) for g in line_dedup.apply_bitmaps(docs, bitmaps).select("doc.doc_id", "lines", "n_dropped", "kept").collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (last if i is None else i)]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert got == want
    lost = {(g.doc_id, g._row): g for g in bitmaps.collect()}
    assert lost and all(sum(g.runs[1::2]) == g.n_dropped and min(g.runs[1:]) > 0 for g in lost.values())
    back = bitmaps.select("n_dropped", line_dedup.dropped_positions(bitmaps["runs"]).alias("p")).collect()
    assert all(len(set(b.p)) == b.n_dropped for b in back)
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in kept.filter("text IS NOT NULL").collect())
    clash = docs.withColumns({"n_dropped": F.lit(77), "lines": F.lit("l"), "runs": F.lit("r"), "kept": F.lit(8), "new": F.lit(9), "a.b": F.lit(1)})
    out = line_dedup.dedup_lines(clash)
    assert out.columns == clash.columns and {(r.n_dropped, r.lines, r.runs, r.kept, r.new, r["a.b"]) for r in out.collect()} == {(77, "l", "r", 8, 9, 1)}


def test_first_lines_come_from_sorted_ranges(spark):
    """The plan keeps the sort by hash, document and position, and a sorted aggregation reads it."""
    rng = random.Random(4)
    hot = [(1, 1, i, i % 3) for i in range(3000)]  # one hash fills several ranges
    data = hot + [(rng.randrange(50), 2, rng.randrange(900), rng.randrange(5)) for _ in range(2000)] + [(1, 1, None, 0), (7, 7, None, 1)]
    rng.shuffle(data)
    found = line_dedup.first_occurrences(spark.createDataFrame(data, "h1 long, h2 long, doc_id long, pos int").repartition(7))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"SortAggregate\(key=\[h1#\d+L, h2#\d+L, range#\d+\], functions=\[partial_first", plan)
    assert re.search(r"Sort \[h1#\d+L ASC NULLS FIRST, h2#\d+L ASC NULLS FIRST, range#\d+ ASC NULLS FIRST, at#\d+ ASC NULLS FIRST\], false", plan)
    key = lambda r: (r[2] is None, r[2] or 0, r[3])
    want = {}
    for r in data:
        want.setdefault(r[:2], []).append(r)
    got = {(r.h1, r.h2): (r["first"].doc_id, r["first"].pos, r["last"].doc_id) for r in found.collect()}
    assert got == {k: (*min(v, key=key)[2:], max(v, key=key)[2]) for k, v in want.items()}


def test_mixing(spark, rows):
    every = mixing.mix(frame(spark, rows)).collect()
    assert len(every) == len(rows) and len({g.copies for g in every if g.doc_id == 3}) == 1  # equal rows get equal copies
    rows = rows[:-2]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: level * weight[s] for s in open_}
        open_ -= set(over) if over else open_
    taken = collections.Counter()
    for g in got:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(target[g.source]) and g.taken == g.copies * g.size <= 2 * g.size
        taken[g.source] += g.taken
    largest = {s: max(g.size for g in got if g.source == s) for s in order}  # a copy is whole
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + (0.5 * largest[s] if largest[s] > sizes[s] / 10 else 30) for s in order)
    again = mixing.mix(docs.repartition(5)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(g.copies for g in got)


def test_newton_meets_targets_by_rates_that_differ_by_size(spark):
    """Each step's sums come from all classes; the solved dual leaves under 1e-6 of any target, and rates fall or rise with size up to the cap."""
    rng = np.random.default_rng(7)
    ratio = {0: 0.3, 1: 1.0, 2: 1.7, 3: 2.0, 4: 0.001, 5: 1.999}
    data = [(s, int(c), int(rng.integers(1, 9))) for s in ratio for c in np.unique(np.minimum(rng.lognormal(4, 1.5, 80).astype(int) + 1, 20_000))] + [(6, 0, 4)]
    classes = spark.createDataFrame([(s, c, n, n * c) for s, c, n in data], "s long, class long, n long, tokens long")
    tokens = collections.Counter()
    for s, c, n in data:
        tokens[s] += n * c
    goals = spark.createDataFrame([(s, r * tokens[s]) for s, r in ratio.items()] + [(6, 0.0)], "s long, target double")
    got = {r.s: r for r in mixing.balanced(classes, goals).collect()}
    assert set(got) == set(range(7)) and got[3].multiplier == math.inf and got[6].multiplier == 0
    for s, r in ratio.items():
        if s != 3:
            rate = {c: min(2.0, math.exp(got[s].multiplier * c / got[s].unit)) for k, c, _ in data if k == s}
            assert abs(sum(n * c * rate[c] for k, c, n in data if k == s) - r * tokens[s]) < 1e-6 * r * tokens[s] and got[s].residual < 1e-6
            assert r == 1.0 or len(set(rate.values())) > 5
            by_size = [rate[c] for c in sorted(rate)]
            assert by_size == sorted(by_size, reverse=r < 1)


def test_mixing_rates_and_copies(spark):
    rng = random.Random(8)
    docs = frame(spark, [(i, prose(rng, rng.choice([5, 20, 60, 200])), "en", "abc"[min(2, i % 6)]) for i in range(900)])
    got = mixing.mix(docs).collect()
    for s in "abc":
        rates = {g.size: g.rate for g in got if g.source == s}
        target, size = next((g.target, g.source_size) for g in got if g.source == s)
        assert len(set(rates.values())) == (1 if target >= 2 * size else 4)
        assert all(abs(g.copies - g.rate) < 1 + 1e-9 for g in got if g.source == s)
        assert abs(sum(g.taken for g in got if g.source == s) - target) <= 5
    assert any(g.target < 2 * g.source_size for g in got)


URLS = ["http://Example.ORG/es/1", "https://a.example.org/en/1x", "http://notexample.org/es/", "ftp://b.com/fr/x", "http://b.com/de/?q", "http://com/de/", "http://x.net/a?u=http://b.com/de/", "http://x.net", "nothing", None, "", "http://www.bad.net/page.html", "http://bad.net/page/#top", "://", "http://org/", "http://bad.net/page/other"]


def test_url_filters(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, key string")
    listed = spark.createDataFrame([("bad.net/page",), (None,), ("bad.net/page",)], "key string")
    got = {g.page_id: g for g in url_filters.url_verdicts(pages, listed).collect()}
    assert len(got) == len(URLS) + 1
    rule = [got[i].rule for i in range(len(URLS))]
    assert rule == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", "com/de/", None, None, None, None, None, None, None, None, "org/", None]
    assert [got[i].verdict for i in (0, 1, 2, 3, 4)] == ["block", "block", "allow", "allow", "block"]
    assert (got[6].host, got[6].path) == ("x.net", "/a") and got[9].host == got[9].path == got[8].host == ""
    assert [got[i].verdict for i in (11, 12, 15, 7)] == ["block", "block", "allow", "allow"]


def test_bloom_filter_has_no_misses_and_the_join_no_false_hits(spark):
    listed = spark.range(0, 8000, 4).selectExpr("concat('k', id) AS key")
    keys = spark.range(4000).selectExpr("CASE WHEN id < 3900 THEN concat('k', id) END AS key")
    pages = spark.range(4000).selectExpr("id AS page_id", "CASE WHEN id < 3900 THEN concat('http://k', id, '/') END AS url")
    for bits, size in ((1, 1 << 26), (16, 1 << 26), (16, 0)):  # one bit a key lets nearly all through; the exact join decides
        got = {r.key: r.maybe for r in url_filters.maybe_listed(keys, listed, bits, size).collect()}
        assert all(got[f"k{i}"] for i in range(0, 3900, 4)) and not got[None] and (bits == 1 or sum(got.values()) < 1100)
        judged = url_filters.url_verdicts(pages, listed, bits_per_key=bits, filter_bytes=size).collect()
        assert len(judged) == 4000 and {r.page_id for r in judged if r.listed} == set(range(0, 3900, 4))


def test_hashes_of_kept_lines(spark):
    docs = frame(spark, [(2, "one same line\nmine", "en", "s"), (1, "ONE same line \n\nother", "en", "s")])
    d = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    got = {r.doc_id: hashlib.sha256("\n".join(r.kept).encode()).hexdigest() for r in d.select("doc.doc_id", "kept").collect()}
    assert got == {1: hashlib.sha256(b"ONE same line \n\nother").hexdigest(), 2: hashlib.sha256(b"mine").hexdigest()}
