"""LM scores, packing, the classifier, near duplicates, secret scans and top-k against plain versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import factorisation, lm_score, ngram_join, packing, secret_scan, tokens, topk
from tests.llm.test_native import EDGES, WORD, frame, prose


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(i, prose(rng, rng.randint(3, 90)), "en", "s") for i in range(120)]
    for i in range(120, 160):  # near copies: one word in the middle changed
        w = out[i - 120][1].split()
        w[len(w) // 2] = "changed"
        out.append((i, " ".join(w), "en", "s"))
    out += [(i, out[5][1], "en", "s") for i in range(160, 170)]
    return out + EDGES + [out[7], (906, "two words", "en", "s"), (907, "two words", "de", "s")]


def test_near_duplicates(spark, rows):
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(t or "")
        k = min(5, len(w))
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    ids = collections.defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[find(k)].append(r[0])
    want = collections.Counter((r[0], min(ids[find(k)], default=None), links[k]) for k, r in enumerate(rows))
    assert collections.Counter((g.doc_id, g.class_id, g.n_links) for g in got) == want
    kept = [r.doc_id for r in ngram_join.keep_one(frame(spark, rows)).collect()]
    alone = {r[0] for r, x in zip(rows, sets, strict=True) if not x}
    assert collections.Counter(kept) == collections.Counter([*{min(v) for v in ids.values() if v}, None]) and alone <= set(kept)


def test_large_groups_span_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(2)
    words = prose(rng, 120).split()
    rows = [(i, " ".join([*words, f"tail{i}"]), "en", "s") for i in range(40)]
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert {(g.class_id, g.n_links) for g in got} == {(0, 39)} and sum(g.keep for g in got) == 1


@pytest.mark.parametrize("blocks", [(512, 1 << 24), (4, 1 << 24), (512, 400)])
def test_blocks_of_any_size(spark, monkeypatch, rows, blocks):
    """Links and classes are the same however groups are cut, each pair counted once though it shares many bands."""
    want = collections.Counter((g.doc_id, g.class_id, g.n_links) for g in ngram_join.near_duplicates(frame(spark, rows)).collect())
    monkeypatch.setattr(ngram_join, "BLOCK", blocks[0])
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", blocks[1])
    assert collections.Counter((g.doc_id, g.class_id, g.n_links) for g in ngram_join.near_duplicates(frame(spark, rows)).collect()) == want


def test_links_do_not_depend_on_other_documents(spark, rows):
    """A text keeps its links when others join its bands and classes."""
    own = {g.doc_id: g.n_links for g in ngram_join.near_duplicates(frame(spark, rows)).collect() if g.doc_id is not None and g.doc_id < 170}
    rng = random.Random(11)
    more = [(5000 + k, " ".join(prose(rng, 40).split() + rows[k][1].split()[:20]), "en", "s") for k in range(60)]
    again = {g.doc_id: g.n_links for g in ngram_join.near_duplicates(frame(spark, rows + more)).collect() if g.doc_id is not None and g.doc_id < 170}
    assert own == again


def test_one_row_stays_of_equal_rows(spark):
    text = "the same nine words stand here in every single row"
    docs = frame(spark, [(1, text, "en", "s")] * 3 + [(None, text + " twice", "en", "s")] * 2 + [(2, "", "en", "s")] * 2 + [(3, "alone", "en", "s")] * 2)
    clash = docs.withColumns({"_doc": F.lit(1), "_id": F.lit(2), "_keep": F.lit(3), "a.b": F.lit(4)})
    out = ngram_join.keep_one(clash)
    assert out.columns == clash.columns and collections.Counter(r.doc_id for r in out.collect()) == {1: 1, 2: 2, 3: 1}
    assert ngram_join.keep_one(clash.filter("false")).count() == 0


def test_banding_meets_its_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, size = ngram_join.banding(threshold, 0.999)
        assert 1 - (1 - threshold**size) ** bands >= 0.999 or size == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)]
    got = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    groups = lambda d: {frozenset(n for n in d if d[n] == x) for x in set(d.values())}
    assert groups(got) == groups({n: x for n, x in label.items() if n in got})


def test_packing(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(950, "a<|endoftext|>b  c\n\n d", "en", "s")]
    got = packing.pack(frame(spark, rows + extra)).collect()
    want = collections.Counter()
    for i, t, *_ in rows + extra:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    places = collections.defaultdict(list)
    for g in got:
        places[g.sequence_id].append((g.offset, g.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(g.length for g in got) // 1024) + 3


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(1025, np.int64)
    counts[1:] = rng.integers(0, [1, 3, 50, 2, 400, 1000][seed], 1024) * (rng.random(1024) < [1, 0.3, 1, 0.02, 0.5, 0.01][seed])
    runs = packing.plan(counts)
    seen, bins = collections.Counter(), collections.defaultdict(list)
    for length, rank, n, first, offset in runs.tolist():
        for k in range(n):
            seen[length, rank + k] += 1
            bins[first + k].append((offset, length))
    assert seen == collections.Counter({(length, k): 1 for length in range(1025) for k in range(counts[length])})
    for p in bins.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024


def best_fit(lengths, capacity=1024):
    """Sequences that best-fit decreasing needs."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = min((r for r in rooms if r >= n), default=None)
        if at is not None:
            rooms.remove(at)
        rooms.append((capacity if at is None else at) - n)
    return len(rooms)


@pytest.mark.parametrize(("low", "high"), [(1, 1024), (20, 400), (250, 700), (110, 340)])
def test_configurations_fill_sequences(low, high):
    """Configurations of three and more pieces are used, and no more sequences than best-fit decreasing needs, but for a thousandth."""
    rng = np.random.default_rng(low)
    lengths = rng.integers(low, high, 6000)
    counts = np.bincount(lengths, minlength=1025)
    sets = packing.grouped(counts, 103, 1024)
    found = packing.configurations([top for top, _ in sets], [sum(m[2] for m in members) for _, members in sets], 1024)
    assert sum(times for parts, times in found if len(parts) >= 3) > 0
    assert all(sum(sets[p][0] for p in parts) <= 1024 for parts, _ in found)
    runs = packing.plan(counts)
    used = int((runs[:, 3] + runs[:, 2]).max())
    assert -(-int(lengths.sum()) // 1024) <= used <= math.ceil(1.001 * best_fit(lengths.tolist()))


def test_most_worth():
    rng = random.Random(6)
    for _ in range(40):
        sizes = sorted(rng.sample(range(2, 30), 5), reverse=True)
        prices = [rng.random() for _ in sizes]
        best = [0.0] * 41
        for r in range(1, 41):
            best[r] = max([best[r - 1], *(best[r - s] + p for s, p in zip(sizes, prices, strict=True) if s <= r)])
        use = packing.most_worth(np.array(sizes), np.array(prices), 40)
        assert use @ np.array(sizes) <= 40 and use @ np.array(prices) == pytest.approx(best[40])


def test_secret_scan(spark):
    texts = ["", None, "x password = 'abcdefghijklmnop' y", "PASSWD:short", "Secret=token=abcdefghijkl", "AKIA" + "B" * 14, "AKIA" + "B" * 13, "é " * 9 + "deadbeef" * 2, "deadbeef" * 2 + "g", "ab" * 7, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "aZ" * 20, "api_key: " + "Zz09+/=_.-" * 2, "apikey=aaaaaaaaaaaa token: bbbbbbbbbbbbb", "a " * 40_000 + "secret=0123456789abcdef0", "ſecret=abcdefghijklmnop"]
    got = {r.doc_id: r.spans for r in secret_scan.scan(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [(s.kind, s.start, s.end) for s in got[i] if s.base] == [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(want)]
    assert [s.kind for s in got[10]] == ["private"] and [s.kind for s in got[11]] == ["github"]


def test_trigram_queries_let_every_match_through():
    rng = random.Random(4)
    samples = {"assign": "my_TOKEN : 'abcdefghijklmnop'", "access": "AKIA" + "Q" * 16, "private": "-----BEGIN PRIVATE KEY-----", "slack": "xoxb-1234567890ab", "google": "AIza" + "x" * 35, "jwt": "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "github": "ghs_" + "a" * 36}
    for rule in secret_scan.RULES:
        q = secret_scan.trigram_query(rule.pattern)
        if rule.kind == "hex":
            assert q == ("and",)
            continue
        assert secret_scan._trigrams(q)
        texts = [prose(rng, 30).encode() for _ in range(20)] + [samples[rule.kind].encode()]
        assert 20 in secret_scan.Segment(texts, sorted(secret_scan._trigrams(q))).find(q)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 64)]) for i in range(400)]
    vectors += [(400 + i, vectors[20][1]) for i in range(60)]  # ties
    bad = [(1000, None), (1001, [None] * 64), (1020, [float("nan")] * 64), (1040, [float("inf")] * 64), (None, vectors[0][1]), (1060, [0.5, 0.25]), (1061, [0.5, 0.5]), (1080, [])]
    data = [(i, v, 1, "x", 2.0) for i, v in [*vectors, *bad, vectors[3]]]
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, block string, score double"), rows=64, query_rows=8).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, x = np.array([i for i, _ in vectors]), np.floor(64 * np.array([v for _, v in vectors])).astype(int)
    want = {1060: [(1, 1061, 32 * 32 + 16 * 32)]}
    for k in np.flatnonzero(ids % 20 == 0):
        s, other = x @ x[k], ids != ids[k]
        order = np.lexsort((ids[other], -s[other]))[:20]
        want[int(ids[k])] = [(r + 1, int(ids[other][j]), int(s[other][j])) for r, j in enumerate(order)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (80, 64)).astype(float) * np.geomspace(1, 0.01, 64)
    axes = topk.Axes(x, 4)
    q, x = x[:30] @ axes.turn, x[30:] @ axes.turn
    last = np.inf
    for level, over in zip(topk.LEVELS, axes.block_bounds(q, axes.summary(x)[None]), strict=True):
        (qm, qd), (xm, xd) = axes.sides(q, level), axes.sides(x, level)
        bound = qm @ xm.T + qd @ xd.T
        assert (bound >= q @ x.T - 1e-6).all() and bound.mean() < last and (over[:, 0] >= bound.max(1)).all()
        last = bound.mean()


def near_vectors(rng, n, centres=40, dim=64):
    c = rng.normal(0, 1, (centres, dim))
    return c[rng.integers(0, centres, n)] + rng.normal(0, 0.1, (n, dim))


def test_bounds_prune_clustered_vectors(spark, monkeypatch):
    """Most blocks are skipped whole and most pairs left die by their bounds; results stay exact."""
    x = np.floor(64 * near_vectors(np.random.default_rng(3), 4000)).astype(int)
    data = spark.createDataFrame([(i, [float(y) / 64 for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    visits = []
    wanted = topk.wanted
    monkeypatch.setattr(topk, "wanted", lambda *a: visits.append(wanted(*a)) or visits[-1])
    got = collections.defaultdict(list)
    for r in topk.top_k(data, rows=128, query_rows=32).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for i in range(0, 4000, 20):
        s, other = x @ x[i], np.arange(4000) != i
        ids = np.arange(4000)[other]
        order = np.lexsort((ids, -s[other]))[:20]
        assert sorted(got[i]) == [(r + 1, int(ids[j]), int(s[other][j])) for r, j in enumerate(order)]
    blocks = -(-4000 // 128)
    gone_to = visits[-1].selectExpr("sum(length(ids) / 8)").first()[0]
    assert gone_to < 0.25 * 200 * blocks
    axes = topk.Axes(x.astype(float), 8)
    seen, s = {}, np.sort(x @ x[:50].T, 0)[-21]
    list(topk.best_of_block(axes, np.arange(50), x[:50], s.astype(float), np.arange(4000), x, 20, seen))
    assert seen["alive"] < 0.1 * seen["pairs"]


def test_scores_beyond_doubles_are_whole(spark):
    data = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**9, 1 / 64]), (2, [2.0**9, 2 / 64]), (3, [2.0**50, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(data).orderBy("rank").collect()]
    assert got == [(3, 2**63 - 1), (2, 2**61 + 128), (1, 2**61 + 64)]


def test_factorisation_machine(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60) if i % 3 else prose(rng, 60).upper() + " ***", "en", "s") for i in range(240)] + EDGES
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(160)] + [(5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in factorisation.quality_scores(frame(spark, rows), labels).collect()}
    assert sum((got[i] >= 0.5) == (i % 3 > 0) for i in range(160, 240)) >= 76
    assert all(0 <= s <= 1 for s in got.values())
    twice = factorisation.training_rows(frame(spark, rows + rows[:50] * 3), labels, "quality", 6000)
    assert len(twice) == len(factorisation.training_rows(frame(spark, rows), labels, "quality", 6000)) == 160 - 1  # ids 5 and 7 count once or not
    none = factorisation.quality_scores(frame(spark, rows), labels.filter("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_pairs_in_linear_time_equal_the_double_sum():
    rng = np.random.default_rng(2)
    model = {"w0": 0.3, "w": rng.normal(size=50), "v": rng.normal(size=(50, 4))}
    at, x = np.array([3, 7, 20, 41]), rng.normal(size=4)
    pairs = sum(model["v"][at[a]] @ model["v"][at[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert factorisation.machine_score(model, at, x) == pytest.approx(0.3 + model["w"][at] @ x + pairs)


def test_lm_scores(spark, rows):
    docs = frame(spark, rows)
    got = collections.defaultdict(list)
    for r in lm_score.lm_scores(docs, head_words=20, most_pairs=200).collect():
        got[r.doc_id].append(r)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter()
    for i, t, *_ in rows:
        if not held(i):
            counts.update([*(t or "").encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in rows:
        words = [*(t or "").encode().lower().split(), "end"]
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(words), sum(counts[w] > 0 for w in words), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
            assert r.score < 0
    assert lm_score.lm_scores(docs.filter("false")).count() == 0


def lm_tables(rng, texts):
    x = np.concatenate([[lm_score.END], *[y for t in texts for y in (t, [lm_score.END])]]).astype(np.int64)
    pairs, n = np.unique(x[:-1] << 16 | x[1:], return_counts=True)
    kind, share = lm_score.classes_of(np.bincount(x[1:], minlength=lm_score.IDS), np.zeros(lm_score.IDS, np.int64))
    after = np.zeros((lm_score.IDS, lm_score.CLASSES))
    np.add.at(after, (pairs >> 16, kind[pairs & 65535]), n)
    kept = rng.random(len(pairs)) < 0.7
    return lm_score.Tables(kind, share, after, pairs[kept], n[kept]), dict(zip(pairs[kept].tolist(), n[kept].tolist(), strict=True)), after


def grown(rng, model):
    return {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float32) for k, v in model.items()}


def test_windows_hold_each_token_once():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 500, n).astype("<u2") for n in (0, 1, 15, 16, 31, 32, 33, 100, 600)]
    x, starts, y, owner, _ = lm_score.lay_out(texts)
    w = lm_score.windows_at(x, starts)
    for k, ids in enumerate(texts):
        assert y[owner == k][y[owner == k] >= 0].tolist() == [*ids.tolist(), lm_score.END]
        assert w[owner == k][:, lm_score.WINDOW - lm_score.STRIDE :].ravel()[: len(ids) + 1].tolist() == [lm_score.END, *ids.tolist()]
    assert lm_score.WINDOW - lm_score.STRIDE + 1 >= 17  # what a scored place sees at least, where the text has it
    for rounds in (1, 2, 3):  # each id of each training text is a target in one round
        seen = collections.Counter()
        for turn in range(rounds):
            a, b = lm_score.training_windows(texts, np.arange(len(texts)), turn, rounds)
            seen.update(zip(a[b >= 0].tolist(), b[b >= 0].tolist(), strict=True))
        assert seen == collections.Counter(z for t in texts for z in zip([lm_score.END, *t.tolist()], [*t.tolist(), lm_score.END], strict=True))


def test_probabilities_of_all_ids_sum_to_one():
    rng = np.random.default_rng(4)
    texts = [(rng.zipf(1.3, 300) % 900).astype("<u2") for _ in range(30)]
    tables, *_ = lm_tables(rng, texts)
    every = np.arange(lm_score.IDS)
    for before in (0, 1, 5, 899, 40_000, lm_score.END):
        p = tables.in_class(np.full(lm_score.IDS, before), every)
        assert np.bincount(tables.kind, p, lm_score.CLASSES) == pytest.approx(1, abs=1e-3)
    x, starts, *_ = lm_score.lay_out(texts[:2])
    p, _ = lm_score.forward(grown(rng, lm_score.start()), tables, lm_score.windows_at(x, starts), lm_score.STRIDE)
    assert p.sum(1) == pytest.approx(1, abs=1e-4)


def test_score_of_one_text_by_plain_steps():
    """One text's score, a token at a time, from the counts and the weights, without windows in batches or tables of hashes."""
    rng = np.random.default_rng(5)
    texts = [(rng.zipf(1.3, 80) % 500).astype("<u2") for _ in range(12)]
    tables, kept, after = lm_tables(rng, texts)
    m = grown(rng, lm_score.start())
    ids, total = [lm_score.END, *texts[0].tolist()], 0.0
    for place, y in enumerate([*texts[0].tolist(), lm_score.END]):
        first = place // lm_score.STRIDE * lm_score.STRIDE - (lm_score.WINDOW - lm_score.STRIDE)
        seen = [j for j in range(first, place + 1) if j >= 0]
        h = {j: tables.embedding[ids[j]] + m["P"][j - first] for j in seen}
        weight = {j: math.exp(float(h[place] @ m["Wq"] @ (h[j] @ m["Wk"])) / 4) for j in seen}
        r = h[place] + sum(weight[j] * (h[j] @ m["Wv"]) for j in seen) / sum(weight.values())
        u = (r + np.maximum(r @ m["W1"], 0) @ m["W2"]) @ m["Wo"]
        p = tables.base[ids[place]] * np.exp(u)
        c, n = tables.kind[y], after[ids[place]]
        others = sum(k - lm_score.DISCOUNT for q, k in kept.items() if q >> 16 == ids[place] and tables.kind[q & 65535] == c)
        own = max(0, kept.get(ids[place] << 16 | y, lm_score.DISCOUNT) - lm_score.DISCOUNT)
        share = (own + (n[c] - others + lm_score.SHARED) * tables.share[y]) / (n[c] + lm_score.SHARED)
        total += math.log10(p[c] / p.sum() * share)
    got = lm_score.log_probabilities(m, tables, texts[:3], 4)
    assert got[0] == pytest.approx(total, rel=1e-4)
    assert got == pytest.approx(lm_score.log_probabilities(m, tables, texts[:3], 64), rel=1e-5)


def test_gradient():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 300, 90).astype("<u2") for _ in range(4)]
    tables, *_ = lm_tables(rng, texts)
    tables.embedding, tables.base = tables.embedding.astype(float), tables.base.astype(float)
    model = {k: v.astype(float) for k, v in lm_score.start().items()}
    x, y = lm_score.training_windows(texts, np.zeros(4), 0, 1)

    def loss():
        p, _ = lm_score.forward(model, tables, x, lm_score.WINDOW)
        return -np.log(p[np.arange(y.size), tables.kind[np.maximum(y.ravel(), 0)]])[y.ravel() >= 0].mean()

    g = lm_score.gradient(model, tables, x, y)
    for name in lm_score.SHAPES:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep = model[name][at]
        model[name][at] = keep + 1e-4
        up = loss()
        model[name][at] = keep - 1e-4
        slope = (up - loss()) / 2e-4
        model[name][at] = keep
        assert slope == pytest.approx(g[name][at], rel=0.02)


def test_training_learns_what_pairs_cannot_tell():
    """After id 1 comes one of three ids that depend on the text; attention finds out which."""
    rng = np.random.default_rng(6)
    make = lambda: np.stack([np.ones(40, int), rng.integers(0, 3, 40) + 2 + 3 * rng.integers(0, 2)], 1).ravel().astype("<u2")
    texts, new = [make() for _ in range(600)], [make() for _ in range(40)]
    tables, *_ = lm_tables(rng, texts)
    adam = lm_score.Adam(lm_score.start(), 0.01)
    before = lm_score.log_probabilities(adam.model, tables, new).mean()
    x, y = lm_score.training_windows(texts, np.zeros(len(texts)), 0, 1)
    for a in range(0, len(x), 32):
        adam.step(lm_score.gradient(adam.model, tables, x[a : a + 32], y[a : a + 32]))
    assert lm_score.log_probabilities(adam.model, tables, new).mean() > before + 40 * 0.8 * math.log10(2)


def test_parts_between_blanks_have_the_ids_of_whole_texts():
    """Texts of runs of spaces of all kinds, in parts and whole, against the JSON file's tokenizer; ordinary parts are encoded once."""
    rng = random.Random(21)
    signs = [*" \t\n\r\x0b\x1c\x85\xa0    　​\x00", *["a", "b'", "'ll", "é", "22", "...", "日", "Word", " ", " ", tokens.SPECIAL]]
    texts = ["", " ", "a b a b", "  a", "a  b", "a \n b", *["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(2000)]]
    encode = tokens.encoder("<u2")
    want = [encode.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(encode(t), "<u2").tolist() for t in texts] == want
    split, owner, code = tokens.blanks(pa.array(texts))
    assert [np.frombuffer(b, "<u2").tolist() for b in tokens.ids_of(pa.array(texts), split, owner, code).to_pylist()] == want
    every, start = encode.parts(split, 100)
    assert [every[a:b].tolist() for a, b in zip(start, start[1:], strict=False)] == [encode.whole.encode(f" {p}", add_special_tokens=False).ids for p in split.to_pylist()]
    assert "(?!" not in tokens.PIECES  # a pattern that looks ahead is matched with backtracking


def test_words_of_texts():
    texts = ["a\x1cb c\x85d\xa0e  Ab\tÉé\n\x0b\x0cX\r", None, "", "   ", " lead", "trail ", "İK\x00z"]
    words, n = lm_score.words_of(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert words.to_pylist() == [w for t in want for w in t] and n.tolist() == [len(t) for t in want]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for size in (1, 3, 1000):
        assert [t for part in lm_score.parts(batch, 0, size) for t in part.column(0).to_pylist()] == texts


def test_kept_arrays_and_blocks_change_nothing():
    """Gradients and scores with arrays used again, after batches of other sizes, and by any number of windows at a time."""
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 300, n).astype("<u2") for n in (0, 90, 700, 1500, 31, 32)]
    model, space = grown(rng, lm_score.start()), lm_score.Space()
    table, *_ = lm_tables(rng, texts)
    x, y = lm_score.training_windows(texts, np.zeros(6), 0, 1)
    want = lm_score.gradient(model, table, x, y, some=len(x))
    lm_score.log_probabilities(model, table, texts[1:3], 16, space)
    for some in (1, 5, 64):
        got = lm_score.gradient(model, table, x, y, space, some)
        assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    scores = [lm_score.log_probabilities(model, table, [t])[0] for t in texts]
    assert lm_score.log_probabilities(model, table, texts, 16, space) == pytest.approx(scores, rel=1e-5)


def test_repeats_score_apart(spark):
    """Texts that training saw twice score above others of their kind."""
    rng = random.Random(12)
    names = ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(names) if rng.random() < 0.3 else w for w in prose(rng, 60).split()), "en", "s") for i in range(400)]
    rows += [(1000 + i, rows[i][1], "en", "s") for i in range(60)]
    each = {r.doc_id: r.score / r.n_tokens for r in lm_score.lm_scores(frame(spark, rows)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    new = [each[i] for i in range(60, 400) if held(i)]
    twice = [each[i] for i in range(60) if not held(i) and not held(1000 + i)]
    assert np.mean([a > b for a in twice for b in new]) > 0.9


def test_added_spans(spark):
    """Every kind that the method adds comes out at its place, beside base spans and letters of several bytes."""
    samples = [("private", "-----BEGIN RSA PRIVATE KEY-----"), ("slack", "xoxb-1234567890ab"), ("google", "AIza" + "x" * 35), ("jwt", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12), ("github", "ghs_" + "Z" * 36)]
    rows = [(k, f"é日 {t} {t[:6]}, then {t}", "en", "s") for k, (_, t) in enumerate(samples)]
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in secret_scan.scan(frame(spark, rows)).collect()}
    for k, (kind, t) in enumerate(samples):
        second = rows[k][1].index(t, 5)
        assert [s for s in got[k] if s[0] == kind] == [(kind, 3, 3 + len(t), False), (kind, second, second + len(t), False)]
