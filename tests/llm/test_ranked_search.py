"""Ranked search against plain scoring, the dual tree's pruning and edge cases."""

import collections
import math
import random
import re

import numpy as np
import pytest

from quire.llm import ranked_search
from quire.llm.ranked_search import halves, search_pair

TERM = re.compile(ranked_search.TERM)
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs, items, k=20):
    """docs: (doc_id, text); items: (item_id, text). Rows (item_id, rank, doc_id, score), a null doc_id last among equals."""
    terms = [collections.Counter(TERM.findall((t or "").translate(UPPER))) for _, t in docs]
    n = [sum(t.values()) for t in terms]
    count, length = sum(x > 0 for x in n), sum(n)
    df = collections.Counter(x for t in terms for x in t)
    out = collections.Counter()
    for item, text in dict.fromkeys(items):
        scores = []
        for (i, _), t, size in zip(docs, terms, n, strict=True):
            m = 100 - 25 + (25 * size * count) // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * ((10**9 * t[x]) // (1000 * t[x] + 12 * m)) for x in TERM.findall((text or "").translate(UPPER)) if t[x])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, None if none else i, -s] += 1
    return out


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, n int, terms string, share int"), spark.createDataFrame([(*i, "y", 3) for i in items], "item_id long, text string, term string, rank int")


def found(df):
    return collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("sizes", [(2048, 32), (5, 2)])
def test_ranking(spark, monkeypatch, sizes):
    monkeypatch.setattr(ranked_search, "DOCS", sizes[0])
    monkeypatch.setattr(ranked_search, "ITEMS", sizes[1])
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["Éa", "日本", "A1b"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([8, 63])]) + rng.choice(["", ",", "_x", "."]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(150)]
    docs += [(None, docs[3][1]), (300, None), (301, ""), (302, "...  \n"), (303, "w1 " * 40_000), docs[5], docs[5], *((400 + k, docs[9][1]) for k in range(30))]
    items = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(None, "w1 w2"), (90, None), (91, ""), (92, "unheard of"), (93, "w5 w5 W5"), (93, "w5 w5 W5")]
    d, i = tables(spark, docs, items)
    assert found(ranked_search.ranked_search(d, i)) == plain(docs, items)
    assert found(ranked_search.ranked_search(d, i, 3)) == plain(docs, items, 3)


def test_empty_tables(spark):
    d, i = tables(spark, [(1, "a b")], [(1, "b")])
    assert found(ranked_search.ranked_search(d, i)) == plain([(1, "a b")], [(1, "b")])
    assert ranked_search.ranked_search(d.filter("false"), i).count() == 0 and ranked_search.ranked_search(d, i.filter("false")).count() == 0


def test_terms(monkeypatch):
    text = "Ab-cd_EF\x7f1 2é[x]日 AB" * 3
    monkeypatch.setattr(ranked_search, "PIECE", 4)
    assert ranked_search.terms_of(text) == collections.Counter(t.encode() for t in TERM.findall(text.translate(UPPER)))
    assert not ranked_search.terms_of(None) and not ranked_search.terms_of("")


def test_halves():
    for n in (1, 2, 3, 7, 64):
        levels = halves(n)
        assert levels[-1].tolist() == list(range(n + 1)) and all(set(a.tolist()) <= set(b.tolist()) for a, b in zip(levels, levels[1:], strict=False))


@pytest.mark.parametrize("clusters", [1, 16])
def test_dual_tree(clusters):
    """Exact on random vectors; on clustered ones most pairs of items and leaves are never scored."""
    rng = np.random.default_rng(3)
    cols, n_docs, items = 16 * 12, 1500, 16
    of = np.sort(rng.integers(0, clusters, n_docs))
    x = np.zeros((n_docs, cols), np.int64)
    for d in range(n_docs):
        at = (of[d] * 12 + rng.integers(0, 12, 6)) if clusters > 1 else rng.integers(0, cols, 6)
        x[d, at] = rng.integers(1, 10**6, 6)
    q = np.zeros((items, cols), np.int64)
    for k in range(items):
        q[k, (k * 12 + np.arange(12)) if clusters > 1 else rng.integers(0, cols, 12)] = rng.integers(1, 20_000, 12)
    doc, col = np.nonzero(x)
    for k in (1, 20):
        got, (scored, pairs) = search_pair(q, doc // ranked_search.LEAF, doc, col, x[doc, col], n_docs, np.ones(items, np.int64), k)
        scores = q @ x.T
        for j in range(items):
            want = sorted(((int(s), -d) for d, s in enumerate(scores[j]) if s > 0), reverse=True)[:k]
            assert sorted(((s, -d) for s, d in got[j]), reverse=True)[:k] == want
        if clusters > 1:
            assert scored < 0.2 * pairs
        floors = np.sort(scores, 1)[:, -k]
        again, (fewer, _) = search_pair(q, doc // ranked_search.LEAF, doc, col, x[doc, col], n_docs, np.maximum(1, floors), k)
        assert fewer <= scored and [sorted(a, key=lambda r: (-r[0], r[1]))[:k] for a in again] == [sorted(a, key=lambda r: (-r[0], r[1]))[:k] for a in got]


def test_sums_beyond_floats():
    q, x = np.array([[2**40, 1]]), np.array([[2**20, 1], [2**20, 0]])
    doc, col = np.nonzero(x)
    got, _ = search_pair(q, doc // ranked_search.LEAF, doc, col, x[doc, col], 2, np.array([1]), 1)
    assert max(got[0]) == (2**60 + 1, 0)
