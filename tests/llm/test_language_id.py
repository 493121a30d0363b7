"""Language identification against plain prediction by partial matching, held-out accuracy and edge cases."""

import collections
import math
import random
from fractions import Fraction

import pytest

from quire.llm import language_id
from quire.llm.language_id import ContextTree, Model, predict_language

TABLES = "/root/testdata/sf0.01"
WORDS = {"the": 5, "then": 2, "other": 3, "é": 1, "toto": 2}


def plain(words, order, context, byte):
    """Probability of a byte after the bytes before it, by counting substrings and excluding what longer contexts know."""
    counts = collections.defaultdict(collections.Counter)
    for w, n in words.items():
        coded = b" " + w.encode() + b" "
        for k in range(1, len(coded)):
            for a in range(max(0, k - order), k + 1):
                counts[coded[a:k]][coded[k]] += n
    p, gone = Fraction(1), set()
    for size in range(min(order, len(context)), -1, -1):
        c = context[len(context) - size :]
        if c not in counts:
            continue
        left = {b: n for b, n in counts[c].items() if b not in gone}
        new = len(left)
        if byte in left:
            return p * Fraction(left[byte], sum(left.values()) + new)
        if new:
            p *= Fraction(new, sum(left.values()) + new)
        gone |= set(left)
    return p * Fraction(1, 256 - len(gone))


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_code_lengths(order):
    tree = ContextTree(WORDS, order)
    for context in (b"", b" ", b" t", b"othe", b" xyz", b" toto"):
        known = context[-order:] if order else b""
        while known not in tree.followers:
            known = known[1:]
        ps = [plain(WORDS, order, context, b) for b in range(256)]
        assert sum(ps) == 1
        for b in range(256):
            assert tree.bits(known, b) == pytest.approx(-math.log2(ps[b]), abs=1e-9)


def test_words_through_tables():
    rng = random.Random(1)
    rows = tuple((lang, w, n) for lang, words in (("a", WORDS), ("b", {"zu": 4, "thy": 1})) for w, n in words.items())
    model = Model(rows)
    words = ["the", "zu", "", "é²x", "½", "q" * 300, *("".join(rng.choice("thezuoñ") for _ in range(rng.randint(1, 12))) for _ in range(60))]
    got = model.code_lengths(words)
    for w, costs in zip(words, got, strict=True):
        parts = w.replace("²", " ").replace("½", " ").strip()
        for lang, cost in zip((WORDS, {"zu": 4, "thy": 1}), costs, strict=True):
            coded = b" " + parts.encode() + b" "
            want = sum(-math.log2(plain(lang, language_id.ORDER, coded[:k], coded[k])) for k in range(1, len(coded))) if parts else 0
            assert cost == pytest.approx(want, abs=1e-6)


def test_texts(monkeypatch):
    """A text in pieces, with a small cache, costs what its words cost."""
    texts = ["The other, the toto. " * 40, None, "", "123 !?", "½²", "then\nÉ thy zu zu zu"]
    rows = tuple((lang, w, n) for lang, words in (("a", WORDS), ("b", {"zu": 4, "thy": 1})) for w, n in words.items())
    want = Model(rows).predict(texts)
    assert [w[0] for w in want] == ["a", "und", "und", "und", "und", "b"] and [w[1] for w in want[1:5]] == [0.0] * 4
    for name, n in (("PIECE", 7), ("HELD", 3), ("CACHED", 12)):
        monkeypatch.setattr(language_id, name, n)
    assert Model(rows).predict(texts) == want
    assert Model(()).predict(["some text"]) == [("und", 0.0)]


def test_edges(spark):
    schema = "doc_id long, text string, lang string, word string, n int, _rank int"
    rows = [(1, "the water and the stone", "en"), (2, "der stein und das wasser", "de"), (2, "der stein und das wasser", "de"), (None, "the stone", None), (3, None, "en"), (4, "", "xx"), (5, "...", "de"), (6, "das wasser " * 50_000, None)]
    docs = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], schema)
    got = [(r.doc_id, r.lang_pred) for r in predict_language(docs, docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (2, "de"), (2, "de"), (None, "en"), (3, "und"), (4, "und"), (5, "und"), (6, "de")], key=str)
    assert predict_language(docs.filter("false"), docs).count() == 0
    assert {r.lang_pred for r in predict_language(docs, docs.filter("false")).collect()} == {"und"}
    with pytest.raises(ValueError):
        predict_language(docs, docs, total=1)


def test_every_training_text_counts(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, f"apple pear{'' if k % 2 else ' plum'}", "en") for k in range(40)], "doc_id long, text string, lang string").repartition(5)
    assert {(r.word, r.n) for r in language_id.word_counts(docs, F.col("lang")).collect()} == {("apple", 40), ("pear", 40), ("plum", 20)}


def test_held_out_accuracy(spark):
    from quire.llm.queries import op12_language_id

    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang")
    got = op12_language_id(spark, TABLES).join(docs, "doc_id").filter("held_out AND lang_pred <> 'und'").collect()
    assert len(got) > 250 and sum(g.lang == g.lang_pred for g in got) >= 0.98 * len(got) and all(0 <= g.score <= 1 for g in got)
