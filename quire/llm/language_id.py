"""Language identification by prediction by partial matching.

For each language a tree of byte contexts, of order 0 to ORDER, counts which byte follows. A byte costs
-log2 of its probability in the longest context that the tree knows; where that context never saw it, an escape
(as likely as the context has distinct followers) leads to the next shorter one, in which what the longer one
knows is excluded, down to all bytes alike. So each context gives a true distribution over the 256 bytes. The
statistics are frozen: a text's code length is a sum over its words, and the language of the least one wins.

A word is a run of letters in lower case, coded byte by byte up to the space that ends it; its contexts begin
with the space before it. Words of all training texts are counted where they lie and summed by Spark; the trees
take the most frequent words of each language, tree_words in all, so what travels to the tasks is bounded.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written

#: The longest context in bytes; words of all languages together that the trees take.
ORDER, TREE_WORDS = 5, 1 << 15
#: Characters of a piece in which a long text is read, so at most half as many words; words that are looked up together; words whose code lengths a task keeps.
PIECE, HELD, CACHED = 1 << 18, 1 << 16, 1 << 19
#: Parts of a language's words that are ranked apart.
SALTS = 32
_WORD, _BREAK = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")


def words_of(text: str) -> Iterator[list[str]]:
    """The words of the whole text in lower case, a piece at a time; pieces end between words."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        yield _WORD.findall(text[at:end].lower())
        at = end


class ContextTree:
    """Frozen counts of the bytes that follow each context of up to ORDER bytes."""

    def __init__(self, words: dict[str, int], order: int = ORDER):
        self.order = order
        self.followers: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        self.followers[b""] = defaultdict(int)
        for word, n in words.items():
            coded = b" " + word.encode() + b" "
            for k in range(1, len(coded)):
                for a in range(max(0, k - order), k + 1):
                    self.followers[coded[a:k]][coded[k]] += n
        # what is left in a context's next shorter one without the bytes that the context itself knows: counts, distinct bytes
        self.rest = {c: self._without(self.followers[c[1:]], f) for c, f in self.followers.items() if c}

    @staticmethod
    def _without(shorter: dict[int, int], known: dict[int, int]) -> tuple[int, int]:
        return sum(shorter.values()) - sum(shorter[b] for b in known), len(shorter) - len(known)

    def bits(self, context: bytes, byte: int) -> float:
        """The code length of a byte after a known context."""
        known = self.followers[context]
        total, distinct, spent = sum(known.values()), len(known), 0.0
        while True:
            n = self.followers[context].get(byte)
            if n:
                return spent - math.log2(n / (total + distinct))
            if distinct:  # with nothing new in it, a context is left at no cost
                spent -= math.log2(distinct / (total + distinct))
            if not context:
                return spent + math.log2(256 - len(self.followers[b""]))
            total, distinct = self.rest[context]
            context = context[1:]

    def after(self, context: bytes, byte: int) -> bytes:
        """The longest known context after a byte."""
        longer = (context + bytes([byte]))[-self.order :] if self.order else b""
        while longer not in self.followers:
            longer = longer[1:]
        return longer


class Model:
    """A tree for each language as one table of steps, filled as they are met, and the code lengths of words met lately."""

    def __init__(self, rows: tuple[tuple[str, str, int], ...]):
        counts: dict[str, dict[str, int]] = defaultdict(dict)
        for lang, word, n in rows:
            counts[lang][word] = n
        self.langs = sorted(counts)
        self.trees = [ContextTree(counts[x]) for x in self.langs]
        self.states = [(t, c) for t in self.trees for c in t.followers]
        self.number = {(id(t), c): k for k, (t, c) in enumerate(self.states)}
        self.begin = np.array([self.number[id(t), b" "] for t in self.trees], np.int64)
        # bytes that no tree knows are alike
        known = sorted({b for t in self.trees for b in t.followers[b""]})
        self.bytes = [*known, next((b for b in range(256) if b not in set(known)), 0)]
        self.kind = np.full(256, len(known), np.int64)
        self.kind[known] = np.arange(len(known))
        self.next = np.full(len(self.states) * len(self.bytes), -1, np.int32)
        self.cost = np.zeros(len(self.next))
        self.at: dict[str, int] = {}
        self.costs = np.empty((CACHED, len(self.langs)))

    def _fill(self, steps: np.ndarray) -> None:
        for step in np.unique(steps).tolist():
            (tree, context), byte = self.states[step // len(self.bytes)], self.bytes[step % len(self.bytes)]
            self.next[step] = self.number[id(tree), tree.after(context, byte)]
            self.cost[step] = tree.bits(context, byte)

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits of each word and its end in each language."""
        # the word class has a few signs that are no letters: they part words
        parts = [w if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).strip() for w in words]
        coded = [p.encode() + b" " if p else b"" for p in parts]
        order = sorted(range(len(coded)), key=lambda k: -len(coded[k]))
        sizes = np.array([len(coded[k]) for k in order], np.int64)
        kinds, starts = self.kind[np.frombuffer(b"".join(coded[k] for k in order), np.uint8)], np.cumsum(sizes) - sizes
        state, bits = np.tile(self.begin, (len(words), 1)), np.zeros((len(words), len(self.langs)))
        for k in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -k))  # words of over k bytes
            step = state[:n] * len(self.bytes) + kinds[starts[:n] + k][:, None]
            after = self.next[step]
            if after.min() < 0:
                self._fill(step[after < 0])
                after = self.next[step]
            bits[:n] += self.cost[step]
            state[:n] = after
        out = np.empty_like(bits)
        out[order] = bits
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its share of the languages' joint probability of a text; und without letters, or without anything learned."""
        total, letters = np.zeros((len(texts), len(self.langs))), [False] * len(texts)
        held: list[tuple[int, list[str], np.ndarray]] = []
        size = 0
        look = lambda words: np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))

        def add():
            fresh = {words[j] for _, words, at in held for j in np.flatnonzero(at < 0).tolist()}
            if len(self.at) + len(fresh) > CACHED:
                self.at.clear()
                fresh = {w for _, words, _ in held for w in words}
            n = len(self.at)
            self.costs[n : n + len(fresh)] = self.code_lengths(list(fresh))
            self.at.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            for k, words, at in held:
                if n == 0 or at.min(initial=0) < 0:
                    at = look(words)
                total[k] += self.costs[at].sum(0)

        for k, text in enumerate(texts):
            for words in words_of(text or ""):
                letters[k] = letters[k] or any(c.isalpha() for w in words for c in w)
                if words and self.langs:
                    held.append((k, words, look(words)))
                    size += len(words)
                if size > HELD:
                    add()
                    held, size = [], 0
        if held:
            add()
        best = total.argmin(1) if self.langs else total  # of equal ones the first by code point
        share = lambda k: float(1 / np.exp2(np.maximum(total[k, best[k]] - total[k], -1000)).sum())
        return [(self.langs[best[k]], share(k)) if letters[k] and self.langs else ("und", 0.0) for k in range(len(texts))]


@functools.lru_cache(1)
def model_of(rows: tuple[tuple[str, str, int], ...]) -> Model:
    """One for each Python worker, kept between its tasks."""
    return Model(rows)


def word_counts(docs: DataFrame, lang: Column) -> DataFrame:
    """lang, word, n over the whole texts of docs; null texts and languages count nothing."""

    def count(batches):
        found: Counter[tuple[str, str]] = Counter()

        def out():
            keys = list(found)
            batch = pa.RecordBatch.from_pydict({"lang": [k[0] for k in keys], "word": [k[1] for k in keys], "n": list(found.values())}, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))
            found.clear()
            return batch

        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for words in words_of(text.as_py()):
                    for word, n in Counter(words).items():
                        if word.isalpha():
                            found[language, word] += n
                    if len(found) >= CACHED:
                        yield out()
        if found:
            yield out()

    rows = docs.select(lang.cast("string").alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def tree_words(counts: DataFrame, total: int = TREE_WORDS) -> tuple[tuple[str, str, int], ...]:
    """The most frequent words of each language, the same number for each and `total` rows at most; of equal counts the lesser word."""
    counts = written(counts, "word_counts")
    langs = counts.agg(F.count_distinct("lang")).first()[0]
    if langs > total:
        raise ValueError(f"{langs} languages, more than the {total} words that the trees take")
    most = total // max(1, langs)
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))
    # a language's words in SALTS parts first, so no task ranks them all
    some = counts.withColumn("_part", F.pmod(F.xxhash64("word"), F.lit(SALTS))).withColumn("_rank", rank("lang", "_part")).filter(F.col("_rank") <= most)
    chosen = some.withColumn("_rank", rank("lang")).filter(F.col("_rank") <= most).select("lang", "word", "n")
    return tuple(sorted((r.lang, r.word, r.n) for r in chosen.toLocalIterator()))


def predict_language(docs: DataFrame, training: DataFrame, total: int = TREE_WORDS) -> DataFrame:
    """A row for each row of docs: doc_id, lang_pred and score from 0 to 1, learned from text and lang of `training`.

    A null or empty text, or one without a letter, is `und` with score 0, and so is every text if nothing was
    learned. Rows with a null text or lang teach nothing; repeated rows teach again and are predicted alike. Equal
    code lengths go to the lesser language name. Whole texts are read, long ones piece by piece. Other columns,
    whatever their names, are left alone.
    """
    rows = docs.sparkSession.sparkContext.broadcast(tree_words(word_counts(training, F.col("lang")), total))  # at most `total` words
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches):
        model = model_of(rows.value)
        for batch in batches:
            got = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
