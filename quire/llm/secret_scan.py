"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query of the trigrams that a match must hold. A task indexes
its texts segment by segment, as search engines do: postings of just the trigrams that queries name. Queries
intersect and unite postings, and only the documents left are searched with the expression. A rule whose
expression demands no trigram searches every text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from re import _constants as C
from re import _parser as parser

#: Alternatives kept for one place of an expression; beyond them it demands nothing.
MOST = 16


@dataclass(frozen=True)
class Rule:
    """A match of pattern counts if the given group of it has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = field(default=False)


#: Fixed values of the base rules; the run of hex digits and of capitals is as long as it can be, so its least length can stand in the pattern.
RULES = (
    Rule("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("private", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def _product(a: set | None, b: set | None) -> set | None:
    if a is None or b is None or len(a) * len(b) > MOST:
        return None
    return {x + y for x in a for y in b}


def _demand(strings: set) -> tuple:
    """('or', of ('and', of trigrams)): one of strings stands in the text; () if that demands nothing."""
    if any(len(x.encode()) < 3 for x in strings):
        return ()
    return ("or", *[("and", *sorted({b[k : k + 3] for k in range(len(b) - 2)})) for b in sorted(x.lower().encode() for x in strings)])


def _walk(tree) -> tuple[set | None, list]:
    """The few strings that the tree matches, or None, and what else it demands of the text."""
    run: set | None = {""}
    demands: list = []

    def close():
        nonlocal run
        if run and (d := _demand(run)):
            demands.append(d)
        run = {""}

    known = True
    for op, value in tree:
        exact, inner = None, []
        if op is C.LITERAL:
            exact = {chr(value)}
        elif op is C.IN and all(k is C.LITERAL or k is C.RANGE and v[1] - v[0] < MOST for k, v in value):
            exact = {chr(x) for k, v in value for x in ([v] if k is C.LITERAL else range(v[0], v[1] + 1))}
            exact = exact if len(exact) <= MOST else None
        elif op is C.SUBPATTERN:
            exact, inner = _walk(value[3])
        elif op is C.BRANCH:
            sides = [_walk(x) for x in value[1]]
            exact = set().union(*[s for s, _ in sides]) if all(s is not None for s, _ in sides) else None
            if exact is None and all(d for _, d in sides):
                inner = [("or", *[("and", *d) for _, d in sides])]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = value
            e, d = _walk(body)
            if (low, high) == (0, 1) and e is not None:
                exact = e | {""}
            elif low:
                inner = d
                if low == high == 1:
                    exact = e
        elif op is C.AT:
            exact = {""}
        demands += inner
        joined = _product(run, exact)
        if joined is None:
            known = False
            close()
            run = exact if exact is not None and len(exact) <= MOST else {""}
        else:
            run = joined
    if known:
        return run, demands
    close()
    return None, demands


def trigram_query(pattern: str) -> tuple:
    """Nested ('and' | 'or', ...) over lower-case trigrams that every match of pattern holds; ('and',) demands nothing."""
    exact, demands = _walk(parser.parse(pattern))
    if exact is not None and (d := _demand(exact)):
        demands = [*demands, d]
    return ("and", *demands)


def _trigrams(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1:]))


class Segment:
    """Postings of the named trigrams over some texts."""

    def __init__(self, texts: list[bytes], trigrams: list[bytes]):
        self.all = np.arange(len(texts))
        flat = np.frombuffer(b"\x00".join(texts).lower(), np.uint8).astype(np.uint32)
        codes = np.array(sorted(int.from_bytes(t, "big") for t in trigrams), np.uint32)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        self.postings = {t: self.all[:0] for t in trigrams}
        if len(flat) >= 3 and len(codes):
            named = np.zeros(1 << 24, bool)
            named[codes] = True
            seen = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
            at = np.flatnonzero(named[seen])
            doc = np.searchsorted(starts, at, "right") - 1
            for t in trigrams:
                self.postings[t] = np.unique(doc[seen[at] == int.from_bytes(t, "big")])

    def find(self, query) -> np.ndarray:
        if isinstance(query, bytes):
            return self.postings[query]
        found = [self.find(x) for x in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        out = self.all
        for x in sorted(found, key=len):
            out = np.intersect1d(out, x, assume_unique=True)
        return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, segment_bytes: int = 4 << 20) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, spans (array of struct kind, start, end, base; by start,
    then in the order of the rules).

    Spans are code points, the end exclusive; spans of one rule don't overlap, those of two may. A null text is
    empty and has none. Repeated rows are scanned alike; whole texts are searched, however long.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    queries = [trigram_query(r.pattern) for r in rules]
    names = sorted(set().union(*map(_trigrams, queries)))
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def search(batches):
        compiled = [re.compile(r.pattern) for r in rules]

        def found(texts: list[str]) -> list[list[dict]]:
            segment = Segment([t.encode() for t in texts], names)
            out: list[list] = [[] for _ in texts]
            for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                for i in segment.find(query):
                    for m in compiled[k].finditer(texts[i]):
                        if len(m[rule.group]) >= rule.least:
                            out[i].append((m.start(), k, m.end()))
            return [[{"kind": rules[k].kind, "start": a, "end": b, "base": rules[k].base} for a, k, b in sorted(spans)] for spans in out]

        for batch in batches:
            spans, texts, size = [], [], 0
            for text in batch.column(1).to_pylist():
                texts.append(text or "")
                size += len(texts[-1])
                if size >= segment_bytes:
                    spans += found(texts)
                    texts, size = [], 0
            if texts:
                spans += found(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, spans_type)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
