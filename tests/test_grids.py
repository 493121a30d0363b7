"""Grids with wide cells and term marks against plain versions on random regions."""

import random
import re

from pyspark.sql import functions as F

from quire.operators import grids, ordered

LINES = "lines array<struct<y:double,words:array<struct<x0:double,x1:double,t:string>>>>, slots array<struct<a:double,b:double>>"


def plain_grid(lines, slots, size):
    """Rows as {start: (text, span)}: words to slots, slots to cells, lines to rows, rows to places."""
    made, rows = [], []
    for y, words in sorted(lines):
        cells = []
        for x0, x1, t in sorted(words):
            over = [k for k, (a, b) in enumerate(slots) if min(x1, b) - max(x0, a) >= max(1.5, (x1 - x0) / 4)]
            if not over:
                far = [abs((a + b) / 2 - (x0 + x1) / 2) for a, b in slots]
                over = [far.index(min(far))]
            if cells and cells[-1][2] >= over[0]:
                cells[-1] = [f"{cells[-1][0]} {t}", cells[-1][1], max(cells[-1][2], over[-1])]
            else:
                cells.append([t, over[0], over[-1]])
        if made and y - made[-1][0] < 0.8 * size:
            made[-1] = (y, made[-1][1] + cells)
        else:
            made.append((y, cells))
    for _, cells in made:
        merged = []
        for t, a, b in cells:
            hit = next((m for m in merged if m[1] <= b and a <= m[2]), None)
            if hit:
                hit[0], hit[1], hit[2] = f"{hit[0]} {t}", min(hit[1], a), max(hit[2], b)
            else:
                merged.append([t, a, b])
        line = [None] * len(slots)
        for t, a, b in sorted(merged, key=lambda m: m[1]):
            line[a] = (t, min(b - a + 1, len(slots) - a))
        rows.append(line)
    return rows


def test_span_grids(spark):
    rng = random.Random(9)
    data = []
    for _ in range(150):
        slots = [(40.0 * k, 40.0 * k + rng.choice([30.0, 38.0])) for k in range(rng.randint(1, 5))]
        lines, y = [], 0.0
        for n in range(rng.randint(0, 6)):
            y += rng.choice([3.0, 8.0, 12.0])
            starts = sorted(rng.sample(range(0, 200, 5), rng.randint(1, 5)))
            lines.append((y, [(float(x), float(x + rng.choice([4, 20, 70])), f"w{n}{k}") for k, x in enumerate(starts)]))
        data.append((lines, slots))
    got = spark.createDataFrame(data, LINES).select("lines", "slots", grids.span_grid(F.col("lines"), F.col("slots"), F.lit(10.0)).alias("g")).collect()
    for r in got:
        want = plain_grid([(x.y, [tuple(w) for w in x.words]) for x in r.lines], [tuple(s) for s in r.slots], 10.0)
        assert [[None if c is None else (c.text, c.span) for c in row] for row in r.g] == want


def test_term_marks(spark):
    rng = random.Random(10)
    terms = ["a.b", "ab", "abc", "b+", "c a", "bc"]
    rows = [(d, p, "".join(rng.choice("abc .+$") for _ in range(30)), rng.choice(["text", "text", "table"])) for d in range(20) for p in range(6)]
    pattern = re.compile("|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))))
    want = {}
    for d, p, t, kind in rows:
        if kind == "text":
            for m in pattern.findall(re.sub(r"\$[^$]*\$", " ", t)):
                want.setdefault((d, m), p)
    pairs = spark.createDataFrame([(d, t.upper() if d % 2 else t) for d in range(20) for t in terms] + [(0, " "), (0, None)], "doc_id long, term string")
    got = ordered.term_marks(spark.createDataFrame(rows, "doc_id long, pos int, text string, kind string"), pairs).collect()
    assert {(r.doc_id, r.term): r.pos for r in got} == want
