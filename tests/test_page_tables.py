"""Tables, boxes and figures of pages against plain versions, and one page with all of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import page_tables as pt

WORDS, DRAWN = "doc_id long, page int, x0 double, x1 double, y double, t string", "doc_id long, page int, x0 double, x1 double, y0 double, y1 double"
CAPTIONS, BLOCKS = "doc_id long, page int, text string, x0 double, x1 double, y0 double, y1 double", "doc_id long, page int, block int, text string, x0 double, x1 double, y0 double, y1 double"


def put(x, y, text, size=9.0, doc=1):
    """Words of a text whose baseline is y, half a size wide a character; blanks are as wide."""
    out, at = [], float(x)
    for part in text.split(" "):
        if part:
            out.append((doc, 1, at, at + len(part) * size / 2, round(y - size, 1), part))
        at += (len(part) + 1) * size / 2
    return out


def rule(y, x0=72.0, x1=300.0, doc=1):
    return (doc, 1, float(x0), float(x1), y - 0.6, y + 0.6)


def caption(x, y, text, size=8.0, doc=1):
    return (doc, 1, text, float(x), x + len(text) * size / 2, y - size, float(y))


def test_one_page(spark):
    words, drawn, captions = [], [rule(80), rule(150)], []
    for k, line in enumerate(["Algorithm 1: SEARCH(q, ep)", "1  V <- ep", "2  for i <- 1..n do", "3  return V"]):
        words += put(76, 96 + k * 12, line)
    drawn += [rule(200), rule(222), rule(246)]
    words += put(76, 216, "Model     Time     Rounds") + put(76, 238, "Llama     1.00     66")
    drawn += [rule(y, 72, 400) for y in (300, 320, 380)]
    words += put(76, 314, "Symbol") + put(160, 314, "Description")
    for k, (sign, text) in enumerate([("M", "degree bound of traversed nodes in HNSW search"), ("ef", "size of dynamic candidate list in HNSW search"), ("efn", "size of directional filter")]):
        words += put(76, 336 + k * 12, sign) + put(160, 336 + k * 12, text)
    drawn += [rule(y, 72, 220) for y in (420, 440, 460)] + [rule(y, 72, 200) for y in (510, 530, 550)]
    for k, t in enumerate(["0.04", "0.08", "0.12"]):
        words += put(78, 432 + k * 16, t, 8.0)
    words += put(78, 522, "0.4", 8.0) + put(78, 540, "0.8", 8.0)
    for x, y, text in ((120, 266, "Table 1: Latency and rounds."), (150, 396, "Table 2: Summary of Notation."), (90, 490, "Figure 1: Latency breakdown."), (90, 580, "Figure 2: A purely graphical plot.")):
        captions.append(caption(x, y, text))
        words += put(x, y, text, 8.0)
    blocks = [(1, 1, k, w[5], w[2], w[3], w[4], w[4] + 9) for k, w in enumerate(words)]
    got = pt.page_blocks(spark.createDataFrame(words, WORDS), spark.createDataFrame(drawn, DRAWN), spark.createDataFrame(captions, CAPTIONS), spark.createDataFrame(blocks, BLOCKS)).orderBy("number").collect()
    assert [g.kind for g in got] == ["algorithm", "table", "table", "figure", "figure"]
    assert got[0].lines == ["Algorithm 1: SEARCH(q, ep)", "1 V <- ep", "2 for i <- 1..n do", "3 return V"]
    assert got[1].columns == 3 and got[1].head_rows == 1 and [[c.text for c in r] for r in got[1].rows] == [["Model", "Time", "Rounds"], ["Llama", "1.00", "66"]]
    assert got[2].columns == 2 and got[2].rows[1][1].text == "degree bound of traversed nodes in HNSW search" and got[2].caption == "Table 2: Summary of Notation."
    assert got[3].content == ["0.04", "0.08", "0.12"] and got[4].content == [] and got[4].caption.startswith("Figure 2")


def plain_slots(lines):
    """Columns by a scan of x in steps of one point."""
    words = [w for _, ws in lines for w in ws]
    lo, hi, need = min(w[0] for w in words), max(w[1] for w in words), max(1, math.ceil(0.9 * len(lines) - 1e-9))
    gaps = [[(a[1], b[0]) for a, b in zip(ws, ws[1:], strict=False) if b[0] > a[1]] for _, ws in lines]
    found, begun, k = [], None, 0
    while lo + k <= hi + 1:
        x = lo + k
        free = sum(any(a - 0.5 <= x <= b + 0.5 for a, b in g) for g in gaps) >= need
        if free and begun is None:
            begun = x
        if not free and begun is not None:
            found.append((begun, x))
            begun = None
        k += 1
    bounds = [(a + b) / 2 for a, b in found if b - a >= 3]
    if not bounds:
        ws = max(lines, key=lambda line: len(line[1]))[1]
        edges = [ws[0][0] - 8, *((a[1] + b[0]) / 2 for a, b in zip(ws, ws[1:], strict=False)), ws[-1][1] + 8]
    else:
        edges = [lo - 8, *bounds, hi + 8]
    return list(zip(edges, edges[1:], strict=False))


def test_slots(spark):
    rng = random.Random(5)
    data = []
    for n in range(120):
        columns = sorted(rng.sample(range(20, 300, 20), rng.randint(1, 4)))
        lines = []
        for k in range(rng.randint(1, 14)):
            words, right = [], 0
            for c in columns:
                at = max(right + 1, c + rng.choice([0, 0, 1.5, 3]))
                for _ in range(rng.choice([1, 1, 1, 3])):
                    width = rng.choice([4.0, 9.0, 15.0, 31.0])
                    words.append((float(at), at + width, "w"))
                    at += width + rng.choice([1.0, 2.5, 4.0])
                right = at
            if rng.random() < 0.9:
                lines.append((12.0 * k, words if rng.random() < 0.9 else words[:1]))
        if lines:
            data.append((n, 1, 1, lines))
    got = pt.slots_of_lines(spark.createDataFrame(data, f"doc_id long, page int, region int, lines array<{pt.LINE}>")).collect()
    assert len(got) == len(data)
    for g in got:
        want = plain_slots(next(d[3] for d in data if d[0] == g.doc_id))
        assert [x for s in g.slots for x in s] == pytest.approx([x for s in want for x in s])


def test_regions_part_at_captions(spark):
    rules = [(1, 1, y, 10.0, 200.0) for y in (0.0, 20.0, 40.0, 70.0, 90.0, 95.0, 130.0)] + [(1, 1, y, 10.0, 150.0) for y in (5.0, 12.0)]
    words = put(12, 15, "some text") + put(12, 35, "more") + put(12, 60, "Table 3: between") + put(12, 85, "other") + put(300, 115, "far")
    got = pt.table_regions(spark.createDataFrame(rules, "doc_id long, page int, y double, x0 double, x1 double"), spark.createDataFrame(words, WORDS)).orderBy("region").collect()
    assert [(g.region, g.x1, g.ys) for g in got] == [(1, 200.0, [0.0, 20.0, 40.0]), (2, 200.0, [70.0, 90.0, 95.0])]


def test_headers(spark):
    slots = [(0.0, 100.0), (100.0, 200.0), (200.0, 300.0)]
    lines = [(0.0, [(10.0, 40.0, "Name"), (120.0, 280.0, "Perplexity")]), (8.0, [(110.0, 270.0, "(lower)"), (12.0, 30.0, "id")]), (16.0, [(120.0, 140.0, "Float"), (220.0, 240.0, "Fixed")])]
    d = spark.createDataFrame([(lines, slots), (lines[2:] + [(24.0, [(120.0, 130.0, "(s)")])], slots), ([], slots)], "lines array<struct<y:double,words:array<struct<x0:double,x1:double,t:string>>>>, slots array<struct<a:double,b:double>>")
    got = [[[tuple(c) for c in r] for r in row.h] for row in d.select(pt.header_rows(F.col("lines"), F.col("slots")).alias("h")).collect()]
    assert got == [[[("Name", 0, 1), ("id", 0, 1), ("Perplexity (lower)", 1, 2)], [("Float", 1, 1), ("Fixed", 2, 1)]], [[("Float (s)", 1, 1), ("Fixed", 2, 1)]], []]


def test_boxed_tables(spark):
    """A grid of single boxes with a merged head, a grid of long lines with a cell of two rows, and lines that close nothing."""
    boxes = [(1, 1, 50.0, 250.0, 50.0, 70.0), *((1, 1, 50.0 + 100 * c, 150.0 + 100 * c, 70.0 + 20 * r, 90.0 + 20 * r) for c in range(2) for r in range(2))]
    words = put(60, 65, "Head over both") + put(60, 85, "a1") + put(160, 85, "b1 b1") + put(160, 105, "b2")
    lines = [(2, 1, 10.0, 110.0, y, y + 0.5) for y in (10.0, 70.0)] + [(2, 1, 60.0, 110.0, 40.0, 40.5)] + [(2, 1, x, x + 0.5, 10.0, 70.0) for x in (10.0, 60.0, 110.0)]
    words += put(15, 35, "tall", doc=2) + put(65, 35, "r1", doc=2) + put(65, 65, "r2", doc=2)
    lines += [(3, 1, 10.0, 90.0, 10.0, 10.5), (3, 1, 10.0, 10.5, 10.0, 60.0)]
    got = {g.doc_id: g for g in pt.boxed_tables(spark.createDataFrame(boxes + lines, DRAWN), spark.createDataFrame(words, WORDS)).collect()}
    shown = lambda g: [[None if c is None else (c.text, c.span) for c in r] for r in g.rows]
    assert set(got) == {1, 2} and (got[1].x0, got[1].x1, got[1].y0, got[1].y1, got[1].columns) == (50.0, 250.0, 50.0, 110.0, 2)
    assert shown(got[1]) == [[("Head over both", 2), None], [("a1", 1), ("b1 b1", 1)], [("", 1), ("b2", 1)]]
    assert shown(got[2]) == [[("tall", 1), ("r1", 1)], [None, ("r2", 1)]]


def test_growth(spark):
    rng = random.Random(8)
    areas, blocks, captions, want = [], [], [], {}
    for d in range(60):
        top = 300.0
        areas.append((d, 1, 1, 50.0, 200.0, top, 400.0))
        own = [(d, 1, k, rng.choice(["legend", "Figure 3: no", "A sentence. More of it"]) if rng.random() < 0.3 else "label", x := rng.choice([60.0, 60.0, 240.0]), x + 50, y := rng.uniform(200, 300), y + rng.choice([1.0, 8.0, 12.0])) for k in range(8)]
        above = rng.choice([None, rng.uniform(215, 290)])
        captions += [(d, 1, "Figure 1: own", 60.0, 120.0, 402.0, 410.0)] + ([(d, 1, "Figure 0: x", 60.0, 120.0, above - 8, above)] if above else [])
        blocks += own
        ceiling = max(top - 80, above if above else 0)
        moved = True
        while moved:
            moved = False
            for *_, text, x0, x1, y0, y1 in own:
                if text in ("legend", "label") and x1 >= 50 and x0 <= 200 and ceiling <= y1 <= top + 2 and top - y1 <= 18 and y0 < top:
                    top, moved = y0, True
        want[d] = top
    a = spark.createDataFrame(areas, "doc_id long, page int, caption int, x0 double, x1 double, top double, bottom double")
    got = pt.grown_areas(a, spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(captions, CAPTIONS)).collect()
    assert {g.doc_id: g.top for g in got} == want and len(set(want.values())) > 10


def test_empty(spark):
    none = [spark.createDataFrame([], s) for s in (WORDS, DRAWN, CAPTIONS, BLOCKS)]
    assert pt.page_blocks(*none).count() == 0
