"""Tables of boxes for many pages at once: the tasks' part of page_tables.boxed_tables, on arrays of a batch.

A line is known by its index in the batch; lines are in order of page, kind (those that lie first), place and start.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.operators import line_arrays as la

CELL = pa.struct([("text", pa.string()), ("span", pa.int32())])
ROWS = pa.list_(pa.list_(CELL))
#: Fixed value: drawings thinner than this are lines.
THIN = 2.0


class Segments(NamedTuple):
    page: np.ndarray
    tall: np.ndarray
    at: np.ndarray
    a: np.ndarray
    b: np.ndarray


def half_up(x: np.ndarray) -> np.ndarray:
    whole = np.trunc(x)
    return whole + np.sign(x) * (np.abs(x - whole) >= 0.5)


def ranks(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value its rank from 0 among the distinct ones of its group, and these, sorted, with their groups."""
    order = np.lexsort((values, groups))
    g, v = groups[order], values[order]
    new_group = np.concatenate([[True], np.diff(g) != 0])[: len(g)]
    new = new_group | np.concatenate([[True], np.diff(v) != 0])[: len(g)]
    nth = np.cumsum(new) - 1
    first = np.maximum.accumulate(np.where(new_group, nth, 0)) if len(g) else nth
    rank = np.empty(len(g), np.int64)
    rank[order] = nth - first
    return rank, g[new], v[new]


def merged(s: Segments, tolerance: float) -> Segments:
    """Segments that overlap or nearly touch on one line, joined."""
    order = np.lexsort((s.b, s.a, s.at, s.tall, s.page))
    page, tall, at, a, b = (x[order] for x in s)
    if not len(page):
        return s
    new_line = np.concatenate([[True], (np.diff(page) != 0) | (np.diff(tall) != 0) | (np.diff(at) != 0)])
    line = np.cumsum(new_line) - 1
    ends, rank = np.unique(b, return_inverse=True)
    reach = ends[np.maximum.accumulate(rank + line * len(ends)) - line * len(ends)]
    new = new_line.copy()
    new[1:] |= a[1:] > reach[:-1] + tolerance
    first = np.flatnonzero(new)
    return Segments(page[first], tall[first], at[first], a[first], reach[np.append(first[1:], len(a)) - 1])


def edges(page: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> Segments:
    """Thin drawings as lines, others as four."""
    lies, stands = y1 - y0 < THIN, x1 - x0 < THIN
    h, v, box = np.flatnonzero(lies), np.flatnonzero(~lies & stands), np.flatnonzero(~lies & ~stands)
    parts = [(h, False, y0, x0, x1), (v, True, x0, y0, y1), (box, False, y0, x0, x1), (box, False, y1, x0, x1), (box, True, x0, y0, y1), (box, True, x1, y0, y1)]
    joined = lambda pick: np.concatenate([pick(*p) for p in parts])
    return Segments(joined(lambda i, t, at, a, b: page[i]), joined(lambda i, t, at, a, b: np.full(len(i), t)), half_up(joined(lambda i, t, at, a, b: at[i])), joined(lambda i, t, at, a, b: a[i]), joined(lambda i, t, at, a, b: b[i]))


def pairs(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner with the indices from its first on, so many as it has."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(la.offsets(counts)[:-1] - first, counts)


def following(group: np.ndarray, along: np.ndarray, test: np.ndarray) -> np.ndarray:
    """For each item the next along its group that the test holds for, or -1."""
    order = np.lexsort((along, group))
    n = len(order)
    ahead = np.append(np.minimum.accumulate(np.where(test[order], np.arange(n), n)[::-1])[::-1], n)[1:]
    ahead[ahead < n] = np.where(group[order][ahead[ahead < n]] == group[order][ahead < n], ahead[ahead < n], n)
    out = np.full(n, -1, np.int64)
    out[order[ahead < n]] = order[ahead[ahead < n]]
    return out


def cells(s: Segments, pages: int, tolerance: float) -> tuple[np.ndarray, ...]:
    """table, page, x0, x1, y0, y1 of each cell; a table is the first of the lines that hang together."""
    lying, standing = np.flatnonzero(~s.tall), np.flatnonzero(s.tall)
    at = la.offsets(np.bincount(s.page[standing], minlength=pages))
    i, j = pairs(at[s.page[lying]], np.diff(at)[s.page[lying]])
    h, v = lying[i], standing[j]
    x, y = s.at[v], s.at[h]
    meets = (x >= s.a[h] - tolerance) & (x <= s.b[h] + tolerance) & (y >= s.a[v] - tolerance) & (y <= s.b[v] + tolerance)
    h, v, x, y = h[meets], v[meets], x[meets], y[meets]
    right, down, left, up = s.b[h] > x + tolerance, s.b[v] > y + tolerance, s.a[h] < x - tolerance, s.a[v] < y - tolerance
    beside, below = following(h, x, left & down), following(v, y, up & right)
    c = np.flatnonzero(right & down & (beside >= 0) & (below >= 0))
    v1, h1 = v[beside[c]], h[below[c]]
    fourth = np.isin(h1 * len(s.at) + v1, (h * len(s.at) + v)[left & up])
    c, v1, h1 = c[fourth], v1[fourth], h1[fourth]
    label = np.arange(len(s.at))
    while True:
        least, new = np.minimum(label[h], label[v]), label.copy()
        np.minimum.at(new, h, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            return label[h[c]], s.page[h[c]], x[c], s.at[v1], y[c], s.at[h1]
        label = new


def texts(page: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, words: pa.Array, tolerance: float, slack: float) -> pa.Array:
    """The text of each cell, of the page's words (y, x0, x1, t), sorted, whose middle is in it."""
    at, flat = la.starts(words), words.flatten()
    wy, wx0, wx1, t = la.numbers(flat.field("y")), la.numbers(flat.field("x0")), la.numbers(flat.field("x1")), flat.field("t")
    heights, rank = np.unique(wy, return_inverse=True)
    place = rank + la.owners(at) * (len(heights) + 1)
    upto = lambda y: np.searchsorted(place, np.searchsorted(heights, y) + page * (len(heights) + 1))
    first = upto(y0 - tolerance)
    cell, w = pairs(first, np.maximum(upto(y1 - tolerance) - first, 0))
    middle = (wx0[w] + wx1[w]) / 2
    inside = (middle >= x0[cell]) & (middle <= x1[cell]) & np.asarray(pc.is_valid(t))[w]
    cell, w = cell[inside], w[inside]
    own = la.offsets(np.bincount(cell, minlength=len(page)))
    lines = la.lines_of_flat(own, wy[w], wx0[w], wx1[w], t.take(pa.array(w)), slack)
    return pc.binary_join(la.listed(own, lines.t.cast(pa.string())), " ")


def tables(drawings: pa.Array, words: pa.Array, tolerance: float, slack: float) -> tuple[np.ndarray, list[pa.Array]]:
    """Per table its page in the batch; and region, x0, x1, y0, y1, columns, head_rows, rows as columns."""
    at, flat = la.starts(drawings), drawings.flatten()
    s = merged(edges(la.owners(at), *(la.numbers(flat.field(c)) for c in ("x0", "x1", "y0", "y1"))), tolerance)
    table, page, x0, x1, y0, y1 = cells(s, len(drawings), tolerance)
    text = texts(page, x0, x1, y0, y1, words, tolerance, slack)
    n = len(table)
    names, table = np.unique(table, return_inverse=True)
    of_page = np.zeros(len(names), np.int64)
    of_page[table] = page
    x, xt, xs = ranks(np.concatenate([table, table]), np.concatenate([x0, x1]))
    y, yt, ys = ranks(np.concatenate([table, table]), np.concatenate([y0, y1]))
    start, span, row = x[:n], x[n:] - x[:n], y[:n]
    x_at, y_at = la.offsets(np.bincount(xt, minlength=len(names))), la.offsets(np.bincount(yt, minlength=len(names)))
    columns = np.diff(x_at) - 1
    # rows with text; tables of two such rows
    shown = np.zeros(len(ys), bool)
    shown[(y_at[table] + row)[np.asarray(pc.not_equal(text, ""), bool)]] = True
    kept = np.bincount(yt[shown], minlength=len(names)) >= 2
    shown &= kept[yt]
    rows = np.flatnonzero(shown)
    places = la.offsets(columns[yt[rows]])
    nth = np.cumsum(shown) - 1
    own = np.flatnonzero(shown[y_at[table] + row])
    held = np.full(places[-1], -1, np.int64)
    held[places[nth[y_at[table[own]] + row[own]]] + start[own]] = own
    none = held < 0
    cell = pa.StructArray.from_arrays([text.take(pa.array(held, mask=none)), pa.array(np.maximum(1, span[held] if n else held).astype(np.int32), mask=none)], fields=list(CELL), mask=pa.array(none))
    ends = [xs[x_at[:-1]], xs[x_at[1:] - 1], ys[y_at[:-1]], ys[y_at[1:] - 1]]
    picked = np.flatnonzero(kept)
    order = picked[np.lexsort((picked, ends[0][picked], ends[2][picked], of_page[picked]))]
    region = np.empty(len(names), np.int64)
    region[order] = np.arange(len(order)) - la.offsets(np.bincount(of_page[order], minlength=len(drawings)))[of_page[order]] + 1
    grid = la.listed(la.offsets(np.bincount(yt[rows], minlength=len(names))[picked]), la.listed(places, cell))
    whole = lambda values: pa.array(values.astype(np.int32))
    return of_page[picked], [whole(region[picked]), *(pa.array(e[picked]) for e in ends), whole(columns[picked]), whole(np.ones(len(picked))), grid]
