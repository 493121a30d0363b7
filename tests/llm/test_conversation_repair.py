"""Conversation repair against all edits of short conversations, in runs and segments of any size, and its edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from quire.llm import conversation_repair as cr
from quire.llm.conversation_repair import crossings, damaged, edits_of, ending, repair_report, row_matrix

LEGAL = re.compile(r"(s?(ua)+)?")


def all_edits(codes, before=0):
    """Every way to edit rows of these codes with up to `before` inserts at each place: (cost, audit, role initials)."""
    roles = "sua?"
    places = [(5 * k, "I" * k, out) for k in range(before + 1) for out in map("".join, itertools.product("ua", repeat=k))]
    ways = places
    for c in codes:
        fault = c & 3
        late = 5 * (fault == 3)
        own = [(2, "D", "")] + ([(late, "K", roles[c >> 2]), (1 + late, "R", "u"), (1 + late, "R", "a")] if fault not in (1, 2) else [])
        ways = [(x + y + z, a + b + d, o + p + q) for (x, a, o), (y, b, p), (z, d, q) in itertools.product(ways, own, places)]
    return ways


def solved(codes):
    nodes = [row_matrix(c) for c in codes]
    end, cost = ending(nodes)
    states = crossings(nodes, cr.START, end)
    return cost, "".join(edits_of(c)[a][b][1] for c, a, b in zip(codes, states, states[1:], strict=False)) + cr.TAILS[end][1]


@pytest.mark.parametrize("size", [0, 1, 2, 3])
def test_all_edits(size):
    rng = random.Random(size)
    cases = list(itertools.product(range(16), repeat=size))
    for codes in cases if size < 2 else rng.sample(cases, 120 if size == 2 else 25):
        want = min((c, a) for c, a, roles in all_edits(codes, 2 if size < 3 else 1) if LEGAL.fullmatch(roles))
        assert solved(codes) == want


def test_crossings_agree_with_one_pass():
    """The audit of halves of halves is the least of one pass that carries whole audits."""
    rng = random.Random(7)
    for size in (4, 9, 40, 200):
        codes = [rng.randrange(16) for _ in range(size)]
        now = {0: (0, "")}
        for c in codes:
            after = {}
            for p, (cost, audit) in now.items():
                for q, (more, edits) in edits_of(c)[p].items():
                    after[q] = min(after.get(q, (1 << 60, "")), (cost + more, audit + edits))
            now = after
        want = min((cost + cr.TAILS[q][0], audit + cr.TAILS[q][1]) for q, (cost, audit) in now.items())
        assert solved(codes) == want
        # runs as single nodes
        cuts = [0, *sorted(rng.sample(range(1, size), 2)), size]
        rows = [row_matrix(c) for c in codes]
        runs = [tuple(tuple(cr.forward(rows, a, b, p)) for p in range(4)) for a, b in itertools.pairwise(cuts)]
        end, cost = ending(runs)
        borders = crossings(runs, 0, end)
        audit = ""
        for a, b, s, t in zip(cuts, cuts[1:], borders, borders[1:], strict=False):
            states = crossings(rows[a:b], s, t)
            audit += "".join(edits_of(c)[x][y][1] for c, x, y in zip(codes[a:b], states, states[1:], strict=False))
        assert (cost, audit + cr.TAILS[end][1]) == want


def plain(rows):
    """The report by one pass over each conversation."""
    groups, ids = collections.defaultdict(list), {r[0] for r in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            groups[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv in ids:
        held = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes = set(), []
        for _, role, text in held:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = 1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3
            seen.add((role, text))
            codes.append(4 * ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + fault)
        turns = {t for t, *_ in held if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = solved(codes)
        lines, k, state = [], 0, 0
        for letter in audit:
            role, text = (None, "") if letter == "I" else held[k][1:]
            k += letter != "I"
            if letter != "D":
                state = 1 if letter == "K" and not lines and role[:1] == "s" else 3 if state == 2 else 2
                lines.append(f"{role if letter == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held))
        out[conv] = (gaps, *(sum(c & 3 == f for c in codes) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(spark, rows):
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, run int, _kind string, seq int")
    got = repair_report(d, damaged(d)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {g.conv_id: tuple(g)[1:] for g in got}


def conversations(rng, n, longest):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "Why?", "no end", "", " \t", None, f"Text {rng.random()}!"])))
    return rows


def test_report(spark):
    rows = conversations(random.Random(2), 60, 9)
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (100, None, None, None), (101, 5, "user", "same."), (101, 5, "user", "same."), (101, 5, "assistant", "same."), (102, 0, "user", "long " * 60_000)]
    assert report(spark, rows) == plain(rows)


@pytest.mark.parametrize("size", [1, 7])
def test_a_long_conversation_in_runs_and_segments(spark, monkeypatch, size):
    """One conversation holds most rows, over several partitions and segments."""
    monkeypatch.setattr(cr, "SEGMENT_ROWS", size)
    rng = random.Random(size)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Turn {t}.", "again.", f"cut {t}"])) for t in range(900)] + conversations(rng, 20, 4)
    assert report(spark, rows) == plain(rows)


def test_repaired_rows(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "Be kind."), ("user", "Hi."), ("user", "Hello?"), ("assistant", "Yes.")])]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(cr.repaired_rows(cr.repaired_segments(d)).collect(), key=lambda r: (r.run, r.seq, r.at))
    assert [(r.edit, r.role, r.text) for r in got] == [("K", "system", "Be kind."), ("D", None, None), ("K", "user", "Hello?"), ("K", "assistant", "Yes.")]


def test_empty(spark):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_report(d, damaged(d)).count() == 0
