"""Conversation structure repair: the cheapest edits that give each conversation the role order (s?(ua)+)?.

Four states tell what a prefix of the repaired roles ends in: nothing, the system turn, a user or an assistant.
Edits of a row (Delete, Keep, Rerole, with Inserts before it) lead from state to state. An audit, the edits'
initials, fixes the states it runs through, so two audits of the same rows that end in different states differ
before either ends; the order of audits is therefore the order of their first halves wherever those end in
different states.

Hirschberg's scheme builds the least audit of least cost in linear space: four-state cost vectors run forward
over the first half of the rows and backward over the second; of the states where their sum is least, the one
whose first half has the least audit is the crossing (ranks of the four audits travel with the forward costs), and
both halves are solved alike. A stretch of rows acts as one row: a matrix of costs and ranks from state to state.

On Spark, rows are range-partitioned in conversation order, so a conversation of any length lies in runs, one a
partition, each of which gives its matrix. A conversation's runs are crossed by the same scheme, a row a run; then
each run is solved between its two states, and texts meet their edits in segments of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: Classes of role initials and of faults; a row's code is 4 * role + fault.
ROLES, FAULTS = {"s": 0, "u": 1, "a": 2}, ("", "blank", "duplicate", "truncated")
OTHER_ROLE = 3
#: What stands in for inserted turns, by the state they lead to.
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Rows and characters of a segment.
SEGMENT_ROWS, SEGMENT_CHARS = 1024, 1 << 20
#: Costs and ranks from each state to each.
Matrix = tuple[tuple[tuple[int, int], ...], ...]


def inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


@functools.cache
def edits_of(code: int) -> dict[int, dict[int, tuple[int, str]]]:
    """From each state to each that a row of this code can lead to: the least cost and the least edits of that cost."""
    role, fault = code >> 2, FAULTS[code & 3]
    late = TRUNCATED if fault == "truncated" else 0
    out: dict[int, dict[int, tuple[int, str]]] = {}
    for start in range(4):
        found: dict[int, tuple[int, str]] = {}
        state, spent, done = start, 0, ""
        for _ in range(3):  # two inserts lead back to what the next row needs, so more never pay
            options = [(state, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                options.append((inserted(state), REROLE + late, "R"))
                if role == ROLES["s"] and state == START:
                    options.append((SYSTEM, late, "K"))
                if role == (ROLES["a"] if state == USER else ROLES["u"]):
                    options.append((inserted(state), late, "K"))
            for after, cost, letter in options:
                found[after] = min(found.get(after, (NEVER, "")), (spent + cost, done + letter))
            state, spent, done = inserted(state), spent + INSERT, done + "I"
        out[start] = found
    return out


@functools.cache
def row_matrix(code: int) -> Matrix:
    rows = []
    for start in range(4):
        found = edits_of(code)[start]
        order = sorted(found, key=lambda q: found[q][1])
        rows.append(tuple((found[q][0], order.index(q)) if q in found else (NEVER, 0) for q in range(4)))
    return tuple(rows)


#: Cost and edits that end a conversation after its last row.
TAILS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def forward(nodes: Sequence[Matrix], lo: int, hi: int, start: int) -> list[tuple[int, int]]:
    """For each state after nodes[lo:hi] from `start`: the least cost, and the rank of its least audit among the four."""
    now = [(0, 0) if q == start else (NEVER, 0) for q in range(4)]
    for k in range(lo, hi):
        found = [(NEVER, 0, 0)] * 4
        for p, (cost, rank) in enumerate(now):
            if cost < NEVER:
                for q, (more, order) in enumerate(nodes[k][p]):
                    if more < NEVER and (cost + more, rank, order) < found[q]:
                        found[q] = (cost + more, rank, order)
        ranks = {x: k for k, x in enumerate(sorted({f[1:] for f in found if f[0] < NEVER}))}
        now = [(f[0], ranks[f[1:]]) if f[0] < NEVER else (NEVER, 0) for f in found]
    return now


def backward(nodes: Sequence[Matrix], lo: int, hi: int, end: int) -> list[int]:
    """For each state before nodes[lo:hi]: the least cost to `end`."""
    left = [0 if q == end else NEVER for q in range(4)]
    for k in range(hi - 1, lo - 1, -1):
        left = [min(cost + left[q] for q, (cost, _) in enumerate(nodes[k][p])) for p in range(4)]
        left = [min(x, NEVER) for x in left]
    return left


def crossings(nodes: Sequence[Matrix], start: int, end: int) -> list[int]:
    """The states before, between and after the nodes on the audit-least of the cheapest ways from start to end."""
    states = [start] + [end] * len(nodes)
    spans = [(0, len(nodes))]
    while spans:
        lo, hi = spans.pop()
        if hi - lo > 1:
            mid = (lo + hi) // 2
            there, back = forward(nodes, lo, mid, states[lo]), backward(nodes, mid, hi, states[hi])
            states[mid] = min(range(4), key=lambda q: (there[q][0] + back[q], there[q][1]))
            spans += [(lo, mid), (mid, hi)]
    return states


def ending(nodes: Sequence[Matrix]) -> tuple[int, int]:
    """The state after a whole conversation's last node, and the cost of all edits."""
    last = forward(nodes, 0, len(nodes), START)
    end = min(range(4), key=lambda q: (last[q][0] + TAILS[q][0], last[q][1]))
    return end, last[end][0] + TAILS[end][0]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32 of `conv_id:turn`; nulls count as one space, but in conv_id and turn themselves."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("_kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", ROLES["s"]).when(initial == "u", ROLES["u"]).when(initial == "a", ROLES["a"]).otherwise(OTHER_ROLE)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, 1).when(F.col("_again"), 2).when(cut, 3).otherwise(0)
    return (4 * role + fault).cast("int")


def coded_rows(rows: DataFrame) -> DataFrame:
    """Rows with their code; a row is a duplicate if its role and text stand earlier in its conversation."""
    rows = written(rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("_row")), "rows")
    hashes = [F.xxhash64("role", "text").alias("_h1"), F.xxhash64(F.lit(1), "text", "role").alias("_h2")]
    firsts = rows.groupBy("conv_id", *hashes).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "_row"))["_row"].alias("_row"))
    # row numbers are unique, so the join has no hot key
    again = rows.join(firsts.select("_row", F.lit(False).alias("_again")), "_row", "left").withColumn("_again", F.coalesce("_again", F.lit(True)))
    return again.select("conv_id", "turn", "role", "text", _code().alias("code"), "_row")


RUN = "run long, seq int, conv_id {}, codes binary, roles array<string>, texts array<string>, node array<long>, counts array<long>, first_turn long, last_turn long"


def segments(coded: DataFrame) -> DataFrame:
    """Rows in conversation order as segments; the last segment of a run has the run's matrix and counts.

    counts: blank, duplicate, truncated, illegal, distinct turns, the codes of the first and the last row.
    """
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("_tie"), F.asc("_row")]
    kind = coded.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "turn", "role", "text", "code"]

    def pack(batches):
        run = (TaskContext.get().partitionId() << 32) - 1
        conv: object = pack  # no conversation yet
        codes, turns, seq, roles, texts, chars = bytearray(), [], 0, [], [], 0

        def out(last: bool):
            nonlocal seq, chars
            row = {"run": [run], "seq": [seq], "conv_id": [conv], "codes": [bytes(codes[len(codes) - len(roles) :])], "roles": [list(roles)], "texts": [list(texts)], "node": [None], "counts": [None], "first_turn": [None], "last_turn": [None]}
            if last:
                nodes = [row_matrix(c) for c in codes]
                row["node"] = [[x for p in range(4) for pair in forward(nodes, 0, len(nodes), p) for x in pair]]
                illegal = sum((a >> 2, b >> 2) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:], strict=False))
                row["counts"] = [[*(sum(c & 3 == k for c in codes) for k in (1, 2, 3)), illegal, len(turns), codes[0], codes[-1]]]
                row["first_turn"], row["last_turn"] = ([turns[0]], [turns[-1]]) if turns else ([None], [None])
            seq, chars = seq + 1, 0
            roles.clear()
            texts.clear()
            return pa.RecordBatch.from_pydict(row, schema)

        schema = None
        for batch in batches:
            if schema is None:
                fields = [("run", pa.int64()), ("seq", pa.int32()), ("conv_id", batch.schema.field(0).type), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("node", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
                schema = pa.schema(fields)
            for c, turn, role, text, code in zip(*(batch.column(x).to_pylist() for x in columns), strict=True):
                if conv is pack or c != conv or (c is None) != (conv is None):
                    if conv is not pack:
                        yield out(True)
                    run, conv, seq = run + 1, c, 0
                    codes.clear()
                    turns = []
                elif len(roles) >= SEGMENT_ROWS or chars >= SEGMENT_CHARS:
                    yield out(False)
                codes.append(code)
                roles.append(role)
                texts.append(text)
                chars += len(text)
                if turn is not None:
                    if not turns:
                        turns = _Turns(turn)
                    turns.add(turn)
        if conv is not pack:
            yield out(True)

    parts = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = coded.withColumn("_tie", F.md5("text"))  # range borders are sampled by the driver, so no texts among the keys
    return coded.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(columns).mapInArrow(pack, RUN.format(kind))


class _Turns:
    """First and last of ascending turns, and how many differ."""

    def __init__(self, turn: int):
        self.first = self.last = turn
        self.distinct = 1

    def add(self, turn: int) -> None:
        self.distinct += turn != self.last
        self.last = turn

    def __len__(self) -> int:
        return self.distinct

    def __getitem__(self, k: int) -> int:
        return self.last if k else self.first


def _groups(batches, key: str) -> Iterator[tuple[object, list[dict]]]:
    """Runs of rows with equal keys in sorted batches."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row[key] != held[0][key] or (row[key] is None) != (held[0][key] is None)):
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held


def run_borders(parts: DataFrame) -> DataFrame:
    """For each run the states at its borders; the last run of a conversation has the edits after its last row, its cost and its counts."""
    runs = parts.filter("node IS NOT NULL").select("conv_id", "run", "node", "counts", "first_turn", "last_turn")

    def cross(batches):
        for _, held in _groups(batches, "conv_id"):  # a row for each range partition at most
            nodes = [tuple(tuple((n[8 * p + 2 * q], n[8 * p + 2 * q + 1]) for q in range(4)) for p in range(4)) for n in (h["node"] for h in held)]
            end, cost = ending(nodes)
            states = crossings(nodes, START, end)
            counts = [h["counts"] for h in held]
            blank, duplicate, truncated, illegal, turns = (sum(c[k] for c in counts) for k in range(5))
            illegal += sum((a[6] >> 2, b[5] >> 2) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(counts, counts[1:], strict=False))
            dated = [h for h in held if h["first_turn"] is not None]
            turns -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:], strict=False))
            gaps = dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - turns if dated else 0
            last = [None] * (len(held) - 1)
            yield pa.RecordBatch.from_pydict(
                {"run": [h["run"] for h in held], "before": states[:-1], "after": states[1:], "tail": [*last, TAILS[end][1]], "totals": [*last, [gaps, blank, duplicate, truncated, illegal, cost]]},
                pa.schema([("run", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("tail", pa.string()), ("totals", pa.list_(pa.int64()))]),
            )

    sorted_runs = runs.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "run")
    return sorted_runs.mapInArrow(cross, "run long, before int, after int, tail string, totals array<long>")


def segment_edits(parts: DataFrame, borders: DataFrame) -> DataFrame:
    """run, seq, state, edits: the state before each segment, and for each of its rows the edits up to and with it."""
    rows = parts.select("run", "seq", "codes").join(borders.select("run", "before", "after"), "run")

    def solve(batches):
        for _, held in _groups(batches, "run"):  # a byte for each row of a run, which is part of a partition
            codes = b"".join(h["codes"] for h in held)
            states = crossings([row_matrix(c) for c in codes], held[0]["before"], held[0]["after"])
            edits = [edits_of(c)[a][b][1] for c, a, b in zip(codes, states, states[1:], strict=False)]
            at, out = 0, []
            for h in held:
                out.append((h["run"], h["seq"], states[at], edits[at : at + len(h["codes"])]))
                at += len(h["codes"])
            yield pa.RecordBatch.from_pydict({k: [o[j] for o in out] for j, k in enumerate(("run", "seq", "state", "edits"))}, pa.schema([("run", pa.int64()), ("seq", pa.int32()), ("state", pa.int32()), ("edits", pa.list_(pa.string()))]))

    return rows.repartition("run").sortWithinPartitions("run", "seq").mapInArrow(solve, "run long, seq int, state int, edits array<string>")


def repaired_segments(rows: DataFrame) -> DataFrame:
    """Segments in order of (conv_id, run, seq), with state, edits, roles, texts; a conversation's last one with tail and totals."""
    parts = written(segments(coded_rows(rows)), "segments")
    borders = written(run_borders(parts), "borders")
    edits = segment_edits(parts, borders)
    ends = parts.filter("node IS NOT NULL").select("run", "seq").join(borders.filter("totals IS NOT NULL").select("run", "tail", "totals"), "run")
    return parts.select("conv_id", "run", "seq", "roles", "texts").join(edits, ["run", "seq"]).join(ends, ["run", "seq"], "left")


def edited(segment: dict) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of a segment's rows and inserted turns in order; a deleted row has neither role nor text."""
    state = segment["state"]
    rows = [*zip(segment["edits"], segment["roles"], segment["texts"], strict=True), *([(segment["tail"], None, None)] if segment["tail"] else [])]
    for edits, role, text in rows:
        for edit in edits:
            if edit == "D":
                yield edit, None, None
                continue
            system = edit == "K" and state == START and role[:1] == "s"
            state = SYSTEM if system else inserted(state)
            yield edit, role if edit == "K" else NAMES[state], "" if edit == "I" else text


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """conv_id, run, seq, at, edit, role, text: every edit in order of (run, seq, at), for use beyond a digest."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            for segment in batch.to_pylist():
                out = [(segment["conv_id"], segment["run"], segment["seq"], k, *e) for k, e in enumerate(edited(segment))]
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("run", pa.int64()), ("seq", pa.int32()), ("at", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
                yield pa.RecordBatch.from_pydict({f.name: [o[j] for o in out] for j, f in enumerate(schema)}, schema)

    return repaired.select("conv_id", "run", "seq", "state", "edits", "roles", "texts", "tail").mapInArrow(rows, f"conv_id {kind}, run long, seq int, at int, edit string, role string, text string")


def repair_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, totals, audit and the SHA-256 of the repaired `role:text` lines; segments stream by, none but the audit is kept."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def digest(batches):
        conv: object = digest
        audit, sha, lines = [], hashlib.sha256(), 0
        for batch in batches:
            for segment in batch.to_pylist():
                if conv is digest:
                    conv, audit, sha, lines = segment["conv_id"], [], hashlib.sha256(), 0
                for edit, role, text in edited(segment):
                    audit.append(edit)
                    if role is not None:
                        sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                        lines += 1
                if segment["totals"] is not None:
                    schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("totals", pa.list_(pa.int64())), ("audit", pa.string()), ("repaired_sha256", pa.string())])
                    yield pa.RecordBatch.from_pydict({"conv_id": [conv], "totals": [segment["totals"]], "audit": ["".join(audit)], "repaired_sha256": [sha.hexdigest()]}, schema)
                    conv = digest

    columns = ["conv_id", "run", "seq", "state", "edits", "roles", "texts", "tail", "totals"]
    in_order = repaired.select(columns).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "run", "seq")
    return in_order.mapInArrow(digest, f"conv_id {kind}, totals array<long>, audit string, repaired_sha256 string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for every conv_id of `conversations`.

    rows (conv_id, turn, role, text, no null role or text) are repaired in order of turn (null first), role and the
    MD5 of the text. A null conv_id is a conversation like others. One without rows has zeros, an empty audit and the hash of
    the empty string. Rows of any number and texts of any length lie in segments; only the hash of a conversation,
    which needs all of its bytes in order, streams through one task. Repeated rows are duplicates. Other columns,
    whatever their names, are left alone. An empty table gives an empty result.
    """
    got = repair_digests(repaired_segments(rows)).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(got, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = [F.coalesce(F.col("totals")[k], F.lit(0).cast("long")).alias(name) for k, name in enumerate(COUNTS)]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
