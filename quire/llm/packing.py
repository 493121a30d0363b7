"""Best-fit packing by a linear grouping scheme.

Tasks tokenise documents and cut them into pieces. Lengths are whole numbers up to the capacity, so a
histogram of at most `capacity` counts says all that the packing needs, however many pieces there are. On
it, large lengths are put in groups of equal cardinality and rounded up to their group's largest;
configurations of few sizes are chosen by the linear programme of the fewest sequences; actual lengths take the
places of the rounded ones; what whole uses leave over and small lengths go where they fit best. The plan is a short table of runs: so many pieces of one length,
from one rank on, go to as many sequences, from one on, at one offset. Tasks look up each piece's run by its
rank among the pieces of its length; ranks are counted in salted parts of a length, more of them the more
pieces there are. A piece of the whole capacity is a sequence of its own and needs no rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written

#: Parts of a length that are ranked apart: at least so many, and one for each so many pieces.
SALTS, SALT_ROWS = 128, 1 << 22
END = 2
#: Lengths above this share of the capacity are large: they are grouped and come in configurations, found in at most so many steps.
LARGE, STEPS = 0.1, 300


def pieces_of(docs: DataFrame, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a row for each piece of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        from quire.llm.tokens import encoder

        encode = encoder("<u4")
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows, columns = [], ([], [], [], [])
            for k, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for piece, (a, b) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity), strict=True)):
                    rows.append(k)
                    for column, x in zip(columns, (piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def grouped(counts: np.ndarray, large: int, groups: int) -> list[tuple[int, list[list[int]]]]:
    """Large lengths in groups of equal cardinality: (rounded length, [[length, first rank, pieces]...]), largest first."""
    total = int(counts[large:].sum())
    size = max(1, -(-total // groups))
    out, room = {}, 0
    for length in range(len(counts) - 1, large - 1, -1):
        n, rank = int(counts[length]), 0
        while n:
            if not room:
                room, top = size, length
            k = min(n, room)
            out.setdefault(top, []).append([length, rank, k])
            n, rank, room = n - k, rank + k, room - k
    return list(out.items())


def most_worth(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size stands in the configuration of the highest price that fits in capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], prices[order]
    upto = np.searchsorted(s, np.arange(capacity + 1), "right")
    for r in range(int(s[0]), capacity + 1):
        worth = best[r - s[: upto[r]]] + v[: upto[r]]
        k = int(worth.argmax())
        if worth[k] > best[r - 1]:
            best[r], last[r] = worth[k], k
        else:
            best[r] = best[r - 1]
    out, r = np.zeros(len(sizes)), capacity
    while r > 0:
        if last[r] < 0:
            r -= 1
        else:
            out[order[last[r]]] += 1
            r -= int(s[last[r]])
    return out


def fullest(sizes: np.ndarray, have: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size stands in the configuration of the largest size there is and those that fill it best."""
    use = np.zeros(len(sizes))
    use[have[0]] = 1
    room = capacity - int(sizes[have[0]])
    if room >= sizes[have].min():
        # a sum is worth itself; of equal ones that of fewer, larger sizes
        use[have] += most_worth(sizes[have], sizes[have] - 1e-3, room)
    return use


def configurations(sizes: list[int], counts: list[int], capacity: int, steps: int = STEPS) -> list[tuple[list[int], int]]:
    """Configurations (indexes of sizes) and how often each is used.

    The linear programme of the fewest sequences for all counts, by column generation: the prices of the sizes under the
    present configurations say which new one is worth most; it takes the place of the one that runs out first. It ends
    when none is worth more than a sequence, or after `steps`. Whole uses are kept; what is left over, less than
    one use of each of as many configurations as there are sizes, is for best fit.
    """
    if not sizes:
        return []
    s, n = np.array(sizes, np.int64), len(sizes)
    # a start: full sequences one after another, each as often as counts allow, so that it uses up a size
    columns, left = np.diag((capacity // s).astype(float)), np.array(counts, float)
    while left.any():
        use = np.minimum(fullest(s, np.flatnonzero(left), capacity), left)
        fit = np.where(use > 0, left / np.maximum(use, 1), np.inf)
        k = int(fit.argmin())
        left = np.where(fit <= fit[k], 0, left - fit[k] * use)
        columns[:, k] = use
    inverse = np.linalg.inv(columns)
    uses = np.maximum(inverse @ np.array(counts, float), 0)
    for _ in range(steps):
        prices = inverse.sum(0)
        new = most_worth(s, prices, capacity)
        if prices @ new <= 1 + 1e-7:
            break
        change = inverse @ new
        ratio = np.where(change > 1e-9, uses / np.maximum(change, 1e-9), np.inf)
        out = int(ratio.argmin())
        uses = np.maximum(uses - ratio[out] * change, 0)
        uses[out] = ratio[out]
        inverse[out] /= change[out]
        change[out] = 0
        inverse -= np.outer(change, inverse[out])
        columns[:, out] = new
    times, left, found = np.floor(uses + 1e-6).astype(np.int64), np.array(counts, np.int64), []
    for k in np.argsort(-times, kind="stable").tolist():
        use = columns[:, k].astype(np.int64)
        fit = int(min(times[k], (left[use > 0] // use[use > 0]).min()))
        if fit:
            left -= fit * use
            found.append((np.repeat(np.arange(n), use).tolist(), fit))
    return found


def plan(counts: np.ndarray, capacity: int = 1024, groups: int = 1024, small_share: float = LARGE) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, offset) for the histogram of lengths 0 to capacity."""
    runs: list[tuple[int, int, int, int, int]] = []
    large = int(capacity * small_share) + 1
    sets = grouped(counts, large, groups)
    free: dict[int, list[list[int]]] = defaultdict(list)  # room left: [first sequence, sequences]
    queues = [[list(run) for run in reversed(members)] for _, members in sets]
    bins = 0
    for parts, times in configurations([top for top, _ in sets], [sum(m[2] for m in members) for _, members in sets], capacity):
        # pieces of each part for the sequences bins to bins + times, in runs
        slots = []
        for part in parts:
            need, slot = times, []
            while need:
                length, rank, n = run = queues[part][-1]
                k = min(need, n)
                slot.append((length, rank, k))
                run[1], run[2] = rank + k, n - k
                if not run[2]:
                    queues[part].pop()
                need -= k
            slots.append(slot)
        cuts = sorted({0, times, *(int(x) for slot in slots for x in np.cumsum([k for _, _, k in slot]))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            offset = 0
            for slot in slots:
                at = 0
                for length, rank, k in slot:
                    if at <= a < at + k:
                        runs.append((length, rank + a - at, b - a, bins + a, offset))
                        offset += length
                        break
                    at += k
            free[capacity - offset].append([bins + a, b - a])
        bins += times
    rest: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for queue in queues:
        for length, rank, n in queue:
            rest[length].append((rank, n))
    for length in range(1, large):
        if counts[length]:
            rest[length].append((0, int(counts[length])))
    for length, rank, left in sorted(((length, rank, n) for length, parts in rest.items() for rank, n in parts), reverse=True):
        while left:
            room = next((r for r in range(length, capacity + 1) if free.get(r)), None)
            if room is None:
                room, new = capacity, -(-left // (capacity // length))
                free[capacity].append([bins, new])
                bins += new
            first, n = free[room].pop()
            each = room // length
            whole = min(n, left // each)
            if whole:  # so many sequences get each pieces
                for k in range(each):
                    runs.append((length, rank + k * whole, whole, first, capacity - room + k * length))
                free[room - each * length].append([first, whole])
                rank, left = rank + each * whole, left - each * whole
                if n > whole:
                    free[room].append([first + whole, n - whole])
            else:
                for k in range(left):
                    runs.append((length, rank + k, 1, first, capacity - room + k * length))
                free[room - left * length].append([first, 1])
                if n > 1:
                    free[room].append([first + 1, n - 1])
                left = 0
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = 1024, groups: int = 1024) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and an end; only those longer than capacity are cut, their first piece may be shorter.
    A null or empty text is the end alone. Repeated rows are packed as often as they stand; null doc_ids stay
    null. An empty table gives no rows. The driver holds the histogram and the plan, bounded by the capacity.
    """
    pieces = written(pieces_of(docs, capacity).withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32", "start")), "pieces")
    salts = max(SALTS, pieces.count() // SALT_ROWS)
    # whole sequences are numbered down from -1, as they stand in the written table
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}).drop("_h")
    pieces = pieces.filter(F.col("length") < capacity).withColumn("_salt", F.pmod("_h", F.lit(salts)))
    parts = written(pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "parts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").agg(F.sum("_n")).collect():  # at most capacity rows
        counts[length] = n
    runs = plan(counts, capacity, groups)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_h", "doc_id", "piece"))
    ranked = pieces.withColumn("_rank", rank).join(parts.withColumn("_before", before).drop("_n"), ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
    starts = runs[:, 0] << 44 | runs[:, 1]

    def place(batches):
        for batch in batches:
            length, at = (np.asarray(batch.column(k)) for k in (3, 5))
            run = runs[np.searchsorted(starts, length << 44 | at, "right") - 1] if len(length) else runs[:0]
            sequence = run[:, 3] + at - run[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(run[:, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.unionByName(full)
