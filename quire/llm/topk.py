"""Exact top-k search by inner product with multi-resolution segment statistics.

For a segment of a vector, its mean and deviation bound what it adds to an inner product: length * (mean *
mean + deviation * deviation). As |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, an upper bound of the product is a lower
bound of the distance. Bounds are taken after a rotation, fitted on a bounded sample, that gathers the
vectors' energy in few axes; segments hold equal shares of it. It moves no product, and results are exact.

Vectors are packed into blocks of near ones. A block's ranges of means and its largest deviations bound all of
its products at once. First each query meets the one block of the highest bound, whose k-th best score is its
floor. Then whole blocks under the floor are skipped, coarse bounds first; a query's vector travels only to
the blocks left. There, bounds of few segments thin out the pairs, then those of more, and what survives is
computed exactly. Blocks and queries meet by block number, and a block that many queries want is held by
several tasks, so no task holds more than some blocks of either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written

#: Segments of a vector, coarse to fine.
LEVELS = (4, 16)
#: Rows of the sample that the rotation and the pivots are fitted on, and the most pivots.
SAMPLE, PIVOTS = 8192, 1024
#: Blocks whose summaries are judged together; blocks of queries that share a copy of a candidate block.
CHUNK, SHARE = 4096, 16
PACKED = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("floors", pa.binary()), ("summary", pa.binary())])
PACKED_SQL = "dim int, block long, ids binary, data binary, floors binary, summary binary"


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v = floor(scale * component); rows with a null id, null or not finite components go."""
    v = vectors.select("vec_id", F.col("embedding").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    v = v.withColumn("v", F.transform("v", lambda x: x.cast("double")))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.filter(F.forall("v", fine)).select("vec_id", F.transform("v", lambda x: F.floor(scale * x)).alias("v"))


class Axes:
    """A rotation, segments of equal energy and pivots for vectors of one length."""

    def __init__(self, sample: np.ndarray, pivots: int, seed: int = 0):
        dim = sample.shape[1]
        x = sample / max(1.0, np.abs(sample).max())
        energy, axes = np.linalg.eigh(x.T @ x)
        self.turn = axes[:, ::-1].copy()
        share = np.cumsum(np.maximum(energy[::-1], 0)) / max(energy.sum(), 1e-300)
        self.cuts = {}
        for level in LEVELS:
            if level < dim:
                inner = np.searchsorted(share, np.arange(1, level) / level) + 1
                self.cuts[level] = np.unique([0, *np.minimum(inner, dim), dim])
        x = sample @ self.turn
        self.pivots = x[np.random.default_rng(seed).permutation(len(x))[:pivots]]
        for _ in range(4 if pivots > 1 else 0):
            near = self.cells(x)
            self.pivots = np.stack([x[near == k].mean(0) if (near == k).any() else p for k, p in enumerate(self.pivots)])
        self.pivots = self.pivots[np.lexsort(self.pivots.T[::-1])]

    def cells(self, turned: np.ndarray) -> np.ndarray:
        """The nearest pivot of each turned vector."""
        return (0.5 * (self.pivots**2).sum(1) - turned @ self.pivots.T).argmin(1)

    def sides(self, turned: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Per vector sqrt(length) * mean and sqrt(length) * deviation of each segment."""
        cuts = self.cuts[level]
        length = np.diff(cuts)
        sums, squares = (np.add.reduceat(x, cuts[:-1], 1) for x in (turned, turned**2))
        return sums / np.sqrt(length), np.sqrt(np.maximum(squares - sums**2 / length, 0))

    def summary(self, turned: np.ndarray) -> np.ndarray:
        """Of a block: for each level and segment the lowest and highest mean and the largest deviation."""
        out = []
        for level in self.cuts:
            mean, dev = self.sides(turned, level)
            out += [mean.min(0), mean.max(0), dev.max(0)]
        return np.concatenate(out) if out else np.zeros(0)

    def block_bounds(self, turned: np.ndarray, summaries: np.ndarray):
        """For each level, coarse first, upper bounds of all products of each vector with each block."""
        at = 0
        for level, cuts in self.cuts.items():
            n = len(cuts) - 1
            low, high, dev = (summaries[:, at + k * n : at + (k + 1) * n] for k in range(3))
            at += 3 * n
            mean, own = self.sides(turned, level)
            yield loose(np.maximum(mean, 0) @ high.T + np.minimum(mean, 0) @ low.T + own @ dev.T, turned)


def loose(bound: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """A bound with room for the rounding of floats."""
    return bound + 1e-9 * (np.abs(bound) + np.abs(turned).max(initial=0) ** 2 * turned.shape[1]) + 1e-6


def fitted(vectors: DataFrame, rows: int, lengths: dict[int, int]) -> dict[int, Axes]:
    """Axes for each length of vector, from the SAMPLE rows of the smallest hashes; a length that has none there gets its first rows' axes."""
    table = vectors.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).select("v").toArrow()
    held: dict[int, list] = {}
    for v in table["v"].to_pylist():
        held.setdefault(len(v), []).append(v)
    return {dim: Axes(np.array(held.get(dim) or [[1.0] * dim]), min(PIVOTS, max(1, len(held.get(dim, ())) // 4), max(1, 2 * n // rows))) for dim, n in lengths.items()}


def _arrays(batch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends of a column of lists."""
    lists = batch.column(column)
    return np.asarray(lists.flatten()), np.cumsum(np.diff(np.asarray(lists.offsets)))


def in_cells(vectors: DataFrame, axes) -> DataFrame:
    """vectors with dim and cell, the pivot they are nearest to."""

    def assign(batches):
        for batch in batches:
            flat, ends = _arrays(batch, 1)
            sizes = np.diff(ends, prepend=0)
            cell = np.zeros(len(ends), np.int32)
            for dim in map(int, np.unique(sizes)):
                at = np.flatnonzero(sizes == dim)
                x = flat[(ends[at] - dim)[:, None] + np.arange(dim)].reshape(len(at), dim)
                cell[at] = axes.value[dim].cells(x @ axes.value[dim].turn)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(cell)], ["vec_id", "v", "dim", "cell"])

    return vectors.mapInArrow(assign, "vec_id long, v array<long>, dim int, cell int")


def packed(vectors: DataFrame, axes, rows: int, n: int) -> DataFrame:
    """Blocks of at most `rows` vectors (vec_id, v, dim, cell, floor) of one length, near ones together: PACKED.

    A block of a quarter of that or more ends with its cell, so that its bounds stay close.
    """

    def pack(batches):
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, []

        def block(dim):
            nonlocal k
            ids, data, floors = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for a in range(0, len(ids), rows):
                order = a + np.argsort(ids[a : a + rows], kind="stable")
                x = data[order]
                width = next(w for w in (2, 4, 8) if w == 8 or np.abs(x.astype(float)).max(initial=0) < 2 ** (8 * w - 1) - 1)
                row = [dim], [part << 24 | k], [ids[order].astype("<i8").tobytes()], [x.astype(f"<i{width}").tobytes()], [floors[order].astype("<f8").tobytes()], [axes.value[dim].summary(x @ axes.value[dim].turn).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, PACKED.types, strict=True)], schema=PACKED)
                k += 1

        now = None
        for batch in batches:
            flat, ends = _arrays(batch, 1)
            ids, dims, floors, cells = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3, 4))
            cuts = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(cells) != 0)) + 1), len(dims)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                dim = int(dims[a])
                size = sum(len(x[0]) for x in held)
                if size and (dim != now[0] or size >= rows or (cells[a] != now[1] and 4 * size >= rows)):
                    yield from block(now[0])
                now = dim, cells[a]
                held.append((ids[a:b], flat[ends[a] - dim : ends[b - 1]].reshape(b - a, dim), floors[a:b]))
        if held:
            yield from block(now[0])

    near = vectors.withColumn("_h", F.xxhash64("vec_id"))
    near = near.repartitionByRange(max(1, -(-n // (4 * rows))), "dim", "cell", "_h").sortWithinPartitions("dim", "cell", "_h")
    return near.select("vec_id", "v", "dim", F.col("floor").cast("double"), "cell").mapInArrow(pack, PACKED_SQL)


def unpacked(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, "<i8")
    return numbers, np.frombuffer(data, f"<i{len(data) // (len(numbers) * dim)}").reshape(-1, dim)


def wanted(queries: DataFrame, chunks: DataFrame, axes, number: dict[int, int], shares: Column, first: bool) -> DataFrame:
    """Which queries go to which block: block, share, ids, data, floors. Either to the block of the highest bound, or to all whose bound reaches the floor.

    chunks are (dim, chunk, held: the block numbers and summaries of up to about CHUNK blocks). A block of queries meets
    each chunk of its length; chunks are copied for each share of the query blocks, so that none is wanted by all.
    """
    chunk_count = F.create_map(*[F.lit(x) for item in number.items() for x in item])
    q = queries.select("dim", "ids", "data", "floors", F.pmod(F.hash("block"), shares).alias("share"), F.explode(F.sequence(F.lit(0), chunk_count[F.col("dim")] - 1)).alias("chunk"))
    c = chunks.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    pairs = q.join(c, ["dim", "chunk", "share"]).select("dim", "share", "ids", "data", "floors", "held")
    schema = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("share", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("floors", pa.binary())])

    def judge(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, share, ids, data, floors, held = (batch.column(k)[i].as_py() for k in range(6))
                a = axes.value[dim]
                ids, q = unpacked(ids, data, dim)
                floors = np.frombuffer(floors, "<f8")
                numbers = np.array([h["block"] for h in held], np.int64)
                summaries = np.array([np.frombuffer(h["summary"]) for h in held])
                alive, bound, turned = np.ones((len(q), len(numbers)), bool), None, q @ a.turn
                cols = np.arange(len(numbers))
                for bound in a.block_bounds(turned, summaries):
                    if not first:
                        alive &= bound >= floors[:, None]
                if first:
                    alive[:] = False
                    alive[np.arange(len(q)), 0 if bound is None else bound.argmax(1)] = True
                cols = np.flatnonzero(alive.any(0))
                for j in cols:
                    at = np.flatnonzero(alive[:, j])
                    row = [dim], [numbers[j]], [share], [ids[at].tobytes()], [q[at].tobytes()], [floors[at].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

    return pairs.mapInArrow(judge, "dim int, block long, share int, ids binary, data binary, floors binary")


def best_of_block(axes: Axes, qids, q, floors, xids, x, k: int, seen: dict | None = None):
    """(query, vec_ids, scores) of the best k of each query in a block, if they reach its floor, ties to the smaller id; ids of x ascend."""
    f, g = q.astype(float), x.astype(float)
    exact = max(1.0, np.abs(f).max()) * max(1.0, np.abs(g).max()) * q.shape[1] < 2**52
    alive = qids[:, None] != xids[None, :]
    total = alive.sum()
    tf, tg = f @ axes.turn, g @ axes.turn
    for level in axes.cuts:
        (qm, qd), (xm, xd) = axes.sides(tf, level), axes.sides(tg, level)
        alive &= loose(qm @ xm.T + qd @ xd.T, np.concatenate([tf, tg])) >= floors[:, None]
        if not alive.any():
            break
    if seen is not None:
        seen["pairs"], seen["alive"] = seen.get("pairs", 0) + int(total), seen.get("alive", 0) + int(alive.sum())
    rows, cols = np.nonzero(alive)
    if not len(rows):
        return
    if not exact:  # whole numbers of any length, held in 64 bits at the end
        scores = np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)))) for i, j in zip(rows, cols, strict=True)], np.int64)
    elif 4 * len(rows) > alive.size:
        scores = (f @ g.T)[rows, cols].astype(np.int64)
    else:
        scores = np.concatenate([np.einsum("ij,ij->i", f[rows[a : a + 65536]], g[cols[a : a + 65536]]) for a in range(0, len(rows), 65536)]).astype(np.int64)
    hit = scores >= floors[rows]
    rows, cols, scores = rows[hit], cols[hit], scores[hit]
    cuts = np.searchsorted(rows, np.arange(len(q) + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        at, s = cols[cuts[i] : cuts[i + 1]], scores[cuts[i] : cuts[i + 1]]
        if len(at) > k:
            limit = np.partition(s, len(s) - k)[len(s) - k]
            at, s = at[s >= limit], s[s >= limit]
        order = np.lexsort((xids[at], -s))[:k]
        yield qids[i], xids[at[order]], s[order]


def answers(visits: DataFrame, blocks: DataFrame, axes, shares: Column, k: int) -> DataFrame:
    """query_id, vec_id, score: each visit's best k in its block. A share's visits follow a copy of the block, in one sorted task."""
    none = F.lit(None).cast("binary")
    b = blocks.select("block", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(0).alias("visit"), "dim", "ids", "data", none.alias("floors"))
    v = visits.select("block", "share", F.lit(1).alias("visit"), "dim", "ids", "data", "floors")
    rows = b.unionByName(v).repartition("block", "share").sortWithinPartitions("block", "share", "visit")

    def search(batches):
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                visit, dim, ids, data, floors = (batch.column(c)[i].as_py() for c in (2, 3, 4, 5, 6))
                if not visit:
                    held = unpacked(ids, data, dim)
                    continue
                found = list(best_of_block(axes.value[dim], *unpacked(ids, data, dim), np.frombuffer(floors, "<f8"), *held, k))
                if found:
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat([q for q, _, _ in found], [len(a) for _, a, _ in found]), "vec_id": np.concatenate([a for _, a, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    return rows.mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, query_rows: int = 1024, rows: int = 2048) -> DataFrame:
    """For each vec_id divisible by `every`: query_id, rank (from 1), vec_id, score of the k best others.

    Only vectors of the query's length are candidates. Vectors null, empty, or with null or not finite components
    take no part. Ties go to the smaller vec_id. Equal rows count once; the rows of a vec_id are never candidates
    for a query of that id. Fewer than k candidates give fewer rows, an empty table none. A score beyond 64 bits is
    held at the largest or smallest of them. The driver holds a sample of SAMPLE rows and a number for each length.
    """
    spark = vectors.sparkSession
    v = written(whole_vectors(vectors, scale).filter("size(v) > 0").distinct(), "vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    counts = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q")).collect()  # a row for each length of vector
    n, q = sum(c["n"] for c in counts), sum(c["q"] for c in counts)
    if not q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    axes = spark.sparkContext.broadcast(fitted(v, rows, {c["dim"]: c["n"] for c in counts}))  # at most PIVOTS + dim rows of a vector's size
    v = written(in_cells(v, axes), "cells")
    blocks = written(packed(v.withColumn("floor", F.lit(None)), axes, rows, n), "blocks")
    number = {c["dim"]: max(1, -(-c["n"] // (rows * CHUNK))) for c in counts}
    chunk_count = F.create_map(*[F.lit(x) for item in number.items() for x in item])
    chunks = blocks.groupBy("dim", F.pmod(F.hash("block"), chunk_count[F.col("dim")]).alias("chunk")).agg(F.collect_list(F.struct("block", "summary")).alias("held"))
    chunks = written(chunks, "chunks")
    shares = F.lit(max(1, -(-q // (query_rows * SHARE))))
    queries = v.filter(is_query)
    firsts = packed(queries.withColumn("floor", F.lit(float("-inf"))), axes, query_rows, q)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = lambda found: found.withColumn("rank", best.cast("int")).filter(F.col("rank") <= k)
    seen = ranked(answers(wanted(firsts, chunks, axes, number, shares, True), blocks, axes, shares, k))
    floors = seen.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    floored = queries.join(floors, queries["vec_id"] == floors["query_id"], "left").select("vec_id", "v", "dim", "cell", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    again = packed(floored, axes, query_rows, q)
    return ranked(answers(wanted(again, chunks, axes, number, shares, False), blocks, axes, shares, k)).select("query_id", "rank", "vec_id", "score")
