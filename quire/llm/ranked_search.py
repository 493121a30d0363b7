"""Ranked lexical search by a dual tree: exact top documents of every item.

A score is an inner product of term vectors: an item's coordinates are a term's weight times its occurrences in
the item, a document's are the saturated frequencies of its terms, which need no statistic of a term. Both sides
form hierarchies whose nodes hold the largest coordinate of what lies below, so the product of two nodes bounds
every score between them. A pair of nodes is dropped as a whole once its bound is below the weakest k-th score
known for the node's items; else its children meet.

The upper levels are DataFrames: documents sorted by their heaviest terms form chunks, items form blocks, and
bounds of (block, chunk) come from a join of their maxima by term. Each block first meets the one chunk of its
highest bound, whose k-th scores are floors; then it meets the chunks whose bounds reach the floors. Below, a
task descends two binary trees, over the items of a block and over the documents of a chunk, to single items and
leaves of documents, and scores the leaves that are left, best bounds first, raising the floors as it goes.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import LOWER, UPPER, row_key, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents and entries of a chunk, documents of a leaf; items and entries of a block; blocks that share a copy of a chunk.
DOCS, ENTRIES, LEAF, ITEMS, ITEM_ENTRIES, SHARE = 2048, 1 << 18, 32, 32, 1 << 14, 64
#: Bits of the filter of item terms, and buckets of the terms' weights by hash: both of a fixed size whatever the items.
FILTER_BITS, BUCKETS = 1 << 23, 1 << 18
#: Bytes of a text whose terms are counted at once.
PIECE = 1 << 20
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: str | None) -> Counter[bytes]:
    """The terms of a whole text and how often they occur, A-Z lower-cased."""
    raw, found, at = (text or "").encode().translate(_FOLD), Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """_item, item_id, term, n: the terms of each distinct item."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = items.select("item_id", "text").distinct().select(row_key(F.col("item_id"), F.col("text")).alias("_item"), "item_id", F.regexp_extract_all(lowered, F.lit(f"({TERM})"), F.lit(1)).alias("_t"))
    return rows.select("_item", "item_id", F.explode("_t").alias("term")).groupBy("_item", "item_id", "term").agg(F.count("*").alias("n"))


def _bucket(buckets: int):
    return (F.crc32(F.col("term").cast("binary")) % buckets).cast("int")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, n, terms, counts: every document's length, and those of its terms that the filter of `terms` lets through."""
    spot = _bucket(FILTER_BITS)
    rows = terms.select(F.shiftright(spot, 3).alias("at"), F.expr("shiftleft(1, cast(crc32(cast(term as binary)) % 8 as int))").alias("bit"))
    got = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_BITS / 8 rows at most
    filtered = np.zeros(FILTER_BITS // 8, np.uint8)
    filtered[np.asarray(got["at"].to_numpy(), np.int64)] = got["bits"].to_numpy()
    passes = docs.sparkSession.sparkContext.broadcast(filtered.tobytes())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        bits = passes.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                sizes.append(sum(found.values()))
                kept = []
                for t in found:
                    h = zlib.crc32(t) % FILTER_BITS
                    if bits[h >> 3] >> (h & 7) & 1:
                        kept.append(t)
                terms.append([t.decode() for t in kept])
                counts.append([found[t] for t in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n long, terms array<string>, counts array<long>")


def weighted_items(items: DataFrame, found: DataFrame, documents: int) -> DataFrame:
    """_item, item_id, term, w, q: items' terms that documents hold, with their weights w and coordinates q = n * w."""
    df = found.select(F.explode("terms").alias("term")).join(items.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return items.join(df.select("term", w.alias("w")), "term").select("_item", "item_id", "term", "w", (F.col("n") * F.col("w")).alias("q"))


def _packed(rows: DataFrame, ids: str, most: int, entries: int) -> DataFrame:
    """Consecutive rows (ids, terms, values, sorted) as nodes: node, the ids, sizes, terms and values, and the largest value of each term."""
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches):
        held, size, done = [], 0, 0

        def out():
            nonlocal held, size, done
            node = (TaskContext.get().partitionId() << 32) + done
            done += 1
            table = pa.Table.from_batches(held)
            terms, values = (pc.list_flatten(table[c].combine_chunks()) for c in ("terms", "values"))
            top = pa.table({"t": terms, "v": values}).group_by("t").aggregate([("v", "max")])
            lists = {ids: table["id"].combine_chunks(), "sizes": pc.list_value_length(table["terms"].combine_chunks()).cast(pa.int64()), "terms": terms, "values": values, "top_terms": top["t"].combine_chunks(), "top_values": top["v_max"].combine_chunks()}
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([node]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists.values())], ["node", *lists])

        for batch in batches:
            batch, at = batch.select(["id", "terms", "values"]), 0
            sizes = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
            while at < len(sizes):
                before = sizes[at - 1] if at else 0
                end = min(at + most - sum(map(len, held)), int(np.searchsorted(sizes, before + entries - size, "right")))
                if end <= at and held:
                    yield out()
                    continue
                end = max(end, at + 1)
                held.append(batch.slice(at, end - at))
                size, at = size + int(sizes[end - 1] - before), end
                if sum(map(len, held)) >= most or size >= entries:
                    yield out()
        if held:
            yield out()

    return rows.mapInArrow(pack, f"node long, {ids} array<{kind}>, sizes array<long>, terms array<string>, values array<long>, top_terms array<string>, top_values array<long>")


def item_blocks(weighted: DataFrame) -> DataFrame:
    """Blocks of items that share heavy terms."""
    heaviest = F.max(F.struct("w", "term"))["term"].alias("_key")
    pairs = F.sort_array(F.collect_list(F.struct("term", "q")))
    rows = weighted.groupBy("_item", "item_id").agg(heaviest, pairs.alias("_p"), F.count("*").alias("_size")).select(F.struct("_item", "item_id").alias("id"), F.col("_p.term").alias("terms"), F.col("_p.q").alias("values"), "_key", "_item")
    count, entries = weighted.agg(F.count_distinct("_item"), F.count("*")).first()
    parts = 1 + max(count // (64 * ITEMS), entries // (64 * ITEM_ENTRIES))
    return _packed(rows.repartitionByRange(parts, "_key", "_item").sortWithinPartitions("_key", "_item"), "items", ITEMS, ITEM_ENTRIES)


def document_chunks(found: DataFrame, weighted: DataFrame, documents: int, length: int) -> DataFrame:
    """Chunks of documents that share heavy terms; those without any term of an item are left out, as they score 0."""
    got = weighted.groupBy(_bucket(BUCKETS).alias("at")).agg(F.max("w").alias("w")).toArrow()  # BUCKETS rows at most
    weights = np.zeros(BUCKETS, np.int64)
    weights[np.asarray(got["at"].to_numpy(), np.int64)] = got["w"].to_numpy()
    heavy = found.sparkSession.sparkContext.broadcast(weights)
    kind = found.schema["doc_id"].dataType.simpleString()

    def coordinates(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            terms, tf = batch.column("terms").flatten(), batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            coded = terms.dictionary_encode()
            n = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), sizes)
            m = 75 + (25 * n * documents) // length
            values = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
            hashes = np.fromiter((zlib.crc32(t.encode()) for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            codes = hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.int64)
            weight = values * heavy.value[codes % BUCKETS]
            # the three heaviest terms of each document, by their hashes
            order = np.lexsort((codes, -weight, np.repeat(np.arange(len(sizes)), sizes)))
            starts = np.cumsum(sizes) - sizes
            keys = [np.where(sizes > k, codes[order[np.minimum(starts + k, max(0, len(codes) - 1))]], -1) for k in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("terms"), lists, *map(pa.array, keys)], ["id", "terms", "values", "_k0", "_k1", "_k2"])

    some = found.filter(F.size("terms") > 0).select("doc_id", "n", "terms", "counts")
    rows = some.mapInArrow(coordinates, f"id {kind}, terms array<string>, values array<long>, _k0 long, _k1 long, _k2 long")
    # the id and a hash of the row part documents of equal terms
    keys = ["_k0", "_k1", "_k2", "_h"]
    rows = rows.withColumn("_h", F.xxhash64("id", "values"))
    return _packed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), "docs", DOCS, ENTRIES)


def node_bounds(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """block, chunk, bound: the product of two nodes' maxima, for nodes that share a term."""
    side = lambda d, node, value: d.select(F.col("node").alias(node), F.explode(F.arrays_zip("top_terms", "top_values")).alias("_x")).select(node, F.col("_x.top_terms").alias("term"), F.col("_x.top_values").alias(value))
    pairs = side(chunks, "chunk", "c").join(side(blocks, "block", "b"), "term")
    return pairs.groupBy("block", "chunk").agg(F.sum(F.col("b") * F.col("c")).alias("bound"))


def halves(n: int) -> list[np.ndarray]:
    """The borders of the nodes of a binary tree over n leaves, level by level from the root."""
    levels = [np.array([0, n])]
    while (np.diff(levels[-1]) > 1).any():
        last = levels[-1]
        levels.append(np.unique(np.concatenate([last, (last[:-1] + last[1:]) // 2])))
    return levels


def _node_maxima(rows: np.ndarray, levels: list[np.ndarray]) -> list[np.ndarray]:
    return [np.maximum.reduceat(rows, borders[:-1], axis=0) for borders in levels]


def search_pair(q: np.ndarray, leaf_of: np.ndarray, doc: np.ndarray, col: np.ndarray, value: np.ndarray, n_docs: int, floors: np.ndarray, k: int) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """(score, document) of every document that may be among the k best of an item; counts of leaf pairs scored and in all.

    q: items by terms. Entries (leaf_of, doc, col, value) by document. floors: scores that k documents are known to reach.
    """
    items, cols = q.shape
    leaves = np.zeros((-(-n_docs // LEAF), cols), np.int64)
    np.maximum.at(leaves, (leaf_of, col), value)
    item_levels, leaf_levels = halves(items), halves(len(leaves))
    item_max, leaf_max = _node_maxima(q, item_levels), _node_maxima(leaves, leaf_levels)
    exact = float((item_max[0].astype(float) @ leaf_max[0].T.astype(float)).max()) < 2.0**52
    kind = np.float64 if exact else np.int64  # floats hold every sum as it is while all are below 2^53
    floors = floors.astype(np.int64).copy()
    active = np.ones((1, 1), bool)
    for level in range(max(len(item_levels), len(leaf_levels))):
        a, b = min(level, len(item_levels) - 1), min(level, len(leaf_levels) - 1)
        if level:  # children of the pairs that are left
            up = lambda levels, at, was: np.searchsorted(levels[was], levels[at][:-1], "right") - 1
            active = active[up(item_levels, a, min(level - 1, len(item_levels) - 1))][:, up(leaf_levels, b, min(level - 1, len(leaf_levels) - 1))]
        weakest = np.minimum.reduceat(floors, item_levels[a][:-1])
        rows, columns = np.flatnonzero(active.any(1)), np.flatnonzero(active.any(0))
        bounds = np.zeros(active.shape, np.int64)
        bounds[np.ix_(rows, columns)] = item_max[a][rows].astype(kind) @ leaf_max[b][columns].T.astype(kind)
        active &= bounds >= np.maximum(weakest, 1)[:, None]
        if not active.any():
            return [[] for _ in range(items)], np.array([0, items * len(leaves)])
    scored, best, found = 0, [[] for _ in range(items)], [[] for _ in range(items)]
    starts = np.searchsorted(leaf_of, np.arange(len(leaves) + 1))
    qk = q.astype(kind)
    for leaf in np.argsort(-np.where(active, bounds, 0).max(0), kind="stable").tolist():
        of = np.flatnonzero(active[:, leaf] & (bounds[:, leaf] >= floors))
        if not len(of):
            continue
        scored += len(of)
        at = slice(starts[leaf], starts[leaf + 1])
        vectors = np.zeros((min(LEAF, n_docs - leaf * LEAF), cols), kind)
        vectors[doc[at] - leaf * LEAF, col[at]] = value[at]
        scores = (qk[of] @ vectors.T).astype(np.int64)
        for item, row in zip(of.tolist(), scores, strict=True):
            for j in np.flatnonzero(row >= max(1, floors[item])).tolist():
                found[item].append((int(row[j]), leaf * LEAF + j))
                best[item].append(int(row[j]))
            if len(best[item]) >= k:
                best[item] = sorted(best[item], reverse=True)[:k]
                floors[item] = max(floors[item], best[item][-1])
    return [[f for f in found[i] if f[0] >= floors[i]] for i in range(items)], np.array([scored, items * len(leaves)])


def search(chunks: DataFrame, blocks: DataFrame, visits: DataFrame, shares: int, k: int) -> DataFrame:
    """_item, item_id, doc_id, score: of each visited chunk the k best documents of each item of the block, those below its floor left out."""
    doc_kind, item_kind = chunks.schema["docs"].dataType.elementType.simpleString(), blocks.schema["items"].dataType.elementType["item_id"].dataType.simpleString()
    visits = visits.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)))
    left = chunks.select(F.col("node").alias("chunk"), "docs", "sizes", "terms", "values").join(visits.select("chunk", "share").distinct(), "chunk")
    right = visits.join(blocks.select(F.col("node").alias("block"), "items", "sizes", "terms", "values", "floors"), "block").withColumnsRenamed({"chunk": "of_chunk", "share": "of_share"})

    def descend(chunk: pa.Table, wanted: pa.Table) -> pa.Table:
        get = lambda t, c, k=0: t[c][k].values
        docs = get(chunk, "docs").to_pylist()
        sizes = get(chunk, "sizes").to_numpy()
        coded = get(chunk, "terms").dictionary_encode()
        doc, codes, values = np.repeat(np.arange(len(docs)), sizes), coded.indices.to_numpy(), get(chunk, "values").to_numpy()
        out = []
        for b in range(wanted.num_rows):
            items = get(wanted, "items", b).to_pylist()
            item_codes = get(wanted, "terms", b).dictionary_encode()
            columns = pc.index_in(coded.dictionary, item_codes.dictionary).fill_null(-1).to_numpy()
            col = columns[codes]
            at = np.flatnonzero(col >= 0)
            q = np.zeros((len(items), len(item_codes.dictionary)), np.int64)
            q[np.repeat(np.arange(len(items)), get(wanted, "sizes", b).to_numpy()), item_codes.indices.to_numpy()] = get(wanted, "values", b).to_numpy()
            found, _ = search_pair(q, doc[at] // LEAF, doc[at], col[at], values[at], len(docs), get(wanted, "floors", b).to_numpy(), k)
            for item, rows in zip(items, found, strict=True):
                rows.sort(key=lambda r: (-r[0], docs[r[1]] is None, docs[r[1]] if docs[r[1]] is not None else 0))
                out += [(item["_item"], item["item_id"], docs[j], score) for score, j in rows[:k]]
        schema = pa.schema([("_item", pa.int64()), ("item_id", wanted.schema.field("items").type.value_type.field("item_id").type), ("doc_id", chunk.schema.field("docs").type.value_type), ("score", pa.int64())])
        return pa.Table.from_pydict({f.name: [o[j] for o in out] for j, f in enumerate(schema)}, schema)

    return left.groupBy("chunk", "share").cogroup(right.groupBy("of_chunk", "of_share")).applyInArrow(descend, f"_item long, item_id {item_kind}, doc_id {doc_kind}, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of every item, equal scores by doc_id.

    Null texts have no terms; an item or document without terms takes no part. A null doc_id is a document like
    others and comes last among equal scores; a null item_id is an item. Repeated documents are documents of their
    own; equal rows of items count once, rows of one item_id with different texts are items of their own. Texts
    are read whole, long ones piece by piece. Empty tables give an empty result. Other columns, whatever their
    names, are left alone.
    """
    wanted = written(item_terms(items), "item_terms")
    found = written(term_counts(docs, wanted.select("term").distinct()), "term_counts")
    documents, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weighted = written(weighted_items(wanted, found, documents), "weighted_items")
    blocks = written(item_blocks(weighted), "item_blocks")
    chunks = written(document_chunks(found, weighted, documents, max(1, length)), "document_chunks")
    bounds = written(node_bounds(blocks, chunks), "node_bounds")
    shares = -(-max(1, blocks.count()) // SHARE)

    open_floors = blocks.withColumn("floors", F.transform("items", lambda x: F.lit(1).cast("long")))
    seeds = bounds.groupBy("block").agg(F.max_by("chunk", F.struct("bound", "chunk")).alias("chunk"))
    first = ranked(search(chunks, open_floors, seeds, shares, k), k).filter(F.col("rank") == k).select("_item", F.col("score").alias("floor"))
    places = blocks.select("node", F.posexplode("items").alias("_at", "_x")).select("node", "_at", F.col("_x._item").alias("_item")).join(first, "_item", "left")
    floors = places.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("floor", F.lit(1).cast("long")).alias("floor")))).alias("_f")).select("node", F.col("_f.floor").alias("floors"))
    blocks = written(blocks.join(floors, "node"), "item_floors")
    visits = bounds.join(blocks.select(F.col("node").alias("block"), F.array_min("floors").alias("_least")), "block").filter(F.col("bound") >= F.col("_least")).select("block", "chunk")
    return ranked(search(chunks, blocks, visits, shares, k), k).select("item_id", "rank", "doc_id", "score")
