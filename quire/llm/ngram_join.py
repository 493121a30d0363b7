"""N-gram Jaccard join by MinHash banding.

Documents are sets of five-word shingles. Bands and rows are chosen for a target recall at the threshold.
Documents with equal sets become one node, so copies never pair up. Nodes that share a band's hash are a
candidate group; of groups with the same members, as near copies share most bands, one is left. A pair counts in
the first band that it shares, at every size of a group. Full sets are compared in pairs of blocks of bounded
numbers and bytes: a large group spreads over many tasks, and no pair is ever a row. Per block come the number of
links of each node and a spanning forest of the links; components of the forests are the classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import row_key, written

WORDS = 5
#: Groups of copies that hold more than one row in so many are broadcast.
MANY = 1000
#: Sets and bytes of sets that a block holds, about.
BLOCK, BLOCK_BYTES = 512, 1 << 24


def banding(threshold: float = 0.8, recall: float = 0.999, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands find a pair at the threshold with the wanted recall, in at most `most` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= 300_000:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of 1 to 4 words the one sequence there is; of none nothing."""
    raw = (text or "").encode().split()
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, raw), np.uint64, n)
    k = min(WORDS, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))
        for i in range(k):
            h = (h ^ w[i : n - k + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
    return np.unique(h)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(salt)) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
        h = h * np.uint64(0x9FB21C651E98DF25)
        return h ^ (h >> np.uint64(28))


class Signer:
    """Band hashes and the digest of a set."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(8)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 32, bands * rows, np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, int, int]:
        low = None
        m = _mix(s, 5)
        for at in range(0, len(s), 4096):
            part = m[at : at + 4096]
            high, base = (part >> np.uint64(32)).astype(np.uint32), part.astype(np.uint32)
            least = ((base[None, :] ^ self.b[:, None]) * self.a[:, None] + (high[None, :] >> np.uint32(3))).min(1)
            low = least if low is None else np.minimum(low, least)
        rows = low.reshape(self.bands, self.rows).astype(np.uint64)
        h = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            h = _mix(h * np.uint64(31) + rows[:, k], 11)
        return h.view(np.int64), int(np.bitwise_xor.reduce(_mix(s, 1)).view(np.int64)), int(np.add.reduce(_mix(s, 2)).view(np.int64))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) of longs to (node, label): label is one for each connected component, and one of its nodes.

    Each round hooks every label to the smallest label next to it, follows the hooks and drops the edges that
    lie inside a label; rounds end when no edge is left.
    """
    left = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels = written(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), name)
    while not left.isEmpty():
        both = left.select(F.col("a").alias("label"), F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("label"), F.col("a").alias("to")))
        hooks = written(both.groupBy("label").agg(F.least(F.col("label"), F.min("to")).alias("to")), name)
        while True:  # follow hooks to their ends: a path halves each time
            ends = hooks.select(F.col("label").alias("to"), F.col("to").alias("next"))
            jumped = written(hooks.join(ends, "to").select("label", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), name)
            hooks = jumped.select("label", "to")
            if jumped.filter("moved").isEmpty():
                break
        labels = written(labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")), name)
        to = lambda c: hooks.select(F.col("label").alias(c), F.col("to").alias(f"_{c}"))  # noqa: E731, B023
        moved = left.join(to("a"), "a").join(to("b"), "b").filter("_a <> _b")
        left = written(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), name)
    return labels


def compare(ids: np.ndarray, sets: list[np.ndarray], weights: np.ndarray, left: np.ndarray, cross: bool, threshold: float, earlier: np.ndarray | None = None):
    """Links among the sets, or only between those of left and the others: (links of each, forest edges).

    Links of sets that share a value in a column of `earlier` are only edges: they are counted elsewhere.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.float64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.zeros((n, n), np.float32)
    wide = often == n
    shared += wide.sum()  # shingles that all hold
    some = (often > 1) & ~wide
    number = np.cumsum(some) - 1
    use = some[column]
    column, owner = number[column[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(256, (1 << 22) // max(1, n))
    for a in range(0, int(some.sum()), width):
        i, j = np.searchsorted(column, [a, a + width])
        m = np.zeros((n, width), np.float32)
        m[owner[i:j], column[i:j] - a] = 1
        shared += m @ m.T
    linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if cross:
        linked &= left[:, None] != left[None, :]
    new = linked
    if earlier is not None and earlier.shape[1]:
        new = linked.copy()
        for column in earlier.T:
            new &= column[:, None] != column[None, :]
    links = new.astype(np.float64) @ weights
    edges, seen = [], np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root], front = True, [root]
        while front:
            i = front.pop()
            for j in np.flatnonzero(linked[i] & ~seen):
                seen[j] = True
                edges.append((ids[i], ids[j]))
                front.append(j)
    return links.astype(np.int64), edges


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, _row, class_id, n_links, n_shingles, keep.

    A link is a Jaccard similarity of at least the threshold; n_links counts the other rows linked to a row,
    class_id is the smallest doc_id of its connected component and keep marks one row of it, that of the smallest
    doc_id. Nulls and texts without words link to nothing, each is alone with its doc_id as class_id; texts of 1
    to 4 words are one shingle. A text of any length is one set, hashed in a task. Null doc_ids come last. Equal rows are copies: all are kept or none, so that the
    caller can drop them by key.
    """
    bands, rows = banding(threshold, recall)
    d = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_row"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        signer = Signer(bands, rows)
        for batch in batches:
            sizes, hashes, ones, twos = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py())
                h, one, two = signer(s) if len(s) else (None, None, None)
                sizes.append(len(s))
                hashes.append(h)
                ones.append(one)
                twos.append(two)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "_row", "n_shingles", "d1", "d2", "bands"])

    signed = written(d.mapInArrow(sign, f"doc_id {kind}, _row long, n_shingles long, d1 long, d2 long, bands array<long>"), "signed")
    first = F.min_by(F.struct("doc_id", "_row"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row")))
    same = signed.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"), first.alias("f"))
    nodes = written(same.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "n", "n_shingles", F.col("f.doc_id").alias("first_id"), F.col("f._row").alias("first_row")), "nodes")
    firsts = nodes.select("node", "first_id", "first_row")
    of_first = signed["doc_id"].eqNullSafe(firsts["first_id"]) & (signed["_row"] == firsts["first_row"])
    hashes = signed.filter("n_shingles > 0").join(firsts, of_first).select("node", F.posexplode("bands").alias("band", "h")).distinct()
    hashes = written(hashes, "bands")
    # a group is what shares a band's hash; of groups with the same members the first band's is compared, as it holds the same pairs
    members_of = hashes.groupBy("h").agg(F.min("band").alias("_band"), F.count("*").alias("_n"), F.min("node").alias("_least"), F.max("node").alias("_most"), F.bit_xor(F.xxhash64("node")).alias("_sign")).filter("_n > 1")
    chosen = members_of.groupBy("_n", "_least", "_most", "_sign").agg(F.min(F.struct("_band", "h"))["h"].alias("h"))
    # _band says how many bands come before: a pair counts in the first band that it shares
    groups = written(hashes.join(chosen.select("h"), "h").select("node", F.col("h").alias("label"), F.col("band").alias("_band")), "compared")
    first_rows = nodes.select("node", "n", "n_shingles", "first_id", "first_row")
    groups = groups.join(first_rows, "node")
    room = groups.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("n_shingles") * 8) / BLOCK_BYTES)).cast("int").alias("_blocks"))
    members = groups.join(room, "label").withColumn("_block", F.pmod(F.hash("node"), F.col("_blocks")))
    members = members.groupBy("node", "n", "first_id", "first_row").agg(F.collect_list(F.struct("label", "_band", "_blocks", "_block")).alias("_groups"))  # at most one a band

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([shingles(t.as_py()).tobytes() for t in batch.column(batch.num_columns - 1)], pa.binary())], [*batch.schema.names[:-1], "s"])

    bands_of = signed.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_key"), "bands")
    kept_bands = members.filter(F.exists("_groups", lambda g: g["_band"] > 0)).join(bands_of, members["first_id"].eqNullSafe(F.col("_id")) & (members["first_row"] == F.col("_key")))
    kept_bands = kept_bands.groupBy("node").agg(F.first("bands").alias("bands"))
    members = members.join(kept_bands, "node", "left")
    here = d.join(members, d["doc_id"].eqNullSafe(members["first_id"]) & (d["_row"] == members["first_row"]))
    here = here.select("node", "n", "bands", "_groups", "text").mapInArrow(sets, "node long, n long, bands array<long>, _groups array<struct<label:long,_band:int,_blocks:int,_block:int>>, s binary")
    spread = here.withColumn("g", F.explode("_groups")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("g._blocks") - 1)))
    spread = spread.select("g.label", F.least("g._block", "_other").alias("x"), F.greatest("g._block", "_other").alias("y"), "g._block", "node", "n", F.slice("bands", F.lit(1), F.col("g._band")).alias("earlier"), "s")
    spread = spread.repartition("label", "x", "y").sortWithinPartitions("label", "x", "y", "node")

    def pairs(batches):
        def work(key, rows_):
            ids, seen = np.array([r[1] for r in rows_], np.int64), {}
            for k, i in enumerate(ids):
                seen.setdefault(int(i), k)  # equal first rows come twice
            at = list(seen.values())
            weights = np.array([rows_[k][2] for k in at], np.float64)
            left = np.array([rows_[k][0] == key[1] for k in at])
            earlier = np.array([rows_[k][3] or [] for k in at], np.int64)
            links, edges = compare(ids[at], [np.frombuffer(rows_[k][4], np.uint64) for k in at], weights, left, key[1] != key[2], threshold, earlier)
            return ids[at], links, edges

        def out(done):
            columns = [(int(i), int(n), None) for ids, links, _ in done for i, n in zip(ids, links, strict=True) if n] + [(int(a), 0, int(b)) for *_, edges in done for a, b in edges]
            return pa.RecordBatch.from_pydict({"a": [c[0] for c in columns], "links": [c[1] for c in columns], "b": [c[2] for c in columns]}, schema=pa.schema([("a", pa.int64()), ("links", pa.int64()), ("b", pa.int64())]))

        key, held = None, []
        for batch in batches:
            done = []
            for label, x, y, block, node, n, earlier, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, x, y) != key:
                    if len(held) > 1:
                        done.append(work(key, held))
                    key, held = (label, x, y), []
                held.append((block, node, n, earlier, s))
            yield out(done)
        if len(held) > 1:
            yield out([work(key, held)])

    found = written(spread.mapInArrow(pairs, "a long, links long, b long"), "links")
    classes = components(found.filter("b IS NOT NULL").select("a", "b"), "classes")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    nodes = nodes.join(classes, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("first_row"))
    heads = nodes.groupBy("label").agg(F.min_by(F.struct("first_id", "first_row"), order).alias("head"))
    nodes = written(nodes.join(heads, "label").select("d1", "d2", "n", "head", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "heads")
    # the largest groups of copies, under MANY of them, meet their rows by broadcast, the others by key; rows without words meet none
    worded = signed.filter("n_shingles > 0").drop("bands")
    total = signed.count()
    few = F.broadcast(nodes.filter(F.col("n") * MANY > total).drop("n"))  # under MANY rows, as each holds more than a MANY-th
    by_few = worded.join(few, ["d1", "d2"], "left")
    rest = by_few.filter("head IS NULL").drop("head", "n_links").join(nodes.filter(F.col("n") * MANY <= total).drop("n"), ["d1", "d2"])
    alone = signed.filter("n_shingles = 0").drop("bands").withColumns({"head": F.struct(F.col("doc_id").alias("first_id"), F.col("_row").alias("first_row")), "n_links": F.lit(0).cast("long")})
    out = by_few.filter("head IS NOT NULL").unionByName(rest).unionByName(alone)
    keep = (F.col("n_shingles") == 0) | (F.col("doc_id").eqNullSafe(F.col("head.first_id")) & (F.col("_row") == F.col("head.first_row")))
    return out.select("doc_id", "_row", F.col("head.first_id").alias("class_id"), F.col("n_links").cast("long"), "n_shingles", keep.alias("keep"))


def keep_one(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """docs with one row of each group: without the rows that near_duplicates doesn't keep, and once where equal rows are kept.

    Of rows that share doc_id and text, any one stays. Rows without a word are no copies and all stay; so does a row with a
    null doc_id that is alone. All columns pass as they are; an empty table gives none.
    """
    found = near_duplicates(docs, threshold, recall)
    keys = found.groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_key")).agg(F.count("*").alias("_times"), F.bool_or("keep").alias("_keep"), F.max("n_shingles").alias("_n"))
    keys = keys.filter("NOT _keep OR (_times > 1 AND _n > 0)").select("_id", "_key", "_keep")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    of_key = lambda k: d["_doc.doc_id"].eqNullSafe(k["_id"]) & (row_key(d["_doc.doc_id"], d["_doc.text"]) == k["_key"])
    again = keys.filter("_keep")
    first = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.lit(0)))
    once = d.join(again, of_key(again)).withColumn("_k", first).filter("_k = 1")
    kept = d.join(keys, of_key(keys), "left_anti").select("_doc").unionByName(once.select("_doc"))
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
