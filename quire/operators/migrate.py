"""Incremental work and the move of earlier results to a new segmentation."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import anchor, normal

#: Fixed value: the characters of a seed, of two in the 24 sought.
SEED = 12


def todo(paragraphs: DataFrame, records: DataFrame, key: list[str], done: str, only: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Paragraphs without a record whose `done` column isn't blank, or with force all; of those in `only`, where it is given."""
    wanted = paragraphs if only is None else paragraphs.join(only, key, "left_semi")
    return wanted if force else wanted.join(records.filter(F.trim(F.coalesce(done, F.lit(""))) != ""), key, "left_anti")


def _seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, old, pos, t) by document, the new texts before the old anchors, each in order of pos; to doc_id, old_pos, new_pos, how."""
    doc, found = None, None
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for d, old, pos, t in zip(*(c.to_pylist() for c in batch.columns)):
            if found is None or d != doc:
                doc, found = d, _Texts()
            if not old:
                found.add(pos, t)
                continue
            for column, x in zip(out, (d, pos, *(found.place(t) if d is not None else (None, "orphan")))):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], batch.schema.field(2).type), pa.array(out[2], batch.schema.field(2).type), pa.array(out[3], pa.string())], ["doc_id", "old_pos", "new_pos", "how"])


class _Texts:
    """The new texts of one document, in order, and where anchors are in them."""

    def __init__(self):
        self.pos, self.texts, self.exact, self.prefix, self.held, self.seeds, self.all = [], [], {}, {}, {}, None, None

    def add(self, pos: int, t: str) -> None:
        self.pos.append(pos)
        self.texts.append(t)
        self.exact.setdefault(t[:48], pos)
        self.prefix.setdefault(t[:32], pos)

    def place(self, a: str) -> tuple[int | None, str]:
        if a in self.exact:
            return self.exact[a], "exact"
        if len(a) >= 32 and a[:32] in self.prefix:
            return self.prefix[a[:32]], "prefix"
        if a and a[:24] not in self.held:
            self.held[a[:24]] = self.by_seed(a[:24]) if len(a) >= 24 else self.by_text(a)
        at = self.held.get(a[:24])
        return (None, "orphan") if at is None else (at, "contained")

    def by_seed(self, a: str) -> int | None:
        if self.seeds is None:
            self.seeds = {}
            for i, t in enumerate(self.texts):
                for piece in {t[k : k + SEED] for k in range(0, len(t) - SEED + 1, SEED + 1)}:
                    self.seeds.setdefault(piece, []).append(i)
        lists = [self.seeds[w] for k in range(24 - SEED + 1) if (w := a[k : k + SEED]) in self.seeds]
        return next((self.pos[i] for i in heapq.merge(*lists) if a in self.texts[i]), None)

    def by_text(self, a: str) -> int | None:
        if self.all is None:  # no text holds a line's end
            self.all, self.ends = "\n".join(self.texts), list(accumulate(len(t) + 1 for t in self.texts))
        at = self.all.find(a)
        return None if at < 0 else self.pos[bisect_right(self.ends, at)]


def rematch(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, pos, text) twice to doc_id, old_pos, new_pos, how.

    An old paragraph goes to the first new one of its document with the same anchor of 48, else whose text begins
    with the anchor's first 32, else whose text holds its first 24; else it is an orphan. The last is found by seeds: a text
    that holds 24 characters holds one of its own pieces of 12, cut every 13, inside them; anchors shorter than that are
    looked for in the texts of their document. One shuffle by document brings its texts and anchors together.
    """
    o = old.select("doc_id", F.lit(True).alias("old"), F.col("pos").cast("long").alias("pos"), anchor(F.col("text")).alias("t"))
    n = new.select("doc_id", F.lit(False).alias("old"), F.col("pos").cast("long").alias("pos"), normal(F.col("text")).alias("t")).filter("t <> ''")
    rows = n.unionByName(o.fillna("", "t")).repartition("doc_id").sortWithinPartitions("doc_id", "old", "pos")
    kind = dict(old.dtypes)
    m = rows.mapInArrow(_seek, f"doc_id {kind['doc_id']}, old_pos long, new_pos long, how string")
    return m.select("doc_id", F.col("old_pos").cast(kind["pos"]).alias("old_pos"), F.col("new_pos").cast(dict(new.dtypes)["pos"]).alias("new_pos"), "how")


def _grown(matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, old_pos, new_pos, _grew of the matches: whether the new text is longer than the old one that it begins with.

    Old texts go as lengths and digests, so that only the new texts are shuffled.
    """
    start = F.regexp_replace("text", r"\s+$", "")
    o = old.select("doc_id", F.col("pos").alias("old_pos"), F.length(start).alias("_n"), F.sha2(start, 256).alias("_start"), F.sha2("text", 256).alias("_old"))
    n = new.select("doc_id", F.col("pos").alias("new_pos"), F.col("text").alias("_new"))
    m = matches.filter("new_pos IS NOT NULL").select("doc_id", "old_pos", "new_pos").join(o, ["doc_id", "old_pos"]).join(n, ["doc_id", "new_pos"])
    grew = (F.col("_n") > 0) & (F.sha2(F.col("_new").substr(F.lit(1), F.col("_n")), 256) == F.col("_start")) & (F.sha2("_new", 256) != F.col("_old"))
    return m.select("doc_id", "old_pos", "new_pos", grew.alias("_grew"))


def migrate(records: DataFrame, matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Records (doc_id, pos, zh, en, terms) of old paragraphs at their new places: doc_id, pos, zh, en, terms, merged, moved.

    A record whose paragraph only grew, so that the new text begins with the old one, is stale and left out. Records that
    meet are joined by blanks in old order, their terms (en, zh) kept once for each en, whatever its case. Terms without en go.
    """
    m = _grown(matches, old, new).filter(~F.col("_grew"))
    m = records.withColumnRenamed("pos", "old_pos").join(m.select("doc_id", "old_pos", "new_pos"), ["doc_id", "old_pos"])
    g = m.groupBy("doc_id", F.col("new_pos").alias("pos")).agg(F.sort_array(F.collect_list(F.struct("old_pos", "zh", "en", "terms"))).alias("_r"))
    joined = lambda c: F.array_join(F.filter(F.transform("_r", lambda r: F.trim(F.coalesce(r[c], F.lit("")))), lambda t: t != ""), " ")
    every = F.filter(F.flatten(F.filter(F.transform("_r", lambda r: r["terms"]), lambda t: t.isNotNull())), lambda t: F.coalesce(t["en"], F.lit("")) != "")
    g = g.withColumn("_t", every)
    first = F.filter("_t", lambda t, i: ~F.exists(F.slice("_t", F.lit(1), i), lambda u: F.lower(u["en"]) == F.lower(t["en"])))
    return g.select("doc_id", "pos", joined("zh").alias("zh"), joined("en").alias("en"), first.alias("terms"), F.size("_r").cast("long").alias("merged"), (F.get("_r", F.lit(0))["old_pos"] != F.col("pos")).alias("moved"))


def stale(matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, old_pos, new_pos of the matches whose new text is longer than the old one that it begins with."""
    return _grown(matches, old, new).filter("_grew").select("doc_id", "old_pos", "new_pos")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed upsert of a log: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
