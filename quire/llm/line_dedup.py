"""Line dedup: the first holder of a line keeps it, later documents lose it.

Lines become 128-bit hashes that are range-partitioned by hash, document and position and sorted so
inside each partition: equal hashes stand together, and a hash of very many lines spreads over several
ranges. A sorted aggregation streams over each range and takes the first row of each hash, with the last
document beside it. What the ranges found meets by hash, a row a range at most, and only hashes of two or
more documents stay. The result holds bitmaps, not texts: per document the lengths of the runs of kept and
dropped lines in turn, beginning with kept ones.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, UPPER, row_key, written


def line_key(line: Column) -> Column:
    return F.translate(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), UPPER, LOWER)


def first_occurrences(lines: DataFrame) -> DataFrame:
    """lines (h1, h2, doc_id, pos) to h1, h2, first (doc_id, pos) and last (doc_id), structs in document order, a row for each hash.

    A null doc_id comes last. first() depends on the order of its rows, so the sort of the ranges stays in the plan, and as
    its value is a struct, the aggregation is one that streams over sorted rows. The range's number is a key, so that one
    task alone finds each first.
    """
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = lines.select("h1", "h2", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pos").alias("at"))
    ranges = d.repartitionByRange(n, "h1", "h2", "at").withColumn("range", F.spark_partition_id()).sortWithinPartitions("h1", "h2", "range", "at")
    of_range = ranges.groupBy("h1", "h2", "range").agg(F.first("at").alias("first"), F.last("at").alias("last"))
    return of_range.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Rows only for documents that lose lines: doc_id, _row (key of doc_id and text), n_dropped, runs.

    A key of at least min_chars code points that two or more doc_ids hold stays only in the smallest. Null
    texts are one empty line. A null doc_id counts as the largest, and as one document; rows with the same
    doc_id are one document too, so they never take lines from each other.
    """
    d = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    d = d.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    lines = written(d.select("doc_id", "_row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    firsts = first_occurrences(lines).filter(~F.col("first.doc_id").eqNullSafe(F.col("last.doc_id")))
    firsts = written(firsts.select("h1", "h2", F.col("first.doc_id").alias("first")), "firsts")
    lost = lines.join(firsts, ["h1", "h2"]).filter(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    gone = lost.groupBy("doc_id", "_row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    # starts of runs of dropped lines, and what follows each
    starts = F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", i - 1) != x - 1))
    ends = F.filter("gone", lambda x, i: F.coalesce(F.get("gone", i + 1) != x + 1, F.lit(True)))
    gone = gone.withColumns({"s": starts, "e": ends})
    runs = F.flatten(F.transform("s", lambda x, i: F.array(x - F.when(i == 0, 0).otherwise(F.get("e", i - 1) + 1), F.get("e", i) - x + 1)))
    return gone.select("doc_id", "_row", F.size("gone").cast("long").alias("n_dropped"), runs.alias("runs"))


def dropped_positions(runs: Column) -> Column:
    """The dropped line numbers of a bitmap's runs."""
    ends = F.transform(runs, lambda _, i: F.aggregate(F.slice(runs, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    return F.flatten(F.transform(F.filter(F.transform(ends, lambda e, i: F.struct(e.alias("e"), i.alias("i"), F.get(runs, i).alias("n"))), lambda x: (x["i"] % 2 == 1) & (x["n"] > 0)), lambda x: F.sequence(x["e"] - x["n"], x["e"] - 1)))


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines that runs keeps: each pair of runs is a slice of kept lines and a gap; the tail stays."""
    total = F.aggregate(runs, F.lit(0), lambda a, x: a + x)
    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<string>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.when(x["keep"] & (x["n"] > 0), F.concat(a["out"], F.slice(lines, a["at"] + 1, x["n"]))).otherwise(a["out"]).alias("out"))
    kept = F.aggregate(F.transform(runs, lambda n, i: F.struct(n.alias("n"), (i % 2 == 0).alias("keep"))), start, step, lambda a: a["out"])
    return F.concat(kept, F.slice(lines, total + 1, F.size(lines)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """A row for each row of docs: doc (a struct of its columns, whatever their names), lines, kept (arrays of lines), n_dropped.

    Rows without a bitmap keep all lines.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    of_row = d["doc.doc_id"].eqNullSafe(bitmaps["doc_id"]) & (row_key(d["doc.doc_id"], d["doc.text"]) == bitmaps["_row"])
    d = d.join(bitmaps, of_row, "left").select("doc", F.split(F.coalesce("doc.text", F.lit("")), "\n").alias("lines"), "runs", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"))
    return d.select("doc", "lines", F.when(F.col("runs").isNull(), F.col("lines")).otherwise(kept_lines(F.col("lines"), F.col("runs"))).alias("kept"), "n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with the kept lines as text and n_chars to match; documents that lose every word go.

    Rows that lose no line stay as they are, with their nulls, and so do all other columns. An empty table gives none.
    """
    d = apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
    d = d.withColumn("new", F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("doc.text")))
    d = d.filter((F.col("n_dropped") == 0) | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(F.col("n_dropped") > 0, F.length("new")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return d.select(*[F.col("new").alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
