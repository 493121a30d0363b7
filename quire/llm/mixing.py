"""Mixing sources to target weights by entropy balancing.

Among all rates of documents that give each source its target of tokens, with no rate over the cap, entropy
balancing takes those nearest to one by relative entropy: rate = min(cap, exp(multiplier * size)), one
multiplier for each source's token constraint. The dual is convex; Newton steps solve it, each from sums of
rate * size and rate * size^2 that all tasks gather over the documents, pre-aggregated by size class. So long
documents are thinned out, or repeated, before short ones. Rounding to copies keeps each source near its
target: a fold from the largest size class to the smallest gives each class as many extra copies as its rate
and what larger classes left over ask for, and hashes choose the documents inside a class.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import row_key, words, written

#: Parts of a size class that are ranked apart: at least so many, and one for each so many rows.
BUCKETS, BUCKET_ROWS = 256, 1 << 22


def size_class(size: Column) -> Column:
    """Exact up to 1023; then three and a half digits, so that classes stay few however long texts get."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))) - 9, F.lit(0)))
    return (F.floor(size / step) * step).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size) with target. One task orders the sources, a row each.

    Sources by code point, null last, get the weights in turn and share `share` of all sizes by weight; none gets
    over `most` times its own size, what exceeds that is shared anew. That fixed point is found by filling: in
    order of size per weight, a source is full if an equal share of what is left would overfill it.
    """
    pattern = F.array(*[F.lit(float(x)) for x in weights])
    every = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = sources.withColumn("_w", F.get(pattern, (F.row_number().over(every) - 1) % len(weights)))
    s = s.withColumn("_cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = s.withColumns({
        "_total": share * F.sum("source_size").over(Window.partitionBy()),
        "_full": F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
    })
    s = s.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_rest"))
    s = s.withColumn("_open", F.col("_level") * F.col("_w") < F.col("_cap"))
    level = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(Window.partitionBy())["_level"]
    s = s.withColumn("_at", level)
    s = s.withColumn("target", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_at"))))
    return s.select("source", "source_size", "target")


def exact_sum(x: Column) -> Column:
    """A sum of doubles that does not depend on the order of rows: each is rounded to 2^-20 first."""
    return F.sum(F.round(x * 2.0**20).cast("decimal(38,0)")).cast("double") / 2.0**20


def balanced(classes: DataFrame, goals: DataFrame, most: float = 2.0, near: float = 1e-9, steps: int = 100) -> DataFrame:
    """goals (s, target) with multiplier, unit and residual; classes are (s, class, n, tokens), class standing for size.

    The multiplier goes with class / unit, unit being the size of the document that holds a source's mean token. Newton
    solves log(sum of rate * size) = log(target) for all sources at once, between bounds that each step narrows; a step
    that leaves them, or has no slope, halves them or doubles the multiplier. It ends when all sources are within near of
    their targets. A source whose target is its cap has no finite multiplier: it is infinite. Sources without tokens get 0.
    """
    size = F.col("class").cast("double")
    sums = classes.groupBy("s").agg(F.sum("tokens").alias("all"), exact_sum(F.col("tokens") * size).alias("_squares"))
    full = F.col("target") >= most * F.col("all") * (1 - 1e-12)
    state = goals.join(sums, "s").select(
        "s", "target", F.when(F.col("all") > 0, F.col("_squares") / F.col("all")).otherwise(1.0).alias("unit"),
        F.when((F.col("all") > 0) & full, F.lit(float("inf"))).otherwise(0.0).alias("multiplier"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("residual"))
    state = written(state, "multipliers")
    for _ in range(steps):
        m, tilt = F.col("multiplier"), F.col("multiplier") * size / F.col("unit")
        rate = F.when((size > 0) & (tilt < math.log(most)), F.exp(tilt)).when(size > 0, F.lit(float(most))).otherwise(0.0)
        got = classes.join(state, "s").groupBy("s", "target", "unit", "multiplier", "low", "high").agg(
            exact_sum(F.col("tokens") * rate).alias("got"),
            exact_sum(F.when(tilt < math.log(most), F.col("tokens") * rate * size / F.col("unit")).otherwise(0.0)).alias("slope"))
        got = got.withColumn("residual", F.when(F.col("target") > 0, F.abs(F.col("got") - F.col("target")) / F.col("target")).otherwise(0.0))
        under, done = F.col("got") < F.col("target"), (F.col("residual") <= near) | (m == float("inf"))
        got = got.withColumns({"low": F.when(under & ~done, m).otherwise(F.col("low")), "high": F.when(~under & ~done, m).otherwise(F.col("high"))})
        newton = F.when((F.col("slope") > 0) & (F.col("got") > 0), m + F.log(F.col("target") / F.col("got")) * F.col("got") / F.col("slope"))
        inside = newton.isNotNull() & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        other = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2).when(under, 2 * F.abs(m) + 1).otherwise(-2 * F.abs(m) - 1)
        state = written(got.select("s", "target", "unit", F.when(done, m).when(inside, newton).otherwise(other).alias("multiplier"), "low", "high", "residual", done.alias("done")), "multipliers")
        if state.filter("NOT done").isEmpty():
            break
        state = state.drop("done")
    return state.select("s", "multiplier", "unit", "residual")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each row of docs: doc_id, source, _row, size, source_size, target, rate, copies (0 to most), taken.

    Size counts words; null texts have none. A null source is a source of its own. Empty documents, whose rate is
    exp(0), have one copy, or as many as the cap lets in a source that is at its cap. The same rows give the same copies
    in every run; equal rows (of one doc_id and text) get equal copies, by which a source can miss its target. An empty
    table gives no rows.
    """
    d = docs.select("doc_id", "source", row_key(F.col("doc_id"), F.col("text")).alias("_row"), F.size(words(F.col("text"))).cast("long").alias("size"))
    d = written(d.withColumns({"_class": size_class(F.col("size")), "_h": F.xxhash64(F.lit("mix"), "doc_id", "size")}), "sizes")
    d = d.withColumn("_bucket", F.pmod("_h", F.lit(max(BUCKETS, d.count() // BUCKET_ROWS))))
    cells = written(d.groupBy("source", "_class", "_bucket").agg(F.count("*").alias("_n"), F.sum("size").alias("_size")), "cells")
    goals = targets(cells.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, most)
    goals = written(goals.withColumn("s", F.monotonically_increasing_id()), "targets")
    by_class = cells.groupBy("source", F.col("_class").alias("class")).agg(F.sum("_n").alias("n"), F.sum("_size").alias("tokens"))
    names = goals.select("s", F.col("source").alias("_src"))
    classes = written(by_class.join(names, by_class["source"].eqNullSafe(names["_src"])).select("s", "class", "n", "tokens"), "classes")
    tilts = balanced(classes, goals.select("s", "target"), most)
    tilt = F.col("multiplier") * F.col("class") / F.col("unit")
    rate = F.when(F.col("multiplier") == float("inf"), float(most)).when(F.col("class") == 0, 1.0).otherwise(F.least(F.lit(float(most)), F.exp(tilt)))
    rates = classes.join(tilts, "s").select("s", "class", "n", "tokens", rate.alias("rate"))
    plan = rates.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("class", "n", "tokens", "rate")), asc=False).alias("classes"))  # a source's size classes are bounded
    # what larger classes asked for and did not get, or got too much, goes on to smaller ones
    zero = F.struct(F.lit(0.0).alias("owed"), F.expr("array()").cast("array<struct<class:bigint,n:bigint,rate:double,whole:bigint,extra:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        whole = F.floor(x["rate"] + 1e-9)
        owed = a["owed"] + (x["rate"] - whole) * x["tokens"]
        extra = F.when((x["tokens"] > 0) & (whole + 1 <= most), F.greatest(F.lit(0), F.least(x["n"], F.round(owed * x["n"] / x["tokens"]).cast("long")))).otherwise(0).cast("long")
        return F.struct((owed - extra * x["tokens"] / x["n"]).alias("owed"), F.concat(a["out"], F.array(F.struct(x["class"].alias("class"), x["n"].alias("n"), x["rate"].alias("rate"), whole.alias("whole"), extra.alias("extra")))).alias("out"))

    plan = plan.select("s", F.explode(F.aggregate("classes", zero, step, lambda a: a["out"])).alias("p")).join(goals, "s")
    plan = written(plan.select("source", "source_size", "target", F.col("p.rate").alias("rate"), F.col("p.whole").alias("_whole"), F.col("p.class").alias("_class"), F.col("p.n").alias("_all"), F.col("p.extra").alias("_extra")), "plan")
    # each class's extra copies over its buckets, as evenly as counts allow
    upto = F.sum("_n").over(Window.partitionBy("source", "_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    c = cells.withColumn("_upto", upto)
    p = plan.withColumnsRenamed({"source": "_src", "_class": "_cls"})
    c = c.join(p, c["source"].eqNullSafe(p["_src"]) & (c["_class"] == p["_cls"]))
    share_of = lambda n: F.floor(n * F.col("_extra") / F.col("_all") + 1e-9)
    c = c.select("source", "_class", "_bucket", "source_size", "target", "rate", "_whole", (share_of(F.col("_upto")) - share_of(F.col("_upto") - F.col("_n"))).alias("_take"))
    c = written(c.withColumnsRenamed({"source": "_src", "_class": "_cls", "_bucket": "_bkt"}), "takes")
    rank = F.rank().over(Window.partitionBy("source", "_class", "_bucket").orderBy("_h", "doc_id", "_row"))
    d = d.withColumn("_rank", rank)
    d = d.join(c, d["source"].eqNullSafe(c["_src"]) & (d["_class"] == c["_cls"]) & (d["_bucket"] == c["_bkt"]))
    copies = (F.col("_whole") + (F.col("_rank") <= F.col("_take")).cast("long")).cast("long")
    return d.select("doc_id", "source", "_row", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """docs with each row as often as its copies say, all columns as they are; nulls and empty tables as in mix."""
    m = mix(docs, **parameters).select(F.col("doc_id").alias("_m_id"), F.col("_row").alias("_m_row"), F.col("copies").cast("int").alias("_copies")).filter("_copies > 0").distinct()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    # a merge join: the copies grow with the documents, so they are not broadcast at any size
    d = d.join(m.hint("merge"), d["_doc.doc_id"].eqNullSafe(m["_m_id"]) & (row_key(d["_doc.doc_id"], d["_doc.text"]) == m["_m_row"]))
    d = d.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy"))
    return d.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
