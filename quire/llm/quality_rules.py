"""Quality rules: robust multivariate outliers by minimum covariance determinants per language and source.

Each document gets counts that need no other document; those with too few words or too much repetition
fail at once. The rest become vectors of seven transformed statistics. For each (lang, source) group a
minimum-covariance-determinant estimate is found by concentration steps: every step is one aggregation
of the vectors by group and by bin of distance, so no group meets in one task, and the share of the
bin on the border of the half kept is weighed. Two starts are concentrated, the one with the lower
determinant stays, then one reweighting step follows. Estimates shrink towards the language's by the size of
the group. A document whose squared Mahalanobis distance
exceeds the cutoff is rejected.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import row_key, words, written

P = 7
X = [f"_x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Sums that make an estimate: the number, the statistics, their products.
SUMS = 1 + P + len(PAIRS)
#: Least standard deviation of each statistic: words, word length, shares of marks, capitals and repeats.
FLOORS = (0.30, 0.08, 0.035, 0.08, 0.12)
#: The same for the shares of symbols and of lines that repeat.
SHARE_FLOORS = (0.035, 0.12)
LEAST = FLOORS + SHARE_FLOORS
#: A clean document of a normal sample lies beyond the cutoff once in so many.
CLEAN_LOST = 1e-4


def _small(df: DataFrame, name: str) -> DataFrame:
    """A table of a row or two for each group, in one file: its size on disk shows that it is small, so joins with it don't deal rows out by group."""
    return written(df.repartition(1), name)


def chi2_cdf(x: float, k: int) -> float:
    """Of k degrees of freedom, by the series of the incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


def consistency(share: float, k: int = P) -> float:
    """What the covariance of the nearest share of a normal sample has to be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def base_statistics(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, lang, source, _row and the counts; null and empty texts count 0."""
    d = docs.select("doc_id", "lang", "source", row_key(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    d = d.withColumns({"_w": words(F.col("_text")), "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    at = lambda i, k: F.get("_w", i + k)
    d = d.withColumn("_g", F.when(F.size("_w") >= 5, F.transform(F.sequence(F.lit(0), F.size("_w") - 5), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4)))).otherwise(F.expr("array()").cast("array<bigint>")))
    d = d.select(
        "doc_id",
        "lang",
        "source",
        "_row",
        "_g",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_text", F.lit(r"[^\p{L}\x20\x09-\x0D]")).cast("long").alias("n_marks"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        (F.size(F.array_distinct("_g")) < F.size("_g")).alias("_repeats"),
    )
    # only where a window repeats: its starts in order, then the words that they cover
    d = d.withColumn("_s", F.when(F.col("_repeats"), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_r", F.when(F.col("_repeats"), F.array_sort(F.transform(F.filter("_s", lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))))
    covered = F.aggregate("_r", F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")), lambda a, r: F.struct(r.alias("last"), (a["n"] + F.least(F.lit(5), r - a["last"])).alias("n")), lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.when(F.col("_repeats"), covered).otherwise(0).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return d.drop("_g", "_s", "_r", "_repeats")


def vector() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    shares = [F.sqrt(F.col("n_marks") / chars), F.sqrt(F.col("n_capitals") / chars), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / lines)]
    return [F.log1p("n_words"), F.log(chars / n), *shares]


def _summed(weight: Column, values: list[Column]) -> Column:
    """The array of the sums of values, weighted; one column, so that plans stay small on the driver."""
    return F.array(*[F.sum(weight * x) for x in values])


def _items(column: str) -> list[Column]:
    return [F.get(column, F.lit(k)) for k in range(SUMS)]


def _cells(vectors: DataFrame, *by: str, weight: Column | None = None) -> DataFrame:
    """_v of each group: its (weighted) number of vectors, their sums and the sums of their products."""
    values = [F.lit(1.0), *[F.col(x) for x in X], *[F.col(X[i]) * F.col(X[j]) for i, j in PAIRS]]
    return vectors.groupBy(*by).agg(_summed(F.lit(1.0) if weight is None else weight, values).alias("_v"))


def _shrunk(sums: DataFrame) -> DataFrame:
    """Sums of each group (_v), of its language (_of_lang) and of all (_of_all)."""
    sums = _small(sums.withColumn("_lang", F.get_json_object("_group", "$[0]")), "sums")
    every = sums.groupBy("_start").agg(_summed(F.lit(1.0), _items("_v")).alias("_of_all"))
    langs = sums.groupBy("_lang", "_start").agg(_summed(F.lit(1.0), _items("_v")).alias("_of_lang")).join(every, "_start")
    return sums.join(langs, ["_lang", "_start"]).select("_group", "_start", "_v", "_of_lang", "_of_all")


def _estimate(sums: DataFrame, factor: float, prior: float) -> DataFrame:
    """From sums to _det and _e, of _roots: a row for each group and start."""
    return _roots(_shrunk(sums), factor, prior)


def _roots(shrunk: DataFrame, factor: float, prior: float) -> DataFrame:
    """Log determinant _det, and _e: means, then the inverse of the Cholesky root of factor * covariance + floors.

    To a row's sums come its language's at the weight of `prior` documents, and to these those of all at the same.
    Roots are folded over the places of an array, so the plan does not grow with the places.
    """
    item = lambda c, k: F.get(c, F.lit(k))
    more = lambda a, b, n: a + prior * b / F.greatest(n, F.lit(1e-9))
    d = shrunk.withColumn("_of_lang", F.zip_with("_of_lang", "_of_all", lambda a, b: more(a, b, item("_of_all", 0))))
    d = d.withColumn("_v", F.zip_with("_v", "_of_lang", lambda a, b: more(a, b, item("_of_lang", 0))))
    d = d.withColumn("_v", F.transform("_v", lambda x: x / F.greatest(item("_v", 0), F.lit(1e-9))))
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(LEAST[i] ** 2 if i == j else 0.0).alias("floor")) for i, j in PAIRS])
    d = d.withColumn("_c", F.transform(places, lambda x, k: F.lit(factor) * (F.get("_v", k + 1 + P) - F.get("_v", x["i"] + 1) * F.get("_v", x["j"] + 1)) + x["floor"]))
    none, row = F.array().cast("array<double>"), lambda i: (i * (i + 1) / 2).cast("int")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def root(done: Column, x: Column) -> Column:
        before = total(F.zip_with(F.slice(done, row(x["i"]) + 1, x["j"]), F.slice(done, row(x["j"]) + 1, x["j"]), lambda a, b: a * b))
        left = F.get("_c", F.size(done)) - before
        return F.concat(done, F.array(F.when(x["i"] == x["j"], F.sqrt(F.greatest(left, F.lit(1e-9)))).otherwise(left / F.get(done, row(x["j"]) + x["j"]))))

    def inverse(done: Column, x: Column) -> Column:
        own = F.get("_l", row(x["i"]) + x["i"])
        above = F.transform(F.sequence(x["j"], x["i"] - 1), lambda t: F.get("_l", row(x["i"]) + t) * F.get(done, row(t) + x["j"]))
        return F.concat(done, F.array(F.when(x["i"] == x["j"], 1 / own).otherwise(-total(above) / own)))

    d = d.withColumn("_l", F.aggregate(places, none, root))
    det = total(F.array(*[F.log(item("_l", i * (i + 3) // 2)) for i in range(P)]))
    return d.select("_group", "_start", det.alias("_det"), F.concat(F.slice("_v", 2, P), F.aggregate(places, none, inverse)).alias("_e"))


def _distances(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """vectors with _start and the squared distance _d2 under the estimate of their group."""
    d = vectors.join(estimates, "_group")
    centred = [F.col(X[i]) - F.get("_e", F.lit(i)) for i in range(P)]
    rows: list[list[Column]] = [[] for _ in range(P)]
    for k, (i, j) in enumerate(PAIRS):
        rows[i].append(F.get("_e", F.lit(P + k)) * centred[j])
    return d.withColumn("_d2", sum((sum(row[1:], row[0]) ** 2 for row in rows), F.lit(0.0)))


def _nearest(distances: DataFrame, share: float) -> DataFrame:
    """Sums over the nearest share of each group and start; the bin on the border counts in part."""
    bins = _cells(distances.withColumn("_bin", F.least(F.floor(16 * F.log2(1 + F.col("_d2"))), F.lit(1023))), "_group", "_start", "_bin").withColumn("_n", F.get("_v", F.lit(0)))
    w = Window.partitionBy("_group", "_start")
    upto = F.sum("_n").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumns({"_all": F.sum("_n").over(w), "_upto": upto})
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_all") * share - (F.col("_upto") - F.col("_n"))) / F.col("_n")))
    return bins.withColumn("_part", part).groupBy("_group", "_start").agg(_summed(F.col("_part"), _items("_v")).alias("_v"))


def _medians(vectors: DataFrame) -> DataFrame:
    """A start for each group from coordinate medians and deviations, by bins of 1/64; correlations 0."""
    long = vectors.select("_group", F.posexplode(F.array(*X)).alias("_k", "_v"))
    bins = long.groupBy("_group", "_k", F.round(F.col("_v") * 64).alias("_b")).agg(F.count("*").cast("double").alias("_n"))
    w = Window.partitionBy("_group", "_k")
    bins = bins.withColumns({"_all": F.sum("_n").over(w), "_upto": F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("_b"))) / 64
    q = bins.groupBy("_group", "_k").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"))
    of = lambda c, i: F.max(F.when(F.col("_k") == i, F.col(c)))
    root = [1 / F.sqrt(of("s", i) ** 2 + LEAST[i] ** 2) if i == j else F.lit(0.0) for i, j in PAIRS]
    return q.groupBy("_group").agg(F.array(*[of("m", i) for i in range(P)], *root).alias("_e")).select("_group", F.lit(1).alias("_start"), F.lit(0.0).alias("_det"), "_e")


def quality_verdicts(docs: DataFrame, share: float = 0.75, steps: int = 3, cutoff: float | None = None, prior: float = 50.0) -> DataFrame:
    """A row for each row of docs (doc_id, text, lang, source; others are ignored): doc_id, lang, source, _row
    (its key, of common.row_key), n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_marks,
    n_capitals, n_repeat_words, base_failed, distance2 and kept. Without a cutoff it is the chi-square quantile of
    1 - CLEAN_LOST.

    Every (lang, source) has an estimate of its own, at any size: to its sums come those of its language as if they were
    `prior` documents, and to the language's those of all alike, so a large group is judged by itself and a small one
    mostly by its language. Null texts count as empty, so base_failed. A null lang or source is a value of its own.
    Repeated rows are judged alike; an empty table gives no rows. A text of any length is one row, and so are the hashes of
    its words.
    """
    cutoff = chi2_quantile(1 - CLEAN_LOST, P) if cutoff is None else cutoff
    stats = written(base_statistics(docs), "statistics")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    group = F.to_json(F.array(name("lang"), name("source")))
    vectors = written(stats.filter(~F.col("base_failed")).select("doc_id", "_row", group.alias("_group"), *[c.alias(x) for c, x in zip(vector(), X, strict=True)]), "vectors")
    plain = _estimate(_cells(vectors, "_group").withColumn("_start", F.lit(0)), 1.0, prior)
    best = _small(plain.unionByName(_medians(vectors)), "start")
    for k in range(steps):
        best = _small(_estimate(_nearest(_distances(vectors, best), share), consistency(share), prior), f"step{k}")
    first = Window.partitionBy("_group").orderBy("_det", "_start")
    best = _small(best.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k"), "best")
    near = (F.col("_d2") <= chi2_quantile(0.975, P)).cast("double")
    final = _small(_estimate(_cells(_distances(vectors, best), "_group", "_start", weight=near), consistency(0.975), prior), "final")
    judged = _distances(vectors, final).groupBy("doc_id", "_row").agg(F.max("_d2").alias("distance2"))
    same = stats["doc_id"].eqNullSafe(judged["doc_id"]) & (stats["_row"] == judged["_row"])
    out = stats.join(judged, same, "left").select(*[stats[c] for c in stats.columns], "distance2")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True)))


def keep_good(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with all their columns."""
    bad = quality_verdicts(docs, **parameters).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), "_row").distinct()
    key = row_key(docs["doc_id"], docs["text"], docs["lang"], docs["source"])
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (key == bad["_row"]), "left_anti")
