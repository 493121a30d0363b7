"""Records of nested fields: one change to every string, unified terms, sets that need work again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import mathtext


def over_strings(x: Column, kind: T.DataType, change: Callable[[Column], Column]) -> Column:
    """x of that type with every string in it changed, however deep in arrays, structs and the values of maps it stands."""
    if isinstance(kind, T.StringType):
        return change(x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda item: over_strings(item, kind.elementType, change))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: over_strings(v, kind.valueType, change))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[over_strings(x[f.name], f.dataType, change).alias(f.name) for f in kind.fields]))
    return x


def strings_of(x: Column, kind: T.DataType) -> Column:
    """All strings of x as one array, in the order of its fields and items."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(x.isNotNull(), F.array(x)).otherwise(none)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(x, lambda item: strings_of(item, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(x), lambda v: strings_of(v, kind.valueType))), none)
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.concat(none, *[strings_of(x[f.name], f.dataType) for f in kind.fields])).otherwise(none)
    return none


def _over_columns(records: DataFrame, columns: list[str], change: Callable[[Column], Column]) -> DataFrame:
    return records.withColumns({c: over_strings(F.col(c), records.schema[c].dataType, change) for c in columns})


def repair_results(records: DataFrame, columns: list[str]) -> DataFrame:
    """Every string of the columns with its lone currency escaped, commands given their arguments and angles in formulas as commands."""
    return _over_columns(records, columns, lambda s: mathtext.repaired(mathtext.balance_dollars(s)))


def repair_sources(records: DataFrame, columns: list[str]) -> DataFrame:
    """Like repair_results for what was extracted: dollars stay as they are."""
    return _over_columns(records, columns, mathtext.repaired)


def unify(records: DataFrame, columns: list[str], plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """records with the replacements (key, zh, best) of their document in every string of the columns, and `replaced`, how many there were.

    A document's replacements are applied one after the other, the longest zh first, equal ones in their order.
    """
    order = lambda a, b: F.when(F.length(a["zh"]) != F.length(b["zh"]), F.length(b["zh"]) - F.length(a["zh"])).when(a["zh"] < b["zh"], -1).when(a["zh"] > b["zh"], 1).otherwise(0)
    plans = plan.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("zh", "best")), order).alias("_plan"))
    r = records.join(plans, key, "left").withColumn("_plan", F.coalesce("_plan", F.array().cast("array<struct<zh:string,best:string>>")))
    step = lambda a, p: F.struct(F.replace(a["t"], p["zh"], p["best"]).alias("t"), (a["n"] + F.when(p["zh"] == "", 0).otherwise((F.length(a["t"]) - F.length(F.replace(a["t"], p["zh"], F.lit("")))) / F.length(p["zh"])).cast("long")).alias("n"))
    fold = lambda s: F.aggregate("_plan", F.struct(s.alias("t"), F.lit(0).cast("long").alias("n")), step)
    found = [F.aggregate(strings_of(F.col(c), records.schema[c].dataType), F.lit(0).cast("long"), lambda a, s: a + fold(s)["n"]) for c in columns]
    r = r.withColumn("replaced", sum(found[1:], found[0]))
    return r.withColumns({c: over_strings(F.col(c), records.schema[c].dataType, lambda s: fold(s)["t"]) for c in columns}).drop("_plan")


def keep_notes(rebuilt: DataFrame, earlier: DataFrame, most: int = 120) -> DataFrame:
    """A rebuilt glossary (doc_id, en, zh), sorted by en, at most `most` a document, with the notes that the earlier one held for a term, whatever its case."""
    notes = earlier.filter(F.trim(F.coalesce("note", F.lit(""))) != "").groupBy("doc_id", F.lower("en").alias("_en")).agg(F.min("note").alias("note"))
    g = rebuilt.withColumn("_en", F.lower("en")).join(notes, ["doc_id", "_en"], "left")
    ranked = g.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("_en", "en", "zh", "note"))), 1, most).alias("_g"))
    return ranked.select("doc_id", F.posexplode("_g").alias("rank", "_t")).select("doc_id", (F.col("rank") + 1).alias("rank"), "_t.en", "_t.zh", "_t.note")


def needs_repair(sources: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, pos, reasons of the results (doc_id, pos, zh) that show an unrepaired formula; sources (doc_id, pos, text) say whether there was a placeholder."""
    j = results.filter(F.trim(F.coalesce("zh", F.lit(""))) != "").join(sources.select("doc_id", "pos", "text"), ["doc_id", "pos"])
    j = j.withColumn("reasons", mathtext.unrepaired(F.col("zh"), F.col("text").contains(mathtext.MISSING)))
    return j.filter(F.size("reasons") > 0).select("doc_id", "pos", "reasons")
