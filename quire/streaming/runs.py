"""Runs of a provider over documents: batches in waves, retries as a frontier, claims, stop and resume.

A run works in waves: a wave holds one batch of each document, so documents are parallel and the batches of one
follow each other, each with the glossary of those before. What a wave got is a table of its own under the run's
token, committed before the next wave begins, so a run that stops anywhere is taken up by asking for what has no
record yet. A document belongs to one run: claims are tables under a token, tokens count up, and of two records of
a paragraph that of the higher token counts, so a run that was given up for dead can't overwrite its successor's.

Retries never recurse inside a task. A round asks all parts of the frontier at once; a part that failed or got no
answer is cut into halves by position, what was left out of an answer is asked one by one, and these are the next
round's frontier.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.mathtext import MISSING, unrepaired
from quire.operators import segment, votes
from quire.operators.provider import Provider
from quire.operators.review import status
from quire.sources.tables import stored

TERMS = "array<struct<en:string,zh:string>>"
ANSWER = f"struct<id:string,zh:string,en:string,terms:{TERMS}>"
RECORDS = f"doc_id long, pos int, id string, zh string, en string, terms {TERMS}, unrepaired boolean"
ITEM = ["doc_id", "part", "pos", "id", "text"]


def batched(items: DataFrame, most: int = 8, most_chars: int = 3500) -> DataFrame:
    """Items (doc_id, pos, id, text) with batch from 1: full at `most`, or where the next would make it too long."""
    g = items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.length("text").alias("n")))).alias("_i"))
    sizes = segment.batches_of(F.transform("_i", lambda x: x["n"]), most, most_chars)
    cuts = g.select("doc_id", F.transform("_i", lambda x: x["pos"]).alias("_p"), F.posexplode(sizes).alias("_k", "_b"))
    before = F.coalesce(F.sum("_b.n").over(Window.partitionBy("doc_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    of = cuts.withColumn("_from", before + 1).select("doc_id", (F.col("_k") + 1).alias("batch"), F.explode(F.slice("_p", F.col("_from"), F.col("_b.n"))).alias("pos"))
    return items.join(of, ["doc_id", "pos"])


def ask(frontier: DataFrame, provider: Provider, strict: bool = False) -> DataFrame:
    """doc_id, part, failed, answers: one call for each part of the frontier (doc_id, part, pos, id, text), whose items are few."""
    parts = frontier.groupBy("doc_id", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "text"))).alias("items"))
    answer = pa.struct([("id", pa.string()), ("zh", pa.string()), ("en", pa.string()), ("terms", pa.list_(pa.struct([("en", pa.string()), ("zh", pa.string())])))])

    def call(batches):
        for batch in batches:
            failed, answers = [], []
            for items in batch.column("items").to_pylist():
                try:
                    got = [{"id": r["id"], "zh": r.get("zh"), "en": r.get("en"), "terms": r.get("terms") or []} for r in provider.translate(items, strict)]
                except Exception:
                    got = None  # any failure of a call is retried in parts
                failed.append(got is None)
                answers.append(got or [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(failed), pa.array(answers, pa.list_(answer))], ["doc_id", "part", "failed", "answers"])

    return parts.mapInArrow(call, f"doc_id long, part string, failed boolean, answers array<{ANSWER}>")


def answered(frontier: DataFrame, replies: DataFrame) -> DataFrame:
    """The frontier's items that got a text, with it; of several answers to an item the first counts."""
    got = replies.select("doc_id", "part", F.posexplode("answers").alias("_k", "_a")).filter(F.trim(F.coalesce("_a.zh", F.lit(""))) != "")
    got = got.groupBy("doc_id", "part", F.col("_a.id").alias("id")).agg(F.min_by("_a", "_k").alias("_a"))
    return frontier.join(got, ["doc_id", "part", "id"]).select(*ITEM, F.col("_a.zh").alias("zh"), F.col("_a.en").alias("en"), F.col("_a.terms").alias("terms"))


def next_frontier(frontier: DataFrame, replies: DataFrame) -> DataFrame:
    """What has to be asked again, with new parts: halves by position where no item of a part of several was answered,
    else each left-out item alone. An item that was asked alone is not asked again."""
    left = frontier.join(answered(frontier, replies).select("doc_id", "part", "id"), ["doc_id", "part", "id"], "left_anti")
    sizes = frontier.groupBy("doc_id", "part").agg(F.count("*").alias("_n"))
    one = Window.partitionBy("doc_id", "part")
    left = left.join(sizes, ["doc_id", "part"]).filter("_n > 1").withColumns({"_left": F.count("*").over(one), "_at": F.row_number().over(one.orderBy("pos", "id"))})
    half = F.when(2 * F.col("_at") <= F.col("_n") - F.col("_n") % 2, "a").otherwise("b")
    part = F.when(F.col("_left") == F.col("_n"), half).otherwise(F.concat(F.lit("p"), F.col("pos").cast("string")))
    return left.select("doc_id", F.concat("part", F.lit("."), part).alias("part"), "pos", "id", "text")


def translated(items: DataFrame, provider: Provider, most: int = 8) -> DataFrame:
    """Items (doc_id, part, pos, id, text) with zh, en, terms, where an answer came: rounds over what is left, halves and singles as often as they can come."""
    found, frontier = None, stored(items.select(*ITEM), "frontier")
    for _ in range(2 + max(1, most - 1).bit_length()):
        if frontier.isEmpty():
            break
        replies = stored(ask(frontier, provider), "replies")
        got = answered(frontier, replies)
        found = got if found is None else found.unionByName(got)
        frontier = stored(next_frontier(frontier, replies), "frontier")
    if found is None:
        return items.select(*ITEM, *[F.lit(None).cast(t).alias(c) for c, t in (("zh", "string"), ("en", "string"), ("terms", TERMS))]).filter("false")
    return found.drop("part")


def reasons(zh, en, text):
    return unrepaired(F.concat(F.coalesce(en, F.lit("")), F.coalesce(zh, F.lit(""))), text.contains(MISSING))


def repaired(found: DataFrame, paragraphs: DataFrame, provider: Provider) -> DataFrame:
    """Records (doc_id, pos, id, text, zh, en, terms) with `unrepaired`: those that cover up a placeholder are asked again,
    strictly and with a neighbour on each side, and marked where that does not help."""
    found = stored(found.withColumn("_bad", F.size(reasons(F.col("zh"), F.col("en"), F.col("text"))) > 0), "answers")
    bad = found.filter("_bad")
    around = bad.select("doc_id", F.col("id").alias("part"), F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("pos"))
    context = around.join(paragraphs.select("doc_id", "pos", "id", "text"), ["doc_id", "pos"])
    again = answered(context, ask(context, provider, strict=True)).filter("id = part")
    good = again.filter(F.size(reasons(F.col("zh"), F.col("en"), F.col("text"))) == 0).select("doc_id", "id", F.struct("zh", "en", "terms").alias("_new"))
    out = found.join(good, ["doc_id", "id"], "left")
    pick = lambda c: F.coalesce(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")), F.col(c)) if c == "zh" else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c))
    return out.select("doc_id", "pos", "id", *[pick(c).alias(c) for c in ("zh", "en", "terms")], (F.col("_bad") & F.col("_new").isNull()).alias("unrepaired"))


class RunStore:
    """Tokens, claims and records of runs under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _create(self, name: str) -> bool:
        """A file that only one caller can make."""
        try:
            self._fs.create(self._fs_path(f"{self.path}/{name}"), False).close()
            return True
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise

    def _names(self, name: str) -> list[str]:
        folder = self._fs_path(f"{self.path}/{name}")
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def token(self) -> int:
        """A number that no run had before."""
        n = 1 + max(map(int, self._names("tokens")), default=0)
        while not self._create(f"tokens/{n}"):
            n += 1
        return n

    def _tables(self, name: str, schema: str) -> DataFrame:
        """The tables that are complete under a name; those of writers that died have no mark of success."""
        folders = [f for f in self._names(name) if "_SUCCESS" in self._names(f"{name}/{f}")]
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, token long, wave int")
        one = lambda f: self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{f}").withColumns({"token": F.lit(int(f.split("-")[0])).cast("long"), "wave": F.lit(int(f.split("-")[1]))})
        out = one(folders[0])
        for f in folders[1:]:
            out = out.unionByName(one(f))
        return out

    def claim(self, documents: DataFrame, token: int, patience: float = 30.0) -> DataFrame:
        """The documents (doc_id) that no open run holds, now held by this one; runs claim one after another."""
        until = time.time() + patience
        while not self._create("lock"):
            if time.time() > until:
                raise TimeoutError(f"another run holds {self.path}/lock")
            time.sleep(0.1)
        try:
            taken = self.held().filter(F.col("token") != token).select("doc_id").distinct()
            documents.select("doc_id").distinct().join(taken, "doc_id", "left_anti").write.mode("overwrite").parquet(f"{self.path}/claims/{token}-0")
        finally:
            self._fs.delete(self._fs_path(f"{self.path}/lock"), False)
        return self.spark.read.schema("doc_id long").parquet(f"{self.path}/claims/{token}-0")

    def held(self) -> DataFrame:
        """doc_id, token of what open runs hold."""
        closed = [int(x) for x in self._names("released")]
        return self._tables("claims", "doc_id long").filter(~F.col("token").isin(closed)).select("doc_id", "token")

    def release(self, token: int) -> None:
        """The run's documents are free; also how a dead run is given up."""
        self._create(f"released/{token}")

    def write(self, records: DataFrame, token: int, wave: int) -> None:
        records.write.mode("overwrite").parquet(f"{self.path}/records/{token}-{wave}")

    def records(self) -> DataFrame:
        """One record for each paragraph: that of the highest token and its last wave."""
        last = Window.partitionBy("doc_id", "id").orderBy(F.desc("token"), F.desc("wave"))
        return self._tables("records", RECORDS).withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def to_do(paragraphs: DataFrame, records: DataFrame, only: DataFrame | None = None, force: bool = False, column: str = "zh") -> DataFrame:
    """Paragraphs without a record or with a blank one; or the wanted ids (doc_id, id); or all."""
    if only is not None:
        return paragraphs.join(only.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi")
    done = records.filter(F.trim(F.coalesce(column, F.lit(""))) != "").select("doc_id", "id")
    return paragraphs if force else paragraphs.join(done, ["doc_id", "id"], "left_anti")


def translate(store: RunStore, paragraphs: DataFrame, provider: Provider, most: int = 8, most_chars: int = 3500, should_stop: Callable[[int], bool] | None = None, only: DataFrame | None = None, force: bool = False) -> int:
    """Run paragraphs (doc_id, pos, id, text) of all documents that are free; the run's token.

    should_stop(waves done) is asked before each wave; what ran stays. A failure or an interrupted job leaves the waves
    before it, and the claim is released either way.
    """
    token = store.token()
    mine = store.claim(paragraphs, token)
    try:
        own = paragraphs.join(mine, "doc_id", "left_semi")
        work = stored(batched(to_do(own, store.records(), only, force), most, most_chars), "work")
        last = work.agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]
        for wave in range(1, last + 1):
            if should_stop and should_stop(wave - 1):
                break
            items = work.filter(F.col("batch") == wave).withColumn("part", F.col("batch").cast("string"))
            store.write(repaired(translated(items, provider, most), own, provider), token, wave)
    finally:
        store.release(token)
    return token


def restore(store: RunStore, paragraphs: DataFrame, provider: Provider, most: int = 8, most_chars: int = 3500, force: bool = False) -> int:
    """Only the source side of the records: en of paragraphs that have none, the paragraph's text where a blank one comes back; zh and terms stay."""
    token = store.token()
    mine = store.claim(paragraphs, token)
    try:
        own, records = paragraphs.join(mine, "doc_id", "left_semi"), store.records()
        work = stored(batched(to_do(own, records, force=force, column="en"), most, most_chars).withColumn("part", F.col("batch").cast("string")), "work")
        got = translated(work, provider, most).select("doc_id", "pos", "id", F.coalesce(F.nullif(F.trim("en"), F.lit("")), F.col("text")).alias("_en"))
        old = records.select("doc_id", "id", "zh", "terms", "unrepaired")
        new = got.join(old, ["doc_id", "id"], "left")
        empty = F.array().cast(TERMS)
        store.write(new.select("doc_id", "pos", "id", F.coalesce("zh", F.lit("")).alias("zh"), F.col("_en").alias("en"), F.coalesce("terms", empty).alias("terms"), F.coalesce("unrepaired", F.lit(False)).alias("unrepaired")), token, 1)
    finally:
        store.release(token)
    return token


def retranslate(store: RunStore, paragraphs: DataFrame, doc_id: int, para_id: str, provider: Provider) -> int:
    """One paragraph again: its record is replaced as a whole."""
    one = paragraphs.filter((F.col("doc_id") == doc_id) & (F.col("id") == para_id))
    return translate(store, one, provider, force=True)


def progress(store: RunStore, paragraphs: DataFrame) -> DataFrame:
    """doc_id, paragraphs, translated, progress, status of every document."""
    done = store.records().filter(F.trim(F.coalesce("zh", F.lit(""))) != "").select("doc_id", "id").withColumn("_done", F.lit(1))
    g = paragraphs.join(done, ["doc_id", "id"], "left").groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count("_done").alias("translated"))
    made = F.col("translated")
    return g.select("doc_id", "paragraphs", "translated", (made / F.col("paragraphs")).alias("progress"), F.when(made == 0, "error").otherwise(status(F.col("paragraphs"), made, F.lit(False))).alias("status"))


def enriched(store: RunStore, notes: Callable[[DataFrame], DataFrame] | None = None, protocols: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """What follows every run, whether or not it had work: protocols, then terms to their majority, then notes of the glossary.

    protocols(records) and notes(glossary) give frames of the same columns, or are left out. The notes explain the
    renderings that the vote left. Records and glossary (doc_id, rank, term, zh, ...).
    """
    records = store.records().select("doc_id", "pos", "id", "zh", "en", "terms", "unrepaired")
    records = protocols(records) if protocols else records
    terms = records.select("doc_id", "pos", F.explode("terms").alias("_t")).select("doc_id", "pos", "_t.en", "_t.zh")
    plan = votes.replacement_plan(votes.variants(terms))
    # longer renderings first, so that one inside another does no harm
    steps = plan.agg(F.array_sort(F.collect_list(F.struct((-F.length("zh")).alias("_n"), "zh", "best"))).alias("_plan"))
    apply = lambda text: F.aggregate("_plan", text, lambda t, p: F.replace(t, p["zh"], p["best"]))
    unified = records.crossJoin(F.broadcast(steps)).select("doc_id", "pos", "id", apply(F.col("zh")).alias("zh"), "en", F.transform("terms", lambda t: F.struct(t["en"].alias("en"), apply(t["zh"]).alias("zh"))).alias("terms"), "unrepaired")  # one row
    glossary = votes.glossary(unified.select("doc_id", "pos", F.explode("terms").alias("_t")).select("doc_id", "pos", "_t.en", "_t.zh"))
    return unified, notes(glossary) if notes else glossary
