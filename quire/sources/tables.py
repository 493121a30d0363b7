"""Sources and sinks: parquet tables, tolerant JSON, append-only logs, keyed upserts and deletes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QA_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "time", "para_id", "selection", "question")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, which only a local session may leave unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, worked out once however often it is read."""
    path = f"{shared_dir(df.sparkSession)}/quire-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tolerant_json(text: Column, schema: str) -> Column:
    """The parsed struct; null where the text is missing or is no JSON."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def cut_json(reply: Column) -> Column:
    """The JSON text inside a model's reply: a code fence goes, then the outermost braces or else brackets count."""
    bare = F.regexp_replace(reply, r"^\s*```[A-Za-z]*\s*|\s*```\s*$", "")
    braces, brackets = F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(F.trim(bare)), valid(F.nullif(braces, F.lit(""))), valid(F.nullif(brackets, F.lit(""))))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType = QA_SCHEMA) -> DataFrame:
    """Lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone, keys, "left_anti")


def list_documents(meta: DataFrame, owner: str | None = None, unowned: bool = False) -> DataFrame:
    """Newest id first; of one owner, with or without documents that nobody owns."""
    own = F.lit(True) if owner is None else (F.col("owner") == owner) | (F.lit(unowned) & (F.coalesce("owner", F.lit("")) == ""))
    return meta.filter(own).orderBy(F.desc("id"))


def claim(meta: DataFrame, owner: str) -> DataFrame:
    """Documents without an owner get one."""
    return meta.withColumn("owner", F.when(F.coalesce("owner", F.lit("")) == "", F.lit(owner)).otherwise(F.col("owner")))


def layered(defaults: dict[str, str], file: dict[str, str] | None, env: dict[str, str]) -> dict[str, str]:
    """Settings: the environment before the file before the defaults."""
    return defaults | (file or {}) | {k: v for k, v in env.items() if v}
