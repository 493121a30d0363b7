"""What the training-data operators share: row keys, written intermediate tables, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII space and the controls 09 to 0D.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def row_key(*columns: Column) -> Column:
    """64 bits of a row's values; a null differs from every value."""
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), c)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset and gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Paths of the intermediate tables that this process wrote and did not remove, in order.
_paths: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later steps read it instead of working it out again, also when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    return len(_paths)


def forget(spark: SparkSession, first: int, keep: int = 0) -> None:
    """Remove the intermediate tables from number `first` on, but for the last `keep`; nothing may read them any more."""
    last = len(_paths) - keep
    for path in _paths[first:last]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _paths[first:last]
