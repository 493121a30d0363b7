"""Incremental runs: files as a stream, each batch merged into what is there, the batch path's result in the end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import votes
from quire.sources.tables import shared_dir


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_available(source: DataFrame, step, checkpoint: str) -> None:
    """Everything that is there, in batches; step(batch, number) must give the same for the same number."""
    query = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def glossary_by_stream(spark: SparkSession, path: str) -> DataFrame:
    """Each batch writes its candidates, the first rendering of each term in it, under its number, so a batch that runs
    again writes the same; the first of all candidates, ranked, is the glossary."""
    out = _shared(spark)
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern: the path may be a file or a folder
    terms = source.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.get(F.split("text", " "), F.lit(0)).alias("en"), F.col("role").alias("zh"))

    def step(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy("doc_id", F.lower("en")).orderBy("pos", "zh")
        batch.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k").write.mode("overwrite").parquet(f"{out}/candidates/batch={number}")

    run_available(terms, step, f"{out}/checkpoint")
    return votes.glossary(spark.read.parquet(f"{out}/candidates").drop("batch"))
