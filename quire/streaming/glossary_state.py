"""The glossary as keyed state: a document's first terms, kept from batch to batch and over restarts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST, LONGEST = 80, 40


class FirstTerms(StatefulProcessor):
    """Of each document the first rendering of each term and the first MOST terms, by position and then by term.

    Rows may come in any order: a term's place only ever moves forward, so a term that falls behind MOST others comes
    back only with an earlier place, and the state never needs more than MOST terms.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.terms = handle.getMapState("terms", "term string", "pos long, zh string")

    def handleInputRows(self, key, rows, timerValues):
        kept = {k[0]: (v[0], v[1]) for k, v in self.terms.iterator()} if self.terms.exists() else {}
        before = dict(kept)
        for frame in rows:
            for en, zh, pos in zip(frame["en"], frame["zh"], frame["pos"], strict=True):
                if isinstance(en, str) and isinstance(zh, str) and en.strip() and zh.strip() and len(en) <= LONGEST:
                    kept[en.lower()] = min(kept.get(en.lower(), (pos, zh)), (pos, zh))
        first = dict(sorted(kept.items(), key=lambda t: (t[1][0], t[0]))[:MOST])
        for term in before.keys() - first.keys():
            self.terms.removeKey((term,))
        for term, (pos, zh) in first.items():
            if before.get(term) != (pos, zh):
                self.terms.updateValue((term,), (int(pos), zh))
        yield pd.DataFrame({"doc_id": [key[0]], "terms": [len(first)]})

    def close(self) -> None:
        pass


def run_glossary(terms: DataFrame, checkpoint: str, once: bool = False, sink: str = "noop") -> None:
    """All that the stream of terms (doc_id, en, zh, pos) holds, or one batch of it, into the state under `checkpoint`."""
    spark = terms.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    counts = terms.groupBy("doc_id").transformWithStateInPandas(FirstTerms(), "doc_id long, terms int", "Update", "None")
    writer = counts.writeStream.format(sink).outputMode("update").option("checkpointLocation", checkpoint)
    query = (writer.trigger(once=True) if once else writer.trigger(availableNow=True)).start()
    query.awaitTermination()


def glossary_of_state(spark: SparkSession, checkpoint: str, most: int = MOST) -> DataFrame:
    """doc_id, rank, term, zh as the state holds them, read by the source of state data."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "terms").load()
    rows = state.select(F.col("key.doc_id").alias("doc_id"), F.col("user_map_key.term").alias("term"), F.col("user_map_value.pos").alias("pos"), F.col("user_map_value.zh").alias("zh"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "term"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", "rank", "term", "zh")
