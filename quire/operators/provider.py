"""Calls of a model per batch of paragraphs: a provider contract, retries by halves."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Provider(Protocol):
    def translate(self, items: list[dict], strict: bool = False) -> list[dict]:
        """A record for each item that the model answered, with its id and zh; may raise."""


def translate_batch(items: list[dict], provider: Provider) -> dict:
    """zh by id. A batch that fails or gets no answer is halved; items left out are asked for one by one."""
    if not items:
        return {}
    try:
        got = {r["id"]: r["zh"] for r in provider.translate(items)}
    except Exception:
        if len(items) == 1:
            return {}
        got = {}
    if not got and len(items) > 1:
        half = len(items) // 2
        return translate_batch(items[:half], provider) | translate_batch(items[half:], provider)
    for x in items:
        if x["id"] not in got and len(items) > 1:
            got |= translate_batch([x], provider)
    return got


def run_batches(rows: DataFrame, provider: Provider, most: int = 8) -> DataFrame:
    """rows (id, lang, text) with zh, null where no answer came; a task sends batches of at most `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, found = batch.to_pylist(), {}
            for a in range(0, len(items), most):
                found |= translate_batch(items[a : a + most], provider)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([found.get(x["id"]) for x in items], pa.string())], ["id", "zh"])

    return rows.select("id", "lang", "text").mapInArrow(run, "id long, zh string")
