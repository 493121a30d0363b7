"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), in time linear in the features.
It is fitted on at most `fit_rows` labelled documents, those with the smallest hashes of their ids; scoring
runs over every whole text in tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, RANK = 15, 8
WORDS = 1 << BITS
#: Each structure statistic and the metadata column n_chars in so many steps, one feature a step.
STEPS = 24
STATISTICS = ("words", "word_length", "capitals", "digits", "marks", "symbols", "lines", "line_length", "distinct", "long_words", "repeated_lines", "n_chars")
FEATURES = WORDS + STEPS * len(STATISTICS)
_MARKS = bytes(set(range(33, 127)) - set(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_CAPITALS, _DIGITS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word) & WORDS - 1
        if len(word) <= 32:
            if len(self) >= 300_000:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values: the distinct hashed words with equal weights of norm 1, and a step of each statistic."""
    raw = (text or "").encode()
    words = raw.split()
    hashed = np.fromiter(set(map(_hashes.__getitem__, set(words))), np.int32)
    n, size = max(1, len(words)), max(1, len(raw) - raw.count(b" ") - raw.count(b"\n"))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = raw.split(b"\n")
    share = lambda x: x**0.5 * (STEPS - 1)
    log = lambda x: 2 * np.log2(1 + x)
    values = (
        log(len(words)),
        2 * size / n,
        share(count(_CAPITALS) / size),
        share(count(_DIGITS) / size),
        share(count(_MARKS) / size),
        share(count(_SYMBOLS) / size),
        log(len(lines)),
        log(len(words) / len(lines)),
        share(len(set(words)) / n),
        share(sum(len(w) > 12 for w in words) / n),
        share(1 - len(set(lines)) / len(lines)),
        -1.0 if n_chars is None else 1 + log(max(0, n_chars)),
    )
    steps = WORDS + STEPS * np.arange(len(values)) + np.clip(np.array(values) + 1, 0, STEPS - 1).astype(np.int64)
    x = np.concatenate([np.full(len(hashed), 1 / max(1, len(hashed)) ** 0.5, np.float32), np.full(len(steps), 0.5, np.float32)])
    return np.concatenate([hashed, steps]).astype(np.int32), x


def machine_score(model: dict, at: np.ndarray, x: np.ndarray) -> float:
    v = model["v"][at] * x[:, None]
    pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
    return float(model["w0"] + model["w"][at] @ x + pairs)


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.1, ridge: float = 1e-5, seed: int = 0) -> dict:
    """AdaGrad on the log loss; either label has half of the weight. Without both labels the model says 1/2 or the one label."""
    rng = np.random.default_rng(seed)
    model = {"w0": 0.0, "w": np.zeros(FEATURES, np.float32), "v": (0.02 * rng.standard_normal((FEATURES, RANK))).astype(np.float32)}
    ones = sum(y for *_, y in samples)
    if not samples or ones in (0, len(samples)):
        return model | {"w0": 0.0 if not samples else 4.0 if ones else -4.0, "v": 0 * model["v"]}
    weight = {1: len(samples) / (2 * ones), 0: len(samples) / (2 * (len(samples) - ones))}
    g0, gw, gv = 1e-6, np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, RANK), 1e-6, np.float32)
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            at, x, y = samples[k]
            v = model["v"][at]
            s = (v * x[:, None]).sum(0)
            z = model["w0"] + float(model["w"][at] @ x) + 0.5 * float((s**2).sum() - ((v * x[:, None]) ** 2).sum())
            d = weight[y] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            dw = d * x + ridge * model["w"][at]
            dv = d * (x[:, None] * s - v * (x**2)[:, None]) + ridge * v
            g0 += d * d
            gw[at] += dw**2
            gv[at] += dv**2
            model["w0"] -= rate * d / g0**0.5
            model["w"][at] -= rate * dw / np.sqrt(gw[at])
            model["v"][at] -= rate * dv / np.sqrt(gv[at])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and label of at most fit_rows documents; ids labelled both ways don't count, of rows with one doc_id the smallest text does."""
    agreed = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_y"), F.max(label).alias("_z")).filter("_y = _z")
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("doc_id", "_y")
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")  # bounded by fit_rows
    rows = rows.groupBy("doc_id", "_y").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "n_chars")).alias("_d")).select("doc_id", "_d.text", "_d.n_chars", "_y")

    def extract(batches):
        for batch in batches:
            out = [(i, *features(t, n), y) for i, t, n, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
            yield pa.RecordBatch.from_pydict({"i": [o[0] for o in out], "at": [o[1] for o in out], "x": [o[2] for o in out], "y": [o[3] for o in out]}, schema=pa.schema([("i", pa.int64()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32())), ("y", pa.int32())]))

    got = rows.select(F.col("doc_id").cast("long"), "text", F.col("n_chars").cast("long"), F.col("_y").cast("int")).mapInArrow(extract, "i long, at array<int>, x array<float>, y int").toArrow()
    ids = np.asarray(got["i"].combine_chunks()) if got.num_rows else np.array([], np.int64)
    order = np.argsort(ids, kind="stable")[:fit_rows]
    return [(got["at"][int(k)].values.to_numpy(), got["x"][int(k)].values.to_numpy(), got["y"][int(k)].as_py()) for k in order]


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = 6000, epochs: int = 6) -> DataFrame:
    """A row for each row of docs (doc_id, text, n_chars): doc_id and score from 0 to 1.

    Labels other than 0 and 1 and null doc_ids teach nothing; null texts count as empty and a null n_chars as a
    value of its own. Without labels every score is 1/2. Neither lang, source nor doc_id is an input.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(training_rows(docs, labels, label, fit_rows), epochs))  # fixed size: FEATURES * (RANK + 1) floats
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            z = [machine_score(model.value, *features(t.as_py(), n.as_py())) for t, n in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))], ["doc_id", "score"])

    return docs.select("doc_id", "text", F.col("n_chars").cast("long")).mapInArrow(score, f"doc_id {kind}, score double")
