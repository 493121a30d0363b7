"""Runs over documents: retries, resume, stop, claims, restore, enrichment, and the glossary as state."""

import os
import pickle

import pytest
from pyspark.sql import functions as F

from quire.operators import votes
from quire.streaming import glossary_state, runs

#: Calls that the provider got, one file a call.
ASKED = "asked"


class Model:
    """A deterministic provider of the tests: notes each call, fails or leaves out what it is told to."""

    def __init__(self, folder, fails=(), drops=(), bad=()):
        self.folder, self.fails, self.drops, self.bad = str(folder), set(fails), set(drops), set(bad)

    def translate(self, items, strict=False):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "wb") as f:
            pickle.dump(([x["id"] for x in items], strict), f)
        ids = [x["id"] for x in items]
        if len(ids) > 1 and self.fails & set(ids):
            raise ValueError("no JSON")
        out = []
        for x in items:
            if x["id"] in self.drops and len(items) > 1:
                continue
            text = x["text"].replace("⟦?⟧", "").strip()
            zh = "$?$" if x["id"] in self.bad and not (strict and "never" not in x["text"]) else f"zh {text}"
            out.append({"id": x["id"], "zh": zh, "en": text.upper(), "terms": [{"en": "Proof", "zh": "Beweis" if x["pos"] % 3 else "Nachweis"}]})
        return out

    def calls(self):
        return [pickle.load(open(f"{self.folder}/{f}", "rb")) for f in os.listdir(self.folder)]


@pytest.fixture
def paragraphs(spark):
    texts = lambda d, p: f"text {d} {p}" + (" ⟦?⟧" if p == 4 else "") + (" never" if (d, p) == (2, 4) else "")
    rows = [(d, p, f"{d}-{p}", texts(d, p)) for d in (1, 2, 3) for p in range(1, 20 if d == 1 else 8)]
    return spark.createDataFrame(rows, "doc_id long, pos int, id string, text string")


def store_of(spark, tmp_path, name="runs"):
    return runs.RunStore(spark, str(tmp_path / name))


def model(tmp_path, name="calls", **k):
    (tmp_path / name).mkdir(exist_ok=True)
    return Model(tmp_path / name, **k)


def test_dropped_and_failed_items_come_back(spark, tmp_path, paragraphs):
    m, store = model(tmp_path, fails={"1-2"}, drops={"2-2", "3-1", "3-2", "3-3", "3-4", "3-5", "3-6", "3-7"}), store_of(spark, tmp_path)
    runs.translate(store, paragraphs, m, most=8)
    got = {r.id: r for r in store.records().collect()}
    assert set(got) == {r.id for r in paragraphs.collect()} and got["2-2"].zh == "zh text 2 2" and not got["1-1"].unrepaired
    asked = [ids for ids, _ in m.calls()]
    assert ["2-2"] in asked and ["1-2"] in asked and ["1-1", "1-2", "1-3", "1-4"] in asked and ["1-1", "1-2"] in asked  # halves, and one by one
    assert {r.status for r in runs.progress(store, paragraphs).collect()} == {"ready"}


def test_strict_retry_with_neighbours(spark, tmp_path, paragraphs):
    m, store = model(tmp_path, bad={"1-4", "2-4"}), store_of(spark, tmp_path)
    runs.translate(store, paragraphs, m)
    got = {r.id: r for r in store.records().collect()}
    assert not got["1-4"].unrepaired and got["1-4"].zh.startswith("zh text") and got["2-4"].unrepaired and got["2-4"].zh == "$?$"
    assert sorted(ids for ids, strict in m.calls() if strict) == [["1-3", "1-4", "1-5"], ["2-3", "2-4", "2-5"]]


def test_stop_and_resume(spark, tmp_path, paragraphs):
    m, store = model(tmp_path), store_of(spark, tmp_path)
    runs.translate(store, paragraphs, m, most=3, should_stop=lambda done: done >= 2)
    state = {r.doc_id: (r.translated, r.status) for r in runs.progress(store, paragraphs).collect()}
    assert state == {1: (6, "partial"), 2: (6, "partial"), 3: (6, "partial")}
    done, n = {r.id for r in store.records().collect()}, len(m.calls())
    runs.translate(store, paragraphs, m, most=3)
    later = [i for ids, _ in m.calls() for i in ids]
    assert len(later) == paragraphs.count() and {r.status for r in runs.progress(store, paragraphs).collect()} == {"ready"} and len(done) == 18
    assert len(m.calls()) - n <= -(-(paragraphs.count() - 18) // 3) + 3
    runs.translate(store, paragraphs, m, most=3)  # nothing left to do
    assert len([i for ids, _ in m.calls() for i in ids]) == paragraphs.count()


def test_a_lost_wave_is_asked_again(spark, tmp_path, paragraphs):
    """A run that dies inside a wave leaves the waves before it and no claim."""
    m, store = model(tmp_path), store_of(spark, tmp_path)

    def dies(done):
        if done == 1:
            os.makedirs(f"{store.path}/records/1-2")  # what a writer left that never committed
            raise RuntimeError("interrupted")

    with pytest.raises(RuntimeError):
        runs.translate(store, paragraphs, m, most=3, should_stop=dies)
    assert store.records().count() == 9 and store.held().count() == 0
    runs.translate(store, paragraphs, m, most=3)
    assert store.records().count() == paragraphs.count()


def test_one_run_a_document(spark, tmp_path, paragraphs):
    m, store = model(tmp_path), store_of(spark, tmp_path)
    first = store.token()
    store.claim(paragraphs.filter("doc_id < 3"), first)
    runs.translate(store, paragraphs, m)
    assert {r.doc_id for r in store.records().select("doc_id").distinct().collect()} == {3}
    store.release(first)  # given up for dead
    later = runs.translate(store, paragraphs, m)
    assert later > first and store.records().count() == paragraphs.count()
    late = paragraphs.filter("doc_id = 1").select("doc_id", "pos", "id", F.lit("late").alias("zh"), F.lit("").alias("en"), F.array().cast(runs.TERMS).alias("terms"), F.lit(False).alias("unrepaired"))
    store.write(late, first, 1)
    assert store.records().filter("zh = 'late'").count() == 0


def test_restore_keeps_translations(spark, tmp_path, paragraphs):
    m, store = model(tmp_path), store_of(spark, tmp_path)
    runs.translate(store, paragraphs.filter("doc_id = 2"), m)
    before = {r.id: r.zh for r in store.records().collect()}
    runs.restore(store, paragraphs, m)
    after = {r.id: r for r in store.records().collect()}
    assert {i: after[i].zh for i in before} == before and after["1-1"].en == "TEXT 1 1" and after["1-1"].zh == ""
    n = len(m.calls())
    runs.restore(store, paragraphs, m)
    assert len(m.calls()) == n
    runs.retranslate(store, paragraphs, 1, "1-1", m)
    assert {r.id: r.zh for r in store.records().collect()}["1-1"] == "zh text 1 1"


def test_enrichment_follows(spark, tmp_path, paragraphs):
    m, store = model(tmp_path), store_of(spark, tmp_path)
    runs.translate(store, paragraphs, m)
    order = []
    records, glossary = runs.enriched(store, notes=lambda g: order.append("notes") or g.withColumn("note", F.lit("n")), protocols=lambda r: order.append("protocols") or r)
    assert order == ["protocols", "notes"] and {t.zh for r in records.collect() for t in r.terms} == {"Beweis"}
    assert {(g.term, g.zh, g.note) for g in glossary.collect()} == {("proof", "Beweis", "n")}


def test_glossary_state_survives_a_restart(spark, tmp_path):
    terms = [(d, f"T{(7 * k) % 110} x"[: 3 + k % 3], f"z{k}", k % 130) for d in (1, 2) for k in range(400)] + [(1, "  ", "z", 0), (2, "a" * 41, "z", 0), (2, None, "z", 0)]
    source = tmp_path / "terms"
    for k in range(4):
        spark.createDataFrame(terms[k::4], "doc_id long, en string, zh string, pos long").write.mode("append").parquet(str(source))
    read = lambda: spark.readStream.schema("doc_id long, en string, zh string, pos long").option("maxFilesPerTrigger", 6).parquet(str(source))
    glossary_state.run_glossary(read(), str(tmp_path / "state"), once=True)
    glossary_state.run_glossary(read(), str(tmp_path / "state"))
    got = sorted(map(tuple, glossary_state.glossary_of_state(spark, str(tmp_path / "state")).collect()))
    want = sorted(map(tuple, votes.glossary(spark.createDataFrame(terms, "doc_id long, en string, zh string, pos long")).collect()))
    assert got == want and len(got) == 160
