"""The pipeline on a small table, held against what plain versions of its stages keep."""

import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import common
from tests.llm.test_native import WORD, frame, prose


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, "\n".join(prose(rng, rng.randint(15, 60)) for _ in range(3)), "en", rng.choice(["s1", "s2"])) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s1") for i in range(20)]  # exact copies: every line goes
    near = [(300 + i, " ".join(rows[i][1].split()), "en", "s2") for i in range(10)]  # other lines, same words
    rows += near + [(400 + i, "too short", "en", "s1") for i in range(5)]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        if stage is not corpus_pipeline.packing:
            assert kept.columns == docs.columns
            seen.append(collections.Counter(r.doc_id for r in kept.collect()))
    clean = set(range(120))
    assert set(seen[0]) == clean | set(range(200, 220)) | set(range(300, 310))
    assert set(seen[1]) == clean | set(range(300, 310))
    assert set(seen[2]) == clean
    assert set(seen[3]) <= clean and max(seen[3].values()) <= 2
    words = lambda ids: sum(n * len(WORD.findall(rows[i][1])) for i, n in ids.items())
    assert abs(words(seen[3]) - 1.5 * words(seen[2])) < 0.02 * words(seen[2])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = collections.Counter(r.doc_id for r in out)
    assert set(pieces) == set(seen[3]) and all(pieces[i] == n for i, n in seen[3].items())
    used = collections.Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and columns with the operators' own names; then no rows at all."""
    rng = random.Random(13)
    rows = [(i, "\n".join(prose(rng, rng.randint(15, 60)) for _ in range(3)), "en", "s1") for i in range(80)]
    rows += [rows[3], rows[3], (None, prose(rng, 40), None, None), (None, None, None, None), (90, None, "en", "s1"), (91, "", None, "s2"), (92, " \n ", "de", None)]
    rows += [(93, prose(rng, 30_000), "en", "s2"), (94, rows[5][1], None, None)]
    names = ("_row", "_doc", "n_dropped", "lines", "_key", "_copies", "_copy", "_id", "_keep", "_class", "key", "size", "rate", "piece", "a b.c")
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        got = kept.collect()
        assert kept.columns == docs.columns, name
        assert {tuple(r[c] for c in names) for r in got} == {tuple(f"own {c}" for c in names)}, name
        assert name == "mixing" or {r.doc_id for r in got} >= set(range(80)), name
    assert 94 not in {r.doc_id for r in got} and max(collections.Counter(r.doc_id for r in got).values()) <= 2
    assert corpus_pipeline.packing(spark, kept, str(tmp_path)).count() >= len(got)
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_run_removes_what_no_one_reads(spark, tmp_path):
    rng = random.Random(14)
    frame(spark, [(i, prose(rng, 60), "en", "s") for i in range(30)]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    before = common.tables_written()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 30
    assert common.tables_written() - before <= 4
