"""The sink of pages: whole or not at all, replaced by a rerun."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quire.sources import export
from quire.sources.pages import manifest, write_site


def files(path):
    return {f: open(os.path.join(path, d, f), encoding="utf-8").read() for d in manifest(path) for f in os.listdir(os.path.join(path, d))}


def test_site(spark, tmp_path):
    path = str(tmp_path / "site")
    documents = spark.createDataFrame([(k, f"Über <Titel> {k}") for k in range(30)], "doc_id long, title string").repartition(5)
    paragraphs = spark.createDataFrame([(k, p, f"p{p}", "a</script><b> & é") for k in range(30) for p in range(3)], "doc_id long, pos int, id string, text string")
    pages = export.pages(documents, paragraphs)
    write_site(pages, path)
    first = files(path)
    coverage = paragraphs.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("doc_id") % 3 == 0).alias("translated"))
    index = export.site_index(documents, coverage).collect()
    assert {r.name for r in index} == set(first) and sum(manifest(path).values()) == 30 and {r.badge for r in index} == {"complete", "source only"}
    for html in first.values():
        assert html.count("<script") == html.count("</script>") == 1 and "&lt;Titel&gt;" in html
        data = json.loads(html[html.index('id=\'data\'>') + 10 : html.index("</script>")])
        assert [p["text"] for p in data["paragraphs"]] == ["a</script><b> & é"] * 3
    # a task fails: nothing of the run is seen, and nothing of it stays
    broken = pages.repartition(4).withColumn("html", F.when(F.col("doc_id") == 17, F.raise_error(F.lit("stop"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="stop"):
        write_site(broken, path)
    assert files(path) == first and len([d for d in os.listdir(path) if os.path.isdir(os.path.join(path, d))]) == len(manifest(path))
    write_site(pages.filter("doc_id < 10").withColumn("html", F.lit("new")), path)
    assert set(files(path).values()) == {"new"} and len(files(path)) == 10
    assert len([d for d in os.listdir(path) if os.path.isdir(os.path.join(path, d))]) == len(manifest(path))


def test_a_failed_run_leaves_nothing_of_slow_tasks(spark, tmp_path):
    """One task fails at once, while the others, a second later, make a folder yet, as a writer does that begins late."""
    path = str(tmp_path / "site")
    write_site(spark.createDataFrame([("a.html", "old")], "name string, html string"), path)

    def slow(batches):
        for batch in batches:
            if (batch["k"] % 4 == 0).any():
                raise ValueError("stop")
            time.sleep(1)
            os.makedirs(os.path.join(path, f"late-{batch['k'].iloc[0]}"))
            yield batch[["name", "html"]]

    rows = spark.createDataFrame([(k, f"{k}.html", "new") for k in range(4)], "k long, name string, html string").repartitionByRange(4, "k")
    with pytest.raises(Exception, match="stop"):
        write_site(rows.mapInPandas(slow, "name string, html string"), path)
    folders = lambda: {d for d in os.listdir(path) if os.path.isdir(os.path.join(path, d))}
    left = folders()
    time.sleep(3)
    assert left == folders() == set(manifest(path))
    assert files(path) == {"a.html": "old"}
