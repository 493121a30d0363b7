"""A sink of pages: a file for each document, seen as a whole or not at all.

Tasks write the pages of their rows into a folder of their own attempt. The driver's commit names the folders of the
attempts that count in a manifest, which takes the old one's place by one rename; then what the old one named, and
what failed attempts left, goes. So a failed run leaves the site as it was, a retried task counts once, and a rerun
replaces the site. The driver holds one name a task. Paths are of any store that Arrow's file systems reach.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

MANIFEST = "_manifest.json"
#: Seconds that a failed run waits for its last tasks.
WAIT = 60


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    pages: int


class PageWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex
        self.name, self.html = columns.index("name"), columns.index("html")

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        folder = f"{self.run}-{context.partitionId()}-{context.taskAttemptId()}"
        store, base = _store(self.path)
        store.create_dir(f"{base}/{folder}")
        pages = 0
        for row in rows:
            with store.open_output_stream(f"{base}/{folder}/{row[self.name]}") as out:
                out.write(row[self.html].encode())
            pages += 1
        return Written(folder, pages)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        done = {m.folder: m.pages for m in messages if m is not None}
        store.create_dir(base)
        with store.open_output_stream(f"{base}/{self.run}.json") as out:
            out.write(json.dumps(done).encode())
        store.move(f"{base}/{self.run}.json", f"{base}/{MANIFEST}")
        self._tidy(store, base, set(done))

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        self._tidy(store, base, set(manifest(self.path)))

    @staticmethod
    def _tidy(store: fs.FileSystem, base: str, kept: set[str]) -> None:
        for found in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if found.type == fs.FileType.Directory and found.base_name not in kept:
                store.delete_dir(found.path)


class PageSource(DataSource):
    """df.write.format("pages").mode("overwrite").save(path), for rows with name and html."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        if not overwrite:
            raise ValueError("a site is replaced as a whole: mode('overwrite')")
        return PageWriter(self.options["path"], schema.names)


def manifest(path: str) -> dict[str, int]:
    """The folders of the site and how many pages each holds; empty before the first commit."""
    store, base = _store(path.rstrip("/"))
    if store.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.NotFound:
        return {}
    with store.open_input_stream(f"{base}/{MANIFEST}") as got:
        return json.loads(got.read())


def write_site(pages: DataFrame, path: str) -> None:
    """Pages (name, html) as files under path; names have to differ.

    Spark calls abort while other tasks of a failed run still write. So a failed run is tidied up again when no task is left, or
    after `WAIT` seconds, if other jobs of the session go on.
    """
    spark = pages.sparkSession
    spark.dataSource.register(PageSource)
    try:
        pages.select("name", "html").write.format("pages").mode("overwrite").save(path)
    except Exception:
        tracker, end = spark.sparkContext._jsc.sc().statusTracker(), time.monotonic() + WAIT
        while time.monotonic() < end and any(e.numRunningTasks() for e in tracker.getExecutorInfos()):
            time.sleep(0.1)
        store, base = _store(path.rstrip("/"))
        PageWriter._tidy(store, base, set(manifest(path)))
        raise
