"""Documents as files, a file for each page, through Spark's writer:

    spark.dataSource.register(Documents)
    documents.write.format("pagelight_documents").mode("append").option("ending", "hocr").save(folder)

for rows (name string, document string). A task writes under a folder of its own; only when all tasks are done are the files of those whose result counts
moved to their names, so a task that is run twice leaves one file, and a job that fails leaves none
(but perhaps a folder ``_temporary-...`` of a task that ended after it). Two rows of one name fail
the job. The folder must be one that all tasks see.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, ending: str, overwrite: bool) -> None:
        self.path, self.ending, self.overwrite = path, ending, overwrite
        self.pending = os.path.join(path, f"_temporary-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        folder = os.path.join(self.pending, uuid.uuid4().hex)
        os.makedirs(folder)
        names = []
        for row in iterator:
            names.append(f"{quote(row['name'], safe=' ')}.{self.ending}")
            with open(os.path.join(folder, names[-1]), "xb") as f:
                f.write((row["document"] or "").encode())
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two documents have one name")
        if self.overwrite:
            for old in os.scandir(self.path):
                if old.is_file():
                    os.remove(old.path)
        for m in done:
            for n in m.names:
                os.replace(os.path.join(m.folder, n), os.path.join(self.path, n))
        shutil.rmtree(self.pending, ignore_errors=True)
        with open(os.path.join(self.path, "_SUCCESS"), "wb"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class Documents(DataSource):
    """The sink. Options: path, ending ("txt" where it is not given)."""

    @classmethod
    def name(cls) -> str:
        return "pagelight_documents"

    def schema(self) -> str:
        return "name string, document string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if [f.name for f in schema.fields] != ["name", "document"]:
            raise ValueError("documents are rows of name and document")
        return _Writer(self.options["path"].removeprefix("file://"), self.options.get("ending", "txt"), overwrite)
