"""A folder of text files as a sink: ``df.write.format("text_files")`` puts each row (name, body) into a file of its own, from executors.

A file is written under a hidden name of this job and then moved to its own, so a task that is run again, or twice at once,
leaves one whole file; what lost tasks left goes when the job ends. Names are relative to the folder, which all executors must see.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class TextFiles(DataSource):
    """Options: ``path``, a folder's path or URI. A null body is an empty file; of equal names one stays."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema] != ["name", "body"]:
            raise ValueError(f"text_files takes the columns name and body, not {', '.join(f.name for f in schema)}")
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.uri = path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))
        self.mark = f".{uuid.uuid4().hex}"

    def _folder(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.uri)
        system.create_dir(base, recursive=True)
        return system, base.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, base = self._folder()
        files = size = 0
        for r in iterator:
            if not r.name or r.name in (".", "..") or "/" in r.name or "\\" in r.name:
                raise ValueError(f"not the name of a file: {r.name!r}")
            body, hidden = (r.body or "").encode("utf-8", "surrogatepass"), f"{base}/{self.mark}.{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as f:
                f.write(body)
            system.move(hidden, f"{base}/{r.name}")
            files, size = files + 1, size + len(body)
        return Written(files, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Hidden files of this job that a lost task left; files under their own names stay."""
        system, base = self._folder()
        for x in system.get_file_info(fs.FileSelector(base)):
            if x.base_name.startswith(self.mark):
                system.delete_file(x.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextFiles)


__all__ = ["TextFiles", "register"]
