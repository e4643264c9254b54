"""Rows as a tree of files, all of them or none.

``df.write.format("winnow_files").mode("append").save(root)`` takes the columns path and text (a string
or bytes) and makes a file of each row, in a folder that all executors reach. Tasks write to a staging
folder beside the root; the commit is one rename of it, which fails if the root holds anything, so two
writers cannot mix and a reader sees the whole tree or none of it. ``mode("overwrite")`` puts the tree in
the place of an older one. An aborted write leaves nothing.

A file appears under its name at once and whole. A task that is run again, or twice, finds its own
files and goes on; repeated rows are one file; a path with two contents fails the write, as does a path
that is absolute, empty, null or leads out of the root, or that is a file's and a folder's. A null text is an empty
file. Columns beside path and text are not taken.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType

from winnow.sources import store

#: Files that a task removes.
REMOVED_FILES = 5_000


def local_path(path: str) -> str:
    """A path or file URI as the path that ``open`` takes; other schemes are refused."""
    uri = urllib.parse.urlsplit(path)
    if uri.scheme == "file" and uri.netloc in ("", "localhost"):
        return urllib.parse.unquote(uri.path).rstrip("/")
    if uri.scheme or not path.startswith("/"):
        raise ValueError(f"not an absolute path in a mounted folder: {path}")
    return path.rstrip("/")


def checked(path: str | None) -> str:
    """A path below the root, or an error."""
    if not path or path.startswith("/") or "\0" in path or any(p in ("", ".", "..") for p in path.split("/")):
        raise ValueError(f"not a path below the root: {path!r}")
    return path


def put(full: str, raw: bytes, part: str) -> bool:
    """Create a file with this content, made under the name ``part`` in the same file system; False if
    it is there already, an error if it holds another."""
    try:
        with open(part, "xb", buffering=0) as f:
            left = memoryview(raw)
            while left:
                left = left[f.write(left) :]
        os.link(part, full)
        return True
    except FileExistsError:
        if os.path.isdir(full):
            raise
        with open(full, "rb") as f:
            if f.read() != raw:
                raise
        return False
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(part)


def remove(spark: SparkSession, root: str) -> None:
    """Delete a tree of files that executors reach: its files in tasks, by pieces as the scan cuts them, then
    the folders and what the scan does not list."""
    at = local_path(root)

    def unlinked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with contextlib.suppress(OSError):
                    os.unlink(f"{at}/{path}")
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    if os.path.isdir(at):
        files = spark.read.format("winnow_files").options(path=at, content="false", partitionFiles=REMOVED_FILES).load().where("kind = 'file'")
        files.select("path").mapInArrow(unlinked, "n long").agg({"n": "sum"}).collect()
    store.delete(spark, root)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: new files and their bytes."""

    files: int
    bytes: int


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.root = local_path(options["path"])
        self.overwrite = overwrite
        self.stage = f"{self.root}.writing-{uuid.uuid4().hex}"
        types = {f.name: f.dataType for f in schema.fields}
        if set(types) != {"path", "text"} or types["path"] != StringType() or types["text"] not in (StringType(), BinaryType()):
            raise ValueError(f"wanted: path string, text string or binary; given: {schema.simpleString()}")
        if not overwrite:
            self._refuse()

    def _refuse(self) -> None:
        if os.path.lexists(self.root) and not (os.path.isdir(self.root) and not os.listdir(self.root)):
            raise FileExistsError(self.root)

    def write(self, iterator: Iterator) -> Written:
        files = size = 0
        # a folder of its own for each task: many tasks that make files in one wait for each other
        parts, made = f"{self.stage}.parts/{uuid.uuid4().hex}", set()
        os.makedirs(parts, exist_ok=True)
        for row in iterator:
            raw = row["text"] or b""
            raw = raw.encode() if isinstance(raw, str) else bytes(raw)
            full = f"{self.stage}/{checked(row['path'])}"
            if (folder := os.path.dirname(full)) not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            if put(full, raw, f"{parts}/part"):
                files, size = files + 1, size + len(raw)
        os.rmdir(parts)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.stage, exist_ok=True)
        old = f"{self.stage}.old"
        if self.overwrite and os.path.lexists(self.root):
            os.rename(self.root, old)
        # onto an empty folder or none; anything else is an error, and the write is aborted
        os.rename(self.stage, self.root)
        for path in (old, f"{self.stage}.parts"):
            shutil.rmtree(path, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.isdir(old := f"{self.stage}.old") and not os.path.lexists(self.root):
            os.rename(old, self.root)
        for path in (self.stage, f"{self.stage}.parts"):
            shutil.rmtree(path, ignore_errors=True)
