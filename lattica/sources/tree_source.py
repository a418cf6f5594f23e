"""Source trees as a Spark data source: folders are walked, and files hashed, on the executors.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("path", root).load()
    spark.readStream.format("source_tree").option("path", root).load()

The driver only opens folders from the root down, breadth first, until there are enough of them to hand out; each is a partition, and what
lies beside them in the opened folders is one for each. Every executor must reach the tree by the same path. Links are followed but for
those that lead back into a folder above. The stream gives what is new or has changed since the last batch, by the
time that the file system itself keeps (so moved and copied files count whatever their own date).

Options: path; extensions and excluded, separated by commas; partitions, how many folders to hand out, about; hash, whether files
are read and hashed (a file that can't be read then has an error instead).
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lattica.operators.resolve import file_order
from lattica.sources.files import EXTENSIONS, SKIPPED

PARTITIONS = 256


@dataclass
class Subtree(InputPartition):
    """A folder to walk; `above` are the real paths of it and the folders above, deep if those below belong to it."""

    folder: str
    above: tuple[str, ...]
    deep: bool
    after: int = -1
    until: int = -1


class _Walk:
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        listed = lambda k, default: tuple(x.strip() for x in options[k].split(",") if x.strip()) if k in options else default
        self.extensions = listed("extensions", EXTENSIONS)
        self.skipped = {*SKIPPED, *listed("excluded", ())}
        self.wanted = int(options.get("partitions", PARTITIONS))
        self.hashed = str(options.get("hash", "true")).lower() == "true"

    def _below(self, folder: str, above: tuple[str, ...]) -> tuple[list[tuple[str, tuple[str, ...]]], list[str]]:
        """(folders with their real paths, source files) within a folder; what can't be read isn't there."""
        folders, files = [], []
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return [], []
        for e in entries:
            try:
                if e.is_dir():
                    real = os.path.realpath(e.path)
                    if e.name not in self.skipped and real not in above:
                        folders.append((e.path, (*above, real)))
                elif e.is_file():
                    stem, dot, ending = e.name.rpartition(".")
                    if dot and stem and ending.lower() in self.extensions and not e.name.startswith("._"):
                        files.append(e.path)
            except OSError:
                continue
        return folders, files

    def subtrees(self) -> list[Subtree]:
        if os.path.basename(self.root.rstrip("/")) in self.skipped or not os.path.isdir(self.root):
            return []
        closed, opened = [(self.root, (os.path.realpath(self.root),))], []
        while closed and len(closed) < self.wanted:
            below = [x for folder, above in closed for x in self._below(folder, above)[0]]
            opened += closed
            closed = below
        return [Subtree(f, a, True) for f, a in closed] + [Subtree(f, a, False) for f, a in opened]

    def rows(self, part: Subtree) -> Iterator[tuple]:
        """path, size, modified (seconds), content_hash, error of the source files of a partition."""
        todo = [(part.folder, part.above)]
        while todo:
            folder, above = todo.pop()
            folders, files = self._below(folder, above)
            for path in files:
                row = self._row(path, part)
                if row is not None:
                    yield row
            if part.deep:
                todo += reversed(folders)

    def _row(self, path: str, part: Subtree) -> tuple | None:
        try:
            status = os.stat(path)
            if part.until >= 0 and not part.after < status.st_ctime_ns <= part.until:
                return None
            digest = None
            if self.hashed:
                own = hashlib.sha256()
                with open(path, "rb") as f:
                    while piece := f.read(1 << 20):
                        own.update(piece)
                digest = own.hexdigest()
            return path, status.st_size, int(status.st_mtime), digest, None
        except OSError as e:
            return path, None, None, None, str(e)


class _Reader(DataSourceReader):
    def __init__(self, walk: _Walk):
        self.walk = walk

    def partitions(self) -> list[Subtree]:
        return self.walk.subtrees()

    def read(self, partition: Subtree) -> Iterator[tuple]:
        return iter(()) if partition is None else self.walk.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times; a batch has the files that have changed after one, and up to the next."""

    def __init__(self, walk: _Walk):
        self.walk = walk

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[Subtree]:
        found = self.walk.subtrees()
        for p in found:
            p.after, p.until = start["until"], end["until"]
        return found

    def read(self, partition: Subtree) -> Iterator[tuple]:
        return self.walk.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, size long, modified long, content_hash string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Walk(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(_Walk(self.options))


def tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """path, size, modified, content_hash, error of the source files of a tree."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(path=root, **{k: str(v) for k, v in options.items()}).load()


def new_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """The same as a stream of what is new or changed."""
    spark.dataSource.register(SourceTree)
    return spark.readStream.format("source_tree").options(path=root, **{k: str(v) for k, v in options.items()}).load()


def in_order(found: DataFrame) -> DataFrame:
    return found.orderBy(file_order(F.col("path")))
