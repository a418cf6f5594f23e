"""Source trees: listing on the driver, reading and hashing on the executors; remote folders through Hadoop's filesystems."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import lines_of

#: Endings of source files, and folders that are never entered.
EXTENSIONS = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx")
SKIPPED = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".build", ".cache", ".cct",
    "test", "tests", "unittests", "unittest", "testing", "benchmarks", "benchmark", "examples", "example",
)
#: Where a compile database is looked for, in order.
COMPILE_DATABASES = (
    ".cct/compile_commands.json", "compile_commands.json", "build/compile_commands.json", "cmake-build-debug/compile_commands.json",
    "cmake-build-release/compile_commands.json", "out/compile_commands.json", "out/Default/compile_commands.json", "builddir/compile_commands.json",
    ".build/compile_commands.json",
)
INCLUDE_DEPTH, PREVIEW_LINES = 10, 50


def source_paths(root: str, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = ()) -> list[str]:
    """Source files under root, links followed (each folder once), in order of their paths' components."""
    skip, found, entered = {*SKIPPED, *excluded}, [], set()
    if os.path.basename(root.rstrip("/")) in skip:
        return []
    for folder, names, files in os.walk(root, followlinks=True):
        real = os.path.realpath(folder)
        if real in entered:
            names[:] = []
            continue
        entered.add(real)
        names[:] = [n for n in names if n not in skip]
        for f in files:
            stem, dot, ending = f.rpartition(".")
            if dot and stem and ending.lower() in extensions and not f.startswith("._"):
                path = os.path.join(folder, f)
                if os.path.isfile(path):
                    found.append(path)
    return sorted(found, key=lambda p: p.split("/"))


def sources_among(paths: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The rows of paths(path, ..) that are source files, by the rules of source_paths(), for stores that list paths (below
    their root, without it): no folder among those that are skipped, an ending of a source file, not begun with `._`."""
    parts = F.split("path", "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    stem, ending = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1), F.lower(F.substring_index(name, ".", -1))
    skipped = F.arrays_overlap(folders, F.array(*map(F.lit, (*SKIPPED, *excluded))))
    return paths.where(~skipped & (stem != "") & ending.isin(*extensions) & ~name.startswith("._"))


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = ()) -> DataFrame:
    """position, path of the source files; listed by name, so files with leading dots or underscores count too."""
    return spark.createDataFrame(list(enumerate(source_paths(root, extensions, excluded))), "position int, path string")


def contents(paths: DataFrame, partitions: int | None = None) -> DataFrame:
    """path, content, error of files that every executor can open; read where the rows are, not on the driver."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                data, error = None, None
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                except OSError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    rows = paths.select("path")
    return (rows.repartition(partitions) if partitions else rows).mapInArrow(read, "path string, content binary, error string")


def hashes(files: DataFrame) -> DataFrame:
    """path, content_hash: SHA-256 in lowercase hex; a file that can't be read fails the job."""
    failed = F.raise_error(F.concat(F.lit("can't read "), "path", F.lit(": "), "error"))
    return files.select("path", F.when(F.col("error").isNotNull(), failed.cast("string")).otherwise(F.sha2("content", 256)).alias("content_hash"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """name, path, is_dir, size of the entries of a folder but for hidden ones: folders, then files, each by name in lower case."""
    if not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    rows = []
    for entry in os.scandir(folder):
        if not entry.name.startswith("."):
            try:
                rows.append((entry.name, entry.path, entry.is_dir(), entry.stat().st_size))
            except OSError:
                continue
    return ordered_listing(spark.createDataFrame(rows, "name string, path string, is_dir boolean, size long"))


def ordered_listing(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("name").startswith(".")).orderBy(F.desc("is_dir"), F.lower("name"), "name")


def remote_listing(spark: SparkSession, uri: str) -> DataFrame:
    """The entries of a folder in any store that Hadoop knows (sftp, hdfs, object stores)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(uri)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return spark.createDataFrame([(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getLen()) for s in found], "name string, path string, is_dir boolean, size long")


def remote_contents(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.format("binaryFile").load(uri).select("path", "content")


def upload(spark: SparkSession, local: str, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(uri)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, path(local), target)


def include_folders(root: str, excluded: tuple[str, ...] = (), depth: int = INCLUDE_DEPTH) -> list[str]:
    """-I arguments for a tree without a compile database: root, and all folders from root (again) to a depth but for hidden
    and excluded ones."""
    out = [f"-I{root}"]
    base = root.rstrip("/").count("/")
    for folder, names, _ in os.walk(root):
        names.sort()
        if folder.rstrip("/").count("/") - base >= depth:
            names[:] = []
        name = os.path.basename(folder.rstrip("/"))
        if not name.startswith(".") and name not in excluded:
            out.append(f"-I{folder}")
    return out


def find_compile_database(root: str) -> str | None:
    return next((p for p in (os.path.join(root, c) for c in COMPILE_DATABASES) if os.path.exists(p)), None)


def numbered_lines(texts: DataFrame, start: int, end: int) -> DataFrame:
    """path, number, line of the lines start to end (from 1, both included, within the text) of each text."""
    line = F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    return texts.select("path", line).select("path", (F.col("pos") + 1).alias("number"), "line").where(F.col("number").between(max(1, start), end))


def code_slice(texts: DataFrame, start: int, end: int) -> DataFrame:
    """path, text: the numbered lines as a report, numbers five wide; a message where the range holds no line."""
    rows = lines_of(F.col("text"))
    n = F.size(rows)
    first, last = F.lit(max(0, start - 1)), F.least(F.lit(end), n)
    part = F.slice(rows, first + 1, F.greatest(last - first, F.lit(0)))
    shown = F.transform(part, lambda line, i: F.concat(F.when(first + i + 1 < 100_000, F.lpad((first + i + 1).cast("string"), 5, " ")).otherwise((first + i + 1).cast("string")), F.lit(" | "), line))
    bad = F.format_string(f"no lines {start}-{end}: the file has %d lines", n)
    return texts.select("path", F.when(first >= last, bad).otherwise(F.array_join(shown, "\n")).alias("text"))


def preview(texts: DataFrame, lines: int = PREVIEW_LINES) -> DataFrame:
    """path, end_line, content: the first lines of each text."""
    rows = lines_of(F.col("text"))
    return texts.select("path", F.least(F.lit(lines), F.size(rows)).alias("end_line"), F.array_join(F.slice(rows, 1, lines), "\n").alias("content"))


def with_line_count(texts: DataFrame) -> DataFrame:
    return texts.select("path", F.col("text").alias("content"), F.size(lines_of(F.col("text"))).alias("lines"))
