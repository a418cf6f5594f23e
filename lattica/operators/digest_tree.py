"""Digest trees of folders: two listings are compared from the root down, and only where digests differ.

A folder's digest is the sum, limb by limb, of the SHA-256 of all files below it (path and content hash). Sums don't depend
on an order and add up from folder to folder, so a tree takes two aggregations with partial sums, whatever its depth, and
no folder's entries ever come together in one task. They tell apart what happens to files, not what somebody constructs
to collide.

A tree lies in the shared folder by depth and by a hash: nodes by that of the folder above, files by that of their folder. A comparison
goes one level down at a time, reads the buckets of the folders that still differ and no others, and at last the files of
those whose own files differ.

Defined results: rows of null path are no files; a null hash differs from every other and equals itself; a path that occurs more than once
counts as often, and is compared by incremental.changes() where its folder differs; two empty listings are equal. Folders
of a path are what stands between its slashes, so `/a/b` lies in `` and `a`; a folder may have 2**31 files of its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lattica.operators import incremental
from lattica.session import work_folder

#: Files for each bucket of a level, about.
BUCKET_FILES = 50_000
#: A digest's limbs: hexadecimal digits of each, and how many.
DIGITS, LIMBS = 8, 8
_SUMS = [f"s{i}" for i in range(LIMBS)]


def _above(folder: Column, depth: Column) -> Column:
    """The folder that many levels below the root in which a folder lies."""
    return F.array_join(F.slice(F.split(folder, "/"), F.lit(1), depth), "/")


def _digest() -> Column:
    return F.concat(*(F.lpad(F.hex(c), DIGITS, "0") for c in _SUMS))


def _sums() -> list[Column]:
    return [F.pmod(F.sum(c), F.lit(16**DIGITS)).alias(c) for c in _SUMS]


def _files(listing: DataFrame) -> DataFrame:
    """path, content_hash, folder, depth of a listing: how many levels its folder stands below the root."""
    parts = F.split("path", "/")
    above = F.size(parts) - 1
    return listing.where("path IS NOT NULL").select("path", "content_hash", F.array_join(F.slice(parts, F.lit(1), above), "/").alias("folder"), above.alias("depth"))


def _nodes(files: DataFrame) -> DataFrame:
    """depth, folder, own (digest of the files in the folder itself, null without), digest (of all below), n_files."""
    leaf = F.sha2(F.concat(F.col("path"), F.lit("\0"), F.coalesce(F.concat(F.lit("h"), "content_hash"), F.lit("n"))), 256)
    limbs = [F.conv(F.substring("leaf", 1 + DIGITS * i, DIGITS), 16, 10).cast("long").alias(c) for i, c in enumerate(_SUMS)]
    each = files.select("depth", "folder", leaf.alias("leaf")).select("depth", "folder", *limbs)
    own = each.groupBy("depth", "folder").agg(*_sums(), F.count(F.lit(1)).alias("n"))
    of = own.select("folder", F.col("depth").alias("from"), *_SUMS, "n", F.explode(F.sequence(F.lit(0), "depth")).alias("depth"))
    itself = F.col("from") == F.col("depth")
    of = of.select("depth", F.when(itself, F.col("folder")).otherwise(_above(F.col("folder"), F.col("depth"))).alias("folder"), *_SUMS, "n", F.when(itself, _digest()).alias("own"))
    return of.groupBy("depth", "folder").agg(F.max("own").alias("own"), *_sums(), F.sum("n").alias("n_files")).select("depth", "folder", "own", _digest().alias("digest"), "n_files")


def _bucket(folder: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(folder), F.lit(buckets)).cast("int")


@dataclass
class DigestTree:
    """A tree that lies in a folder."""

    spark: SparkSession
    root: str

    @classmethod
    def build(cls, listing: DataFrame, root: str | None = None, bucket_files: int = BUCKET_FILES) -> DigestTree:
        """The tree of listing(path, content_hash, ..), written below root (by default a new place in the shared folder)."""
        spark = listing.sparkSession
        root = root or f"{work_folder(spark)}/digests-{uuid.uuid4().hex}"
        listing.select("path", "content_hash").write.parquet(f"{root}/listing")  # once: a listing may read and hash all files
        files = _files(spark.read.schema("path string, content_hash string").parquet(f"{root}/listing"))
        buckets = max(1, -(-files.count() // bucket_files))
        laid = lambda df, by: df.withColumn("bucket", _bucket(by, buckets)).hint("rebalance", F.col("depth"), F.col("bucket"))
        laid(files, F.col("folder")).write.partitionBy("depth", "bucket").parquet(f"{root}/files")
        above = _above(F.col("folder"), F.col("depth") - 1)
        nodes = _nodes(files).withColumn("above", F.when(F.col("depth") > 0, above))
        laid(nodes, F.coalesce("above", F.lit(""))).write.partitionBy("depth", "bucket").parquet(f"{root}/nodes")
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{root}/layout")
        return cls(spark, root)

    @property
    def buckets(self) -> int:
        return self.spark.read.schema("buckets int").parquet(f"{self.root}/layout").first()[0]

    def nodes(self) -> DataFrame:
        return self.spark.read.schema("folder string, own string, digest string, n_files long, above string, depth int, bucket int").parquet(f"{self.root}/nodes")

    def files(self) -> DataFrame:
        return self.spark.read.schema("path string, content_hash string, folder string, depth int, bucket int").parquet(f"{self.root}/files")


@dataclass
class Comparison:
    """changes(path, change_type); the parts of both trees' nodes and files that were read to find them."""

    changes: DataFrame
    nodes: list[DataFrame]
    files: list[DataFrame]

    def rows_read(self) -> tuple[int, int]:
        """How many nodes and files that were."""
        return sum(df.count() for df in self.nodes), sum(df.count() for df in self.files)


def compared(old: DigestTree, new: DigestTree) -> Comparison:
    """What has changed from one tree to the other."""
    spark, place = new.spark, f"{work_folder(new.spark)}/descent-{uuid.uuid4().hex}"
    trees = [(t.buckets, t.nodes(), t.files()) for t in (old, new)]
    out = Comparison(spark.createDataFrame([], "path string, change_type string"), [], [])

    def differing(sides: list[DataFrame], depth: int) -> tuple[DataFrame, Row]:
        """(folder, own_differs of the nodes of a level that differ; the buckets of both trees where what is below them lies,
        and where their own files lie: these numbers are all that the driver sees)."""
        a, b = (s.select("folder", F.col("own").alias(f"own_{i}"), F.col("digest").alias(f"digest_{i}")) for i, s in enumerate(sides))
        rows = a.join(b, "folder", "full_outer").where("NOT digest_0 <=> digest_1").select("folder", F.expr("NOT own_0 <=> own_1").alias("own_differs"))
        rows.write.parquet(f"{place}/{depth}")
        rows = spark.read.schema(rows.schema).parquet(f"{place}/{depth}")
        of = [_bucket(F.col("folder"), t[0]) for t in trees]
        places = [F.collect_set(b).alias(f"nodes_{i}") for i, b in enumerate(of)] + [F.collect_set(F.when(F.col("own_differs"), b)).alias(f"files_{i}") for i, b in enumerate(of)]
        return rows, rows.agg(*places).first()

    depth = 0
    level, at = differing([nodes.where("depth = 0") for _, nodes, _ in trees], 0)
    while at["nodes_0"]:
        if at["files_0"]:
            own = level.where("own_differs").select("folder")
            read = [files.where((F.col("depth") == depth) & F.col("bucket").isin(at[f"files_{i}"])) for i, (_, _, files) in enumerate(trees)]
            was, now = (f.join(own, "folder", "left_semi").select("path", "content_hash") for f in read)
            out.changes = out.changes.unionByName(incremental.changes(now, was.withColumnRenamed("path", "file_path")))
            out.files += read
        depth += 1
        read = [nodes.where((F.col("depth") == depth) & F.col("bucket").isin(at[f"nodes_{i}"])) for i, (_, nodes, _) in enumerate(trees)]
        out.nodes += read
        above = level.select(F.col("folder").alias("above"))
        level, at = differing([n.join(above, "above", "left_semi") for n in read], depth)
    return out


def changes(disk: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of incremental.changes(), by trees of both listings that are built for it."""
    old = DigestTree.build(files.select(F.col("file_path").alias("path"), "content_hash"))
    return compared(old, DigestTree.build(disk.select("path", "content_hash"))).changes
