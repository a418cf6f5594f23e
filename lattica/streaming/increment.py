"""Incremental maintenance as a stream: extraction results that arrive as files are merged into the snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators import incremental, store
from lattica.sources.extraction import LONGEST, decoded, sizes

#: seq, where the sender gives it, tells the order of arrivals that come in one file. part: see schema.PART_ROWS; all parts of
#: an arrival come in one file and have its content_hash.
ARRIVAL = "file string, content_hash string, json string, error string, deleted boolean, seq long, part int"


def arrivals(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of arrivals as JSON lines in a folder; `deleted` ones carry no document. arrived: time and name of the file.
    A line that can't be read fails the stream; it would be lost otherwise."""
    found = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files_a_batch).option("maxStringLen", LONGEST).option("mode", "FAILFAST").json(folder)
    return found.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_name").alias("arrived"))


def merge_batch(snapshots: store.Snapshots, batch: DataFrame, now: int, project_id: str = "default") -> None:
    """One batch as a new snapshot; of several arrivals of one file in it, the last one counts."""
    order = [F.col(c) for c in ("arrived", "seq") if c in batch.columns]
    columns = ("file", "content_hash", "json", "error", "deleted")
    part = F.coalesce("part", F.lit(0)) if "part" in batch.columns else F.lit(0)
    at = F.struct(*order, F.coalesce("content_hash", F.lit("")))
    each = batch.groupBy("file", part.alias("part")).agg(F.max_by(F.struct(*columns), at).alias("x"), F.max(at).alias("at")).select("x.*", "part", "at")
    of = F.struct("content_hash", F.coalesce("deleted", F.lit(False)).alias("gone"), F.col("json").isNull().alias("failed"))
    newest = each.groupBy("file").agg(F.max_by(of, "at").alias("of"))
    parts = each.join(newest, "file").where(of.eqNullSafe(F.col("of")))
    last = parts.groupBy("file").agg(F.max_by(F.struct("content_hash", "error", "deleted", F.col("json").isNull().alias("failed")), "at").alias("x")).select("file", "x.*")
    tables = snapshots.read()
    gone = F.coalesce("deleted", F.lit(False))
    disk = last.where(~gone).select(F.col("file").alias("path"), "content_hash")
    known = tables["file_info"].join(last.select(F.col("file").alias("file_path")), "file_path", "left_semi")
    changed = incremental.changes(disk, known)
    fresh = last.where(~gone).join(changed.select(F.col("path").alias("file")), "file", "left_semi")
    results = decoded(parts.join(fresh.where("NOT failed").select("file"), "file", "left_semi").select("file", "part", "json"))
    failed = F.col("failed")
    files = fresh.join(sizes(results), "file", "left").select(
        F.col("file").alias("file_path"), F.lit(now).cast("long").alias("last_modified"), F.when(failed, "").otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(failed, "failed").otherwise("success").alias("parse_status"), F.col("error").alias("error_message"), F.coalesce("n", F.lit(0).cast("long")).alias("symbol_count"), F.lit(None).cast("long").alias("parse_time_ms"),
    )
    if not changed.isEmpty():
        incremental.merged(snapshots, changed, results, files, project_id)


def run(spark: SparkSession, folder: str, root: str, checkpoint: str, clock: Callable[[], int], project_id: str = "default") -> StreamingQuery:
    """Starts the stream; each batch is one snapshot that writes the buckets it changes, and a batch that is run again meets unchanged hashes and writes none."""
    snapshots = store.Snapshots(spark, root)
    snapshots.initialize()
    return (
        arrivals(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, _: merge_batch(snapshots, batch, clock(), project_id)).start()
    )
