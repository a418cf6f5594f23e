"""Extraction results: JSON documents of an external parser, and a plug-in point for parsers that run on the executors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.schema import EXTRACTION, PART_ROWS, REQUIRED
from lattica.sources.lexical import lexical as lexical  # noqa: PLC0414  the extractor that needs no compiler

#: The longest text in a document; Spark's own bound, 20 million characters, takes longer ones for broken.
LONGEST = str(2**31 - 1)
#: Characters of documents that a task holds before it hands them on.
HELD = 4 << 20
#: An extractor maps (path, text) to a document with the fields of schema.EXTRACTION.
Extractor = Callable[[str, str], dict]


def read_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """file and the nested columns of the documents at a path; a document that isn't valid fails the job."""
    text = spark.read.option("wholetext", not lines).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"))
    return decoded(text)


def decoded(documents: DataFrame) -> DataFrame:
    """file, json -> file and nested columns. Fields of REQUIRED must be there, others may be absent; nested JSON within
    parameters and attributes stays text. Null documents have no rows of any kind (a filter on them may run later). A column
    `part` is kept; a part with over PART_ROWS rows of a kind fails, since its ordinals would be those of the next."""
    part = ["part"] if "part" in documents.columns else []
    parsed = documents.select("file", *part, F.col("json").isNotNull().alias("there"), F.from_json("json", EXTRACTION, {"mode": "FAILFAST", "maxStringLen": LONGEST}).alias("r"))
    checked = []
    for field, names in REQUIRED.items():
        value = F.col(f"r.{field}")
        missing = F.exists(value, _lacks(names))
        absent = F.lit(False) if field == "references" else value.isNull()
        error = F.raise_error(F.concat(F.lit(f"a required field of {field} is missing in "), "file"))
        kept = F.when(F.col("there") & (absent | F.coalesce(missing, F.lit(False))), error.cast(parsed.select(value).schema[0].dataType)).otherwise(F.coalesce(value, F.array().cast(parsed.select(value).schema[0].dataType)))
        if part:
            many = F.raise_error(F.concat(F.lit(f"too many rows of {field} in a part of "), "file"))
            kept = F.when(F.col("part").isNotNull() & (F.size(value) > PART_ROWS), many.cast(parsed.select(value).schema[0].dataType)).otherwise(kept)
        checked.append(kept.alias(field))
    return parsed.select("file", *part, *checked)


def _lacks(names: tuple[str, ...]) -> Callable[[Column], Column]:
    def any_null(x: Column) -> Column:
        out = x[names[0]].isNull()
        for n in names[1:]:
            out = out | x[n].isNull()
        return out

    return any_null


def sizes(results: DataFrame) -> DataFrame:
    """file, n: the symbols of each file, over all its parts."""
    return results.groupBy("file").agg(F.sum(F.size("symbols")).cast("long").alias("n"))


def extracted(files: DataFrame, extractor: Extractor) -> DataFrame:
    """file, json, error, millis of files(path, content): the extractor runs on the executors; one that fails yields no
    document but its message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["file", "json", "error", "millis"])
            held.clear()
            return out

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                began, document, error = time.monotonic(), None, None
                try:
                    document = json.dumps(extractor(path, (content or b"").decode("utf-8", "replace")))
                except Exception as e:  # noqa: BLE001  any failure of a plug-in is that file's failure
                    error = f"{type(e).__name__}: {e}"
                took = int((time.monotonic() - began) * 1000)
                held.append((path, document, error, took))
                size += len(document or "")
                if size >= HELD:
                    yield flushed()
                    size = 0
        if held:
            yield flushed()

    return files.select("path", "content").mapInArrow(run, "file string, json string, error string, millis long")


def file_records(files: DataFrame, runs: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """file_info rows: failed files have an empty hash and their message."""
    joined = runs.join(files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("hash")), "file").join(sizes(results), "file", "left")
    failed = F.col("error").isNotNull()
    return joined.select(
        F.col("file").alias("file_path"), F.lit(now).cast("long").alias("last_modified"), F.when(failed, "").otherwise(F.col("hash")).alias("content_hash"),
        F.when(failed, "failed").otherwise("success").alias("parse_status"), F.col("error").alias("error_message"),
        F.coalesce("n", F.lit(0).cast("long")).alias("symbol_count"), F.col("millis").alias("parse_time_ms"),
    )
