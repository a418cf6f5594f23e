"""Index statistics: one aggregation pass over each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The counters that the project information shows.
INFO = ("total_files", "parsed_files", "total_symbols", "total_functions", "total_variables", "total_types", "total_macros", "total_call_relations", "total_include_relations")


def _one_row(frames: list[DataFrame]) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.crossJoin(b), frames)


def statistics(symbols: DataFrame, calls: DataFrame, includes: DataFrame, references: DataFrame, inheritance: DataFrame, files: DataFrame) -> DataFrame:
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    by_kind = [F.count_if(F.col("kind") == k).alias(f"total_{k}s") for k in ("function", "variable", "type", "macro")]
    by_status = [F.count_if(F.col("parse_status") == s).alias(n) for s, n in (("success", "parsed_files"), ("failed", "failed_files"))]
    frames = [
        files.agg(F.count(F.lit(1)).alias("total_files"), *by_status), symbols.agg(F.count(F.lit(1)).alias("total_symbols"), *by_kind),
        count(calls, "total_call_relations"), count(includes, "total_include_relations"), count(references, "total_reference_relations"), count(inheritance, "total_inheritance_relations"),
    ]
    return _one_row(frames).withColumn("elapsed_seconds", F.lit(0.0))


def parse_statistics(symbols: DataFrame, calls: DataFrame, includes: DataFrame, references: DataFrame, inheritance: DataFrame, files: DataFrame, elapsed: float = 0.0) -> DataFrame:
    """The same counters as an extraction run reports them: every file that hasn't failed counts as parsed."""
    own = statistics(symbols, calls, includes, references, inheritance, files)
    return own.withColumn("parsed_files", F.col("total_files") - F.col("failed_files")).withColumn("elapsed_seconds", F.lit(float(elapsed)))


def project_info(stats: DataFrame | None, project_id: str | None, spark=None) -> DataFrame:
    """project_id, status and nine counters; without an index, the status says so and the counters are null."""
    name = F.lit(project_id or "unknown").alias("project_id")
    if stats is None:
        return spark.range(1).select(name, F.lit("not_indexed").alias("status"), *(F.lit(None).cast("long").alias(c) for c in INFO))
    return stats.select(name, F.lit("indexed").alias("status"), *INFO)


def progress(done: int, total: int, elapsed: float) -> dict[str, float]:
    """Percentage, rate and seconds left of a run."""
    rate = done / max(elapsed, 0.001)
    share = min(100.0, max(0.0, 100.0 * done / total)) if total else 0.0
    return {"percentage": share, "rate": rate, "remaining": (total - done) / max(rate, 0.001)}
