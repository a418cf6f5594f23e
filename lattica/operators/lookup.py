"""Point lookups, filters and projections over the graph's tables. Every limit has a total order, by id at the end."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symbol(symbols: DataFrame, id_: int) -> DataFrame:
    return symbols.where(F.col("id") == F.lit(id_))


def symbol_field(symbols: DataFrame, id_: int, field: str) -> DataFrame:
    """One field of a symbol; `name` is its qualified name."""
    source = {"name": "qualified_name", "kind": "kind", "file": "file_path", "line": "line"}[field]
    return symbol(symbols, id_).select(F.col(source).alias(field))


def symbols_by_ids(symbols: DataFrame, ids: Iterable[int] | DataFrame) -> DataFrame:
    """Symbols whose id is listed; repetitions in the list don't multiply rows. A DataFrame of ids is joined."""
    if isinstance(ids, DataFrame):
        return symbols.join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_semi")
    ids = sorted(set(ids))
    return symbols.where(F.col("id").isin(ids)) if ids else symbols.limit(0)


def symbols_in_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("file_path") == path).orderBy("line", "id")


def file_record(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("file_path") == path)


def failed_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("parse_status") == "failed")


def parse_errors(files: DataFrame) -> DataFrame:
    return failed_files(files).select("file_path", "error_message", "last_modified")


def indexed_files(files: DataFrame) -> DataFrame:
    return files.select("file_path")


def references_of(references: DataFrame, symbol_id: int) -> DataFrame:
    """References to this very id; symbols of the same qualified name are not merged."""
    return references.where(F.col("symbol_id") == symbol_id).orderBy("file_path", "line", "id")


def includes_of(includes: DataFrame, path: str) -> DataFrame:
    return includes.where(F.col("source_file") == path).orderBy("line", "id")


def included_by(includes: DataFrame, spelling: str) -> DataFrame:
    """Includes that spell the target this way; resolved paths don't count."""
    return includes.where(F.col("target_file") == spelling).orderBy("source_file", "id")


def all_includes(includes: DataFrame) -> DataFrame:
    return includes.orderBy("source_file", "line", "id")


def includers_of(includes: DataFrame, target: str) -> DataFrame:
    """Files that include the target by its spelling or its resolved path."""
    hit = (F.col("target_file") == target) | (F.col("resolved_path") == target)
    return includes.where(hit).select("source_file").distinct()


def include_edges(includes: DataFrame) -> DataFrame:
    """source, target: an edge for the spelling and one for the resolved path, so a closure needs equi-joins only."""
    spelt = includes.select(F.col("source_file").alias("source"), F.col("target_file").alias("target"))
    resolved = includes.where("resolved_path IS NOT NULL").select(F.col("source_file").alias("source"), F.col("resolved_path").alias("target"))
    return spelt.unionByName(resolved).distinct()


def includers_of_all(includes: DataFrame, targets: DataFrame) -> DataFrame:
    """target, source_file for a table of targets: two equi-joins, by spelling and by resolved path."""
    edges = include_edges(includes)
    return edges.join(targets.select(F.col(targets.columns[0]).alias("target")), "target", "left_semi").select("target", F.col("source").alias("source_file"))


def with_endpoint(relations: DataFrame, symbols: DataFrame, id_column: str, prefix: str, missing: str = "symbol_") -> DataFrame:
    """relations with name, kind, file and line of the symbol an id column points to; an unknown one is named missing + id."""
    side = symbols.select(
        F.col("id").alias(id_column), F.col("qualified_name").alias(f"{prefix}_name"), F.col("kind").alias(f"{prefix}_kind"),
        F.col("file_path").alias(f"{prefix}_file"), F.col("line").alias(f"{prefix}_line"),
    )
    name: Column = F.coalesce(f"{prefix}_name", F.concat(F.lit(missing), F.col(id_column).cast("string")))
    return relations.join(side, id_column, "left").withColumn(f"{prefix}_name", name)


def calls_with_callee(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The one inner join of the catalogue: calls and the symbol they call."""
    return calls.select(F.col("id").alias("call_id"), "caller_id", F.col("callee_id").alias("id")).join(symbols, "id")
