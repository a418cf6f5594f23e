"""From extraction results to the graph's tables: de-duplication and name resolution, all as joins and aggregations.

Input rows are one file each: `file` and the nested columns of schema.EXTRACTION; or, with a column `part`, one part of a file,
so that no row grows with its file. Ids are hashes of natural keys, so they stay the same over incremental runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.schema import PART_ROWS, decoded
from lattica.session import stored


def _elements(results: DataFrame, field: str) -> DataFrame:
    """file, ordinal, _x: each element of a nested column, and its place in the file's order over all its parts."""
    part = F.coalesce("part", F.lit(0)) if "part" in results.columns else F.lit(0)
    each = results.select("file", part.alias("_part"), F.posexplode(field).alias("_pos", "_x"))
    return each.select("file", (F.col("_part") * PART_ROWS + F.col("_pos")).alias("ordinal"), "_x")


def exploded(results: DataFrame, field: str) -> DataFrame:
    """One row for each element of a nested column, with the file it is from and its ordinal there."""
    return _elements(results, field).select("file", "ordinal", "_x.*")


def file_order(path: Column) -> Column:
    """Files are in order of their path's components, not of the path as a string."""
    return F.split(path, "/")


def raw_symbols(results: DataFrame) -> DataFrame:
    return exploded(results, "symbols")


def deduplicated_symbols(raw: DataFrame, project_id: str = "default") -> DataFrame:
    """One row of each (qualified_name, file_path, line) in a file: the first definition, else the first row. `place` is the
    ordinal of the key's first row, which the row keeps; file is where it was extracted."""
    key = Window.partitionBy("file", "qualified_name", "file_path", "line")
    best = key.orderBy(F.col("is_definition").desc(), "ordinal")
    chosen = raw.withColumn("place", F.min("ordinal").over(key)).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "ordinal")
    id_ = F.xxhash64("file", "qualified_name", "file_path", "line")
    known = chosen.select(*(decoded(c) if c in ("kind", "access") else F.col(c) for c in chosen.columns))
    return known.withColumn("id", id_).withColumn("project_id", F.lit(project_id))


def names_in_file(symbols: DataFrame) -> DataFrame:
    """file, name, id: the last new symbol of a name in a file, definition or not."""
    return symbols.groupBy("file", F.col("qualified_name").alias("name")).agg(F.max_by("id", "place").alias("id"))


def names_in_project(symbols: DataFrame) -> DataFrame:
    """name, id: the last definition in the order of files and places, else the first declaration."""
    order = F.struct(file_order(F.col("file")).alias("f"), F.col("place").alias("p"))
    definition = F.max(F.when(F.col("is_definition"), F.struct(order.alias("o"), F.col("id").alias("id"))))
    return symbols.groupBy(F.col("qualified_name").alias("name")).agg(
        F.coalesce(definition["id"], F.min(F.struct(order.alias("o"), F.col("id").alias("id")))["id"]).alias("id")
    )


def _named(df: DataFrame, names: DataFrame, column: str, to: str, how: str, in_file: bool) -> DataFrame:
    keys = (["file"] if in_file else []) + [column]
    return df.join(names.withColumnRenamed("name", column).withColumnRenamed("id", to), keys, how)


@dataclass
class Resolved:
    calls: DataFrame
    unresolved: DataFrame


def calls_in_file(results: DataFrame, names: DataFrame) -> Resolved:
    """Calls with both ends in their own file, and the others."""
    return _resolved(_both_ends(results, names))


def _resolved(both: DataFrame) -> Resolved:
    ok = F.col("caller_id").isNotNull() & F.col("callee_id").isNotNull()
    return Resolved(both.where(ok), both.where(~ok).drop("caller_id", "callee_id"))


def _both_ends(results: DataFrame, names: DataFrame) -> DataFrame:
    """Calls with the ids of their ends in their own file, null where it has none."""
    raw = _elements(results, "calls").select("file", "ordinal", "_x.caller", "_x.callee", F.col("_x.file").alias("file_path"), "_x.line", "_x.column", "_x.is_virtual", "_x.is_indirect")
    return _named(_named(raw, names, "caller", "caller_id", "left", True), names, "callee", "callee_id", "left", True)


def calls_across_files(unresolved: DataFrame, names: DataFrame) -> DataFrame:
    """Calls whose ends both exist somewhere in the project."""
    return _named(_named(unresolved, names, "caller", "caller_id", "inner", False), names, "callee", "callee_id", "inner", False)


def still_unresolved(unresolved: DataFrame, across: DataFrame) -> DataFrame:
    """What a later file may answer: kept with the snapshot, so that the order in which files arrive doesn't matter."""
    return unresolved.join(across.select("file", "ordinal"), ["file", "ordinal"], "left_anti")


def _id(*columns: str) -> Column:
    return F.xxhash64(*columns).alias("id")


def call_rows(calls: DataFrame) -> DataFrame:
    return calls.select(_id("file", "ordinal", "caller", "callee", "file_path", "line", "column"), "caller_id", "callee_id", "file_path", "line", "column", "is_virtual", "is_indirect")


def include_rows(results: DataFrame) -> DataFrame:
    return exploded(results, "includes").select(_id("file", "ordinal", "source_file", "target_file", "line"), "source_file", "target_file", "line", "is_system", "resolved_path")


def normalised(path: Column) -> Column:
    """A path without empty and `.` components, and without `..` behind another component."""
    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("..")) != "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((part == "") | (part == "."), done).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def with_resolved_paths(includes: DataFrame, files: DataFrame, folders: list[str] | None = None, flags: DataFrame | None = None) -> DataFrame:
    """includes with resolved_path filled in where the tree, files(path), has what is spelt: beside the including file for
    quoted ones, then in the file's own folders, flags(file, pos, folder), then in the folders of all. The first counts."""
    own = F.regexp_replace("source_file", r"[^/]*$", "")
    order = F.struct(F.lit(0).alias("rank"), F.lit(0).alias("pos"), own.alias("folder"))
    all_ = [F.struct(F.lit(2).alias("rank"), F.lit(i).alias("pos"), F.lit(f.rstrip("/") + "/").alias("folder")) for i, f in enumerate(folders or [])]
    places = F.filter(F.array(F.when(~F.col("is_system"), order), *all_), lambda x: x.isNotNull())
    absolute = F.col("target_file").startswith("/")
    tried = includes.select("id", "source_file", "target_file", F.explode(F.when(absolute, F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("pos"), F.lit("").alias("folder")))).otherwise(places)).alias("x")).select("id", "target_file", "x.*")
    if flags is not None:
        each = includes.where(~absolute).join(flags.select(F.col("file").alias("source_file"), "pos", "folder"), "source_file")
        tried = tried.unionByName(each.select("id", "target_file", F.lit(1).alias("rank"), "pos", F.concat(F.regexp_replace("folder", "/+$", ""), F.lit("/")).alias("folder")))
    found = tried.withColumn("path", normalised(F.concat("folder", "target_file"))).join(files.select("path").distinct(), "path", "left_semi")
    first = found.groupBy("id").agg(F.min_by("path", F.struct("rank", "pos")).alias("_path"))
    return includes.join(first, "id", "left").withColumn("resolved_path", F.coalesce("resolved_path", "_path")).select(includes.columns)


def reference_rows(results: DataFrame, names: DataFrame) -> DataFrame:
    """References to names of their own file; those to other names are dropped."""
    raw = _elements(results, "references").select(
        "file", "ordinal", "_x.symbol_name", F.col("_x.file").alias("file_path"), "_x.line", "_x.column", "_x.ref_kind"
    )
    found = _named(raw, names, "symbol_name", "symbol_id", "inner", True)
    return found.select(_id("file", "ordinal", "symbol_name", "line", "column"), "symbol_id", "file_path", "line", "column", decoded("ref_kind"))


def inheritance_rows(results: DataFrame, names: DataFrame, strip_keywords: bool = False) -> DataFrame:
    """Bases and derived types within their own file. With strip_keywords, a base spelt `class X` or `struct X` is X."""
    raw = exploded(results, "inherits")
    if strip_keywords:
        raw = raw.withColumn("base", F.regexp_replace("base", r"^(?:class|struct)\s+", ""))
    found = _named(_named(raw, names, "derived", "derived_id", "inner", True), names, "base", "base_id", "inner", True)
    return found.select(_id("file", "ordinal", "derived", "base"), "derived_id", "base_id", decoded("access"), "is_virtual")


def resolved_tables(results: DataFrame, project_id: str = "default") -> dict[str, DataFrame]:
    """All tables but file_info from the extraction results of a project. What several of them are made of is stored once:
    the results, whose documents would be read anew for each, the symbols, and the calls as their own files resolve them."""
    results = stored(results)
    symbols = stored(deduplicated_symbols(raw_symbols(results), project_id))
    own = names_in_file(symbols)
    near = _resolved(stored(_both_ends(results, own)))
    across = calls_across_files(near.unresolved, names_in_project(symbols))
    calls = near.calls.unionByName(across)
    return {
        "symbols": symbols.select(
            "id", "name", "qualified_name", "kind", "sub_kind", "file_path", "line", "column", "end_line", "is_definition", "return_type", "parameters", "access", "attributes", "project_id"
        ),
        "call_relations": call_rows(calls),
        "include_relations": include_rows(results),
        "reference_relations": reference_rows(results, own),
        "inheritance_relations": inheritance_rows(results, own),
        "unresolved_calls": still_unresolved(near.unresolved, across),
    }
