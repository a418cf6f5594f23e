"""Change detection by content hash, and incremental maintenance of a snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import resolve, store
from lattica.session import checkpointed

#: Kinds of change.
ADDED, MODIFIED, DELETED = "Added", "Modified", "Deleted"


def changes(disk: DataFrame, files: DataFrame) -> DataFrame:
    """path, change_type of disk(path, content_hash) against file_info: one full outer join by path. A file that failed
    before has an empty hash, so it is always modified."""
    old = files.select(F.col("file_path").alias("path"), F.col("content_hash").alias("_old"), F.lit(True).alias("_had"))
    new = disk.select("path", F.col("content_hash").alias("_new"), F.lit(True).alias("_has"))
    kind = F.when(F.col("_had").isNull(), ADDED).when(F.col("_has").isNull(), DELETED).when(~F.col("_old").eqNullSafe(F.col("_new")), MODIFIED)
    return old.join(new, "path", "full_outer").withColumn("change_type", kind).where("change_type IS NOT NULL").select("path", "change_type")


class Change:
    """What a change of some files does to an index: symbols that come and go, and calls that are answered anew.

    Only what the changed files hold, or what names or calls their symbols, is looked for; the rest of the index stays as it is.
    """

    def __init__(self, tables: dict[str, DataFrame], changed: DataFrame, results: DataFrame, unresolved: DataFrame | None = None, project_id: str = "default"):
        self.changed, self.results = changed.select("path").distinct(), results
        self.fresh = checkpointed(resolve.deduplicated_symbols(resolve.raw_symbols(results), project_id))
        self.own = resolve.names_in_file(self.fresh)
        near = resolve.calls_in_file(results, self.own)
        of_file = F.col("file_path").alias("path")
        before = tables["symbols"].withColumn("path", of_file)
        old = before.join(self.changed, "path", "left_semi")
        #: id, name of the symbols that are gone.
        self.gone = checkpointed(old.join(self.fresh.select("id"), "id", "left_anti").select("id", F.col("qualified_name").alias("name")))
        self.near = near.calls
        #: Calls of the changed files that wait for other files, and older ones that name a new symbol.
        self.waiting = near.unresolved
        if unresolved is None:
            unresolved = tables.get("unresolved_calls")
        self.unresolved = unresolved
        if unresolved is not None:
            others = unresolved.join(self.changed.withColumnRenamed("path", "file"), "file", "left_anti")
            names = self.fresh.select(F.col("qualified_name").alias("caller")).distinct().withColumn("_new", F.lit(True))
            named = others.join(names, "caller", "left").join(names.toDF("callee", "_new2"), "callee", "left").where("_new OR _new2")
            self.waiting = self.waiting.unionByName(named.select(self.waiting.columns))
        calls = tables["call_relations"]
        own_file = calls.join(self.changed.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
        ends = lambda end: self.gone.select(F.col("id").alias(end))
        #: Calls of unchanged files into symbols that are gone, with the name they had; those from such symbols go with them.
        lost = own_file.join(ends("caller_id"), "caller_id", "left_anti").join(self.gone.select(F.col("id").alias("callee_id"), "name"), "callee_id")
        self.lost = checkpointed(lost)
        self.orphans = own_file.join(ends("caller_id"), "caller_id", "left_semi")
        # only names that some call asks for
        asked = self.waiting.select(F.col("caller").alias("qualified_name")).unionByName(self.waiting.select(F.col("callee").alias("qualified_name"))).unionByName(self.lost.select(F.col("name").alias("qualified_name"))).distinct()
        kept = before.join(self.changed, "path", "left_anti").withColumn("file", F.col("file_path")).withColumn("place", F.col("line"))
        columns = ("file", "place", "qualified_name", "is_definition", "id")
        names = resolve.names_in_project(self.fresh.select(*columns).unionByName(kept.select(*columns)).join(asked, "qualified_name", "left_semi"))
        self.across = checkpointed(resolve.calls_across_files(self.waiting, names))
        self.again = self.lost.drop("callee_id").join(names.withColumnRenamed("id", "callee_id"), "name")

    def files_of(self, records: DataFrame) -> dict[str, DataFrame]:
        """path: the files whose rows change, by table."""
        path = lambda df, c="file_path": df.select(F.col(c).alias("path"))
        own = {
            "symbols": [path(self.fresh)], "inheritance_relations": [path(self.fresh)], "file_info": [path(records)],
            "call_relations": [path(self.near), path(self.across), path(self.lost), path(self.orphans)],
            "include_relations": [path(resolve.include_rows(self.results), "source_file")],
            "reference_relations": [path(resolve.reference_rows(self.results, self.own))],
            "unresolved_calls": [path(self.waiting, "file"), path(self.across, "file")],
        }
        return {t: reduce(DataFrame.unionByName, [self.changed, *more]) for t, more in own.items()}

    def applied(self, tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
        """The tables after the change; of an index in buckets, those that hold files_of() are enough."""
        kept = store.without_files(tables, self.changed)
        out = dict(kept)
        out["symbols"] = kept["symbols"].unionByName(self.fresh.select(tables["symbols"].columns))
        gone = self.gone.select("id")
        old = kept["call_relations"].join(gone.toDF("caller_id"), "caller_id", "left_anti").join(gone.toDF("callee_id"), "callee_id", "left_anti")
        calls = resolve.call_rows(self.near.unionByName(self.across))
        out["call_relations"] = store.upserted(old.select(calls.columns).unionByName(self.again.select(calls.columns)), calls, ("id",))
        out["include_relations"] = kept["include_relations"].unionByName(resolve.include_rows(self.results))
        out["reference_relations"] = kept["reference_relations"].unionByName(resolve.reference_rows(self.results, self.own))
        out["inheritance_relations"] = kept["inheritance_relations"].unionByName(resolve.inheritance_rows(self.results, self.own))
        out["file_info"] = store.upserted(kept["file_info"], files, ("file_path",))
        waiting = self.waiting
        if self.unresolved is not None:
            held = tables.get("unresolved_calls", self.unresolved).join(self.changed.withColumnRenamed("path", "file"), "file", "left_anti")
            waiting = held.unionByName(waiting).dropDuplicates(["file", "ordinal"])
        out["unresolved_calls"] = resolve.still_unresolved(waiting, self.across)
        return out


def refreshed(tables: dict[str, DataFrame], changed: DataFrame, results: DataFrame, files: DataFrame, unresolved: DataFrame | None = None, project_id: str = "default") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, unresolved calls) after a change: what belongs to changed files goes, what was extracted anew comes in, and
    calls are resolved across files over the new whole, those of unchanged files that nothing had answered included (the
    snapshot's own, unless others are given)."""
    if unresolved is not None:
        tables = tables | {"unresolved_calls": unresolved}
    out = Change(tables, changed, results, unresolved, project_id).applied(tables, files)
    return out, out["unresolved_calls"]


def merged(snapshots: store.Snapshots, changed: DataFrame, results: DataFrame, files: DataFrame, project_id: str = "default") -> str:
    """The change as a new snapshot that shares with the last one all buckets in which no row changes."""
    changed, results = checkpointed(changed), checkpointed(results)
    change = Change(snapshots.read(), changed, results, project_id=project_id)
    touched = snapshots.buckets_of(change.files_of(files))
    return snapshots.rewrite(change.applied(snapshots.read(touched), files), touched)
