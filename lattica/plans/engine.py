"""CodeGraph: the query catalogue over one index, one method an operator, each returning a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.operators import analyzers, client, incremental, lookup, reports, resolve, rules, search, stats, store, traverse
from lattica.session import ship_package


class CodeGraph:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], project_id: str = "default", edges: DataFrame | None = None, snapshots: store.Snapshots | None = None):
        ship_package(spark)
        self.spark, self.tables, self.project_id = spark, tables, project_id
        self.symbols, self.calls, self.includes = tables["symbols"], tables["call_relations"], tables["include_relations"]
        self.references, self.inheritance, self.files = tables["reference_relations"], tables["inheritance_relations"], tables["file_info"]
        self._stored, self._edges, self._snapshots = edges, None, snapshots

    @classmethod
    def open(cls, spark: SparkSession, root: str, project_id: str = "default") -> CodeGraph:
        snapshots = store.Snapshots(spark, root)
        return cls(spark, snapshots.read(), project_id, snapshots.edges(), snapshots)

    @classmethod
    def build(
        cls, spark: SparkSession, root: str, results: DataFrame, files: DataFrame, project_id: str = "default",
        tree: DataFrame | None = None, folders: list[str] | None = None, flags: DataFrame | None = None,
    ) -> CodeGraph:
        """Writes a snapshot of the extraction results and opens it. With a tree(path), includes get the paths that they name
        in it, by the folders of all files and the flags(file, pos, folder) of each (compile_db.include_folders)."""
        tables = resolve.resolved_tables(results, project_id)
        if tree is not None:
            tables["include_relations"] = resolve.with_resolved_paths(tables["include_relations"], tree, folders, flags)
        store.Snapshots(spark, root).write(tables | {"file_info": files})
        return cls.open(spark, root, project_id)

    def edges(self) -> DataFrame:
        """Calls between logical nodes: those of the snapshot, else made once and kept for this engine's traversals."""
        if self._stored is not None:
            return self._stored
        if self._edges is None:
            self._edges = traverse.node_edges(self.calls, self.symbols).persist()
        return self._edges

    def close(self) -> None:
        if self._edges is not None:
            self._edges.unpersist()
            self._edges = None

    # lookups
    def symbol(self, id_): return lookup.symbol(self.symbols, id_)  # noqa: E704
    def symbol_field(self, id_, field): return lookup.symbol_field(self.symbols, id_, field)  # noqa: E704
    def symbols_by_ids(self, ids): return lookup.symbols_by_ids(self.symbols, ids)  # noqa: E704
    def symbols_in_file(self, path): return lookup.symbols_in_file(self.symbols, path)  # noqa: E704
    def file_record(self, path): return lookup.file_record(self.files, path)  # noqa: E704
    def failed_files(self): return lookup.failed_files(self.files)  # noqa: E704
    def parse_errors(self): return lookup.parse_errors(self.files)  # noqa: E704
    def indexed_files(self): return lookup.indexed_files(self.files)  # noqa: E704
    def references_of(self, id_): return lookup.references_of(self.references, id_)  # noqa: E704
    def includes_of(self, path): return lookup.includes_of(self.includes, path)  # noqa: E704
    def included_by(self, path): return lookup.included_by(self.includes, path)  # noqa: E704
    def all_includes(self): return lookup.all_includes(self.includes)  # noqa: E704
    def includers_of(self, path): return lookup.includers_of(self.includes, path)  # noqa: E704

    # search
    def search(self, query, kind=None, limit=50):
        """By the name index, where the engine has a snapshot."""
        if self._snapshots is not None:
            return self._snapshots.search(query, kind, limit)
        return search.search_api(self.symbols, query, kind, limit)

    # traversal
    def same_name_ids(self, id_): return traverse.same_name_ids(self.symbols, id_)  # noqa: E704
    def callers(self, id_, depth=1): return traverse.callers(self.edges(), self.symbols, id_, depth)  # noqa: E704
    def callees(self, id_, depth=1): return traverse.callees(self.edges(), self.symbols, id_, depth)  # noqa: E704
    def shortest_path(self, a, b): return traverse.shortest_path(self.calls, a, b)  # noqa: E704
    def call_trace(self, name, depth=5): return traverse.call_trace(self.calls, self.symbols, name, depth)  # noqa: E704
    def call_graph(self, root, depth=1): return traverse.call_graph(self.edges(), self.symbols, root, depth)  # noqa: E704
    def file_graph(self): return traverse.file_graph(self.includes)  # noqa: E704
    def impact(self, changed): return traverse.impact(self.includes, changed)  # noqa: E704
    def neighbourhood(self, id_): return client.neighbourhood(self.edges(), self.symbols, id_)  # noqa: E704

    # statistics
    def statistics(self): return stats.statistics(self.symbols, self.calls, self.includes, self.references, self.inheritance, self.files)  # noqa: E704
    def project_info(self): return stats.project_info(self.statistics(), self.project_id)  # noqa: E704

    # analyzers and rules
    def syscalls(self): return analyzers.syscalls(self.symbols)  # noqa: E704
    def ioctl_handlers(self): return analyzers.ioctl_handlers(self.symbols)  # noqa: E704
    def ipc_services(self): return analyzers.ipc_services(self.symbols)  # noqa: E704
    def service_registrations(self): return analyzers.service_registrations(self.symbols)  # noqa: E704
    def ipc_trace(self, service): return analyzers.ipc_trace(self.symbols, service)  # noqa: E704
    def apply_rules(self, found): return rules.apply_rules(self.symbols, found)  # noqa: E704

    # positions, reports
    def symbol_at(self, path, line): return client.symbol_at(self.symbols, path, line)  # noqa: E704
    def skill(self, name, **params): return reports.run_skill(name, self, **params)  # noqa: E704
    def context(self, path=None, id_=None): return reports.collect_context(self.edges(), self.symbols, path, id_)  # noqa: E704

    # maintenance
    def changes(self, disk): return incremental.changes(disk, self.files)  # noqa: E704

    def refreshed(self, changed, results, files, unresolved=None) -> tuple[CodeGraph, DataFrame]:
        tables, left = incremental.refreshed(self.tables, changed, results, files, unresolved, self.project_id)
        return CodeGraph(self.spark, tables, self.project_id), left
