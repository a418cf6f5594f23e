"""Snapshots of the graph as Parquet folders, and the DML of the catalogue as set operations on DataFrames."""

from __future__ import annotations

import json
import os
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import name_index
from lattica.operators.traverse import node_edges
from lattica.schema import CALLS, KEYS, KINDS, TABLES, struct_of

#: The folder of the calls between logical nodes.
EDGES = "call_edges"
EDGE_SCHEMA = f"{CALLS}, caller_name string, callee_name string"


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {t: spark.createDataFrame([], struct_of(t)) for t in TABLES}


def upserted(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """old and new with one row of each key (keys aren't null): the new one, if both have it. Of new rows of one key, any one
    stays. The old table isn't moved where the new keys are few."""
    kept = old.join(new.select(*keys), list(keys), "left_anti").select(old.columns)
    return kept.unionByName(new.dropDuplicates(list(keys)))


def upserted_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols replace those of the same id, and those of the same (qualified_name, file_path, line)."""
    kept = old.join(new.select("id"), "id", "left_anti").join(new.select(*KEYS["symbols"]), list(KEYS["symbols"]), "left_anti")
    return kept.unionByName(new)


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows are added; an id that exists already fails the job that reads the result. Only the ids of the old rows that the
    new ones have are moved, not the old table."""
    known = old.join(new.select("id"), "id", "left_semi").select("id")
    times = new.select("id").unionByName(known).groupBy("id").agg(F.count(F.lit(1)).alias("_times"))
    error = F.raise_error(F.concat(F.lit("duplicate id "), F.col("id").cast("string"))).cast("long")
    checked = new.join(times, "id").withColumn("id", F.when(F.col("_times") == 1, F.col("id")).otherwise(error))
    return old.unionByName(checked.select(new.columns))


def without_files(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """The tables without what belongs to the files (a table with a column file_path): calls and references by their site,
    includes by their source, inheritance by the derived symbol's file, symbols, file records."""
    gone = files.select(F.col(files.columns[0]).alias("file_path")).distinct()
    symbols = tables["symbols"]
    derived = symbols.join(gone, "file_path", "left_semi").select(F.col("id").alias("derived_id"))
    out = {t: tables[t].join(gone, "file_path", "left_anti").select(tables[t].columns) for t in ("symbols", "call_relations", "reference_relations", "file_info")}
    out["include_relations"] = tables["include_relations"].join(gone.withColumnRenamed("file_path", "source_file"), "source_file", "left_anti").select(tables["include_relations"].columns)
    if "unresolved_calls" in tables:
        waiting = tables["unresolved_calls"]
        out["unresolved_calls"] = waiting.join(gone.withColumnRenamed("file_path", "file"), "file", "left_anti").select(waiting.columns)
    out["inheritance_relations"] = tables["inheritance_relations"].join(derived, "derived_id", "left_anti").select(tables["inheritance_relations"].columns)
    return out


#: The column with the file that a row belongs to, by which tables are dealt into buckets; inheritance goes by the file of the
#: derived symbol.
OWNER = {
    "symbols": "file_path", "call_relations": "file_path", "include_relations": "source_file", "reference_relations": "file_path",
    "inheritance_relations": None, "file_info": "file_path", "unresolved_calls": "file", EDGES: "file_path",
}
#: How rows are laid out within a bucket, for scans that skip row groups.
ORDER = {"call_relations": "callee_id", "reference_relations": "symbol_id", "symbols": "qualified_name", "include_relations": "source_file", EDGES: "callee_name", name_index.HEADS: "at", name_index.GRAMS: "gram"}
#: Symbols of a bucket, about, unless the number of buckets is given; and the most buckets that are chosen so.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 65_536


#: The column whose values a bucket's rows are counted by; the others are counted as a whole.
COUNTED = {"symbols": "kind", "file_info": "parse_status"}


def bucket_of(path: Column, buckets: int) -> Column:
    """The bucket of a file: the first 32 bits of its path's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(path, F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


class Snapshots:
    """Immutable snapshots under one folder, and a pointer for each: an empty file CURRENT-number-name. The highest counts.

    Tables lie in buckets by the hash of a row's file. A snapshot is a manifest that lists each table's bucket folders, so one that
    follows a change of some files writes only the buckets that hold them and shares the others with the one before.

    A pointer appears by one rename once its manifest is whole, and no file is ever replaced, so a reader always finds one
    whole snapshot; a build never changes what a reader has open, and one that fails leaves no pointer. Of two builds upon the
    same snapshot, the later one fails.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[tuple[int, str]]:
        fs, p = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n.split("-")[1]), n.split("-", 2)[2]) for n in names if n.startswith("CURRENT-"))

    def current(self) -> str | None:
        found = self._pointers()
        return found[-1][1] if found else None

    def initialize(self) -> None:
        """Creates an empty index unless there is one."""
        if self.current() is None:
            self.write(empty_tables(self.spark))

    def manifest(self, name: str | None = None) -> dict:
        """buckets, and by table and bucket the folder with its bytes, of the current snapshot or the one named."""
        name = name or self.current()
        if name is None:
            raise FileNotFoundError(f"no index under {self.root}")
        fs, p = self._fs(f"{self.root}/manifests/{name}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _stored(self, table: str, df: DataFrame, symbols: DataFrame, buckets: int) -> dict[str, dict]:
        """Writes rows into new bucket folders: {bucket: {path, bytes}}. Buckets with much are written by several tasks."""
        if "bucket" in df.columns:
            placed = df
        elif OWNER[table]:
            placed = df.withColumn("bucket", bucket_of(F.col(OWNER[table]), buckets))
        else:
            of = symbols.select(F.col("id").alias("derived_id"), bucket_of(F.col("file_path"), buckets).alias("bucket"))
            placed = df.join(of, "derived_id", "left").withColumn("bucket", F.coalesce("bucket", bucket_of(F.lit(""), buckets)))
        where = f"data/{table}-{uuid.uuid4().hex}"
        order = ["bucket", *([ORDER[table]] if table in ORDER else [])]
        placed.hint("rebalance", F.col("bucket")).sortWithinPartitions(*order).write.option("parquet.page.row.count.limit", name_index.PAGE_ROWS if table == name_index.HEADS else 20_000).partitionBy("bucket").parquet(f"{self.root}/{where}")
        fs, p = self._fs(f"{self.root}/{where}")
        found: dict[str, dict] = {}
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            if (m := re.search(r"/bucket=(\d+)/[^/]*$", f.getPath().toString())) and not f.getPath().getName().startswith(("_", ".")):
                entry = found.setdefault(m[1], {"path": f"{where}/bucket={m[1]}", "bytes": 0})
                entry["bytes"] += f.getLen()
        return found

    def _published(self, manifest: dict, base: str | None) -> str:
        name = f"snapshot-{uuid.uuid4().hex}"
        fs, p = self._fs(f"{self.root}/manifests/{name}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        before = self._pointers()
        if (before[-1][1] if before else None) != base:
            raise RuntimeError(f"another build has changed {self.root} meanwhile")
        fs, part = self._fs(f"{self.root}/.{name}")
        fs.create(part, True).close()
        fs.rename(part, self._fs(f"{self.root}/CURRENT-{before[-1][0] + 1 if before else 0:012d}-{name}")[1])
        for number, old in before[:-1]:  # the last one stays for readers that have just listed it
            fs.delete(self._fs(f"{self.root}/CURRENT-{number:012d}-{old}")[1], False)
        return name

    def write(self, tables: dict[str, DataFrame]) -> str:
        """A snapshot of whole tables, in the columns of their schema, and of the calls between logical nodes."""
        base = self.current()
        typed = {t: tables[t].select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in struct_of(t))) for t in TABLES}
        buckets = self.buckets or max(1, min(MOST_BUCKETS, typed["symbols"].count() // BUCKET_ROWS))
        folders = {"symbols": self._stored("symbols", typed["symbols"], None, buckets)}
        symbols = self._read("symbols", folders["symbols"])
        for t in TABLES:
            if t != "symbols":
                folders[t] = self._stored(t, typed[t], symbols, buckets)
        folders[EDGES] = self._stored(EDGES, node_edges(self._read("call_relations", folders["call_relations"]), symbols), symbols, buckets)
        folders |= self._indexed(symbols, buckets)
        self._counted(folders)
        return self._published({"buckets": buckets, "tables": folders}, base)

    def _indexed(self, symbols: DataFrame, buckets: int) -> dict[str, dict]:
        """The name index of some buckets' symbols."""
        heads = self._stored(name_index.HEADS, name_index.heads(symbols, bucket_of(F.col("file_path"), buckets)), symbols, buckets)
        bucket = F.shiftright("at", name_index.BUCKET_BITS).cast("int")
        return {name_index.HEADS: heads, name_index.GRAMS: self._stored(name_index.GRAMS, name_index.postings(self._read(name_index.HEADS, heads).withColumn("bucket", bucket)), symbols, buckets)}

    def _counted(self, new: dict[str, dict[str, dict]]) -> None:
        """Adds to bucket folders that have just been written what they hold: rows by kind, by status, or all. One pass over a
        column of each."""
        each = []
        for t, found in new.items():
            if t in TABLES and found:
                tag = F.coalesce(F.col(COUNTED[t]), F.lit("")) if t in COUNTED else F.lit("")
                number = F.regexp_extract(F.input_file_name(), r"/bucket=(\d+)/", 1)
                each.append(self._read(t, found).select(F.lit(t).alias("t"), number.alias("bucket"), tag.alias("tag")).groupBy("t", "bucket", "tag").agg(F.count(F.lit(1)).alias("n")))
        for r in union_all(each).collect() if each else ():  # a row for each table, bucket and kind
            new[r["t"]][r["bucket"]].setdefault("counts", {})[r["tag"]] = r["n"]

    def counters(self) -> DataFrame:
        """The statistics of the index (stats.statistics) as sums of its buckets' counters: no table is read, and a change counts
        anew only the buckets that it writes."""
        tables = self.manifest()["tables"]
        rows = lambda t, tag=None: sum(n for x in tables[t].values() for k, n in x.get("counts", {}).items() if tag is None or k == tag)
        by_kind = {f"total_{k}s": rows("symbols", k) for k in KINDS}
        found = {
            "total_files": rows("file_info"), "parsed_files": rows("file_info", "success"), "failed_files": rows("file_info", "failed"), "total_symbols": rows("symbols"), **by_kind,
            "total_call_relations": rows("call_relations"), "total_include_relations": rows("include_relations"), "total_reference_relations": rows("reference_relations"),
            "total_inheritance_relations": rows("inheritance_relations"), "elapsed_seconds": 0.0,
        }
        return self.spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} {'double' if k == 'elapsed_seconds' else 'long'}" for k in found))

    def buckets_of(self, files: dict[str, DataFrame]) -> dict[str, set[str]]:
        """The buckets of some files, path, by table."""
        buckets = self.manifest()["buckets"]
        each = [df.select(F.lit(t).alias("t"), bucket_of(F.col("path"), buckets).alias("bucket")) for t, df in files.items()]
        out: dict[str, set[str]] = {t: set() for t in files}
        for r in union_all(each).distinct().collect():  # a row for each table and bucket
            out[r["t"]].add(str(r["bucket"]))
        return out

    def rewrite(self, tables: dict[str, DataFrame], touched: dict[str, set[str]]) -> str:
        """A snapshot in which some buckets of each table have new rows, those in `tables`; all others are the current one's."""
        base = self.current()
        before = self.manifest(base)
        buckets, folders = before["buckets"], {t: dict(x) for t, x in before["tables"].items()}
        written: dict[str, dict[str, dict]] = {}

        def replaced(t: str, df: DataFrame, symbols: DataFrame | None, own: set[str]) -> None:
            if own:
                new = self._stored(t, df, symbols, buckets)
                if stray := new.keys() - own:
                    raise ValueError(f"rows of {t} in buckets that aren't rewritten: {sorted(stray)}")
                folders[t] = {k: x for k, x in folders[t].items() if k not in own} | new
                written[t] = new

        typed = {t: tables[t].select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in struct_of(t))) for t in touched}
        replaced("symbols", typed["symbols"], None, touched["symbols"])
        symbols = self._read("symbols", folders["symbols"])
        for t in TABLES:
            if t != "symbols":
                replaced(t, typed[t], symbols, touched[t])
        own = touched["call_relations"]
        calls = self._read("call_relations", {k: x for k, x in folders["call_relations"].items() if k in own})
        replaced(EDGES, node_edges(calls, symbols), symbols, own)
        own = touched["symbols"]
        new = self._indexed(self._read("symbols", {k: x for k, x in folders["symbols"].items() if k in own}), buckets)
        folders |= {t: {k: x for k, x in folders[t].items() if k not in own} | new[t] for t in new}
        self._counted(written)
        return self._published({"buckets": buckets, "tables": folders}, base)

    def _read(self, table: str, folders: dict[str, dict]) -> DataFrame:
        schema = struct_of(table) if table in TABLES else EDGE_SCHEMA if table == EDGES else name_index.schema_of(table)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{x['path']}" for _, x in sorted(folders.items())))

    def read(self, only: dict[str, set[str]] | None = None) -> dict[str, DataFrame]:
        """All tables, or those buckets of each."""
        tables = self.manifest()["tables"]
        return {t: self._read(t, tables[t] if only is None else {k: x for k, x in tables[t].items() if k in only[t]}) for t in TABLES}

    def edges(self) -> DataFrame:
        """The calls between logical nodes (traverse.node_edges) of the current snapshot."""
        return self._read(EDGES, self.manifest()["tables"][EDGES])

    def search(self, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
        """Ranked symbol search by the index of the current snapshot."""
        tables = self.manifest()["tables"]
        symbols, heads, lists = (self._read(t, tables[t]) for t in ("symbols", name_index.HEADS, name_index.GRAMS))
        return name_index.indexed_search(symbols, heads, lists, query, kind, limit)

    def vacuum(self) -> int:
        """Deletes bucket folders and manifests that no pointer leads to any more; returns how many. Not to be run beside a build."""
        names = [n for _, n in self._pointers()]
        used = {x["path"] for n in names for folders in self.manifest(n)["tables"].values() for x in folders.values()}
        deleted = 0
        for folder, kept in (("data", lambda p: any(u.startswith(p + "/") for u in used)), ("manifests", lambda p: p.removesuffix(".json").rpartition("/")[2] in names)):
            fs, p = self._fs(f"{self.root}/{folder}")
            for status in fs.listStatus(p):
                path = f"{folder}/{status.getPath().getName()}"
                if not kept(path):
                    fs.delete(status.getPath(), True)
                    deleted += 1
                elif folder == "data":
                    for below in fs.listStatus(status.getPath()):
                        name = below.getPath().getName()
                        if name.startswith("bucket=") and f"{path}/{name}" not in used:
                            fs.delete(below.getPath(), True)
                            deleted += 1
        return deleted


def packed(df: DataFrame, key: str) -> DataFrame:
    """key and the row's JSON as base64: rows that can travel in a text protocol."""
    return df.select(F.col(key), F.base64(F.to_json(F.struct(*(F.col(c) for c in df.columns)), {"ignoreNullFields": "false"}).cast("binary")).alias("payload"))


def unpacked(df: DataFrame, table: str) -> DataFrame:
    return df.select(F.from_json(F.unbase64("payload").cast("string"), struct_of(table)).alias("r")).select("r.*")


class JsonStore:
    """Pretty JSON documents, one file each in a driver-side folder: projects, configuration, conversations."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def save(self, key: str, document: dict) -> None:
        path = os.path.join(self.folder, f"{key}.json")
        with open(f"{path}.part", "w", encoding="utf-8") as f:
            json.dump(document, f, ensure_ascii=False, indent=2)
        os.replace(f"{path}.part", path)

    def get(self, key: str) -> dict:
        with open(os.path.join(self.folder, f"{key}.json"), encoding="utf-8") as f:
            return json.load(f)

    def delete(self, key: str) -> None:
        os.remove(os.path.join(self.folder, f"{key}.json"))

    def listed(self) -> list[dict]:
        """All readable documents, the last updated first; unreadable ones are left out."""
        out = []
        for name in sorted(os.listdir(self.folder)):
            if name.endswith(".json"):
                try:
                    out.append(self.get(name[:-5]))
                except (OSError, ValueError):
                    continue
        return sorted(out, key=lambda d: str(d.get("updated_at", "")), reverse=True)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same documents as a DataFrame; what doesn't parse is left out."""
    fields = f"{schema}, _bad string"
    df = spark.read.schema(fields).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.where("_bad IS NULL").drop("_bad").orderBy(F.desc("updated_at"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
