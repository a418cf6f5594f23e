"""More queries of the catalogue: sources, extraction, building, maintaining and storing an index."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import incremental, reports, resolve, rules, stats, store
from lattica.plans.catalogue import _ALL, _CALLS, _COUNT, _DEDUP, _REP, _results, _search_sql, query
from lattica.schema import TABLES
from lattica.session import checkpointed, work_folder
from lattica.sources import extraction, files, rules_file, tree_source

# Paths of a store below their root, some in folders that are skipped, some no sources.
_TREE = """tree AS (SELECT CASE p_partkey % 7 WHEN 0 THEN 'src/tests/' WHEN 1 THEN 'examples/' WHEN 2 THEN 'src/test_data/' WHEN 3 THEN '' ELSE 'src/a' || CAST(p_size % 5 AS VARCHAR) || '/' END ||
CASE WHEN p_partkey % 13 = 0 THEN '._' ELSE '' END || replace(p_name, ' ', '_') || CAST(p_partkey AS VARCHAR) || CASE p_size % 6 WHEN 0 THEN '.c' WHEN 1 THEN '.CPP' WHEN 2 THEN '.hxx' WHEN 3 THEN '.txt' WHEN 4 THEN '' ELSE '.h' END AS path FROM part)"""


@query("s1_sources_of_a_store", "parts", r"""SELECT path FROM tree WHERE NOT regexp_matches('/' || path, '/(tests|examples)/') AND NOT regexp_matches(path, '(^|/)\._[^/]*$') AND regexp_matches(lower(path), '\.(c|cpp|hxx|h)$')""", _TREE)
def _(p): return files.sources_among(_tree_paths(p).select("path"))


def _tree_paths(p: DataFrame) -> DataFrame:
    """path of each part's file below the root, and the part's name."""
    key = F.col("p_partkey")
    folder = F.when(key % 7 == 0, "src/tests/").when(key % 7 == 1, "examples/").when(key % 7 == 2, "src/test_data/").when(key % 7 == 3, "").otherwise(F.concat(F.lit("src/a"), (F.col("p_size") % 5).cast("string"), F.lit("/")))
    ending = F.element_at(F.array(*map(F.lit, (".c", ".CPP", ".hxx", ".txt", "", ".h"))), (F.col("p_size") % 6 + 1).cast("int"))
    name = F.concat(F.when(key % 13 == 0, "._").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), key.cast("string"))
    return p.select(F.concat(folder, name, ending).alias("path"), "p_name")


def _planted(root: str):
    """Writes a file for each row, on the executors: path below the root, and its content."""

    def write(batches):
        for batch in batches:
            for path, text in zip(batch["path"], batch["p_name"]):
                whole = os.path.join(root, path)
                os.makedirs(os.path.dirname(whole), exist_ok=True)
                with open(whole, "w") as f:
                    f.write(text)
            yield batch[["path"]]

    return write


@query("s1_source_tree", "parts", r"""SELECT path, CAST(octet_length(encode(p_name)) AS BIGINT) AS size, sha256(p_name) AS content_hash FROM named
WHERE NOT regexp_matches('/' || path, '/(tests|examples)/') AND NOT regexp_matches(path, '(^|/)\._[^/]*$') AND regexp_matches(lower(path), '\.(c|cpp|hxx|h)$')""", _TREE + ", named AS (" + _TREE[len("tree AS (SELECT "):].replace(" AS path FROM part)", " AS path, p_name FROM part)").join(["SELECT ", ""]))
def _(p):
    """A tree with a file for each part, written, walked and hashed by the executors."""
    spark = p.sparkSession
    root = f"{work_folder(spark)}/tree-{uuid.uuid4().hex}".removeprefix("file://")
    checkpointed(_tree_paths(p).mapInPandas(_planted(root), "path string"))
    found = tree_source.tree(spark, root, partitions=16)
    return found.select(F.substring("path", len(root) + 2, 10_000).alias("path"), "size", "content_hash")


#: One small source file of each part, by its key k and size z, and what is in it: (what, name, more, line).
_SOURCE = """#include "h{m}.h"
enum Color{k} {{ RED{k} }};
typedef unsigned long size{k};
class Base{k} : public Root, private Side {{
 public:
  virtual int run(int n) {{ return n; }}
 private:
  int field{k};
}};
static const int limit{k} = {z};
int total{k} = 0;
int work{k}(Base{k} *b, int n) {{
  int local{k} = limit{k};
  total{k} = local{k} + b->run(n);
  other(&total{k});
  return total{k};
}}
"""
_FACTS = [
    ("include", "h{m}.h", "false", 1), ("symbol", "Color{k}", "type enum", 2), ("symbol", "size{k}", "type typedef unsigned long", 3), ("symbol", "Base{k}", "type class", 4), ("inherit", "Base{k}", "Root public", 0),
    ("inherit", "Base{k}", "Side private", 0), ("symbol", "Base{k}::run", "function int public", 6), ("symbol", "Base{k}::field{k}", "variable member int private", 8), ("symbol", "limit{k}", "variable const int", 10),
    ("symbol", "total{k}", "variable int", 11), ("symbol", "work{k}", "function int", 12), ("symbol", "local{k}", "variable int", 13), ("reference", "limit{k}", "read", 13), ("reference", "total{k}", "write", 14),
    ("reference", "local{k}", "read", 14), ("call", "work{k}", "Base{k}::run true", 14), ("call", "work{k}", "other false", 15), ("reference", "total{k}", "address", 15), ("reference", "total{k}", "read", 16),
]


def _spliced(text: str, quote: str, k: str, m: str, z: str) -> str:
    """A template as an SQL concatenation."""
    out = quote + text.replace("'", "''").replace("{{", "{").replace("}}", "}") + quote
    for name, e in (("{k}", k), ("{m}", m), ("{z}", z)):
        out = out.replace(name, f"{quote} || {e} || {quote}")
    return out


def _facts_sql() -> str:
    cast = lambda e: f"CAST({e} AS VARCHAR)"
    text = lambda t: _spliced(t, "'", cast("p_partkey"), cast("p_partkey % 50"), cast("p_size"))
    rows = ", ".join(f"{{'what': '{w}', 'name': {text(n)}, 'more': {text(m)}, 'line': {line}}}" for w, n, m, line in _FACTS)
    return f"SELECT file, x.what AS what, x.name AS name, x.more AS more, CAST(x.line AS INTEGER) AS line FROM (SELECT 'gen/p' || {cast('p_partkey')} || '.cpp' AS file, unnest([{rows}]) AS x FROM part)"


@query("s5_lexical_extraction", "parts", _facts_sql())
def _(p):
    """The extractor runs on the executors over a file for each part; all kinds of what it finds, in one table."""
    parts = F.split(F.lit(_SOURCE.replace("{{", "\x01").replace("}}", "\x02").replace("{m}", "\x05").replace("{z}", "\x06").replace("{k}", "\x07")), "\x00")[0]
    for mark, value in (("\x05", F.col("p_partkey") % 50), ("\x06", F.col("p_size")), ("\x07", F.col("p_partkey"))):
        parts = F.replace(parts, F.lit(mark), value.cast("string"))
    text = F.translate(parts, "\x01\x02", "{}")
    # a part's row is a few bytes and its file's reading is work: the table's own splits would keep few cores busy
    dealt = p.select("p_partkey", "p_size").repartition(4 * p.sparkSession.sparkContext.defaultParallelism, "p_partkey")
    own = dealt.select(F.concat(F.lit("gen/p"), F.col("p_partkey").cast("string"), F.lit(".cpp")).alias("path"), text.cast("binary").alias("content"))
    r = extraction.decoded(extraction.extracted(own, extraction.lexical).where("json IS NOT NULL").select("file", "json"))

    def rows(field: str, what: str, name: str, more: list[str], line: bool = True):
        fact = lambda x: F.struct(F.lit(what).alias("what"), x[name].alias("name"), F.concat_ws(" ", *(x[m].cast("string") for m in more)).alias("more"), (x["line"] if line else F.lit(0)).alias("line"))
        return F.transform(field, fact)

    # one explode of all kinds: a union of five would run the extractor five times
    facts = F.concat(
        rows("symbols", "symbol", "qualified_name", ["kind", "sub_kind", "return_type", "access"]), rows("calls", "call", "caller", ["callee", "is_virtual"]), rows("includes", "include", "target_file", ["is_system"]),
        rows("inherits", "inherit", "derived", ["base", "access"], False), rows("references", "reference", "symbol_name", ["ref_kind"]),
    )
    return r.select("file", F.explode(facts).alias("x")).select("file", "x.*")


@query("s5h_resolved_includes", "include_relations", """SELECT id, source_file, target_file, is_system, CASE WHEN EXISTS (SELECT 1 FROM f_include_relations o WHERE o.source_file = 'inc/' || i.target_file) THEN 'inc/' || target_file END AS resolved_path FROM f_include_relations i""")
def _(i):
    """The tree has the headers that include something themselves; `inc/x/..` and `inc` are the same folder."""
    tree = i.where("source_file LIKE 'inc/%'").select(F.col("source_file").alias("path"))
    bare = i.withColumn("resolved_path", F.lit(None).cast("string"))
    return resolve.with_resolved_paths(bare, tree, ["lib", "inc/x/../"]).select("id", "source_file", "target_file", "is_system", "resolved_path")


def _documents(symbols: DataFrame | None = None, includes: DataFrame | None = None) -> DataFrame:
    """file, json: extraction documents of flat rows."""
    none = F.array()
    nested = []
    for name, df in (("symbols", symbols), ("includes", includes)):
        if df is not None:
            nested.append(df.groupBy("file").agg(F.collect_list(F.struct(*(c for c in df.columns if c != "file"))).alias(name)))
    own = nested[0]
    fields = [F.col(n) if n in own.columns else none.alias(n) for n in ("symbols", "calls", "includes", "inherits")]
    return own.select("file", F.to_json(F.struct(*fields)).alias("json"))


@query("s6_json_decode", "raw_symbols", 'SELECT file, name, qualified_name, kind, line, "column", is_definition FROM f_raw_symbols')
def _(r): return resolve.exploded(extraction.decoded(_documents(r.drop("ordinal"))), "symbols").select("file", "name", "qualified_name", "kind", "line", "column", "is_definition")


@query("s11_includes", "include_relations", "SELECT source_file, target_file, line, is_system, resolved_path FROM f_include_relations")
def _(i):
    own = i.select(F.col("source_file").alias("file"), "source_file", "target_file", "line", "is_system", "resolved_path")
    return resolve.include_rows(extraction.decoded(_documents(includes=own))).drop("id")


_RULE_TEXT = """
- {name: ioctl, description: an ioctl, severity: Error, pattern: {name_regex: '_ioctl$', symbol_kind: function}}
- {name: plain, description: plain, severity: Info, action: Highlight, pattern: {name_regex: '^[a-z_]+$', file_pattern: 'f1'}}
"""


@query("s16_rules_file", "kernel_symbols", """SELECT 'ioctl' AS rule_name, name AS symbol_name, file_path, line, 'an ioctl' AS message, CAST(0 AS INTEGER) AS rule_ord FROM f_kernel_symbols WHERE is_definition AND kind = 'function' AND (regexp_matches(name, '_ioctl$') OR regexp_matches(qualified_name, '_ioctl$')) UNION ALL
SELECT 'plain', name, file_path, line, 'plain', 1 FROM f_kernel_symbols WHERE is_definition AND regexp_matches(file_path, 'f1') AND (regexp_matches(name, '^[a-z_]+$') OR regexp_matches(qualified_name, '^[a-z_]+$'))""")
def _(s):
    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as f:  # the driver's own input, read at once
        f.write(_RULE_TEXT)
        f.flush()
        found = rules_file.load_rules(f.name)
    return rules.apply_rules(s, found)


@query("a7_many_rules", "symbols", """SELECT 'r' || CAST(i AS VARCHAR) AS rule_name, name AS symbol_name, file_path, line, 'm' AS message, CAST(i AS INTEGER) AS rule_ord FROM f_symbols, range(400) AS r(i) WHERE is_definition AND (i % 3 <> 0 OR kind = 'function')
AND (regexp_matches(name, '^brand' || CAST(i % 25 + 1 AS VARCHAR) || '::.*' || chr(CAST(97 + i % 26 AS INTEGER)) || '[a-m]') OR regexp_matches(qualified_name, '^brand' || CAST(i % 25 + 1 AS VARCHAR) || '::.*' || chr(CAST(97 + i % 26 AS INTEGER)) || '[a-m]'))""")
def _(s):
    found = [rules.Rule(f"r{i}", "m", f"^brand{i % 25 + 1}::.*{chr(97 + i % 26)}[a-m]", None if i % 3 else "function") for i in range(400)]
    return rules.apply_rules(s, found)


#: Rules of the parts: name, pattern, kind and file pattern by a part's key and size; some of each kind are no rules.
_CANDIDATE = {
    "name": ("CASE WHEN p_size % 6 = 0 THEN '' ELSE p_name END", "name <> ''"),
    "name_regex": ("CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '[' WHEN 2 THEN '(?=x)' WHEN 3 THEN '(a)\\1' WHEN 4 THEN '^\\w+$' ELSE replace(p_name, ' ', '.*') END", "name_regex NOT IN ('', '[', '(?=x)', '(a)\\1')"),
    "symbol_kind": ("CASE p_partkey % 5 WHEN 0 THEN 'gadget' WHEN 1 THEN 'macro' WHEN 2 THEN 'type' END", "coalesce(symbol_kind, 'type') <> 'gadget'"),
    "file_pattern": ("CASE p_partkey % 7 WHEN 0 THEN '[' WHEN 1 THEN '\\.h$' END", "coalesce(file_pattern, '') <> '['"),
}


@query("a6_rule_validation", "parts", f"SELECT p_partkey, {' AND '.join(v for _, v in _CANDIDATE.values())} AS valid FROM r", f"r AS (SELECT p_partkey, {', '.join(f'{e} AS {c}' for c, (e, _) in _CANDIDATE.items())} FROM f_parts)")
def _(p):
    """A rule for each part, validated where the rows are."""
    spark_sql = {c: e.replace("\\", "\\\\") for c, (e, _) in _CANDIDATE.items()}
    return rules.validated(p.selectExpr("p_partkey", *(f"{e} AS {c}" for c, e in spark_sql.items()))).select("p_partkey", "valid")


@query("s13_include_folders", "nations", "SELECT '-I' || f AS argument FROM (SELECT unnest(['', '']) AS f UNION ALL SELECT '/n' || CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT '/n' || CAST(n_nationkey AS VARCHAR) || '/in' FROM nation UNION ALL SELECT '/n' || CAST(n_nationkey AS VARCHAR) || '/.h/below' FROM nation)")
def _(n):
    """A small tree on the driver, where trees are walked: a folder for each nation, one below, and one within a hidden one.
    The root comes twice: as such, and as the first folder of the walk."""
    with tempfile.TemporaryDirectory() as root:
        for r in n.select("n_nationkey").collect():
            for below in ("in", ".h/below", "skipped"):
                os.makedirs(f"{root}/n{r[0]}/{below}")
        found = files.include_folders(root, ("skipped",))
    return n.sparkSession.createDataFrame([(f.replace(root, ""),) for f in found], "argument string")


@query("s14_compile_database_places", "parts", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(files.COMPILE_DATABASES)) + ") AS v(place, found)")
def _(p):
    """Compile databases in ever earlier places: the first place that has one is found."""
    rows = []
    with tempfile.TemporaryDirectory() as root:
        for i, place in reversed([*enumerate(files.COMPILE_DATABASES)]):
            os.makedirs(os.path.dirname(f"{root}/{place}"), exist_ok=True)
            with open(f"{root}/{place}", "w") as f:
                f.write("[]")
            rows.append((i, os.path.relpath(files.find_compile_database(root), root)))
    return p.sparkSession.createDataFrame(rows, "place int, found string")


@query("s18_remote_listing", "nations", "SELECT 'n' || CAST(n_nationkey AS VARCHAR) || '.txt' AS name, false AS is_dir, CAST(length(n_name) AS BIGINT) AS size, n_name AS content FROM nation")
def _(n):
    """Files in a store that Hadoop knows: uploaded, listed and read."""
    spark = n.sparkSession
    folder = f"{work_folder(spark)}/remote-{uuid.uuid4().hex}"
    with tempfile.TemporaryDirectory() as root:
        for r in n.collect():
            with open(f"{root}/n{r['n_nationkey']}.txt", "w") as f:
                f.write(r["n_name"])
            files.upload(spark, f"{root}/n{r['n_nationkey']}.txt", f"{folder}/n{r['n_nationkey']}.txt")
    read = files.remote_contents(spark, folder).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.decode("content", "UTF-8").alias("content"))
    return files.remote_listing(spark, folder).where("NOT startswith(name, '.')").join(read, "name").select("name", "is_dir", "size", "content")


@query("a0c_progress", "nations", "SELECT n_nationkey AS done, 100.0e0 * n_nationkey / 25 AS percentage, n_nationkey / 4.0e0 AS rate, (25 - n_nationkey) / greatest(n_nationkey / 4.0e0, 0.001) AS remaining FROM nation")
def _(n):
    rows = [(int(r[0]), stats.progress(r[0], 25, 4.0)) for r in n.select("n_nationkey").collect()]
    return n.sparkSession.createDataFrame([(k, p["percentage"], p["rate"], p["remaining"]) for k, p in rows], "done long, percentage double, rate double, remaining double")


@query("t2_skill_dispatch", "symbols include_relations", """SELECT 'explain_macro' AS skill, count(*) AS lines FROM (SELECT unnest(['a', 'a', 'a', 'a', 'a', return_type, parameters, access, 'a', CASE WHEN is_definition THEN 'a' END]) AS x FROM f_symbols WHERE id = 76) WHERE x IS NOT NULL UNION ALL
SELECT 'analyze_dependencies', 2 + count(*) FROM f_include_relations WHERE source_file = (SELECT min(source_file) FROM f_include_relations) OR target_file = (SELECT min(source_file) FROM f_include_relations) UNION ALL SELECT 'unknown', -1 UNION ALL SELECT 'find_callers', -2""")
def _(s, i):
    """Skills by name: two with reports of their own, one that isn't known, one without what it needs."""
    from lattica.plans.engine import CodeGraph

    graph = CodeGraph(s.sparkSession, store.empty_tables(s.sparkSession) | {"symbols": s, "include_relations": i})
    path = i.agg(F.min("source_file")).first()[0]
    rows = [("explain_macro", graph.skill("explain_macro", symbol_id=76).count()), ("analyze_dependencies", graph.skill("analyze_dependencies", file_path=path).count())]
    for name, error, n in (("unknown", KeyError, -1), ("find_callers", ValueError, -2)):
        try:
            graph.skill(name)
        except error:
            rows.append((name, n))
    return s.sparkSession.createDataFrame(rows, "skill string, lines long")


def _snapshots(df: DataFrame) -> store.Snapshots:
    return store.Snapshots(df.sparkSession, f"{work_folder(df.sparkSession)}/index-{uuid.uuid4().hex}")


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    return store.union_all([tables[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n") for t in TABLES])


@query("w1_initialize", "symbols", " UNION ALL ".join(f"SELECT '{t}' AS t, {'count(*)' if t == 'symbols' else 'CAST(0 AS BIGINT)'} AS n{' FROM f_symbols' if t == 'symbols' else ''}" for t in TABLES))
def _(s):
    """An index is created once: what it holds by then stays."""
    own = _snapshots(s)
    own.initialize()
    own.write(own.read() | {"symbols": s})
    own.initialize()
    return _counts(own.read())


@query("w6_full_write", _ALL, " UNION ALL ".join(
    f"SELECT '{t}' AS t, count(*) AS n, CAST(coalesce(sum({c}), 0) AS BIGINT) AS total FROM f_{t}" for t, c in (("symbols", "line"), ("call_relations", "callee_id"), ("include_relations", "line"), ("reference_relations", "symbol_id"), ("inheritance_relations", "base_id"), ("file_info", "symbol_count"))))
def _(*tables):
    """A snapshot of all tables, and one over it; the reader sees the second."""
    own = _snapshots(tables[0])
    own.initialize()
    names = [t for t in TABLES if t != "unresolved_calls"]
    own.write(store.empty_tables(tables[0].sparkSession) | dict(zip(names, tables)))
    read = own.read()
    sums = {"symbols": "line", "call_relations": "callee_id", "include_relations": "line", "reference_relations": "symbol_id", "inheritance_relations": "base_id", "file_info": "symbol_count"}
    return store.union_all([read[t].agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("total")).select(F.lit(t).alias("t"), "n", "total") for t, c in sums.items()])


@query("w8_json_documents", "nations", "SELECT n_name AS key, n_nationkey % 7 AS updated_at FROM nation")
def _(n):
    """Documents of a store, one of them broken."""
    spark = n.sparkSession
    folder = f"{work_folder(spark)}/documents-{uuid.uuid4().hex}"
    whole = n.agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("key"), (F.col("n_nationkey") % 7).alias("updated_at")))).alias("value"))
    whole.unionByName(spark.createDataFrame([("{",)], "value string")).repartitionByRange(2, "value").write.text(folder)
    return store.json_documents(spark, folder, "key string, updated_at int")


_LESS = "less AS (SELECT * FROM f_raw_symbols WHERE file <> 'src/m3/x.cpp')"
_LATER = f"{_LESS}, {_DEDUP.replace('f_raw_symbols', 'less')}, {_CALLS.replace('f_raw_calls', '(SELECT * FROM f_raw_calls WHERE file <> ' + chr(39) + 'src/m3/x.cpp' + chr(39) + ')')}"


@query("i2_incremental_calls", "raw_symbols raw_calls", """SELECT c.file, c.line, c.caller, c.callee, coalesce(callee_place, b.k.p) AS callee_place FROM near c LEFT JOIN np a ON a.name = c.caller LEFT JOIN np b ON b.name = c.callee
WHERE caller_place IS NOT NULL AND callee_place IS NOT NULL OR a.k IS NOT NULL AND b.k IS NOT NULL""".replace("coalesce(callee_place, b.k.p)", "CASE WHEN caller_place IS NOT NULL AND callee_place IS NOT NULL THEN callee_place ELSE b.k.p END"), _LATER)
def _(r, c):
    """The index of all files, less one: the same calls as those of an index built without it, calls into it included whose
    name another file answers."""
    spark = r.sparkSession
    none = F.array()
    whole = F.struct(*(F.coalesce(n, none).alias(n) for n in ("symbols", "calls")), none.alias("includes"), none.alias("inherits"))
    results = extraction.decoded(_results(r, c).select("file", "part", F.to_json(whole).alias("json")))
    own = store.Snapshots(spark, f"{work_folder(spark)}/index-{uuid.uuid4().hex}", buckets=8)
    own.write(store.empty_tables(spark) | resolve.resolved_tables(results))
    changed = spark.createDataFrame([("src/m3/x.cpp", incremental.DELETED)], "path string, change_type string")
    incremental.merged(own, changed, results.limit(0), store.empty_tables(spark)["file_info"])
    after = own.read()
    s = resolve.deduplicated_symbols(r).select("id", "place", "qualified_name")
    a, b = s.select(F.col("id").alias("caller_id"), F.col("qualified_name").alias("caller")), s.select(F.col("id").alias("callee_id"), F.col("qualified_name").alias("callee"), F.col("place").alias("callee_place"))
    found = after["call_relations"].join(a, "caller_id").join(b, "callee_id")
    return found.select(F.col("file_path").alias("file"), "line", "caller", "callee", "callee_place")


@query("i2_stateful_calls", "raw_symbols raw_calls", """SELECT c.file, c.line, c.caller, c.callee, CASE WHEN caller_place IS NOT NULL AND callee_place IS NOT NULL THEN callee_place ELSE b.k.p END AS callee_place
FROM near c LEFT JOIN np a ON a.name = c.caller LEFT JOIN np b ON b.name = c.callee WHERE caller_place IS NOT NULL AND callee_place IS NOT NULL OR a.k IS NOT NULL AND b.k IS NOT NULL""", f"{_DEDUP}, {_CALLS}")
def _(r, c):
    """Files arrive one after the other in no order of theirs, in two runs of the streams; the calls are those over all files."""
    from lattica.streaming import calls

    spark = r.sparkSession
    none = F.array()
    whole = F.struct(*(F.coalesce(n, none).alias(n) for n in ("symbols", "calls")), none.alias("includes"), none.alias("inherits"))
    arriving = _results(r, c).select("file", "part", F.lit("h").alias("content_hash"), F.to_json(whole).alias("json"), F.pmod(F.xxhash64("file"), F.lit(6)).cast("int").alias("turn"))
    root = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    arriving = checkpointed(arriving)
    for first in (0, 3):
        some = arriving.where(F.col("turn").between(first, first + 2))
        some.repartition(3, "turn").drop("turn").write.mode("append").json(f"{root}/in")
        calls.run(spark, f"{root}/in", root, files_a_batch=1, batches=1)
    s = resolve.deduplicated_symbols(r).select(F.col("id").alias("callee_id"), F.col("place").alias("callee_place"))
    return calls.call_table(spark, root).join(s, "callee_id").select("file", "line", "caller", "callee", "callee_place")


def _indexed(s: DataFrame) -> store.Snapshots:
    own = store.Snapshots(s.sparkSession, f"{work_folder(s.sparkSession)}/index-{uuid.uuid4().hex}", buckets=4)
    own.write(store.empty_tables(s.sparkSession) | {"symbols": s})
    return own


@query("q12_indexed_search", "symbols", _search_sql("d17::red", None, 50), _REP)
def _(s):
    """By posting lists of a snapshot."""
    return _indexed(s).search("d17::red")


@query("q13_indexed_search_by_kind", "symbols", _search_sql("d11::", "function", 40), _REP)
def _(s): return _indexed(s).search("d11::", "function", 40)


_INCLUDER = "(SELECT min(source_file) FROM f_include_relations)"


@query("a0_counters_after_a_change", _ALL, "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _COUNT.items() if k != "total_include_relations") + f", (SELECT count(*) FROM f_include_relations WHERE source_file <> {_INCLUDER}) AS total_include_relations, CAST(0.0 AS DOUBLE) AS elapsed_seconds")
def _(*tables):
    """The counters of an index from which a file's includes are deleted, by its manifest alone."""
    spark = tables[0].sparkSession
    own = store.Snapshots(spark, f"{work_folder(spark)}/index-{uuid.uuid4().hex}", buckets=4)
    none = store.empty_tables(spark)
    own.write(none | dict(zip([t for t in TABLES if t != "unresolved_calls"], tables)))
    gone = tables[2].agg(F.min("source_file").alias("path")).withColumn("change_type", F.lit(incremental.DELETED))
    results = extraction.decoded(spark.createDataFrame([], "file string, json string"))
    incremental.merged(own, gone, results, none["file_info"])
    return own.counters()


@query("w6_copy_on_write", "raw_symbols", f"""SELECT bucket, count(*) AS n, CAST(sum(place) AS BIGINT) AS places, bool_or(moved) AS rewritten
FROM (SELECT CAST('0x' || substr(md5(file_path), 1, 8) AS BIGINT) % 32 AS bucket, place, CAST('0x' || substr(md5(file_path), 1, 8) AS BIGINT) % 32 IN (SELECT CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) % 32 FROM (VALUES ('src/m3/x.cpp'), ('src/m7/x.cpp')) AS v(f)) AS moved FROM ds WHERE file <> 'src/m7/x.cpp') GROUP BY bucket""", _DEDUP)
def _(r):
    """A file that is extracted anew and one that goes: symbols by bucket, and whether the last snapshot wrote the bucket."""
    spark = r.sparkSession
    own = store.Snapshots(spark, f"{work_folder(spark)}/index-{uuid.uuid4().hex}", buckets=32)
    results = extraction.decoded(_documents(r.drop("ordinal")))
    own.write(store.empty_tables(spark) | resolve.resolved_tables(results))
    before = own.manifest()["tables"]["symbols"]
    changed = spark.createDataFrame([("src/m3/x.cpp", incremental.MODIFIED), ("src/m7/x.cpp", incremental.DELETED)], "path string, change_type string")
    incremental.merged(own, changed, results.where("file = 'src/m3/x.cpp'"), store.empty_tables(spark)["file_info"])
    moved = [int(k) for k, x in own.manifest()["tables"]["symbols"].items() if before.get(k) != x]
    places = resolve.deduplicated_symbols(r).select("id", "place")
    found = own.read()["symbols"].join(places, "id").withColumn("bucket", store.bucket_of(F.col("file_path"), 32))
    return found.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("places")).withColumn("rewritten", F.col("bucket").isin(moved))


@query("t1_skills", "parts", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({len(p)} AS INTEGER), '{p[0][0]}', {str(p[0][2]).lower()})" for n, p in reports.SKILLS.items()) + ") AS v(name, n_parameters, first_parameter, first_required)")
def _(p):
    first = F.col("parameters")[0]
    return reports.skills(p.sparkSession).select("name", F.size("parameters").alias("n_parameters"), first["name"].alias("first_parameter"), first["required"].alias("first_required"))
