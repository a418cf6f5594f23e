"""The benchmark tables projected onto the code graph, as DataFrames and as SQL text of one and the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAME = "replace(p_name, ' ', '_')"
_BRAND = "lower(replace(p_brand, '#', ''))"
_KERNEL = (
    f"CASE p_partkey % 12 WHEN 0 THEN 'sys_' || {_NAME} WHEN 1 THEN '__do_sys_' || {_NAME} WHEN 2 THEN '__se_sys_' || {_NAME} WHEN 3 THEN {_NAME} || '_ioctl' WHEN 11 THEN {_NAME} || CASE WHEN p_partkey % 5 = 0 THEN '_ioctl_handler' ELSE '_ioctl' END "
    f"WHEN 4 THEN 'SYSCALL_DEFINE' || CAST(p_partkey % 7 AS STRING) WHEN 5 THEN 'Audio' || {_NAME} || 'Stub' WHEN 6 THEN 'Audio' || {_NAME} || 'ServiceProxy' "
    f"WHEN 7 THEN {_NAME} || 'AbilityStubStub' WHEN 8 THEN 'AddSystemAbility_' || {_NAME} WHEN 9 THEN 'compat_ioctl_' || {_NAME} WHEN 10 THEN 'Publish' || {_NAME} ELSE {_NAME} END"
)
_SYMBOL = [
    ("id", "CAST(p_partkey AS BIGINT)"), ("name", _NAME), ("qualified_name", f"{_BRAND} || '::' || {_NAME}"),
    ("kind", "CASE WHEN p_partkey % 10 <= 5 THEN 'function' WHEN p_partkey % 10 <= 7 THEN 'variable' WHEN p_partkey % 10 = 8 THEN 'type' ELSE 'macro' END"),
    ("sub_kind", "CASE WHEN p_partkey % 10 = 8 THEN 'class' END"),
    ("file_path", "'src/' || lower(p_type) || '/f' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '.h' ELSE '.cpp' END"),
    ("line", "CAST(p_partkey % 997 + 1 AS INT)"), ("column", "CAST(p_size AS INT)"),
    ("end_line", "CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 997 + 1 + p_size AS INT) END"), ("is_definition", "p_partkey % 3 <> 0"),
    ("return_type", "lower(p_type)"), ("parameters", "CAST(NULL AS STRING)"),
    ("access", "CASE WHEN p_partkey % 4 = 0 THEN 'public' WHEN p_partkey % 4 = 1 THEN 'private' END"),
    ("attributes", """CASE WHEN p_partkey % 5 = 0 THEN '{"is_virtual":true,"is_static":false}' END"""), ("project_id", "'fixture'"),
]
_CALLEE = "(o_custkey * 31 + o_orderkey * 7) % {n}"
#: name: (source, filter, columns). {n} is the number of parts, {sha(x)} SHA-256 in hex.
TABLES: dict[str, tuple[str, str, list[tuple[str, str]]]] = {
    "symbols": ("part", "true", _SYMBOL),
    "kernel_symbols": ("part", "true", [
        (c, _KERNEL if c == "name" else f"CASE WHEN p_partkey % 12 = 4 THEN {_BRAND} || '::SYSCALL_DEFINE' || CAST(p_partkey % 7 AS STRING) || '(' || {_NAME} || ', int)' ELSE {_BRAND} || '::' || {_KERNEL} END" if c == "qualified_name"
            else "CASE WHEN p_partkey % 12 IN (5, 6, 7) THEN 'type' ELSE 'function' END" if c == "kind" else e) for c, e in _SYMBOL]),
    "call_relations": ("orders", "true", [
        ("id", "CAST(o_orderkey AS BIGINT)"), ("caller_id", "CAST(o_custkey % {n} AS BIGINT)"), ("callee_id", f"CAST({_CALLEE} AS BIGINT)"),
        ("file_path", "'src/o' || CAST(o_custkey % 50 AS STRING) || '.cpp'"), ("line", "CAST(o_orderkey % 200 + 1 AS INT)"), ("column", "CAST(o_orderkey % 80 + 1 AS INT)"),
        ("is_virtual", "o_orderstatus = 'P'"), ("is_indirect", "false")]),
    "include_relations": ("events", "true", [
        ("id", "CAST(event_id AS BIGINT)"), ("source_file", "CASE WHEN user_id % 3 = 0 THEN 'inc/u' || CAST(user_id AS STRING) || '.h' ELSE 'src/u' || CAST(user_id AS STRING) || '.cpp' END"),
        ("target_file", "'u' || CAST(3 * ((user_id + event_id) % 50) AS STRING) || '.h'"), ("line", "CAST(event_id % 120 + 1 AS INT)"), ("is_system", "event_id % 4 = 0"),
        ("resolved_path", "CASE WHEN event_id % 4 <> 0 THEN 'inc/u' || CAST(3 * ((user_id + event_id) % 50) AS STRING) || '.h' END")]),
    "reference_relations": ("orders", "true", [
        ("id", "CAST(o_orderkey AS BIGINT)"), ("symbol_id", "CAST((o_orderkey * 13) % {n} AS BIGINT)"), ("file_path", "'src/o' || CAST(o_custkey % 50 AS STRING) || '.cpp'"),
        ("line", "CAST(o_orderkey % 300 + 1 AS INT)"), ("column", "CAST(o_custkey % 80 + 1 AS INT)"), ("ref_kind", "CASE o_orderstatus WHEN 'O' THEN 'read' WHEN 'F' THEN 'write' ELSE 'address' END")]),
    "inheritance_relations": ("supplier", "true", [
        ("id", "CAST(s_suppkey AS BIGINT)"), ("derived_id", "CAST((s_suppkey * 10 + 8) % {n} AS BIGINT)"), ("base_id", "CAST((s_nationkey * 10 + 8) % {n} AS BIGINT)"),
        ("access", "CASE WHEN s_nationkey % 2 = 0 THEN 'public' ELSE 'private' END"), ("is_virtual", "s_nationkey % 5 = 0")]),
    "file_info": ("documents LEFT JOIN labels USING (doc_id)", "true", [
        ("file_path", "'src/' || source || '/d' || CAST(doc_id AS STRING) || '.c'"), ("last_modified", "CAST(1700000000 + doc_id AS BIGINT)"), ("content_hash", "{sha(text)}"),
        ("parse_status", "CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'skipped' ELSE 'success' END"), ("error_message", "CASE WHEN toxic = 1 THEN 'flagged' END"),
        ("symbol_count", "CAST(n_chars % 100 AS BIGINT)"), ("parse_time_ms", "CAST(n_chars % 1000 AS BIGINT)")]),
    "disk": ("documents", "doc_id % 10 <> 0", [
        ("path", "'src/' || source || '/d' || CAST(doc_id AS STRING) || '.c'"), ("content_hash", "CASE WHEN doc_id % 7 = 0 THEN {sha(text || 'x')} ELSE {sha(text)} END")]),
    "disk_new": ("documents", "doc_id % 50 = 0", [("path", "'src/new/d' || CAST(doc_id AS STRING) || '.c'"), ("content_hash", "{sha(text)}")]),
    "parts": ("part", "true", [("p_partkey", "p_partkey"), ("p_size", "p_size"), ("p_name", "p_name")]),
    "nations": ("nation", "true", [("n_nationkey", "n_nationkey"), ("n_name", "n_name")]),
    "texts": ("documents", "true", [("path", "'d' || CAST(doc_id AS STRING)"), ("text", "text")]),
    # extraction results, before any resolution: a file, the ordinal in it, and names
    "raw_symbols": ("part", "true", [
        ("file", "'src/m' || CAST(p_partkey % 40 AS STRING) || '/x.cpp'"), ("ordinal", "CAST(p_partkey AS INT)"), ("name", _NAME), ("qualified_name", f"{_BRAND} || '::n' || CAST(p_partkey * 7 % 9 AS STRING)"),
        ("kind", "CASE WHEN p_partkey % 10 <= 8 THEN 'function' ELSE 'gadget' END"), ("sub_kind", "CAST(NULL AS STRING)"), ("file_path", "'src/m' || CAST(p_partkey % 40 AS STRING) || '/x.cpp'"),
        ("line", "CAST(p_size % 3 AS INT)"), ("column", "1"), ("end_line", "CAST(NULL AS INT)"), ("is_definition", "p_partkey % 4 = 0"), ("return_type", "CAST(NULL AS STRING)"), ("parameters", "CAST(NULL AS STRING)"),
        ("access", "CAST(NULL AS STRING)"), ("attributes", "CAST(NULL AS STRING)")]),
    "raw_calls": ("orders", "true", [
        ("file", "'src/m' || CAST(o_custkey % 40 AS STRING) || '/x.cpp'"), ("ordinal", "CAST(o_orderkey AS INT)"), ("caller", "'brand' || CAST(o_custkey % 5 + 1 AS STRING) || CAST(o_orderkey % 5 + 1 AS STRING) || '::n' || CAST(o_custkey % 9 AS STRING)"),
        ("callee", "'brand' || CAST(o_orderkey % 5 + 1 AS STRING) || CAST(o_custkey % 5 + 1 AS STRING) || '::n' || CAST(o_orderkey % 10 AS STRING)"), ("line", "CAST(o_orderkey % 200 + 1 AS INT)"), ("column", "1"),
        ("is_virtual", "false"), ("is_indirect", "false")]),
    "raw_references": ("orders", "true", [
        ("file", "'src/m' || CAST(o_custkey % 40 AS STRING) || '/x.cpp'"), ("ordinal", "CAST(o_orderkey AS INT)"), ("symbol_name", "'brand' || CAST(o_custkey % 5 + 1 AS STRING) || CAST(o_orderkey % 5 + 1 AS STRING) || '::n' || CAST(o_custkey % 9 AS STRING)"),
        ("line", "CAST(o_orderkey % 300 + 1 AS INT)"), ("column", "1"), ("ref_kind", "CASE o_orderstatus WHEN 'O' THEN 'read' WHEN 'F' THEN 'write' ELSE 'odd' END")]),
    "compile_entries": ("part", "true", [("directory", "'/old/base/w' || CAST(p_size % 5 AS STRING)"), ("file", "'/old/base/w' || CAST(p_size % 5 AS STRING) || '/' || " + _NAME + " || '.cpp'"), ("command", "p_type"), ("output", "CAST(p_partkey AS STRING)")]),
    "dir_entries": ("part", "true", [("name", "CASE WHEN p_partkey % 9 = 0 THEN '.' ELSE '' END || p_name || CAST(p_partkey AS STRING)"), ("path", "'/r/' || p_name || CAST(p_partkey AS STRING)"), ("is_dir", "p_partkey % 3 = 0"), ("size", "CAST(p_size AS BIGINT)")]),
    "places": ("orders", "true", [("place_id", "CAST(o_orderkey AS BIGINT)"), ("symbol_near", f"CAST({_CALLEE} AS BIGINT)"), ("shift", "CAST(o_orderkey % 60 AS INT)")]),
}


def _filled(expression: str, n: str, sha: str) -> str:
    out = expression.replace("{n}", n)
    while (i := out.find("{sha(")) >= 0:
        j = out.index(")}", i)
        out = out[:i] + sha.format(out[i + 5 : j]) + out[j + 2 :]
    return out


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, where, columns = TABLES[name]
    first, _, rest = source.partition(" ")
    df = spark.read.parquet(f"{sf_dir}/{first}.parquet")
    if rest:
        # hashed first, so that texts don't move for the join
        df = df.selectExpr("*", "sha2(text, 256) AS text_hash").drop("text")
        columns = [(c, e.replace("{sha(text)}", "text_hash")) for c, e in columns]
        df = df.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    needs_n = any("{n}" in e for _, e in columns)
    n = str(spark.read.parquet(f"{sf_dir}/part.parquet").count()) if needs_n else ""
    return df.where(where).selectExpr(*(f"{_filled(e, n, 'sha2({0}, 256)')} AS `{c}`" for c, e in columns))


def cte(name: str) -> str:
    """The table as a common table expression, f_ and its name."""
    source, where, columns = TABLES[name]
    fields = ", ".join(f'{_filled(e, "(SELECT count(*) FROM part)", "sha256({0})")} AS "{c}"' for c, e in columns)
    return f"f_{name} AS (SELECT {fields} FROM {source} WHERE {where})"


def ctes(*names: str) -> str:
    return ", ".join(map(cte, names))
