"""Every operator as a query over the benchmark tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import short_name
from lattica.operators import analyzers, client, digest_tree, incremental, lookup, reports, resolve, rules, search, stats, store, traverse
from lattica.plans.fixtures import ctes, frame
from lattica.schema import PART_ROWS
from lattica.session import checkpointed
from lattica.sources import compile_db, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None, more: str = ""):
    """Registers a function of the tables' DataFrames. sql follows the tables' common table expressions (and `more`)."""
    names = tables.split()

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(frame(spark, sf_dir, t) for t in names))
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {ctes(*dict.fromkeys(names))}{', ' + more if more else ''} {sql}"
        return f

    return add


def _edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The calls between logical nodes, made once for all levels of a traversal, as a snapshot keeps them."""
    return checkpointed(traverse.node_edges(calls, symbols))


def _first(df: DataFrame):
    return df.first()[0]


# The symbol that most calls lead to, and the one that calls most; the least id among equals.
_BUSY = "(SELECT callee_id FROM f_call_relations GROUP BY callee_id ORDER BY count(*) DESC, callee_id LIMIT 1)"
_CALLER = "(SELECT caller_id FROM f_call_relations GROUP BY caller_id ORDER BY count(*) DESC, caller_id LIMIT 1)"


def busy(calls: DataFrame, column: str = "callee_id") -> int:
    return _first(calls.groupBy(column).count().orderBy(F.desc("count"), column).select(column))


_FILE = "(SELECT file_path FROM f_symbols GROUP BY file_path ORDER BY count(*) DESC, file_path LIMIT 1)"
_SOURCE = "(SELECT source_file FROM f_include_relations GROUP BY source_file ORDER BY count(*) DESC, source_file LIMIT 1)"


def most(df: DataFrame, column: str) -> str:
    return _first(df.groupBy(column).count().orderBy(F.desc("count"), column).select(column))


@query("q1_lookup_symbol", "symbols", "SELECT * FROM f_symbols WHERE id = 77")
def _(s): return lookup.symbol(s, 77)


@query("q1_symbol_fields", "symbols", "SELECT qualified_name AS name, kind, file_path AS file, line FROM f_symbols WHERE id = 77")
def _(s):
    out = None
    for f in ("name", "kind", "file", "line"):
        one = lookup.symbol_field(s, 77, f)
        out = one if out is None else out.crossJoin(one)
    return out


@query("q2_symbols_by_ids", "symbols", "SELECT * FROM f_symbols WHERE id IN (3, 5, 8, 999999999)")
def _(s): return lookup.symbols_by_ids(s, [5, 3, 8, 5, 999999999])


@query("q2_symbols_by_id_table", "symbols reference_relations", "SELECT * FROM f_symbols WHERE id IN (SELECT symbol_id FROM f_reference_relations)")
def _(s, r): return lookup.symbols_by_ids(s, r.select("symbol_id"))


@query("q3_symbols_in_file", "symbols", f"SELECT * FROM f_symbols WHERE file_path = {_FILE}")
def _(s): return lookup.symbols_in_file(s, most(s, "file_path"))


@query("q4_file_record", "file_info", "SELECT * FROM f_file_info WHERE file_path = (SELECT min(file_path) FROM f_file_info)")
def _(f): return lookup.file_record(f, _first(f.agg(F.min("file_path"))))


@query("q5_failed_files", "file_info", "SELECT * FROM f_file_info WHERE parse_status = 'failed'")
def _(f): return lookup.failed_files(f)


@query("q5_parse_errors", "file_info", "SELECT file_path, error_message, last_modified FROM f_file_info WHERE parse_status = 'failed'")
def _(f): return lookup.parse_errors(f)


@query("q6_references", "reference_relations", "SELECT * FROM f_reference_relations WHERE symbol_id = (SELECT symbol_id FROM f_reference_relations GROUP BY symbol_id ORDER BY count(*) DESC, symbol_id LIMIT 1)")
def _(r): return lookup.references_of(r, busy(r, "symbol_id"))


@query("q7_includes", "include_relations", f"SELECT * FROM f_include_relations WHERE source_file = {_SOURCE}")
def _(i): return lookup.includes_of(i, most(i, "source_file"))


@query("q8_included_by", "include_relations", "SELECT * FROM f_include_relations WHERE target_file = 'u3.h'")
def _(i): return lookup.included_by(i, "u3.h")


@query("q9_all_includes", "include_relations", "SELECT * FROM f_include_relations")
def _(i): return lookup.all_includes(i)


@query("q10_indexed_files", "file_info", "SELECT file_path FROM f_file_info")
def _(f): return lookup.indexed_files(f)


@query("q11_includers", "include_relations", "SELECT DISTINCT source_file FROM f_include_relations WHERE target_file = 'inc/u3.h' OR resolved_path = 'inc/u3.h'")
def _(i): return lookup.includers_of(i, "inc/u3.h")


@query("q11_includers_of_all", "include_relations", "SELECT DISTINCT t.f AS target, i.source_file FROM (SELECT DISTINCT target_file AS f FROM f_include_relations UNION SELECT resolved_path FROM f_include_relations WHERE is_system = false) t JOIN f_include_relations i ON i.target_file = t.f OR i.resolved_path = t.f")
def _(i):
    targets = i.select(F.col("target_file").alias("f")).union(i.where("NOT is_system").select("resolved_path")).distinct()
    return lookup.includers_of_all(i, targets)


_REP = "rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY is_definition DESC, id) AS rn FROM f_symbols) WHERE rn = 1)"
_SYMBOL = 'id, name, qualified_name, kind, sub_kind, file_path, line, "column", end_line, is_definition, return_type, parameters, access, attributes, project_id'


def _search_sql(q: str, kind: str | None, limit: int) -> str:
    rank = "" if kind else f"CASE WHEN name = '{q}' THEN 0 WHEN lower(name) LIKE '{q}%' THEN 1 ELSE 2 END, "
    where = f" AND kind = '{kind}'" if kind else ""
    return f"SELECT {_SYMBOL} FROM rep WHERE (lower(name) LIKE '%{q}%' OR lower(qualified_name) LIKE '%{q}%'){where} ORDER BY {rank}length(name), id LIMIT {limit}"


@query("q12_search", "symbols", _search_sql("ring", None, 50), _REP)
def _(s): return search.search(s, "ring", 50)


@query("q12_search_wildcard", "symbols", _search_sql("b%_r_n", None, 50), _REP)
def _(s): return search.search(s, "b%_r_n", 50)


@query("q13_search_by_kind", "symbols", _search_sql("e", "function", 40), _REP)
def _(s): return search.search_by_kind(s, "e", "function", 40)


@query("q14_search_api", "symbols", _search_sql("a", None, 30), _REP)
def _(s): return search.search_api(s, "a", "gadget", 30)


@query("q14_search_tool", "symbols", _search_sql("a", "function", 50), _REP)
def _(s): return search.search_tool(s, "a", "gadget")


@query("j1_calls_with_callee", "call_relations symbols", f"SELECT c.id AS call_id, c.caller_id, s.* FROM f_call_relations c JOIN f_symbols s ON s.id = c.callee_id")
def _(c, s): return lookup.calls_with_callee(c, s).select("call_id", "caller_id", *s.columns)


@query("j5_calls_with_names", "call_relations symbols", "SELECT c.id, coalesce(s.qualified_name, 'symbol_' || CAST(c.caller_id AS VARCHAR)) AS caller_name, s.kind AS caller_kind, s.file_path AS caller_file, s.line AS caller_line FROM f_call_relations c LEFT JOIN f_symbols s ON s.id = c.caller_id")
def _(c, s): return lookup.with_endpoint(c.select("id", "caller_id"), s, "caller_id", "caller").drop("caller_id")


@query("g1_same_name_ids", "symbols", "SELECT id FROM f_symbols WHERE qualified_name = (SELECT qualified_name FROM f_symbols WHERE id = 77) UNION SELECT 77")
def _(s): return traverse.same_name_ids(s, 77)


_EDGES = (
    "cls AS (SELECT id, qualified_name, min(id) OVER (PARTITION BY qualified_name) AS node FROM f_symbols), "
    "e AS (SELECT r.*, a.node AS cn, b.node AS en, a.qualified_name AS caller_name, b.qualified_name AS callee_name FROM f_call_relations r JOIN cls a ON a.id = r.caller_id JOIN cls b ON b.id = r.callee_id)"
)


def _walk(seed: str, depth: int, near: str, far: str, name: str) -> str:
    return (
        f"{_EDGES}, w(node, d) AS (SELECT node, 0 FROM cls WHERE id = {seed} UNION SELECT e.{far}, w.d + 1 FROM w JOIN e ON e.{near} = w.node WHERE w.d < {depth}), "
        f"lvl AS (SELECT node, min(d) AS d FROM w GROUP BY node), "
        f"hit AS (SELECT e.*, l.d + 1 AS level FROM e JOIN lvl l ON l.node = e.{near} WHERE l.d < {depth}), "
        f"got AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {name} ORDER BY level, id) AS rn FROM hit) WHERE rn = 1)"
    )


_CALL = 'id, caller_id, callee_id, file_path, line, "column", is_virtual, is_indirect'
_UP = _walk(_BUSY, 3, "en", "cn", "caller_name")
_DOWN = _walk(_CALLER, 3, "cn", "en", "callee_name")


@query("g2_callers", "call_relations symbols", f"SELECT {_CALL}, level FROM got", _UP)
def _(c, s): return traverse.callers(_edges(c, s), s, busy(c), 3)


@query("g3_callees", "call_relations symbols", f"SELECT {_CALL}, level FROM got", _DOWN)
def _(c, s): return traverse.callees(_edges(c, s), s, busy(c, "caller_id"), 3)


_HOP = f"""st AS (SELECT {_CALLER} AS f), h1 AS (SELECT min(callee_id) AS x FROM f_call_relations, st WHERE caller_id = f), h2 AS (SELECT min(callee_id) AS x FROM f_call_relations, h1 WHERE caller_id = h1.x),
h3 AS (SELECT coalesce((SELECT min(callee_id) FROM f_call_relations, h2 WHERE caller_id = h2.x), (SELECT x FROM h2), (SELECT x FROM h1)) AS t),
pe AS (SELECT caller_id, callee_id, min(id) AS eid FROM f_call_relations GROUP BY 1, 2),
pw(n, ek, np) AS (SELECT f, CAST([] AS BIGINT[]), [f] FROM st UNION ALL SELECT pe.callee_id, list_append(ek, eid), list_append(np, pe.callee_id) FROM pw JOIN pe ON pe.caller_id = pw.n WHERE len(np) <= 5 AND NOT list_contains(np, pe.callee_id)),
best AS (SELECT np FROM pw, h3 WHERE n = t ORDER BY len(ek), ek LIMIT 1)"""


@query("g4_shortest_path", "call_relations", "SELECT CAST(unnest(range(len(np))) AS INTEGER) AS pos, unnest(np) AS symbol_id FROM best", _HOP)
def _(c):
    start = busy(c, "caller_id")
    x = [start]
    for _ in range(3):
        step = _first(c.where(F.col("caller_id") == x[-1]).agg(F.min("callee_id")))
        if step is None:
            break
        x.append(step)
    return traverse.shortest_path(c, start, x[-1])


# Depth first with a stack and the visited nodes as lists: one row a step.
_TRACE = """kids AS (SELECT caller_id, list({'n': callee_id, 'd': 0} ORDER BY s.name, c.id)[:50] AS k FROM f_call_relations c JOIN f_symbols s ON s.id = c.callee_id GROUP BY caller_id),
steps AS (SELECT 0 AS step, [{'n': (SELECT min(id) FROM f_symbols WHERE is_definition AND (lower(name) LIKE '%ring%' OR lower(qualified_name) LIKE '%ring%')), 'd': 0}] AS stack, CAST([] AS BIGINT[]) AS seen, CAST([] AS STRUCT(n BIGINT, d INTEGER)[]) AS done
UNION ALL SELECT step + 1, CASE WHEN list_contains(seen, stack[1].n) OR stack[1].d >= 5 THEN stack[2:] ELSE list_concat(list_transform(coalesce(k, []), lambda x: {'n': x.n, 'd': stack[1].d + 1}), stack[2:]) END,
CASE WHEN list_contains(seen, stack[1].n) THEN seen ELSE list_append(seen, stack[1].n) END, CASE WHEN list_contains(seen, stack[1].n) THEN done ELSE list_append(done, stack[1]) END
FROM steps LEFT JOIN kids ON caller_id = stack[1].n WHERE len(stack) > 0)"""


@query("g5_call_trace", "call_relations symbols", "SELECT CAST(pos AS INTEGER) AS pos, x.d AS depth, s.id, s.qualified_name FROM (SELECT unnest(range(len(done))) AS pos, unnest(done) AS x FROM steps WHERE len(stack) = 0) JOIN f_symbols s ON s.id = x.n", _TRACE)
def _(c, s): return traverse.call_trace(c, s, "ring", 5).select("pos", "depth", "id", "qualified_name")


@query("g6_call_graph_nodes", "call_relations symbols", f"""SELECT CAST(n.id AS VARCHAR) AS id, coalesce(s.qualified_name, 'symbol_' || CAST(n.id AS VARCHAR)) AS label, CASE WHEN s.kind = 'type' THEN 'Type' ELSE 'Function' END AS kind,
s.file_path, s.line, n.id AS symbol_id, CAST(NULL AS VARCHAR) AS metadata FROM (SELECT caller_id AS id FROM got UNION SELECT callee_id FROM got UNION SELECT {_CALLER}) n LEFT JOIN f_symbols s ON s.id = n.id""", _DOWN)
def _(c, s): return traverse.call_graph(_edges(c, s), s, busy(c, "caller_id"), 3)[0]


@query("g6_call_graph_edges", "call_relations symbols", "SELECT CAST(caller_id AS VARCHAR) AS source, CAST(callee_id AS VARCHAR) AS target, 'Call' AS edge_type, CAST(1.0 AS DOUBLE) AS weight, CAST(NULL AS VARCHAR) AS metadata FROM got", _DOWN)
def _(c, s): return traverse.call_graph(_edges(c, s), s, busy(c, "caller_id"), 3)[1]


@query("g7_file_graph_nodes", "include_relations", "SELECT id, regexp_extract(id, '[^/]*$') AS label, 'File' AS kind, id AS file_path, CAST(NULL AS INTEGER) AS line, CAST(NULL AS BIGINT) AS symbol_id, CAST(NULL AS VARCHAR) AS metadata FROM (SELECT source_file AS id FROM f_include_relations UNION SELECT target_file FROM f_include_relations)")
def _(i): return traverse.file_graph(i)[0]


@query("g7_file_graph_edges", "include_relations", "SELECT source_file AS source, target_file AS target, 'Include' AS edge_type, CAST(1.0 AS DOUBLE) AS weight, CAST(NULL AS VARCHAR) AS metadata FROM f_include_relations")
def _(i): return traverse.file_graph(i)[1]


_CHANGED = "(SELECT DISTINCT CASE WHEN id % 2 = 0 THEN source_file ELSE target_file END AS f FROM f_include_relations WHERE id % 40 < 9)"


@query("g8_impact", "include_relations", "SELECT f AS file FROM a UNION SELECT f FROM ch",
       f"ch AS {_CHANGED}, ed AS (SELECT source_file AS s, target_file AS t FROM f_include_relations UNION SELECT source_file, resolved_path FROM f_include_relations WHERE resolved_path IS NOT NULL), a(f) AS (SELECT f FROM ch WHERE regexp_matches(f, '\\.(h|hh|hpp|hxx)$') UNION SELECT ed.s FROM a JOIN ed ON ed.t = a.f)")
def _(i):
    return traverse.impact(i, i.where("id % 40 < 9").select(F.when(F.col("id") % 2 == 0, F.col("source_file")).otherwise(F.col("target_file"))))


@query("g9_context", "call_relations symbols", f"""SELECT 'symbol' AS part, 1 AS pos, (SELECT qualified_name FROM f_symbols WHERE id = {_BUSY}) AS text
UNION ALL SELECT 'file', CAST(row_number() OVER (ORDER BY line, id) AS INTEGER), kind || ' `' || qualified_name || '` line ' || CAST(line AS VARCHAR) FROM (SELECT * FROM f_symbols WHERE file_path = {_FILE} ORDER BY line, id LIMIT 15)
UNION ALL SELECT 'callers', CAST(row_number() OVER (ORDER BY level, id) AS INTEGER), caller_name FROM (SELECT * FROM up ORDER BY level, id LIMIT 10)
UNION ALL SELECT 'callees', CAST(row_number() OVER (ORDER BY level, id) AS INTEGER), callee_name FROM (SELECT * FROM down ORDER BY level, id LIMIT 10)""",
       f"""{_EDGES}, me AS (SELECT node FROM cls WHERE id = {_BUSY}),
up AS (SELECT * FROM (SELECT *, 1 AS level, row_number() OVER (PARTITION BY caller_name ORDER BY id) AS rn FROM e WHERE en = (SELECT node FROM me)) WHERE rn = 1),
down AS (SELECT * FROM (SELECT *, 1 AS level, row_number() OVER (PARTITION BY callee_name ORDER BY id) AS rn FROM e WHERE cn = (SELECT node FROM me)) WHERE rn = 1)""")
def _(c, s): return reports.collect_context(_edges(c, s), s, most(s, "file_path"), busy(c))


_ALL = "symbols call_relations include_relations reference_relations inheritance_relations file_info"
_COUNT = {
    "total_files": "(SELECT count(*) FROM f_file_info)", "parsed_files": "(SELECT count(*) FROM f_file_info WHERE parse_status = 'success')",
    "failed_files": "(SELECT count(*) FROM f_file_info WHERE parse_status = 'failed')", "total_symbols": "(SELECT count(*) FROM f_symbols)",
    **{f"total_{k}s": f"(SELECT count(*) FROM f_symbols WHERE kind = '{k}')" for k in ("function", "variable", "type", "macro")},
    **{f"total_{k}_relations": f"(SELECT count(*) FROM f_{k}_relations)" for k in ("call", "include", "reference", "inheritance")},
}


@query("a0_statistics", _ALL, "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _COUNT.items()) + ", CAST(0.0 AS DOUBLE) AS elapsed_seconds")
def _(*t): return stats.statistics(*t)


@query("a0b_parse_statistics", _ALL, "SELECT " + ", ".join(f"{v if k != 'parsed_files' else _COUNT['total_files'] + ' - ' + _COUNT['failed_files']} AS {k}" for k, v in _COUNT.items()) + ", CAST(2.5 AS DOUBLE) AS elapsed_seconds")
def _(*t): return stats.parse_statistics(*t, elapsed=2.5)


@query("a0d_project_info", _ALL, "SELECT 'p' AS project_id, 'indexed' AS status, " + ", ".join(f"{_COUNT[k]} AS {k}" for k in stats.INFO))
def _(*t): return stats.project_info(stats.statistics(*t), "p")


def _likes(column: str, patterns) -> str:
    return "(" + " OR ".join(f"lower({column}) LIKE '{p.lower()}'" for p in patterns) + ")"


@query("a1_syscalls", "kernel_symbols", f"""SELECT coalesce(nullif(regexp_extract(qualified_name, 'SYSCALL_DEFINE\\d\\((\\w+)', 1), ''), CASE WHEN starts_with(name, '__do_sys_') THEN substr(name, 10) WHEN starts_with(name, '__se_sys_') THEN substr(name, 10) WHEN starts_with(name, 'sys_') THEN substr(name, 5) ELSE name END) AS name,
coalesce(TRY_CAST(nullif(regexp_extract(name, 'SYSCALL_DEFINE([0-9])', 1), '') AS INTEGER), 0) AS number, CAST(NULL AS VARCHAR) AS params, file_path AS definition_file, line AS definition_line FROM f_kernel_symbols WHERE is_definition AND {_likes('name', analyzers.SYSCALL_PATTERNS)}""")
def _(s): return analyzers.syscalls(s)


@query("a2_ioctl_handlers", "kernel_symbols", f"SELECT name, CAST(NULL AS VARCHAR) AS cmd_number, CAST(NULL AS VARCHAR) AS direction, CAST(NULL AS VARCHAR) AS type_char, name AS function_handler, file_path AS file FROM f_kernel_symbols WHERE is_definition AND kind = 'function' AND {_likes('name', analyzers.IOCTL_PATTERNS)}")
def _(s): return analyzers.ioctl_handlers(s)


@query("a3_ipc_services", "kernel_symbols", """SELECT k AS service_name, max_by(qualified_name, {'n': name, 'i': id}) FILTER (WHERE contains(name, 'Stub')) AS stub_class,
max_by(qualified_name, {'n': name, 'i': id}) FILTER (WHERE contains(name, 'Proxy') AND NOT contains(name, 'Stub')) AS proxy_class, '[]' AS message_codes
FROM (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '(?:Stub)+$', ''), '(?:Proxy)+$', ''), '(?:Service)+$', ''), '(?:Ability)+$', ''), ''), name) AS k
FROM f_kernel_symbols WHERE is_definition AND kind = 'type' AND (lower(name) LIKE '%stub%' OR lower(name) LIKE '%proxy%' OR lower(qualified_name) LIKE '%iremotebroker%')) GROUP BY k""")
def _(s): return analyzers.ipc_services(s).withColumn("message_codes", F.to_json("message_codes"))


@query("a4_service_registrations", "kernel_symbols", f"SELECT name, qualified_name FROM f_kernel_symbols WHERE kind = 'function' AND {_likes('name', analyzers.REGISTRATION_PATTERNS)}")
def _(s): return analyzers.service_registrations(s)


@query("a5_ipc_trace", "kernel_symbols", f"SELECT {_SYMBOL} FROM f_kernel_symbols WHERE is_definition AND (lower(name) LIKE '%audio%' OR lower(qualified_name) LIKE '%audio%') ORDER BY kind, name, id LIMIT 100")
def _(s): return analyzers.ipc_trace(s, "Audio")


_RULES = [
    rules.Rule("ioctl", "an ioctl", r"_ioctl$", "function"), rules.Rule("lower", "plain", r"^[a-z_]+$", None, r"\.h$|f1"),
    rules.Rule("virtual", "is virtual", r"a", "type", None, '"is_virtual":true'), rules.Rule("brand", "brand", r"^brand1\d::sys"),
]


@query("a7_apply_rules", "kernel_symbols", " UNION ALL ".join(
    f"SELECT '{r.name}' AS rule_name, name AS symbol_name, file_path, line, '{r.description}' AS message, {i} AS rule_ord FROM f_kernel_symbols WHERE is_definition AND (regexp_matches(name, '{r.name_regex}') OR regexp_matches(qualified_name, '{r.name_regex}'))"
    + (f" AND kind = '{r.symbol_kind}'" if r.symbol_kind else "") + (f" AND regexp_matches(file_path, '{r.file_pattern}')" if r.file_pattern else "") + (f" AND contains(attributes, '{r.has_attribute}')" if r.has_attribute else "") for i, r in enumerate(_RULES)))
def _(s): return rules.apply_rules(s, _RULES)


@query("c1_grouped_by_file", "reference_relations", """SELECT file_path, count(*) OVER (PARTITION BY file_path) AS n, CAST(row_number() OVER (PARTITION BY file_path ORDER BY line, "column", id) AS INTEGER) AS pos, line, "column", id FROM f_reference_relations""")
def _(r): return client.grouped_by_file(r)


@query("c2_merged_by_name", "symbols", f"SELECT {_SYMBOL} FROM rep", _REP)
def _(s): return client.merged_by_name(s)


@query("c3_symbol_at_line", "symbols", f"SELECT {_SYMBOL} FROM f_symbols WHERE file_path = {_FILE} AND line <= 400 ORDER BY CASE WHEN coalesce(end_line, line) >= 400 THEN line END NULLS LAST, line DESC, id LIMIT 1")
def _(s): return client.symbol_at(s, most(s, "file_path"), 400)


@query("c3_symbols_at_places", "symbols places", "SELECT place_id, id AS symbol_id FROM (SELECT p.place_id, s.id, row_number() OVER (PARTITION BY p.place_id ORDER BY CASE WHEN coalesce(s.end_line, s.line) >= p.at THEN s.line END NULLS LAST, s.line DESC, s.id) AS rn FROM pl p JOIN f_symbols s ON s.file_path = p.file_path AND s.line <= p.at) WHERE rn = 1",
       "pl AS (SELECT p.place_id, s.file_path, s.line + p.shift AS at FROM f_places p JOIN f_symbols s ON s.id = p.symbol_near)")
def _(s, p):
    at = s.select(F.col("id").alias("symbol_near"), "file_path", "line")
    return client.symbols_at(s, p.join(at, "symbol_near").select("place_id", "file_path", (F.col("line") + F.col("shift")).alias("at")))


@query("c4_neighbourhood", "call_relations symbols", "SELECT DISTINCT caller_id AS source, callee_id AS target FROM (SELECT * FROM up UNION ALL SELECT * FROM down)",
       f"""{_EDGES}, me AS (SELECT node FROM cls WHERE id = {_BUSY}),
up AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY caller_name ORDER BY id) AS rn FROM e WHERE en = (SELECT node FROM me)) WHERE rn = 1),
down AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY callee_name ORDER BY id) AS rn FROM e WHERE cn = (SELECT node FROM me)) WHERE rn = 1)""")
def _(c, s): return client.neighbourhood(_edges(c, s), s, busy(c))


@query("c5_short_names", "kernel_symbols", "SELECT id, CASE WHEN len(p) > 2 THEN p[len(p) - 1] || '::' || p[len(p)] ELSE q END AS short FROM (SELECT id, q, string_split(q, '::') AS p FROM (SELECT id, 'ns::' || qualified_name AS q FROM f_kernel_symbols))")
def _(s): return s.select("id", short_name(F.concat(F.lit("ns::"), "qualified_name")).alias("short"))


_CHANGES = """SELECT coalesce(f.file_path, d.path) AS path, CASE WHEN f.file_path IS NULL THEN 'Added' WHEN d.path IS NULL THEN 'Deleted' ELSE 'Modified' END AS change_type
FROM f_file_info f FULL OUTER JOIN (SELECT * FROM f_disk UNION ALL SELECT * FROM f_disk_new) d ON f.file_path = d.path WHERE f.file_path IS NULL OR d.path IS NULL OR f.content_hash IS DISTINCT FROM d.content_hash"""


@query("i1_changes", "file_info disk disk_new", _CHANGES)
def _(f, d, n): return incremental.changes(d.unionByName(n), f)


@query("i1_digest_tree", "file_info disk disk_new", _CHANGES)
def _(f, d, n): return digest_tree.changes(d.unionByName(n), f)


@query("s2_file_hash", "texts", "SELECT path, sha256(text) AS content_hash FROM f_texts")
def _(t): return files.hashes(t.select("path", F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("string").alias("error")))


_DEDUP = """ds AS (SELECT * FROM (SELECT *, min(ordinal) OVER (PARTITION BY file, qualified_name, file_path, line) AS place, row_number() OVER (PARTITION BY file, qualified_name, file_path, line ORDER BY is_definition DESC, ordinal) AS rn FROM f_raw_symbols) WHERE rn = 1),
nf AS (SELECT file, qualified_name AS name, max(place) AS place FROM ds GROUP BY 1, 2),
np AS (SELECT name, coalesce(max(CASE WHEN is_definition THEN k END), min(k)) AS k FROM (SELECT qualified_name AS name, is_definition, {'f': string_split(file, '/'), 'p': place} AS k FROM ds) GROUP BY name)"""


@query("s7_deduplicated_symbols", "raw_symbols", "SELECT file, place, name, qualified_name, CASE WHEN kind IN ('function', 'variable', 'type', 'macro') THEN kind ELSE 'function' END AS kind, line, is_definition FROM ds", _DEDUP)
def _(r): return resolve.deduplicated_symbols(r).select("file", "place", "name", "qualified_name", "kind", "line", "is_definition")


@query("s8_names_in_file", "raw_symbols", "SELECT file, name, place FROM nf", _DEDUP)
def _(r):
    s = resolve.deduplicated_symbols(r)
    return resolve.names_in_file(s).join(s.select("id", "place"), "id").select("file", "name", "place")


def _results(symbols: DataFrame, calls: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """Rows as an extraction yields them: nested by file and part of it, in ordinal order."""
    def nested(df: DataFrame, field: str, names: list[str]) -> DataFrame:
        return df.groupBy("file", F.floor(F.col("ordinal") / PART_ROWS).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("ordinal", *names))).alias(field))

    out = nested(symbols, "symbols", ["name", "qualified_name", "kind", "sub_kind", "file_path", "line", "column", "end_line", "is_definition", "return_type", "parameters", "access", "attributes"])
    if calls is not None:
        out = out.join(nested(calls.withColumn("_f", F.col("file")), "calls", ["caller", "callee", F.col("_f").alias("file"), "line", "column", "is_virtual", "is_indirect", F.col("ordinal").alias("o")]), ["file", "part"], "full_outer")
    if references is not None:
        out = out.join(nested(references.withColumn("_f", F.col("file")), "references", ["symbol_name", F.col("_f").alias("file"), "line", "column", "ref_kind", F.col("ordinal").alias("o")]), ["file", "part"], "full_outer")
    return out


_CALLS = """near AS (SELECT c.*, a.place AS caller_place, b.place AS callee_place FROM f_raw_calls c LEFT JOIN nf a ON a.file = c.file AND a.name = c.caller LEFT JOIN nf b ON b.file = c.file AND b.name = c.callee)"""


@query("s9_calls_in_file", "raw_symbols raw_calls", "SELECT file, line, caller, callee, caller_place, callee_place FROM near WHERE caller_place IS NOT NULL AND callee_place IS NOT NULL", f"{_DEDUP}, {_CALLS}")
def _(r, c):
    s = resolve.deduplicated_symbols(r)
    found = resolve.calls_in_file(_results(r, c), resolve.names_in_file(s)).calls
    place = s.select("id", "place")
    a, b = place.select(F.col("id").alias("caller_id"), F.col("place").alias("caller_place")), place.select(F.col("id").alias("callee_id"), F.col("place").alias("callee_place"))
    return found.join(a, "caller_id").join(b, "callee_id").select("file", "line", "caller", "callee", "caller_place", "callee_place")


@query("s10_references_in_file", "raw_symbols raw_references", "SELECT r.file AS file_path, r.line, CASE WHEN ref_kind = 'odd' THEN 'read' ELSE ref_kind END AS ref_kind, n.place FROM f_raw_references r JOIN nf n ON n.file = r.file AND n.name = r.symbol_name", _DEDUP)
def _(r, x):
    s = resolve.deduplicated_symbols(r)
    rows = resolve.reference_rows(_results(r, None, x), resolve.names_in_file(s))
    return rows.join(s.select(F.col("id").alias("symbol_id"), "place"), "symbol_id").select("file_path", "line", "ref_kind", "place")


@query("s12_calls_across_files", "raw_symbols raw_calls", """SELECT c.file, c.line, c.caller, c.callee, a.k.p AS caller_place, array_to_string(a.k.f, '/') AS caller_file, b.k.p AS callee_place, array_to_string(b.k.f, '/') AS callee_file
FROM near c JOIN np a ON a.name = c.caller JOIN np b ON b.name = c.callee WHERE caller_place IS NULL OR callee_place IS NULL""", f"{_DEDUP}, {_CALLS}")
def _(r, c):
    s = resolve.deduplicated_symbols(r)
    near = resolve.calls_in_file(_results(r, c), resolve.names_in_file(s))
    found = resolve.calls_across_files(near.unresolved, resolve.names_in_project(s))
    for end in ("caller", "callee"):
        found = found.join(s.select(F.col("id").alias(f"{end}_id"), F.col("place").alias(f"{end}_place"), F.col("file").alias(f"{end}_file")), f"{end}_id")
    return found.select("file", "line", "caller", "callee", "caller_place", "caller_file", "callee_place", "callee_file")


@query("s15_compile_database", "compile_entries", """SELECT CASE WHEN starts_with(directory, '/old/base/') THEN '/new/' || substr(directory, 11) ELSE directory END AS directory, CASE WHEN starts_with(file, '/old/base/') THEN '/new/' || substr(file, 11) ELSE file END AS file, command, output FROM f_compile_entries""")
def _(e): return compile_db.rewritten(e, "/new")


@query("s17_directory_listing", "dir_entries", "SELECT * FROM f_dir_entries WHERE NOT starts_with(name, '.')")
def _(e): return files.ordered_listing(e)


_LINES = "ln AS (SELECT path, CASE WHEN text = '' THEN [] ELSE string_split(CASE WHEN suffix(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) END AS l FROM f_texts)"


@query("s19_code_slice", "texts", "SELECT path, CASE WHEN len(l) < 2 THEN 'no lines 2-4: the file has ' || CAST(len(l) AS VARCHAR) || ' lines' ELSE array_to_string(list_transform(range(2, least(4, len(l)) + 1), lambda i: lpad(CAST(i AS VARCHAR), 5, ' ') || ' | ' || l[i]), chr(10)) END AS text FROM ln", _LINES)
def _(t): return files.code_slice(t, 2, 4)


@query("s19_numbered_lines", "texts", "SELECT path, CAST(i AS INTEGER) AS number, l[i] AS line FROM (SELECT path, l, unnest(range(2, least(4, len(l)) + 1)) AS i FROM ln)", _LINES)
def _(t): return files.numbered_lines(t, 2, 4)


@query("s20_preview", "texts", "SELECT path, CAST(least(50, len(l)) AS INTEGER) AS end_line, array_to_string(l[1:50], chr(10)) AS content FROM ln", _LINES)
def _(t): return files.preview(t)


@query("s21_file_with_lines", "texts", "SELECT t.path, t.text AS content, CAST(len(l) AS INTEGER) AS lines FROM f_texts t JOIN ln USING (path)", _LINES)
def _(t): return files.with_line_count(t)


_NEW = "nw AS (SELECT id + 1000000 AS id, name || '_v2' AS name, qualified_name, file_path, line, kind FROM f_symbols WHERE id % 11 = 0)"


@query("w2_upserted_symbols", "symbols", "SELECT id, name, qualified_name, file_path, line, kind FROM f_symbols s WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.id = s.id OR (nw.qualified_name = s.qualified_name AND nw.file_path = s.file_path AND nw.line = s.line)) UNION ALL SELECT * FROM nw", _NEW)
def _(s):
    own = s.select("id", "name", "qualified_name", "file_path", "line", "kind")
    new = own.where("id % 11 = 0").withColumn("id", F.col("id") + 1000000).withColumn("name", F.concat("name", F.lit("_v2")))
    return store.upserted_symbols(own, new)


@query("w3_appended_calls", "call_relations", f"SELECT {_CALL} FROM f_call_relations")
def _(c): return store.appended(c.where("id % 2 = 0"), c.where("id % 2 = 1"))


@query("w4_upserted_files", "file_info", "SELECT file_path, CASE WHEN last_modified % 3 = 0 THEN 'failed' ELSE parse_status END AS parse_status, CASE WHEN last_modified % 3 = 0 THEN last_modified + 5 ELSE last_modified END AS last_modified FROM f_file_info")
def _(f):
    own = f.select("file_path", "parse_status", "last_modified")
    new = own.where("last_modified % 3 = 0").withColumn("parse_status", F.lit("failed")).withColumn("last_modified", F.col("last_modified") + 5)
    return store.upserted(own, new, ("file_path",))


_GONE = "gone AS (SELECT DISTINCT file_path FROM f_symbols WHERE id % 17 = 0 UNION SELECT 'src/o3.cpp' UNION SELECT min(source_file) FROM f_include_relations UNION SELECT min(file_path) FROM f_file_info)"


@query("w5_clear_files", _ALL, """SELECT 'symbols' AS t, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM f_symbols WHERE file_path NOT IN (SELECT * FROM gone) UNION ALL
SELECT 'call_relations', count(*), CAST(sum(id) AS BIGINT) FROM f_call_relations WHERE file_path NOT IN (SELECT * FROM gone) UNION ALL
SELECT 'include_relations', count(*), CAST(sum(id) AS BIGINT) FROM f_include_relations WHERE source_file NOT IN (SELECT * FROM gone) UNION ALL
SELECT 'reference_relations', count(*), CAST(sum(id) AS BIGINT) FROM f_reference_relations WHERE file_path NOT IN (SELECT * FROM gone) UNION ALL
SELECT 'inheritance_relations', count(*), CAST(sum(id) AS BIGINT) FROM f_inheritance_relations WHERE derived_id NOT IN (SELECT id FROM f_symbols WHERE file_path IN (SELECT * FROM gone)) UNION ALL
SELECT 'file_info', count(*), CAST(sum(last_modified) AS BIGINT) FROM f_file_info WHERE file_path NOT IN (SELECT * FROM gone)""", _GONE)
def _(s, c, i, r, h, f):
    gone = s.where("id % 17 = 0").select("file_path").union(s.sparkSession.createDataFrame([("src/o3.cpp",)], "f string")).union(i.agg(F.min("source_file"))).union(f.agg(F.min("file_path")))
    tables = {"symbols": s, "call_relations": c, "include_relations": i, "reference_relations": r, "inheritance_relations": h, "file_info": f}
    left = store.without_files(tables, gone)
    return store.union_all([left[t].agg(F.count(F.lit(1)).alias("n"), F.sum("last_modified" if t == "file_info" else "id").alias("ids")).select(F.lit(t).alias("t"), "n", "ids") for t in tables])


@query("w7_index_transfer", "include_relations", "SELECT * FROM f_include_relations")
def _(i): return store.unpacked(store.packed(i, "id"), "include_relations")


@query("t3_callers_report", "call_relations symbols", f"""SELECT 0 AS pos, '## callers of `' || (SELECT qualified_name FROM f_symbols WHERE id = {_BUSY}) || '`: ' || CAST((SELECT count(*) FROM got) AS VARCHAR) AS text UNION ALL
SELECT CAST(row_number() OVER (ORDER BY level, id) AS INTEGER), '- `' || caller_name || '` -> `' || (SELECT qualified_name FROM f_symbols WHERE id = {_BUSY}) || '` @ ' || file_path || ':' || CAST(line AS VARCHAR) || CASE WHEN is_virtual THEN ' (virtual)' ELSE '' END FROM got""", _UP)
def _(c, s): return reports.find_callers(_edges(c, s), s, busy(c), 3)


@query("t3_callees_report", "call_relations symbols", f"""SELECT 0 AS pos, '## callees of `' || (SELECT qualified_name FROM f_symbols WHERE id = {_CALLER}) || '`: ' || CAST((SELECT count(*) FROM got) AS VARCHAR) AS text UNION ALL
SELECT CAST(row_number() OVER (ORDER BY level, id) AS INTEGER), '- `' || (SELECT qualified_name FROM f_symbols WHERE id = {_CALLER}) || '` -> `' || callee_name || '` @ ' || file_path || ':' || CAST(line AS VARCHAR) FROM got""", _DOWN)
def _(c, s): return reports.find_callees(_edges(c, s), s, busy(c, "caller_id"), 3)


_REF = "(SELECT symbol_id FROM f_reference_relations WHERE symbol_id IN (SELECT id FROM f_symbols) GROUP BY symbol_id ORDER BY count(*) DESC, symbol_id LIMIT 1)"


@query("t4_references_report", "reference_relations symbols", f"""SELECT 0 AS pos, '## references to `' || (SELECT qualified_name FROM f_symbols WHERE id = {_REF}) || '`: ' || CAST((SELECT count(*) FROM f_reference_relations WHERE symbol_id = {_REF}) AS VARCHAR) AS text UNION ALL
SELECT CAST(row_number() OVER (ORDER BY file_path, line, id) AS INTEGER), '- [' || ref_kind || '] ' || file_path || ':' || CAST(line AS VARCHAR) || ':' || CAST("column" AS VARCHAR) FROM f_reference_relations WHERE symbol_id = {_REF}""")
def _(r, s): return reports.find_references(r, s, busy(r.join(s.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi"), "symbol_id"))


@query("t5_explain_symbol", "symbols", """SELECT CAST(pos AS INTEGER) AS pos, text FROM (SELECT unnest(range(10)) AS pos, unnest(['## `' || qualified_name || '`', '- kind: ' || kind, '- name: ' || name, '- qualified name: ' || qualified_name, '- file: ' || file_path || ':' || CAST(line AS VARCHAR), '- returns: ' || return_type,
'- parameters: ' || parameters, '- access: ' || upper(access[1]) || access[2:], '- lines: ' || CAST(line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR), CASE WHEN is_definition THEN '- definition: yes' END]) AS text FROM f_symbols WHERE id = 76) WHERE text IS NOT NULL""")
def _(s): return reports.explain_symbol(s, 76)


@query("t6_dependencies_report", "include_relations", f"""SELECT 0 AS pos, '### includes: ' || CAST((SELECT count(*) FROM f_include_relations WHERE source_file = {_SOURCE}) AS VARCHAR) AS text UNION ALL
SELECT CAST(row_number() OVER (ORDER BY line, id) AS INTEGER), '- [' || CASE WHEN is_system THEN 'system' ELSE 'project' END || '] `' || target_file || '` (line ' || CAST(line AS VARCHAR) || ')' FROM f_include_relations WHERE source_file = {_SOURCE} UNION ALL
SELECT CAST(1 + (SELECT count(*) FROM f_include_relations WHERE source_file = {_SOURCE}) AS INTEGER), '### included by: ' || CAST((SELECT count(*) FROM f_include_relations WHERE target_file = {_SOURCE}) AS VARCHAR)""")
def _(i): return reports.analyze_dependencies(i, most(i, "source_file"))


@query("t7_gather_context", _ALL, f"""SELECT 0 AS pos, 'symbol `' || qualified_name || '` (' || kind || ') @ ' || file_path || ':' || CAST(line AS VARCHAR) AS text FROM f_symbols WHERE id = 77 UNION ALL
SELECT 1, 'file `' || {_FILE} || '`: ' || CAST((SELECT count(*) FROM f_symbols WHERE file_path = {_FILE}) AS VARCHAR) || ' symbols' UNION ALL
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY line, id) + 1 AS INTEGER) AS pos, '  - ' || kind || ' `' || qualified_name || '` line ' || CAST(line AS VARCHAR) FROM f_symbols WHERE file_path = {_FILE}) WHERE pos < 22 UNION ALL
SELECT 22, '  - ... ' || CAST(n - 20 AS VARCHAR) || ' more' FROM (SELECT count(*) AS n FROM f_symbols WHERE file_path = {_FILE}) WHERE n > 20""")
def _(s, *t): return reports.gather_context(s, stats.statistics(s, *t), 77, most(s, "file_path"))


@query("t8_tool_search", "symbols", f"""SELECT 0 AS pos, 'symbols that match ''ring'': ' || CAST((SELECT count(*) FROM hits) AS VARCHAR) AS text UNION ALL
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN name = 'ring' THEN 0 WHEN lower(name) LIKE 'ring%' THEN 1 ELSE 2 END, length(name), id) AS INTEGER), '- [' || kind || '] `' || qualified_name || '` @ ' || file_path || ':' || CAST(line AS VARCHAR) || ' (ID=' || CAST(id AS VARCHAR) || ')' FROM hits""", f"{_REP}, hits AS ({_search_sql('ring', None, 50)})")
def _(s): return reports.tool_search(s, "ring")


@query("t8_tool_analyze_file", "symbols include_relations", f"""SELECT 0 AS pos, '### symbols: ' || CAST((SELECT count(*) FROM f_symbols WHERE file_path = {_FILE}) AS VARCHAR) AS text UNION ALL
SELECT CAST(row_number() OVER (ORDER BY line, id) AS INTEGER), '- [' || kind || '] `' || qualified_name || '` line ' || CAST(line AS VARCHAR) || ' (ID=' || CAST(id AS VARCHAR) || ')' FROM f_symbols WHERE file_path = {_FILE} UNION ALL
SELECT 1000000000, '### includes: 0'""")
def _(s, i): return reports.tool_analyze_file(s, i, most(s, "file_path"))


@query("t9_symbol_resource", "symbols", """SELECT '{"id":' || CAST(id AS VARCHAR) || ',"name":"' || name || '","qualified_name":"' || qualified_name || '","kind":"' || kind || '","file_path":"' || file_path || '","line":' || CAST(line AS VARCHAR) || ',"column":' || CAST("column" AS VARCHAR)
|| ',"end_line":' || CAST(end_line AS VARCHAR) || ',"is_definition":true,"return_type":"' || return_type || '","parameters":null,"access":"Public"}' AS text FROM f_symbols WHERE id = 76""")
def _(s): return reports.symbol_resource(s, 76)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q12_search"](spark, sf_dir)
