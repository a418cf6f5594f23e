"""Text reports over query results. A report is a DataFrame (pos, text) made by built-in functions; render() joins it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.numbering import numbered
from lattica.operators import lookup
from lattica.operators.search import search, search_tool
from lattica.operators.traverse import callees, callers

#: The skills, and their parameters as (name, type, required).
SKILLS = {
    "explain_function": [("symbol_id", "integer", True), ("detail_level", "string", False)],
    "explain_code": [("file_path", "string", True), ("start_line", "integer", True), ("end_line", "integer", True)],
    "find_callers": [("symbol_id", "integer", True), ("max_depth", "integer", False)],
    "find_callees": [("symbol_id", "integer", True), ("max_depth", "integer", False)],
    "find_references": [("symbol_id", "integer", True), ("ref_kind", "string", False)],
    "analyze_dependencies": [("file_path", "string", True), ("include_transitive", "boolean", False)],
    "explain_architecture": [("module_name", "string", False)],
    "suggest_refactoring": [("file_path", "string", True), ("symbol_id", "integer", False)],
    "find_similar_code": [("file_path", "string", True), ("start_line", "integer", True), ("end_line", "integer", True), ("threshold", "number", False)],
    "explain_macro": [("symbol_id", "integer", True)],
    "trace_data_flow": [("symbol_id", "integer", True), ("direction", "string", False)],
    "analyze_complexity": [("file_path", "string", False), ("symbol_id", "integer", False)],
    "compare_implementations": [("symbol_id_a", "integer", True), ("symbol_id_b", "integer", True)],
    "generate_documentation": [("symbol_id", "integer", True), ("style", "string", False)],
}
FILE_SYMBOLS, CONTEXT_SYMBOLS, CONTEXT_CALLS = 20, 15, 10


def skills(spark) -> DataFrame:
    """name, description, parameters of the skills."""
    rows = [(n, n.replace("_", " "), [{"name": p, "type": t, "required": r} for p, t, r in ps]) for n, ps in SKILLS.items()]
    return spark.createDataFrame(rows, "name string, description string, parameters array<struct<name:string,type:string,required:boolean>>")


def _text(parts: list) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _lines(rows: DataFrame, order: list, text: Column, first: int = 1) -> DataFrame:
    """pos, text of rows in an order."""
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"_key{i}") for i, o in enumerate(order)]
    return numbered(rows.select(text.alias("text"), *keys), [f"_key{i}" for i in range(len(keys))], first=first).select("pos", "text")


def _titled(lines: DataFrame, title: Column) -> DataFrame:
    """lines below a title of the number of lines (a column `n`)."""
    return lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("pos"), title.alias("text")).unionByName(lines)


def render(report: DataFrame) -> str:
    return "\n".join(r[0] for r in report.orderBy("pos").select("text").collect())


def _name(symbols: DataFrame, id_: int) -> str:
    found = lookup.symbol(symbols, id_).select("qualified_name").collect()
    return found[0][0] if found else f"symbol#{id_}"


def _place() -> list:
    return [F.col("file_path"), ":", F.col("line").cast("string")]


def find_callers(edges: DataFrame, symbols: DataFrame, id_: int, depth: int = 3) -> DataFrame:
    own = _name(symbols, id_)
    rows = lookup.with_endpoint(callers(edges, symbols, id_, depth), symbols, "caller_id", "caller", "symbol#")
    text = _text(["- `", F.col("caller_name"), f"` -> `{own}` @ ", *_place(), F.when(F.col("is_virtual"), " (virtual)").otherwise("")])
    return _titled(_lines(rows, ["level", "id"], text), F.format_string(f"## callers of `{own}`: %d", F.col("n")))


def find_callees(edges: DataFrame, symbols: DataFrame, id_: int, depth: int = 3) -> DataFrame:
    own = _name(symbols, id_)
    rows = lookup.with_endpoint(callees(edges, symbols, id_, depth), symbols, "callee_id", "callee", "symbol#")
    text = _text([f"- `{own}` -> `", F.col("callee_name"), "` @ ", *_place(), F.when(F.col("is_indirect"), " (indirect)").otherwise("")])
    return _titled(_lines(rows, ["level", "id"], text), F.format_string(f"## callees of `{own}`: %d", F.col("n")))


def find_references(references: DataFrame, symbols: DataFrame, id_: int) -> DataFrame:
    """All kinds of references, whatever kind is asked for."""
    own = _name(symbols, id_)
    text = _text(["- [", F.col("ref_kind"), "] ", *_place(), ":", F.col("column").cast("string")])
    return _titled(_lines(lookup.references_of(references, id_), ["file_path", "line", "id"], text), F.format_string(f"## references to `{own}`: %d", F.col("n")))


def explain_symbol(symbols: DataFrame, id_: int) -> DataFrame:
    """One line for each property that is known; for functions and macros alike."""
    c = lambda n: F.col(n).cast("string")
    parts = [
        _text(["## `", c("qualified_name"), "`"]), _text(["- kind: ", c("kind")]), _text(["- name: ", c("name")]), _text(["- qualified name: ", c("qualified_name")]),
        _text(["- file: ", *_place()]), _text(["- returns: ", c("return_type")]), _text(["- parameters: ", c("parameters")]), _text(["- access: ", F.initcap("access")]),
        _text(["- lines: ", c("line"), "-", c("end_line")]), F.when(F.col("is_definition"), F.lit("- definition: yes")),
    ]
    rows = lookup.symbol(symbols, id_).select(F.posexplode(F.array(*parts)).alias("pos", "text"))
    return rows.where("text IS NOT NULL")


def analyze_dependencies(includes: DataFrame, path: str) -> DataFrame:
    """Direct includes both ways, whatever transitive ones are asked for."""
    kind = F.when(F.col("is_system"), "system").otherwise("project")
    out = _titled(_lines(lookup.includes_of(includes, path), ["line", "id"], _text(["- [", kind, "] `", F.col("target_file"), "` (line ", F.col("line").cast("string"), ")"])), F.format_string("### includes: %d", F.col("n")))
    into = _titled(_lines(lookup.included_by(includes, path), ["source_file", "id"], _text(["- `", F.col("source_file"), "` (line ", F.col("line").cast("string"), ")"])), F.format_string("### included by: %d", F.col("n")))
    shift = out.agg(F.count(F.lit(1)).cast("int").alias("_s"))
    return out.unionByName(into.crossJoin(shift).select((F.col("pos") + F.col("_s")).alias("pos"), "text"))


def _symbol_line(indent: str = "") -> Column:
    return _text([f"{indent}- ", F.col("kind"), " `", F.col("qualified_name"), "` line ", F.col("line").cast("string")])


def gather_context(symbols: DataFrame, stats: DataFrame, id_: int | None = None, path: str | None = None) -> DataFrame:
    """The symbol, and the file's first symbols and how many more there are; without either, the index's statistics."""
    frames = []
    if id_ is not None:
        frames.append(lookup.symbol(symbols, id_).select(F.lit(0).alias("pos"), _text(["symbol `", F.col("qualified_name"), "` (", F.col("kind"), ") @ ", *_place()]).alias("text")))
    if path is not None:
        own = _lines(lookup.symbols_in_file(symbols, path), ["line", "id"], _symbol_line("  "), 2)
        n = own.agg(F.count(F.lit(1)).alias("n"))
        frames.append(n.select(F.lit(1).alias("pos"), F.format_string(f"file `{path}`: %d symbols", F.col("n")).alias("text")))
        frames.append(own.where(F.col("pos") < 2 + FILE_SYMBOLS))
        frames.append(n.where(F.col("n") > FILE_SYMBOLS).select(F.lit(2 + FILE_SYMBOLS).alias("pos"), F.format_string("  - ... %d more", F.col("n") - FILE_SYMBOLS).alias("text")))
    out = frames[0] if frames else None
    for f in frames[1:]:
        out = out.unionByName(f)
    if out is None or out.isEmpty():
        text = F.format_string("%d symbols, %d functions, %d files", "total_symbols", "total_functions", "total_files")
        return stats.select(F.lit(0).alias("pos"), text.alias("text"))
    return out


def collect_context(edges: DataFrame, symbols: DataFrame, path: str | None = None, id_: int | None = None) -> DataFrame:
    """part, pos, text: the file's first symbols, the symbol, its first callers and callees."""
    frames = []
    if path is not None:
        frames.append(_lines(lookup.symbols_in_file(symbols, path).limit(CONTEXT_SYMBOLS), ["line", "id"], _text([F.col("kind"), " `", F.col("qualified_name"), "` line ", F.col("line").cast("string")])).withColumn("part", F.lit("file")))
    if id_ is not None:
        spark = symbols.sparkSession
        name = spark.range(1).select(F.lit(id_).cast("long").alias("id")).join(symbols.select("id", "qualified_name"), "id", "left")
        frames.append(name.select(F.lit(1).alias("pos"), F.coalesce("qualified_name", F.lit(f"symbol_{id_}")).alias("text"), F.lit("symbol").alias("part")))
        for part, f, end in (("callers", callers, "caller_id"), ("callees", callees, "callee_id")):
            known = f(edges, symbols, id_, 1).orderBy("level", "id").limit(CONTEXT_CALLS).join(symbols.select(F.col("id").alias(end), "qualified_name"), end)
            frames.append(_lines(known, ["level", "id"], F.col("qualified_name")).withColumn("part", F.lit(part)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("part", "pos", "text")


def run_skill(name: str, graph, **params) -> DataFrame:
    """A skill by name, on an engine's tables; skills without an own report gather context."""
    if name not in SKILLS:
        raise KeyError(name)
    missing = [p for p, _, required in SKILLS[name] if required and p not in params]
    if missing and name in ("find_callers", "find_callees", "find_references", "explain_function", "explain_macro", "analyze_dependencies"):
        raise ValueError(f"{name} needs {', '.join(missing)}")
    depth = params.get("max_depth", 3)
    if name == "find_callers":
        return find_callers(graph.edges(), graph.symbols, params["symbol_id"], depth)
    if name == "find_callees":
        return find_callees(graph.edges(), graph.symbols, params["symbol_id"], depth)
    if name == "find_references":
        return find_references(graph.references, graph.symbols, params["symbol_id"])
    if name in ("explain_function", "explain_macro"):
        return explain_symbol(graph.symbols, params["symbol_id"])
    if name == "analyze_dependencies":
        return analyze_dependencies(graph.includes, params["file_path"])
    return gather_context(graph.symbols, graph.statistics(), params.get("symbol_id"), params.get("file_path"))


def tool_search(symbols: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    rows = search_tool(symbols, query, kind)
    text = _text(["- [", F.col("kind"), "] `", F.col("qualified_name"), "` @ ", *_place(), " (ID=", F.col("id").cast("string"), ")"])
    rank = F.when(F.col("name") == query, 0).when(F.lower("name").startswith(query.lower()), 1).otherwise(2) if kind is None else F.lit(0)
    return _titled(_lines(rows, [rank, F.length("name"), "id"], text), F.format_string(f"symbols that match '{query}': %d", F.col("n")))


def tool_call_graph(edges: DataFrame, symbols: DataFrame, name: str, direction: str = "both", depth: int = 3) -> DataFrame:
    """Callers and callees of the first hit of a search for the name."""
    hit = search(symbols, name, 5).collect()
    if not hit:
        raise LookupError(f"no symbol {name!r}")
    out = None
    for part, f, end in (("callers", callers, "caller_id"), ("callees", callees, "callee_id")):
        if direction in (part, "both"):
            rows = lookup.with_endpoint(f(edges, symbols, hit[0]["id"], depth), symbols, end, "end", "#")
            lines = _titled(_lines(rows, ["level", "id"], _text(["- `", F.col("end_name"), "` @ ", *_place()])), F.format_string(f"### {part}: %d", F.col("n")))
            base = 0 if part == "callers" else 1_000_000_000
            lines = lines.withColumn("pos", F.col("pos") + base)
            out = lines if out is None else out.unionByName(lines)
    return out


def tool_analyze_file(symbols: DataFrame, includes: DataFrame, path: str) -> DataFrame:
    own = _titled(_lines(lookup.symbols_in_file(symbols, path), ["line", "id"], _text(["- [", F.col("kind"), "] `", F.col("qualified_name"), "` line ", F.col("line").cast("string"), " (ID=", F.col("id").cast("string"), ")"])), F.format_string("### symbols: %d", F.col("n")))
    kind = F.when(F.col("is_system"), "system").otherwise("project")
    inc = _titled(_lines(lookup.includes_of(includes, path), ["line", "id"], _text(["- [", kind, "] `", F.col("target_file"), "` line ", F.col("line").cast("string")])), F.format_string("### includes: %d", F.col("n")))
    return own.unionByName(inc.withColumn("pos", F.col("pos") + 1_000_000_000))


def symbol_resource(symbols: DataFrame, id_: int) -> DataFrame:
    """One JSON text of a symbol, with its access in title case."""
    names = ("id", "name", "qualified_name", "kind", "file_path", "line", "column", "end_line", "is_definition", "return_type", "parameters")
    row = F.struct(*(F.col(c) for c in names), F.initcap("access").alias("access"))
    return lookup.symbol(symbols, id_).select(F.to_json(row, {"ignoreNullFields": "false"}).alias("text"))
