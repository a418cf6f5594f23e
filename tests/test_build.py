import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import incremental, resolve, store
from lattica.operators.rules import Rule, apply_rules, validate
from lattica.operators.stats import progress
from lattica.plans.engine import CodeGraph
from lattica.sources import compile_db, extraction, files
from lattica.sources.rules_file import load_rules
from tests.golden import frames, plain

A = '#include "b.h"\n#define LIMIT 3\nint helper(int x) { return x; }\nint main() {\n  helper(LIMIT);\n  remote(1);\n}\n'
B = "class Base {\n};\nclass Derived : public Base {\n};\nint remote(int x) {\n  return x;\n}\n"


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src/tests").mkdir(parents=True)
    (tmp_path / "src/a.cpp").write_text(A)
    (tmp_path / "src/b.h").write_text(B)
    (tmp_path / "src/_hidden.c").write_text("int h() { return 1; }\n")
    (tmp_path / "src/._mac.c").write_text("x")
    (tmp_path / "src/tests/t.c").write_text("x")
    (tmp_path / "src/readme.md").write_text("x")
    return tmp_path


def test_scan(spark, tree):
    names = [p.removeprefix(f"{tree}/") for p in files.source_paths(str(tree))]
    assert names == ["src/_hidden.c", "src/a.cpp", "src/b.h"]
    assert files.source_paths(str(tree), excluded=("src",)) == []
    assert files.source_paths(str(tree / "src/tests")) == []
    got = {r[0]: r[1] for r in files.hashes(files.contents(files.scan(spark, str(tree)))).collect()}
    assert len(set(got.values())) == 3 and all(len(h) == 64 for h in got.values())
    assert [r["name"] for r in files.listing(spark, str(tree / "src")).collect()] == ["tests", "_hidden.c", "a.cpp", "b.h", "readme.md"]
    assert f"-I{tree}/src" in files.include_folders(str(tree))
    assert files.find_compile_database(str(tree)) is None


def built(spark, root, tree, paths=None):
    found = files.scan(spark, str(tree)) if paths is None else paths
    texts = files.contents(found).cache()
    runs = extraction.extracted(texts, extraction.lexical).cache()
    results = extraction.decoded(runs.where("json IS NOT NULL").select("file", "json"))
    return results, extraction.file_records(texts, runs, results, 7)


def test_build_and_increment(spark, tree, tmp_path):
    results, records = built(spark, None, tree)
    graph = CodeGraph.build(spark, f"file://{tmp_path}/index", results, records, tree=files.scan(spark, str(tree)))
    assert [(r["target_file"], r["resolved_path"]) for r in graph.includes.collect()] == [("b.h", f"{tree}/src/b.h")]
    assert {r[0] for r in graph.impact(spark.createDataFrame([(f"{tree}/src/b.h",)], "path string")).collect()} == {f"{tree}/src/b.h", f"{tree}/src/a.cpp"}
    by_name = {r["qualified_name"]: r["id"] for r in graph.symbols.collect()}
    assert {"main", "helper", "remote", "LIMIT", "Base", "Derived"} <= by_name.keys()
    pairs = {(r["caller_id"], r["callee_id"]) for r in graph.calls.collect()}
    assert pairs == {(by_name["main"], by_name["helper"]), (by_name["main"], by_name["remote"])}
    assert graph.inheritance.count() == 1
    assert graph.statistics().first()["total_files"] == 3
    # remote moves to another file, b.h goes
    (tree / "src/b.h").unlink()
    (tree / "src/c.cpp").write_text("int remote(int x) {\n  return x + 1;\n}\n")
    disk = files.hashes(files.contents(files.scan(spark, str(tree))))
    changed = graph.changes(disk).cache()
    assert {r[0].rpartition("/")[2]: r[1] for r in changed.collect()} == {"b.h": "Deleted", "c.cpp": "Added"}
    again = changed.where("change_type <> 'Deleted'").select("path")
    results, records = built(spark, None, tree, again)
    unresolved = spark.createDataFrame([(f"{tree}/src/a.cpp", 1, "main", "remote", f"{tree}/src/a.cpp", 6, 3, False, False)], "file string, ordinal int, caller string, callee string, file_path string, line int, column int, is_virtual boolean, is_indirect boolean")
    new, left = graph.refreshed(changed, results, records, unresolved)
    by_name = {r["qualified_name"]: r["id"] for r in new.symbols.collect()}
    assert "Base" not in by_name
    assert {(r["caller_id"], r["callee_id"]) for r in new.calls.collect()} == {(by_name["main"], by_name["helper"]), (by_name["main"], by_name["remote"])}
    assert left.count() == 0
    assert new.files.count() == 3
    graph.close()


def test_extraction_is_strict(spark):
    ok = {"symbols": [], "calls": [], "includes": [], "inherits": []}
    df = lambda d: spark.createDataFrame([("f", json.dumps(d))], "file string, json string")
    assert extraction.decoded(df(ok)).first()["references"] == []
    with pytest.raises(Exception, match="required"):
        extraction.decoded(df({k: v for k, v in ok.items() if k != "calls"})).collect()
    with pytest.raises(Exception, match="required"):
        extraction.decoded(df(ok | {"calls": [{"caller": "a"}]})).collect()


def test_failing_extractor_is_recorded(spark):
    def broken(path, text):
        raise RuntimeError("no")

    texts = spark.createDataFrame([("x.c", bytearray(b"a"))], "path string, content binary")
    runs = extraction.extracted(texts, broken)
    none = extraction.decoded(runs.where("json IS NOT NULL").select("file", "json"))
    r = extraction.file_records(texts, runs, none, 1).first()
    assert (r["parse_status"], r["content_hash"], r["error_message"]) == ("failed", "", "RuntimeError: no")


def raw(ordinal, name, line, definition, file="f"):
    return (file, ordinal, name, name, "function", None, file, line, 1, None, definition, None, None, None, None)


def test_deduplication_and_names(spark):
    from lattica.plans.fixtures import TABLES

    schema = ", ".join(f"`{c}` {'int' if c in ('ordinal', 'line', 'column', 'end_line') else 'boolean' if c == 'is_definition' else 'string'}" for c, _ in TABLES["raw_symbols"][2])
    rows = [raw(0, "a", 1, False), raw(1, "a", 1, True), raw(2, "a", 1, True), raw(3, "a", 9, False), raw(0, "a", 2, True, "f/z"), raw(0, "b", 2, False, "f-")]
    s = resolve.deduplicated_symbols(spark.createDataFrame(rows, schema))
    got = {(r["file"], r["line"]): (r["place"], r["is_definition"]) for r in s.collect()}
    assert got == {("f", 1): (0, True), ("f", 9): (3, False), ("f/z", 2): (0, True), ("f-", 2): (0, False)}
    own = {(r["file"], r["name"]): r["id"] for r in resolve.names_in_file(s).collect()}
    ids = {(r["file"], r["line"]): r["id"] for r in s.collect()}
    assert own["f", "a"] == ids["f", 9]
    assert {r["name"]: r["id"] for r in resolve.names_in_project(s).collect()}["a"] == ids["f/z", 2]


def test_append_refuses_known_ids(spark):
    _, c = frames(spark)
    assert store.appended(c.limit(0), c).count() == 3
    with pytest.raises(Exception, match="duplicate id"):
        store.appended(c, c.limit(1)).collect()


def test_snapshots(spark, tmp_path):
    snaps = store.Snapshots(spark, f"file://{tmp_path}/x")
    with pytest.raises(FileNotFoundError):
        snaps.read()
    snaps.initialize()
    first = snaps.current()
    snaps.initialize()
    assert snaps.current() == first and snaps.read()["symbols"].count() == 0
    s, c = frames(spark)
    snaps.write(store.empty_tables(spark) | {"symbols": s, "call_relations": c})
    assert snaps.read()["symbols"].count() == 6


def test_clear_file(spark):
    s, c = frames(spark)
    tables = store.empty_tables(spark) | {"symbols": s, "call_relations": c, "inheritance_relations": spark.createDataFrame([(1, 6, 2, "public", False)], "id long, derived_id long, base_id long, access string, is_virtual boolean")}
    left = store.without_files(tables, spark.createDataFrame([("src/network.h",), ("src/core.cpp",)], "f string"))
    assert (left["symbols"].count(), left["call_relations"].count(), left["inheritance_relations"].count()) == (4, 2, 0)


def test_changes(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, content_hash string")
    known = spark.createDataFrame([("a", "1"), ("b", ""), ("c", "3")], "file_path string, content_hash string")
    assert {tuple(r) for r in incremental.changes(disk, known).collect()} == {("b", "Modified"), ("c", "Deleted"), ("d", "Added")}


def test_json_store(tmp_path):
    s = store.JsonStore(str(tmp_path))
    s.save("a", {"updated_at": "2024-01-01"})
    s.save("b", {"updated_at": "2024-02-01"})
    (tmp_path / "bad.json").write_text("{")
    assert [d["updated_at"] for d in s.listed()] == ["2024-02-01", "2024-01-01"]
    s.delete("a")
    assert len(s.listed()) == 1


def test_compile_database(spark):
    rows = [("/w/old/x", "/w/old/x/a.c"), ("/w/old", "/w/old/y/b.c"), ("/w/old/", None)]
    df = spark.createDataFrame(rows, "directory string, file string")
    assert [tuple(r) for r in compile_db.rewritten(df, "/n").collect()] == [("/n/x", "/n/x/a.c"), ("/n", "/n/y/b.c"), ("/n", None)]
    apart = spark.createDataFrame([("a/b", "c/d")], "directory string, file string")
    assert [tuple(r) for r in compile_db.rewritten(apart, "/n").collect()] == [("a/b", "c/d")]


@pytest.mark.parametrize("rule", [Rule("", "d", "x"), Rule("r", "d", ""), Rule("r", "d", "[invalid"), Rule("r", "d", "x", "gadget"), Rule("r", "d", "x", None, "["), Rule("r", "d", "(?=x)")])
def test_rules_are_validated(rule):
    with pytest.raises(ValueError):
        validate(rule)


def test_rules(spark, tmp_path):
    s, _ = frames(spark, [plain(1, "Été", attributes='{"is_virtual":true}'), plain(2, "b"), plain(3, "decl", definition=False)])
    found = [Rule("u", "m", r"^\w+$"), Rule("v", "m", ".", None, None, "is_virtual")]
    assert sorted((r["rule_name"], r["symbol_name"]) for r in apply_rules(s, found).collect()) == [("u", "b"), ("u", "Été"), ("v", "Été")]
    assert apply_rules(s, []).count() == 0
    f = tmp_path / "rules.yaml"
    f.write_text("- {name: a, description: d, severity: Error, pattern: {name_regex: x}}\n")
    assert load_rules(str(f))[0].action == "Report"
    f.write_text("- {name: a, description: d, severity: Error, pattern: {name_regex: '['}}\n")
    with pytest.raises(ValueError):
        load_rules(str(f))


def test_progress():
    assert progress(5, 10, 2.0) == {"percentage": 50.0, "rate": 2.5, "remaining": 2.0}
    assert progress(0, 0, 0.0)["percentage"] == 0.0


def test_stream(spark, tree, tmp_path):
    from lattica.streaming import increment

    folder = tmp_path / "arrive"
    folder.mkdir()
    line = lambda f, h, text=None, gone=False: json.dumps({"file": f, "content_hash": h, "json": text and json.dumps(extraction.lexical(f, text)), "error": None, "deleted": gone})
    root = f"file://{tmp_path}/idx"

    def step(name, *lines):
        (folder / name).write_text("\n".join(lines) + "\n")
        increment.run(spark, str(folder), root, f"{tmp_path}/ck", lambda: 1).awaitTermination()
        tables = store.Snapshots(spark, root).read()
        return {r["name"] for r in tables["symbols"].collect()}

    assert step("1.json", line("a.cpp", "1", A), line("b.h", "2", B)) >= {"main", "remote", "Base"}
    assert "Base" not in step("2.json", line("b.h", "2", None, True))
