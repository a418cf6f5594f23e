"""The extractor that needs no compiler, include paths, and what the order of arrivals must not change."""

import json
import random

from lattica.operators import resolve, store
from lattica.sources import compile_db, files
from lattica.sources.lexical import lexical

TEXT = """#include "b.h"
#include <vector>
// int no(int);
namespace net { namespace v2 {
enum Color { RED, GREEN = 2 };
enum class Mode : int { ON, OFF };
typedef unsigned long size_type;
typedef void (*handler)(int);
using Names = std::vector<std::string>;
extern int shared;
static const int kMax = 10, kMin = 1;
int counter;
class Base : public Root, private virtual other::Side<int> {
 public:
  Base(int x) : a_(x), b_{2} { init(); }
  virtual ~Base();
  virtual int run(const char *s, int n = 3) const = 0;
  static Base* make();
  int get() const { return a_; }
 protected:
  int a_;
 private:
  std::map<int, std::string> names_;
  static int count_;
};
struct Derived final : Base {
  int run(const char *s, int n) const override;
};
int Derived::run(const char *s, int n) const {
  int total = n, *p = &counter;
  for (int i = 0; i < n; ++i) {
    total += helper(i);
    counter = counter + RED;
  }
  counter++;
  Base *b = Base::make();
  b->run("x(y)", 1);
  handler h = &helper;
  if (total > kMax) return get();
  arr[total] = Mode::ON;
  return total;
}
}}
int helper(int x);
int net::v2::Base::count_ = 0;
"""


def test_symbols():
    d = lexical("a.cpp", TEXT)
    of = {}
    for s in d["symbols"]:
        of.setdefault(s["qualified_name"], []).append(s)
    one = lambda name: of[name][0]
    assert [(k, one(f"net::v2::{k}")["sub_kind"]) for k in ("Color", "Mode", "size_type", "handler", "Names", "Base", "Derived")] == [
        ("Color", "enum"), ("Mode", "enum"), ("size_type", "typedef"), ("handler", "typedef"), ("Names", "typedef"), ("Base", "class"), ("Derived", "struct"),
    ]
    assert one("net::v2::size_type")["return_type"] == "unsigned long" and one("net::v2::Names")["return_type"] == "std::vector<std::string>"
    assert not one("net::v2::shared")["is_definition"] and one("net::v2::kMin")["is_definition"]
    assert json.loads(one("net::v2::kMax")["attributes"]) == {"type_name": "const int", "scope": "global", "is_const": True}
    run, get = one("net::v2::Base::run"), one("net::v2::Base::get")
    assert (run["access"], run["is_definition"], json.loads(run["parameters"])) == ("public", False, [["const char *", "s"], ["int", "n"]])
    assert json.loads(run["attributes"]) == {"is_virtual": True, "is_static": False, "is_inline": False}
    assert (get["is_definition"], get["line"], get["column"], get["end_line"]) == (True, 19, 7, 19)
    assert (one("net::v2::Base::a_")["sub_kind"], one("net::v2::Base::a_")["access"], one("net::v2::Base::names_")["access"]) == ("member", "protected", "private")
    assert [s["is_definition"] for s in of["net::v2::Base::count_"]] == [False, True]
    assert json.loads(one("total")["attributes"])["scope"] == "local" and "no" not in of
    assert [s["is_definition"] for s in of["net::v2::Derived::run"]] == [False, True] and of["net::v2::Derived::run"][1]["end_line"] == 42


def test_relations():
    d = lexical("a.cpp", TEXT)
    assert [(x["target_file"], x["is_system"], x["line"]) for x in d["includes"]] == [("b.h", False, 1), ("vector", True, 2)]
    assert [(x["derived"], x["base"], x["access"], x["is_virtual"]) for x in d["inherits"]] == [
        ("net::v2::Base", "Root", "public", False), ("net::v2::Base", "other::Side<int>", "private", True), ("net::v2::Derived", "Base", "public", False),
    ]
    assert [(x["caller"].rpartition("::")[2], x["callee"], x["line"], x["is_virtual"]) for x in d["calls"]] == [
        ("Base", "init", 15, False), ("run", "helper", 32, False), ("run", "net::v2::Base::make", 36, False), ("run", "net::v2::Derived::run", 37, True), ("run", "net::v2::Base::get", 39, False),
    ]
    found = {(x["symbol_name"], x["line"], x["ref_kind"]) for x in d["references"]}
    assert {("net::v2::counter", 30, "address"), ("net::v2::counter", 33, "write"), ("net::v2::counter", 33, "read"), ("net::v2::RED", 33, "read"), ("net::v2::counter", 35, "write"), ("helper", 38, "address"), ("net::v2::Mode::ON", 40, "read"), ("total", 32, "write"), ("i", 31, "write")} <= found
    assert not any(name in ("s", "n", "net::v2::Base::a_") for name, *_ in found)


def test_any_text_ends():
    r = random.Random(1)
    tokens = TEXT.replace("(", " ( ").replace("{", " { ").split()
    for _ in range(300):
        lexical("x.c", " ".join(r.choice(tokens) for _ in range(r.randrange(60))))
    assert lexical("x.c", "") == {"symbols": [], "calls": [], "includes": [], "inherits": [], "references": []}


def test_include_paths(spark):
    rows = [(1, "/s/a/x.c", "../b/h.h", 1, False, None), (2, "/s/a/x.c", "y.h", 1, True, None), (3, "/s/a/x.c", "y.h", 1, False, None), (4, "/s/a/x.c", "own.h", 1, True, None), (5, "/s/a/x.c", "no.h", 1, False, None), (6, "/s/a/x.c", "/t/z.h", 1, True, None), (7, "/s/a/x.c", "k", 1, False, "kept")]
    includes = spark.createDataFrame(rows, "id long, source_file string, target_file string, line int, is_system boolean, resolved_path string")
    tree = spark.createDataFrame([(p,) for p in ("/s/b/h.h", "/s/a/y.h", "/s/inc/y.h", "/w/own/own.h", "/t/z.h")], "path string")
    entries = spark.createDataFrame([("/w", "/s/a/x.c", "cc -I own -I/nowhere -c x.c", None), ("/w", "/s/other.c", None, ["cc", "-Iown"])], "directory string, file string, command string, arguments array<string>")
    flags = compile_db.include_folders(entries)
    assert sorted((r["file"], r["folder"]) for r in flags.collect()) == [("/s/a/x.c", "/nowhere"), ("/s/a/x.c", "/w/own"), ("/s/other.c", "/w/own")]
    got = {r["id"]: r["resolved_path"] for r in resolve.with_resolved_paths(includes, tree, ["/s/./inc/"], flags).collect()}
    assert got == {1: "/s/b/h.h", 2: "/s/inc/y.h", 3: "/s/a/y.h", 4: "/w/own/own.h", 5: None, 6: "/t/z.h", 7: "kept"}


def test_sources_among_are_those_of_a_walk(spark, tmp_path):
    names = ["a.c", "b.CPP", "sub/c.hxx", "sub/._d.c", "tests/e.c", "sub/.git/f.h", "sub/mine/g.h", "noend", "h.txt", ".c", "x.y.cc"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    walked = {p.removeprefix(f"{tmp_path}/") for p in files.source_paths(str(tmp_path), excluded=("mine",))}
    listed = files.sources_among(spark.createDataFrame([(n,) for n in names], "path string"), excluded=("mine",))
    assert {r[0] for r in listed.collect()} == walked == {"a.c", "b.CPP", "sub/c.hxx", "x.y.cc"}


def test_snapshots_are_never_replaced(spark, tmp_path):
    snaps = store.Snapshots(spark, f"file://{tmp_path}/x")
    seen = [snaps.write(store.empty_tables(spark)) for _ in range(4)]
    assert snaps.current() == seen[-1] and len(snaps._pointers()) == 2
    assert snaps.edges().count() == 0


def test_order_of_arrivals(spark, tmp_path):
    from lattica.streaming import increment

    caller, callee = "int main() { far(); return 0; }", "int far() { return 1; }"
    line = lambda f, h, text, seq=0: json.dumps({"file": f, "content_hash": h, "json": json.dumps(lexical(f, text)), "error": None, "deleted": False, "seq": seq})
    for k, order in enumerate(([("a.c", caller), ("b.c", callee)], [("b.c", callee), ("a.c", caller)])):
        folder, root = tmp_path / f"in{k}", f"file://{tmp_path}/index{k}"
        folder.mkdir()
        for i, (f, text) in enumerate(order):
            (folder / f"{i}.json").write_text(line(f, "old", "int old;", 1) + "\n" + line(f, f, text, 2) + "\n" + line(f, "older", "int older;") + "\n")
            increment.run(spark, str(folder), root, f"{tmp_path}/ck{k}", lambda: 1).awaitTermination()
        tables = store.Snapshots(spark, root).read()
        names = {r["id"]: r["name"] for r in tables["symbols"].collect()}
        assert sorted(names.values()) == ["far", "main"]
        assert [(names[r["caller_id"]], names[r["callee_id"]]) for r in tables["call_relations"].collect()] == [("main", "far")]
        assert tables["unresolved_calls"].count() == 0 and {r["symbol_count"] for r in tables["file_info"].collect()} == {1}


def test_the_extractor_runs_once_on_all_cores(spark):
    import __spark_entry__ as entry

    df = entry.queries()["s5_lexical_extraction"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert df.rdd.getNumPartitions() >= 4
