import os

import pytest
from pyspark.sql import functions as F

from lattica.operators import analyzers, client, reports, traverse
from lattica.operators.rules import Rule, _conditions, apply_rules, required_text
from tests.golden import frames, plain

SF = "/root/testdata/sf0.001"


def test_syscall_names(spark):
    names = [("sys_read", "sys_read", "read"), ("__do_sys_write", "x", "write"), ("SYSCALL_DEFINE3", "SYSCALL_DEFINE3(read, int)", "read"), ("system", "system", "system")]
    s, _ = frames(spark, [plain(i, n, q) for i, (n, q, _) in enumerate(names)])
    got = {r["definition_line"]: None for r in analyzers.syscalls(s).collect()}
    assert got == {1: None}
    assert sorted(r["name"] for r in analyzers.syscalls(s).collect()) == sorted(n[2] for n in names)
    assert max(r["number"] for r in analyzers.syscalls(s).collect()) == 3


def test_service_names(spark):
    df = spark.createDataFrame([("AudioPolicyStub",), ("CameraProxy",), ("WindowManagerService",), ("StubStub",), ("XStubService",)], "n string")
    assert [r[0] for r in df.select(analyzers.service_key(F.col("n"))).collect()] == ["AudioPolicy", "Camera", "WindowManager", "StubStub", "XStub"]


def test_services_take_the_last_class(spark):
    s, _ = frames(spark, [plain(1, "AStub", "a::AStub", "type"), plain(2, "AStub", "b::AStub", "type"), plain(3, "AProxy", "c::AProxy", "type"), plain(4, "Z", "z::IRemoteBroker", "type")])
    got = {r["service_name"]: (r["stub_class"], r["proxy_class"], r["message_codes"]) for r in analyzers.ipc_services(s).collect()}
    assert got == {"A": ("b::AStub", "c::AProxy", []), "Z": (None, None, [])}


def test_reports(spark):
    s, c = frames(spark)
    e = traverse.node_edges(c, s)
    text = reports.render(reports.find_callers(e, s, 4, 3))
    assert text.splitlines()[0] == "## callers of `net::connect_socket`: 3" and "(virtual)" in text
    assert reports.render(reports.find_callees(e, s, 99)).endswith(": 0")
    assert "- access: Private" in reports.render(reports.explain_symbol(s, 4))
    assert reports.skills(spark).count() == 14
    assert reports.tool_call_graph(e, s, "main").count() > 2
    with pytest.raises(LookupError):
        reports.tool_call_graph(e, s, "nothing")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the benchmark tables")
@pytest.mark.parametrize("name", ["q12_search", "g2_callers", "a3_ipc_services", "i1_changes", "s12_calls_across_files", "s19_code_slice"])
def test_catalogue_against_sql(spark, name):
    import duckdb

    from lattica.plans import catalogue

    db = duckdb.connect()
    for t in ("part", "orders", "events", "supplier", "documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    rel = db.sql(catalogue.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = sorted(map(repr, rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()) == want and want


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert len(names) > 60 and set(entry.oracle_sql()) <= set(names)


def test_symbols_at_places(spark):
    """Nested, equal, empty and one-line intervals over several stretches of lines, against every pair of a place and a symbol."""
    import random

    r = random.Random(2)
    rows = []
    for i in range(400):
        line = r.choice([r.randrange(1, 60), r.randrange(1, 6000), 512, 1024])
        rows.append((i, f"f{r.randrange(4)}", line, r.choice([None, line, line + r.randrange(5), line + r.randrange(3000), line - 1])))
    asked = [(i, f"f{r.randrange(6)}", r.choice([r.randrange(0, 60), r.randrange(0, 7000), 512, 1024])) for i in range(500)]
    want = {}
    for i, path, at in asked:
        near = [(s[2], s[0], s[3] if s[3] is not None else s[2]) for s in rows if s[1] == path and s[2] <= at]
        if near:
            holds = [x for x in near if x[2] >= at]
            want[i] = min(holds)[1] if holds else min(near, key=lambda x: (-x[0], x[1]))[1]
    symbols = spark.createDataFrame(rows, "id long, file_path string, line int, end_line int")
    places = spark.createDataFrame(asked, "place_id long, file_path string, at int")
    assert {x["place_id"]: x["symbol_id"] for x in client.symbols_at(symbols, places).collect()} == want
    assert client.symbols_at(symbols.limit(0), places).count() == 0 and client.symbols_at(symbols, places.limit(0)).count() == 0


def test_places_of_a_hot_file_meet_one_row_each(spark):
    """As many symbols as places in one file: no operator gives more rows than both have together, at a few stretches each."""
    symbols = spark.range(20_000).select("id", F.lit("f").alias("file_path"), (F.col("id") % 5_000).cast("int").alias("line"), F.lit(None).cast("int").alias("end_line"))
    places = spark.range(20_000).select(F.col("id").alias("place_id"), F.lit("f").alias("file_path"), (F.col("id") % 5_000).cast("int").alias("at"))
    found = client.symbols_at(symbols, places)
    assert found.count() == 20_000 and found.where(F.col("symbol_id") != F.col("place_id") % 5_000).count() == 0


def test_required_texts():
    texts = {"_ioctl$": "_ioctl", "^[a-z_]+$": "", "a(?:bcd)+e": "bcd", "abc|abd": "ab", "(?i)abc": "", "ab?cde": "cde", r"^\w+::run\b": "::run", "x(?:abc){0,3}": "x", "a.bcde[fg]hi": "bcde", "(net|disk)_read": "_read", "(?i:abc)d": "d"}
    for pattern, text in texts.items():
        found = required_text(pattern)
        assert found == text or pattern == "abc|abd" and found in ("", "ab"), (pattern, found)


def test_many_rules_give_what_conditions_give(spark):
    import random

    r = random.Random(1)
    words = ["read", "write", "open", "Été", "ioctl", "a", "x_y"]
    rows = [plain(i, r.choice(words) + r.choice(["", "_", "Été"]) + r.choice(words), r.choice([None, "net::", "q::"]) and "net::" + r.choice(words), definition=r.random() < 0.8, attributes=r.choice([None, '{"is_virtual":true}'])) for i in range(300)]
    s, _ = frames(spark, rows)
    kinds = ["", "^", "(?i)"]
    found = [Rule(f"r{i}", f"m{i}", r.choice(kinds) + r.choice(words) + r.choice(["", "$", ".*d", r"\w", "[a-e]?"]), r.choice([None, "function", "type"]), r.choice([None, "cpp$", "nothing"]), r.choice([None, None, "is_virtual"])) for i in range(400)]
    want = _conditions(s.where("is_definition"), list(enumerate(found)))
    got = apply_rules(s, found)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() > 500
    few, many = (apply_rules(s, [Rule(f"r{i}", "m", f"name{i}") for i in range(n)])._jdf.queryExecution().optimizedPlan().toString() for n in (2, 2_000))
    assert len(many) < 2 * len(few) + 2_000 or "LocalRelation" in many
