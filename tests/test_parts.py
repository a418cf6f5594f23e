"""Long extraction results: documents beyond Spark's own bound on texts, and documents in parts."""

import json

import pytest

from lattica.operators import resolve, store
from lattica.schema import PART_ROWS
from lattica.sources import extraction
from lattica.streaming import calls, increment

CALL = {"file": "a.c", "line": 1, "column": 1, "is_virtual": False, "is_indirect": False}


def symbol(name, line, **more):
    return {"name": name, "qualified_name": name, "kind": "function", "file_path": "a.c", "line": line, "column": 1, "is_definition": True, **more}


def document(symbols=(), found=()):
    return json.dumps({"symbols": [*symbols], "calls": [{**CALL, "caller": a, "callee": b} for a, b in found], "includes": [], "inherits": []})


def arrival(text, part=None, content_hash="1"):
    return json.dumps({"file": "a.c", "content_hash": content_hash, "json": text, "error": None, "deleted": False, "part": part}) + "\n"


def test_document_beyond_20_million_characters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    long = symbol("f", 1, parameters="x" * 21_000_000)
    (tmp_path / "in" / "1.json").write_text(arrival(document([long, symbol("g", 2)], [("f", "g")])))
    calls.extracted(spark, f"{tmp_path}/in", f"{tmp_path}/root").awaitTermination()
    assert [(r["caller"], r["callee"]) for r in spark.read.schema(calls.NEAR).parquet(f"{tmp_path}/root/near/*").collect()] == [("f", "g")]


def test_a_line_that_is_no_arrival_fails_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(arrival(document())[:-5] + "\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|[Mm]alformed"):
        calls.extracted(spark, f"{tmp_path}/in", f"{tmp_path}/root").awaitTermination()


def test_parts_are_one_file(spark):
    rows = [("a.c", 1, document([symbol("g", 2, is_definition=False), symbol("f", 1)], [("f", "g")])), ("a.c", 0, document([symbol("f", 1)], [("g", "f")] * 2)), ("b.c", None, document([symbol("h", 1)]))]
    results = extraction.decoded(spark.createDataFrame(rows, "file string, part int, json string"))
    symbols = resolve.deduplicated_symbols(resolve.raw_symbols(results))
    assert {(r["file"], r["name"], r["place"]) for r in symbols.collect()} == {("a.c", "f", 0), ("a.c", "g", PART_ROWS), ("b.c", "h", 0)}
    near = resolve.calls_in_file(results, resolve.names_in_file(symbols)).calls
    assert sorted((r["ordinal"], r["caller"]) for r in near.collect()) == [(0, "g"), (1, "g"), (PART_ROWS, "f")]
    assert {r["file"]: r["n"] for r in extraction.sizes(results).collect()} == {"a.c": 3, "b.c": 1}


def test_a_part_with_too_many_rows_fails(spark):
    many = json.dumps({"symbols": [], "calls": [], "includes": [{"source_file": "a.c", "target_file": "b", "line": 1, "is_system": False}] * (PART_ROWS + 1), "inherits": []})
    frame = lambda part: spark.createDataFrame([("a.c", part, many)], "file string, part int, json string")
    assert resolve.include_rows(extraction.decoded(frame(None))).count() == PART_ROWS + 1
    with pytest.raises(Exception, match="too many rows"):
        resolve.include_rows(extraction.decoded(frame(0))).collect()


def test_parts_arrive_as_one_change(spark, tmp_path):
    folder, root = tmp_path / "in", f"file://{tmp_path}/index"
    folder.mkdir()
    one, two = document([symbol("f", 1)], [("f", "g")]), document([symbol("g", 2)])
    (folder / "1.json").write_text(arrival(document([symbol("old", 1)]), 2, "0") + arrival(one, 0) + arrival(two, 1))

    def after():
        increment.run(spark, str(folder), root, f"{tmp_path}/ck", lambda: 1).awaitTermination()
        tables = store.Snapshots(spark, root).read()
        return sorted(r["name"] for r in tables["symbols"].collect()), tables["call_relations"].count(), [(r["symbol_count"], r["parse_status"]) for r in tables["file_info"].collect()]

    assert after() == (["f", "g"], 1, [(2, "success")])
    (folder / "2.json").write_text(arrival(one, 0, "2"))
    assert after() == (["f"], 0, [(1, "success")])


def test_documents_are_read_once_for_all_tables(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    documents = spark.createDataFrame([("a.c", document([symbol("f", 1)], [("f", "f")])), ("b.c", document([symbol("g", 1)]))], "file string, json string")
    tables = resolve.resolved_tables(extraction.decoded(documents.mapInPandas(counted, documents.schema)))
    assert {t: df.count() for t, df in tables.items() if t in ("symbols", "call_relations", "unresolved_calls")} == {"symbols": 2, "call_relations": 1, "unresolved_calls": 0}
    assert read.value == 2
