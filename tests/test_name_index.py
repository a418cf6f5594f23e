"""Search by posting lists against the scan, and what it reads."""

import random

import pytest

from lattica.operators import name_index, search, store
from lattica.schema import struct_of


def symbols(spark, rows):
    wanted = struct_of("symbols")
    return spark.createDataFrame([tuple(r.get(f.name) for f in wanted) for r in rows], wanted)


def row(i, qualified, file, name=None, definition=True, kind="function"):
    return {"id": i, "name": name or qualified.rpartition("::")[2], "qualified_name": qualified, "kind": kind, "file_path": file, "line": i, "column": 1, "is_definition": definition, "project_id": "p"}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    r, rows = random.Random(3), []
    for i in range(600):
        space, name = r.choice(["net", "Net", "disk", "Été", "a"]), r.choice(["read", "Write", "open", "close", "poll"]) + r.choice(["", "er", "_all", "X"]) + str(r.randrange(40))
        rows.append(row(i, f"{space}::{name}", f"src/f{r.randrange(30)}.{r.choice('ch')}", definition=r.random() < 0.6, kind=r.choice(["function", "type"])))
    rows += [row(1000, "alias::thing", "src/a.c", "unusual"), row(1001, "alias::thing", "src/b.c", "thing"), row(1002, "ab", "src/a.c"), row(1003, "", "src/a.c", "")]
    snaps = store.Snapshots(spark, f"file://{tmp_path_factory.mktemp('index')}/x", buckets=4)
    df = symbols(spark, rows).cache()
    snaps.write(store.empty_tables(spark) | {"symbols": df})
    return snaps, df


@pytest.mark.parametrize("query, kind", [("net::read", None), ("WRITE", "type"), ("été::", None), ("oller1", "gadget"), ("unusual", None), ("thing", None), ("zzz", None), ("ab", None), ("n_t::r%d", None)])
def test_same_rows_as_the_scan(index, query, kind):
    snaps, df = index
    assert snaps.search(query, kind).collect() == search.search_api(df, query, kind).collect()


def test_too_many_places_are_scanned(index):
    snaps, df = index
    tables = snaps.manifest()["tables"]
    heads, lists = (snaps._read(t, tables[t]) for t in (name_index.HEADS, name_index.GRAMS))
    assert name_index.candidates(heads, lists, "net::", 5) is None and name_index.candidates(heads, lists, "net::") is not None
    assert name_index.indexed_search(df, heads, lists, "net::", most=5).collect() == search.search_api(df, "net::").collect()
    assert name_index.looked_up("ab") is None and name_index.looked_up("a%bc") is None and name_index.looked_up("ABcd") == ["abc", "bcd"]


def test_reads_a_tenth_at_most(spark, tmp_path):
    """The rows that leave the scans of a search, by the plan's own metrics."""
    df = symbols(spark, [row(i, f"space{i % 97}::function{i * 7919 % 100_003}", f"src/f{i % 200}.c") for i in range(30_000)])
    snaps = store.Snapshots(spark, f"file://{tmp_path}/x", buckets=2)
    snaps.write(store.empty_tables(spark) | {"symbols": df})
    tables = snaps.manifest()["tables"]
    heads, lists = (snaps._read(t, tables[t]) for t in (name_index.HEADS, name_index.GRAMS))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def read(d):
            plan = d._jdf.queryExecution().executedPlan()
            d._jdf.collectToPython()
            leaves = plan.collectLeaves()
            return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

        query = "space13::function91"
        near = name_index.candidates(heads, lists, query)
        found = near.count()
        assert 0 < found < 50
        assert read(name_index.places(lists, name_index.looked_up(query))) + read(near) < 30_000 / 10
        assert read(search.search_api(snaps.read()["symbols"], query)) >= 30_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
