"""Snapshots in buckets: what a change writes, what it shares, and that the index stays what a whole build gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import incremental, resolve, stats, store
from lattica.schema import TABLES
from lattica.sources import extraction


def document(file, names, calls, shift=0, definition=True):
    """A file's extraction result: its functions, and calls as (caller, callee)."""
    symbol = lambda n, i: {"name": n.rpartition("::")[2], "qualified_name": n, "kind": "function", "file_path": file, "line": 10 * i + shift, "column": 1, "is_definition": definition}
    call = lambda c, i: {"caller": c[0], "callee": c[1], "file": file, "line": 500 + i, "column": 1, "is_virtual": False, "is_indirect": False}
    return {
        "symbols": [symbol(n, i) for i, n in enumerate(names)], "calls": [call(c, i) for i, c in enumerate(calls)],
        "includes": [{"source_file": file, "target_file": "all.h", "line": 1, "is_system": False, "resolved_path": None}],
        "inherits": [{"derived": names[0], "base": names[-1], "access": "public", "is_virtual": False}] if len(names) > 1 else [],
        "references": [{"symbol_name": names[0], "file": file, "line": 3, "column": 1, "ref_kind": "read"}],
    }


def frames(spark, docs):
    results = extraction.decoded(spark.createDataFrame([(f, json.dumps(d)) for f, d in docs.items()], "file string, json string"))
    records = spark.createDataFrame([(f, 1, "h", "success", None, len(d["symbols"]), None) for f, d in docs.items()], "file_path string, last_modified bigint, content_hash string, parse_status string, error_message string, symbol_count bigint, parse_time_ms bigint")
    return results, records


def rows(tables):
    return {t: sorted(map(str, tables[t].select(sorted(tables[t].columns)).collect())) for t in TABLES}


def whole(spark, docs):
    results, records = frames(spark, docs)
    return resolve.resolved_tables(results) | {"file_info": records}


def project(seed, n):
    """Files that call each other and names that nothing defines."""
    r = random.Random(seed)
    docs = {}
    for i in range(n):
        names = [f"m{i}::f{k}" for k in range(4)]
        docs[f"src/d{i % 9}/m{i}.c"] = document(f"src/d{i % 9}/m{i}.c", names, [(r.choice(names), f"m{r.randrange(n + 5)}::f{r.randrange(5)}") for _ in range(6)])
    return docs


def test_a_small_change_writes_little(spark, tmp_path):
    docs = project(1, 400)
    snaps = store.Snapshots(spark, f"file://{tmp_path}/x", buckets=128)
    first = snaps.write(whole(spark, docs))
    before = snaps.manifest(first)
    assert before["buckets"] == 128 and rows(snaps.read()) == rows(whole(spark, docs))
    # four of 400 files get another call of their own; no symbol moves
    edited = {f: document(f, [s["qualified_name"] for s in docs[f]["symbols"]], [(c["caller"], c["callee"]) for c in docs[f]["calls"]] + [(docs[f]["symbols"][0]["qualified_name"], docs[f]["symbols"][1]["qualified_name"])]) for f in list(docs)[100:104]}
    results, records = frames(spark, edited)
    changed = spark.createDataFrame([(f, incremental.MODIFIED) for f in edited], "path string, change_type string")
    incremental.merged(snaps, changed, results, records)
    after = snaps.manifest()
    written = sum(x["bytes"] for t, of in after["tables"].items() for k, x in of.items() if x != before["tables"][t].get(k))
    total = sum(x["bytes"] for of in after["tables"].values() for x in of.values())
    assert written < 0.05 * total
    assert all(sum(x != before["tables"][t].get(k) for k, x in of.items()) <= 4 for t, of in after["tables"].items())
    assert rows(snaps.read()) == rows(whole(spark, docs | edited))
    assert snaps.edges().count() == snaps.read()["call_relations"].count()
    own = snaps.read()
    want = stats.statistics(*(own[t] for t in ("symbols", "call_relations", "include_relations", "reference_relations", "inheritance_relations", "file_info")))
    assert snaps.counters().first().asDict() == want.first().asDict()
    # the snapshot before is whole still, until what no pointer leads to is deleted
    assert len(before["tables"]["symbols"]) == len(snaps.manifest(first)["tables"]["symbols"])
    incremental.merged(snaps, changed.limit(0), results.limit(0), records.limit(0))
    assert snaps.vacuum() > 0 and rows(snaps.read()) == rows(whole(spark, docs | edited)) and snaps.vacuum() == 0


def test_symbols_that_move_go_and_come(spark, tmp_path):
    """Callers in other files follow a symbol that moves, lose one that goes, and get one that comes late; bucket by bucket the
    index is what a build of all files gives."""
    docs = project(2, 40)
    late = {"src/late.c": document("src/late.c", ["m41::f1", "m42::f3"], [("m41::f1", "m0::f0")])}
    snaps = store.Snapshots(spark, f"file://{tmp_path}/x", buckets=16)
    snaps.write(whole(spark, docs))
    files = list(docs)
    moved = {f: document(f, [s["qualified_name"] for s in docs[f]["symbols"]], [(c["caller"], c["callee"]) for c in docs[f]["calls"]], shift=3) for f in files[3:5]}
    results, records = frames(spark, moved | late)
    changed = spark.createDataFrame([(f, "Modified") for f in moved] + [("src/late.c", "Added")], "path string, change_type string")
    incremental.merged(snaps, changed, results, records)
    assert rows(snaps.read()) == rows(whole(spark, docs | moved | late))
    gone = files[7]
    incremental.merged(snaps, spark.createDataFrame([(gone, "Deleted")], "path string, change_type string"), results.limit(0), records.limit(0))
    left = {f: d for f, d in (docs | moved | late).items() if f != gone}
    own, want = rows(snaps.read()), rows(whole(spark, left))
    # a call whose callee has gone isn't kept as one that waits
    assert {t: own[t] for t in own if t != "unresolved_calls"} == {t: want[t] for t in want if t != "unresolved_calls"}


def test_builds_don_t_overwrite_each_other(spark, tmp_path):
    snaps, other = (store.Snapshots(spark, f"file://{tmp_path}/x") for _ in range(2))
    snaps.initialize()
    base = snaps.current()
    other.write(store.empty_tables(spark))
    with pytest.raises(RuntimeError, match="another build"):
        snaps._published(snaps.manifest(base), base)
    with pytest.raises(ValueError, match="aren't rewritten"):
        s = spark.createDataFrame([(1, "a", "a", "function", "x.c", 1)], "id long, name string, qualified_name string, kind string, file_path string, line int")
        full = store.empty_tables(spark)["symbols"].unionByName(s, allowMissingColumns=True)
        wide = store.Snapshots(spark, f"file://{tmp_path}/y", buckets=8)
        wide.initialize()
        k = full.select(store.bucket_of(F.col("file_path"), 8)).first()[0]
        wide.rewrite(store.empty_tables(spark) | {"symbols": full}, {t: {str((k + 1) % 8)} for t in TABLES})
