import random
from collections import deque

import pytest

from lattica.operators import client, traverse
from tests.golden import call, frames, plain


def run(spark, f, symbols, calls, *args):
    s, c = frames(spark, symbols, calls)
    return f(traverse.node_edges(c, s), s, *args)


def path(spark, calls, a, b):
    _, c = frames(spark, calls=calls)
    return [r["symbol_id"] for r in traverse.shortest_path(c, a, b).orderBy("pos").collect()]


def test_golden_callers_and_callees(spark):
    s, c = frames(spark)
    e = traverse.node_edges(c, s)
    assert [r["caller_id"] for r in traverse.callers(e, s, 2, 1).collect()] == [1]
    assert {r["callee_id"] for r in traverse.callees(e, s, 1, 2).collect()} == {2, 3}
    assert traverse.callers(e, s, 4, 3).count() == 3
    assert traverse.callers(e, s, 1, 1).count() == 0
    assert traverse.callees(e, s, 4, 1).count() == 0
    assert traverse.callers(e, s, 4, 0).count() == 0
    assert traverse.callers(e, s, 99, 2).count() == 0


def test_golden_paths(spark):
    from tests.golden import CALLS

    assert path(spark, CALLS, 1, 2) == [1, 2]
    assert path(spark, CALLS, 1, 4) == [1, 2, 3, 4]
    assert path(spark, CALLS, 3, 3) == [3]
    assert path(spark, CALLS, 4, 1) == []
    assert path(spark, CALLS, 1, 5) == []


def random_graph(seed, n=30, m=60, names=20):
    r = random.Random(seed)
    symbols = [plain(i, f"f{i}", f"q{r.randrange(names)}") for i in range(n)]
    calls = [call(1000 + k, r.randrange(n), r.randrange(n)) for k in range(m)]
    return symbols, calls


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_against_brute_force(spark, seed):
    symbols, calls = random_graph(seed)
    name = {s[0]: s[2] for s in symbols}
    for depth in (1, 3):
        dist = {name[0]: 0}
        todo = deque([name[0]])
        while todo:
            x = todo.popleft()
            for c in calls:
                if name[c[2]] == x and dist[x] < depth and name[c[1]] not in dist:
                    dist[name[c[1]]] = dist[x] + 1
                    todo.append(name[c[1]])
        best = {}
        for c in calls:
            d = dist.get(name[c[2]])
            if d is not None and d < depth:
                best[name[c[1]]] = min(best.get(name[c[1]], (99, 0)), (d + 1, c[0]))
        got = {(r["level"], r["id"]) for r in run(spark, traverse.callers, symbols, calls, 0, depth).collect()}
        assert got == set(best.values())


@pytest.mark.parametrize("seed", [3])
def test_path_is_shortest_and_least(spark, seed):
    _, calls = random_graph(seed, m=45)
    edges = {}
    for c in calls:
        edges[c[1], c[2]] = min(edges.get((c[1], c[2]), 1 << 30), c[0])

    def brute(a, b):
        level = {a: ([], [a])}
        seen = {a}
        while level:
            if b in level:
                return level[b][1]
            new = {}
            for x, (k, p) in level.items():
                for (u, v), e in edges.items():
                    if u == x and v not in seen:
                        new[v] = min(new.get(v, ([1 << 40], [])), (k + [e], p + [v]))
            seen |= new.keys()
            level = new
        return []

    for b in (5, 11, 17):
        assert path(spark, calls, 0, b) == brute(0, b)


def test_trace_depends_on_depth_first_order(spark):
    # z is met first at the limit by way of a -> b, and isn't entered again although c -> z is shorter
    symbols = [plain(1, "entry"), plain(2, "a"), plain(3, "b"), plain(4, "c"), plain(5, "z"), plain(6, "leaf")]
    calls = [call(1, 1, 2), call(2, 2, 3), call(3, 3, 5), call(4, 1, 4), call(5, 4, 5), call(6, 5, 6)]
    s, c = frames(spark, symbols, calls)
    names = [r["name"] for r in traverse.call_trace(c, s, "entry", 3).orderBy("pos").collect()]
    assert names == ["entry", "a", "b", "z", "c"]
    assert [r["name"] for r in traverse.call_trace(c, s, "entry", 0).collect()] == ["entry"]
    assert traverse.call_trace(c, s, "nothing", 3).count() == 0


def test_trace_fan_out_counts_before_deduplication(spark):
    symbols = [plain(1, "entry")] + [plain(i, f"n{i:03d}") for i in range(2, 60)]
    calls = [call(k, 1, 2) for k in range(1, 50)] + [call(100 + i, 1, i) for i in range(3, 60)]
    s, c = frames(spark, symbols, calls)
    got = [r["id"] for r in traverse.call_trace(c, s, "entry", 1).orderBy("pos").collect()]
    assert got == [1, 2, 3]


def test_file_graph_and_impact(spark):
    from lattica.schema import struct_of

    rows = [(1, "src/a.cpp", "b.h", 1, False, "inc/b.h"), (2, "inc/b.h", "c.h", 1, False, "inc/c.h"), (3, "src/d.cpp", "c.h", 2, False, None), (4, "src/d.cpp", "a/b/", 3, True, None)]
    i = spark.createDataFrame(rows, struct_of("include_relations"))
    nodes, edges = traverse.file_graph(i)
    assert {r["id"]: r["label"] for r in nodes.collect()}["a/b/"] == ""
    assert edges.count() == 4
    changed = spark.createDataFrame([("inc/c.h",), ("src/x.cpp",)], "p string")
    assert {r[0] for r in traverse.impact(i, changed).collect()} == {"inc/c.h", "src/x.cpp", "inc/b.h", "src/a.cpp"}


def test_call_graph_of_unknown_root(spark):
    s, c = frames(spark)
    nodes, edges = traverse.call_graph(traverse.node_edges(c, s), s, 99, 2)
    assert [r["label"] for r in nodes.collect()] == ["symbol_99"]
    assert edges.count() == 0


def test_symbol_at(spark):
    s, _ = frames(spark, [plain(1, "a", line=5, end=10), plain(2, "b", line=7, end=8), plain(3, "c", line=20)])
    at = lambda n: [r["id"] for r in client.symbol_at(s, "a.cpp", n).collect()]
    assert [at(4), at(7), at(12), at(20), at(99)] == [[], [1], [2], [3], [3]]
    places = spark.createDataFrame([(k, "a.cpp", n) for k, n in enumerate((4, 7, 12, 20, 99))], "place_id int, file_path string, at int")
    assert {r[0]: r[1] for r in client.symbols_at(s, places).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
