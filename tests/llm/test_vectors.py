"""Clustering and near duplicates of vectors, against brute force."""

import hashlib
import math

import numpy as np
import pytest

from lattica.llm import cover_tree, elkan

VECTORS = "vec_id long, embedding array<float>, label int"


def lloyd(rows, k, rounds, dims, scale):
    """(vec_id, cluster, distance, inertia of the cluster and of all, digest), with every distance."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) <= 2**53]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda x: (x[0] is None, x[0] is not None and digest(x[0]), x[1]))[:k]]
    for r in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
        if r < rounds:
            for j in range(len(centres)):
                members = [v for (_, v), (_, o) in zip(kept, own) if o == j]
                if members:
                    centres[j] = [sum(x) // len(members) for x in zip(*members)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    most = lambda x: min(x, 2**63 - 1)
    return [(i, j, most(d), most(sum(most(e) for e, o in own if o == j)), most(sum(most(e) for e, _ in own)), sha[j]) for (i, _), (d, j) in zip(kept, own)]


def grid(seed, n, dims, spread=3):
    """Small integers over 1024, so that many distances tie."""
    r = np.random.default_rng(seed)
    return [(int(i), (r.integers(-spread, spread + 1, dims) / 1024).tolist()) for i in range(n)]


@pytest.mark.parametrize("dims, k, rounds", [(2, 8, 4), (3, 1, 1)])
def test_clusters_with_ties(spark, dims, k, rounds):
    rows = grid(dims, 150, dims)
    rows += [(3, rows[3][1]), (3, rows[9][1]), (None, rows[5][1]), (900, None), (901, rows[1][1][1:]), (902, [None] * dims), (903, [float("nan")] * dims), (904, [float("inf")] * dims), (905, [1e30] * dims), (906, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)
    got = elkan.clustered(df, k=k, rounds=rounds, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(lloyd(rows, k, rounds, dims, 1024), key=str)


def test_clusters_of_large_components(spark):
    """Distances beyond 52 and 63 bits."""
    r = np.random.default_rng(1)
    rows = [(int(i), (np.float32(10.0 ** r.integers(0, 12)) * r.normal(size=3).astype(np.float32)).tolist()) for i in range(60)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    assert sorted(map(tuple, elkan.clustered(df, k=4, rounds=2, dims=3).collect()), key=str) == sorted(lloyd(rows, 4, 2, 3, 1024), key=str)


def test_few_or_no_vectors(spark):
    rows = grid(7, 3, 2)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    assert sorted(map(tuple, elkan.clustered(df, rounds=1, dims=2).collect()), key=str) == sorted(lloyd(rows, 8, 1, 2, 1024), key=str)
    for none in (df.limit(0), spark.createDataFrame([(1, None, 0)], VECTORS)):
        assert elkan.clustered(none, dims=2).collect() == []


def test_bounds_skip_distances():
    """Bounds hold whatever moves, and most distances of separated clusters are never computed."""
    r = np.random.default_rng(3)
    middles = r.integers(-4000, 4000, (6, 16))
    v = np.concatenate([m + r.integers(-60, 61, (80, 16)) for m in middles])
    centres = v[r.permutation(len(v))[:6]]
    now = elkan.Assignment(v, np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.zeros((len(v), 6)))
    moved, each = np.zeros(6), []
    for _ in range(8):
        before = now.computed
        now.update(centres, elkan.between(centres), moved)
        each.append(now.computed - before)
        exact = np.stack([((v - c) ** 2).sum(axis=1) for c in centres], 1)
        assert (now.cluster == exact.argmin(axis=1)).all()
        assert (now.upper >= np.sqrt(exact[np.arange(len(v)), now.cluster])).all() and (now.lower <= np.sqrt(exact)).all()
        n, sums = now.sums(6)
        new = np.array([[s // m for s in row] if m else c for m, row, c in zip(n, sums, centres.tolist())], np.int64)
        moved = np.sqrt(((new - centres) ** 2).sum(axis=1)) * elkan.UP
        centres = new
    assert each[0] > 2 * len(v) and each[-1] <= len(v)


def brute_links(rows, least):
    """(vec_id, links, component, kept) of each row."""
    fine = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for a in fine:
        for b in fine:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                if cover_tree.exact_cosine(np.array(rows[a][1], float), np.array(rows[b][1], float)) >= least:
                    near[a].add(b)
                    near[b].add(a)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            seen |= group
            first = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            for j in group:
                out[j] = (rows[j][0], len(near[j]), first, first is not None and rows[j][0] == first)
    return out


def clouds(seed, n, dims):
    """Groups of near copies at many distances, copies, multiples of a vector, and lone vectors."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        x = r.normal(size=dims)
        for _ in range(int(r.integers(1, 9))):
            rows.append((x + r.normal(size=dims) * r.choice([0, 1e-6, 0.05, 0.25, 0.45])) * r.choice([1, 1, 0.5, 30]))
    return [(int(i), np.float32(v).tolist()) for i, v in zip(r.permutation(len(rows)), rows)]


@pytest.mark.parametrize("dims, shard, n", [(16, 8_192, 60), (4, 20, 60)])
def test_near_duplicates(spark, dims, shard, n):
    rows = clouds(dims, n, dims)
    rows += [(5, rows[8][1]), (5, rows[5][1]), (None, rows[1][1]), (9_000, None), (9_001, []), (9_002, [0.0] * dims), (9_003, [-0.0] * dims), (9_004, [None] + rows[0][1][1:]), (9_005, [float("nan")] * dims), (9_006, rows[4][1][:-1]), (9_007, rows[4][1][:-1]), (9_008, [1e38] * dims), (9_009, [1e-38] * dims)]
    rows += [(9_100 + i, rows[2][1]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)
    got = cover_tree.near_duplicates(df, 0.9, shard_rows=shard)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_links(rows, 0.9), key=str)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 0), (2, [0.0], 0), (None, [1.0], 0)], VECTORS)
    assert cover_tree.near_duplicates(df.limit(0)).collect() == []
    assert sorted(map(tuple, cover_tree.near_duplicates(df).collect()), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)]


def test_thresholds_on_the_edge(spark):
    """Cosines of exactly 0.6 and 0.8, by vectors of whole numbers."""
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [4.0, 3.0]), (4, [0.0, 5.0]), (5, [-2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    for least in (0.6, 0.8):
        assert sorted(map(tuple, cover_tree.near_duplicates(df, least).collect()), key=str) == sorted(brute_links(rows, least), key=str), least


def test_a_cover_tree():
    """Every point is within its node's radius; centres of a net are apart; a dense group is taken whole."""
    rows = clouds(4, 200, 6)
    v = np.array([x for _, x in rows], float)
    tree = cover_tree.CoverTree(np.arange(len(v)), v, np.ones(len(v), np.int64), leaf=4)
    assert sorted(tree.ids) == list(range(len(v)))
    for node in range(len(tree.centre)):
        (first, end), c = tree.span[node], tree.centre[node]
        assert first <= c < end
        assert cover_tree.apart(tree.points[first:end], tree.points[c : c + 1]).max() <= tree.radius[node] + 1e-9
        children = np.arange(*tree.child[node])
        if len(children):
            assert len(children) > 1 and tree.centre[children[0]] == c
            assert [tree.span[children[0]][0], *(tree.span[k][1] for k in children)] == [first, *(tree.span[k][1] for k in children[:-1]), end]
    close = np.float32(np.ones(32) + np.random.default_rng(1).normal(size=(3_000, 32)) * 1e-3).astype(float)
    dense = cover_tree.CoverTree(np.arange(3_000), close, np.full(3_000, 2, np.int64))
    found = cover_tree.Linked(dense, dense, 0.9)
    rows = found.rows()
    assert found.compared == 0 and (rows["links"] == 2 * 2_999).all() and len(set(rows["root"])) == 1
