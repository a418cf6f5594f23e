"""Digest trees: the rows of a join of all files, found by reading what has changed."""

import random

import pytest

from lattica.operators import digest_tree, incremental
from lattica.operators.digest_tree import DigestTree, compared

SCHEMA = "path string, content_hash string"


def _both(spark, old, new, **options):
    a, b = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    found = compared(DigestTree.build(a, **options), DigestTree.build(b, **options))
    return sorted(map(tuple, found.changes.collect())), found


def _plain(old, new):
    a, b = ({p: h for p, h in x if p is not None} for x in (old, new))
    return sorted([(p, "Deleted") for p in a.keys() - b.keys()] + [(p, "Added") for p in b.keys() - a.keys()] + [(p, "Modified") for p in a.keys() & b.keys() if a[p] != b[p]])


@pytest.mark.parametrize("bucket_files", [20, 50_000])
def test_any_change_of_a_tree(spark, bucket_files):
    rng = random.Random(5)
    names = ["", "a", "b", "c.c", "d.h", "ü", "a b"]
    old = {"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))): rng.choice(["x", "y", "", None]) for _ in range(150)}
    new = {p: rng.choice(["x", "y"]) if rng.random() < 0.1 else h for p, h in old.items() if rng.random() < 0.9}
    new |= {"/".join(rng.choice(names) for _ in range(6)): "z" for _ in range(10)}
    got, _ = _both(spark, list(old.items()), list(new.items()), bucket_files=bucket_files)
    assert got == _plain(old.items(), new.items()) and len({k for _, k in got}) == 3


def test_moves_swaps_and_types(spark):
    old = [("a/x", "1"), ("a/y", "2"), ("b", "3"), ("c/d/e", "4"), ("same/f", "5"), (None, "6"), ("n/n", None), ("n/m", None)]
    new = [("a/x", "2"), ("a/y", "1"), ("b/b", "3"), ("c/e", "4"), ("same/f", "5"), (None, "7"), ("n/n", None), ("n/m", "n")]
    assert _both(spark, old, new)[0] == _plain(old, new)
    assert _both(spark, old, old)[0] == []


def test_empty_listings(spark):
    some = [("a/b", "1"), ("c", "")]
    assert _both(spark, [], [])[0] == []
    assert _both(spark, some, [])[0] == [("a/b", "Deleted"), ("c", "Deleted")]
    assert _both(spark, [], some)[0] == [("a/b", "Added"), ("c", "Added")]


def test_reads_only_where_digests_differ(spark):
    old = [(f"r/m{k % 40}/s{k % 7}/f{k}.c", "h") for k in range(8000)]
    new = [(p, "other" if p == "r/m3/s4/f1803.c" else h) for p, h in old]
    assert ("r/m3/s4/f1803.c", "h") in old
    got, found = _both(spark, old, new, bucket_files=100)
    assert got == [("r/m3/s4/f1803.c", "Modified")]
    nodes = DigestTree.build(spark.createDataFrame(old, SCHEMA)).nodes()
    nodes_read, files_read = found.rows_read()
    assert files_read < 2 * len(old) * 0.05 and nodes_read < 2 * nodes.count() * 0.6
    same, none = _both(spark, old, old, bucket_files=100)
    assert same == [] and none.rows_read() == (0, 0)


def test_digests_add_up(spark):
    """A folder's count is that of the files below it, and its digest doesn't depend on the order or the partitions."""
    rows = [("a/b/c", "1"), ("a/b/d", "2"), ("a/e", "3"), ("f", "4"), ("/g/h", "5")]
    tree = DigestTree.build(spark.createDataFrame(rows, SCHEMA))
    again = DigestTree.build(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), bucket_files=1)
    of = lambda t: {(r.depth, r.folder): (r.n_files, r.own is not None, r.digest) for r in t.nodes().collect()}
    assert {k: v[:2] for k, v in of(tree).items()} == {(0, ""): (5, True), (1, "a"): (3, True), (2, "a/b"): (2, True), (1, ""): (1, False), (2, "/g"): (1, True)}
    assert of(tree) == of(again) and again.buckets == 5


def test_equals_the_join(spark):
    old = spark.createDataFrame([(f"d{k % 9}/f{k}", str(k % 3) if k % 11 else "") for k in range(300)], "file_path string, content_hash string")
    new = spark.createDataFrame([(f"d{k % 9}/f{k}", str(k % 5)) for k in range(40, 330)], SCHEMA)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(digest_tree.changes(new, old)) == rows(incremental.changes(new, old))
