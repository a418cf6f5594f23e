"""The source tree as a data source: what it finds, how it is dealt out, and its stream."""

import hashlib
import os

import pytest

from lattica.sources import files, tree_source


@pytest.fixture
def root(tmp_path):
    names = ("a.c", "b.cc", "c.cpp", "d.cxx", "e.h", "f.hh", "g.hpp", "h.HXX", "i.py", "j.txt", "Makefile", "._k.c", ".c", "_l.c")
    for k, name in enumerate(names):
        for folder in ("src", "src/deep/er/est", f"mod{k % 5}/x"):
            (tmp_path / folder).mkdir(parents=True, exist_ok=True)
            (tmp_path / folder / name).write_text(f"{folder} {name}")
    for skipped in (".git", "src/tests", "mod1/x/node_modules"):
        (tmp_path / skipped).mkdir()
        (tmp_path / skipped / "no.c").write_text("no")
    (tmp_path / "empty").mkdir()
    return tmp_path


@pytest.mark.parametrize("partitions", [1, 4, 1000])
def test_finds_what_a_walk_finds(spark, root, partitions):
    found = tree_source.tree(spark, str(root), partitions=partitions)
    rows = [r.asDict() for r in tree_source.in_order(found).collect()]
    assert [r["path"] for r in rows] == files.source_paths(str(root))
    assert all(r["content_hash"] == hashlib.sha256(open(r["path"], "rb").read()).hexdigest() and r["size"] == os.path.getsize(r["path"]) and r["error"] is None for r in rows)
    parts = tree_source._Walk({"path": str(root), "partitions": str(partitions)}).subtrees()
    assert len(parts) >= min(partitions, 8) and len({p.folder for p in parts if not p.deep}) == sum(not p.deep for p in parts)


def test_options(spark, root):
    few = {r[0] for r in tree_source.tree(spark, str(root), extensions="h,hpp", excluded="deep, mod0", hash="false").select("path", "content_hash").collect()}
    assert few == set(files.source_paths(str(root), ("h", "hpp"), ("deep", "mod0"))) and few
    assert tree_source.tree(spark, str(root / "empty")).count() == 0
    assert tree_source.tree(spark, str(root / "src/tests")).count() == 0
    assert tree_source.tree(spark, str(root / "nowhere")).count() == 0


def test_links_are_followed_but_not_in_circles(spark, root):
    os.symlink(root / "src/deep", root / "again")
    os.symlink(root, root / "src/deep/round")
    os.symlink(root / "nothing", root / "src/broken.c")
    found = [r[0] for r in tree_source.tree(spark, str(root), partitions=3).select("path").collect()]
    assert len(found) == len(set(found)) and not any("round" in p for p in found)
    assert f"{root}/again/er/est/a.c" in found and f"{root}/src/broken.c" not in found


def test_stream_of_new_files(spark, root, tmp_path_factory):
    place = tmp_path_factory.mktemp("stream")

    def step():
        query = tree_source.new_files(spark, str(root), partitions=4).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/ck").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(f"{place}/out").select("path").collect())

    first = step()
    assert first == sorted(files.source_paths(str(root)))
    (root / "src/new.c").write_text("new")
    (root / "src/a.c").write_text("changed")
    assert step() == sorted([*first, f"{root}/src/new.c", f"{root}/src/a.c"])
