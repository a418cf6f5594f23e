"""Exact threshold pairs of vectors by cosine: cover trees, traversed in pairs.

Rows of equal vectors are one class, so copies never meet each other. Classes are split into cells around centres that are
far apart, until a cell has no more than a shard's number of classes; the cells form the upper part of one tree, kept as a table of
nodes with centre and covering radius. Each cell's classes are then built into a cover tree and written as a file: nested levels
of centres, the radius halved from level to level, centres of a level further apart than its radius, each one its own first
child. Both parts are traversed in pairs of nodes. A pair is pruned if the centres' distance less both covering radii exceeds
the threshold's distance, and taken as a whole if the distance plus both radii stays below it; then nothing inside
is compared. Pairs of cells are a table that descends level by level by joins on the parent; pairs of trees are tasks.

A task never lists pairs: it adds up each class's links, weighted by the rows of the other class, and joins what is linked
in a forest, of which it returns a row for each class that has links. Spark adds up the counts and finds components.

Distances are those of unit vectors, with margins that outweigh their rounding, so bounds decide nothing near the threshold;
what is left is decided by the cosine in doubles, and within 1e-12 of the threshold by sums without rounding.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows of null
id, whose component is null and which aren't kept; vectors of different length aren't linked; rows of a repeated id are rows of
their own, counted as links if their vectors are close; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.components import components
from lattica.llm.files import open_file, write_file
from lattica.llm.kernels import U, mix
from lattica.llm.shared import lookup, new_folder, trimmed, written

#: Classes of a cell at most; centres that a larger cell is split around, and the classes they are chosen from.
SHARD_ROWS, FAN, CHOICE = 8_192, 16, 512
#: Levels after which cells that are still too large are split by a hash.
DEEP = 8
#: Nodes of so many classes aren't split further.
LEAF = 32
#: More than distances, radii and cosines are off by rounding.
MARGIN = 1e-7
#: Cosines so near to the threshold are summed anew, exactly.
NEAR = 1e-12
#: Nodes, or points, of one tree that are compared with another's at once.
BLOCK = 256


def reach(least: float) -> float:
    """The distance of two unit vectors whose cosine is `least`."""
    return math.sqrt(max(0.0, 2 - 2 * least))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that squares stay in range."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit rows, right to about 1e-8 (to the square root of the rounding, when they are close)."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine by sums without rounding."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum((a * b).tolist()) / math.sqrt(math.fsum((a * a).tolist()) * math.fsum((b * b).tolist()))


class CoverTree:
    """A cover tree over unit vectors, its points in the order of the leaves.

    Per node: its centre's point, its span of points, the largest distance of one of them to the centre, its children's
    range (none in a leaf) and the weight of its points. Children are numbered one after the other.
    """

    FIELDS = ("ids", "raw", "weight", "centre", "span", "radius", "child")

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, weight: np.ndarray, leaf: int = LEAF):
        own = unit(vectors)
        order = np.arange(len(ids))
        centre, span, radius, child, level = [0], [(0, len(ids))], [0.0], [(0, 0)], [0]
        at = 0
        while at < len(centre):
            (first, end), c = span[at], own[centre[at]]
            rows = order[first:end]
            d = apart(own[rows], c[None, :])[:, 0]
            radius[at] = float(d.max())
            if end - first > leaf and radius[at] > MARGIN:
                # the levels at which the centre alone would be the net are skipped
                size = 2.0 ** (1 - level[at])
                step = level[at] + 1
                while size / 2 >= radius[at]:
                    size, step = size / 2, step + 1
                parts = self._net(own, rows, centre[at], size / 2)
                order[first:end] = np.concatenate([p for _, p in parts])
                child[at] = (len(centre), len(centre) + len(parts))
                for c_, p in parts:
                    centre.append(c_)
                    span.append((first, first + len(p)))
                    radius.append(0.0)
                    child.append((0, 0))
                    level.append(step)
                    first += len(p)
            at += 1
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.raw, self.weight = ids[order], vectors[order], weight[order]
        self.centre, self.span, self.radius, self.child = place[np.array(centre)], np.array(span), np.array(radius), np.array(child)
        self._derive()

    @staticmethod
    def _net(own: np.ndarray, rows: np.ndarray, centre: int, size: float, block: int = 256) -> list[tuple[int, np.ndarray]]:
        """(centre, points within `size` of it): centres further than that from each other, the given one first."""
        rows = np.concatenate([[centre], rows[rows != centre]])
        centres: list[int] = []
        of: dict[int, list[np.ndarray]] = {}
        while len(rows):
            some = rows[:block]
            close = apart(own[some], own[some]) <= size
            free, chosen = np.ones(len(some), bool), []
            for i in range(len(some)):
                if free[i]:
                    chosen.append(i)
                    free[close[i]] = False
            new = some[chosen]
            d = apart(own[rows], own[new])
            nearest = d.argmin(axis=1)
            inside = d[np.arange(len(rows)), nearest] <= size
            # a centre is nearest to itself, whatever the rounding
            where = {c: j for j, c in enumerate(new.tolist())}
            for i in range(len(some)):
                if (j := where.get(int(rows[i]))) is not None:
                    nearest[i], inside[i] = j, True
            for j, c in enumerate(new.tolist()):
                of[c] = [rows[inside & (nearest == j)]]
            centres += new.tolist()
            rows = rows[~inside]
        return [(c, np.concatenate(of[c])) for c in centres]

    def _derive(self) -> None:
        self.points = unit(self.raw)
        self.length = np.sqrt((self.raw * self.raw).sum(axis=1))
        total = np.concatenate([[0], np.cumsum(self.weight)])
        self.weights = total[self.span[:, 1]] - total[self.span[:, 0]]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, uri: str) -> CoverTree:
        tree = cls.__new__(cls)
        with open_file(uri) as f:
            for k, v in np.load(io.BytesIO(f.read())).items():
                setattr(tree, k, v)
        tree._derive()
        return tree


class Linked:
    """What two trees (or one) have in links: counts by class, and a forest of what is connected."""

    def __init__(self, left: CoverTree, right: CoverTree, least: float):
        self.left, self.right, self.least, self.reach = left, right, least, reach(least)
        self.same = left is right
        n = len(left.ids)
        self.offset = 0 if self.same else n
        self.count = np.zeros(n if self.same else n + len(right.ids), np.int64)
        self.spread = np.zeros(len(self.count) + 1, np.int64)  # of whole nodes: what is added from a point on
        self.parent = np.arange(len(self.count))
        #: Cosines computed, for measurements.
        self.compared = 0
        self._whole: set[tuple[int, int]] = set()
        self._run()

    def _root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def _join(self, i: int, j: int) -> None:
        i, j = self._root(i), self._root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def _together(self, first: int, end: int) -> None:
        """Joins all points of a node, once."""
        if (first, end) not in self._whole:
            self._whole.add((first, end))
            for i in range(first + 1, end):
                self._join(first, i)

    def _take(self, a: int, b: int) -> None:
        """All points of two nodes are linked."""
        (a0, a1), (b0, b1) = self.left.span[a].tolist(), self.right.span[b].tolist()
        wa, wb = int(self.left.weights[a]), int(self.right.weights[b])
        b0, b1 = b0 + self.offset, b1 + self.offset
        self.spread[a0] += wb
        self.spread[a1] -= wb
        if self.same and a == b:
            own = np.arange(a0, a1)
            self.count[own] -= self.left.weight[own]
            self._together(a0, a1)
            return
        self.spread[b0] += wa
        self.spread[b1] -= wa
        self._together(a0, a1)
        self._together(b0, b1)
        self._join(a0, b0)

    def _decided(self, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Which of the cosines x of left points rows and right points cols reach the threshold."""
        linked = x >= self.least
        for i, j in np.argwhere(np.abs(x - self.least) <= NEAR).tolist():
            linked[i, j] = exact_cosine(self.left.raw[rows[i]], self.right.raw[cols[j]]) >= self.least
        return linked

    def _compare(self, a: int, leaves: np.ndarray) -> None:
        """A leaf of the left tree with leaves of the right one, itself among them or not."""
        x, y = self.left, self.right
        own = self.same and bool((leaves == a).any())
        spans = y.span[leaves[leaves != a] if own else leaves]
        sizes = spans[:, 1] - spans[:, 0]
        cols = np.repeat(spans[:, 0] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        first, end = x.span[a].tolist()
        for at in range(first, end, BLOCK):
            rows = np.arange(at, min(end, at + BLOCK))
            if own:  # a link within the leaf is counted from both ends
                inside = np.arange(first, end)
                linked = self._decided(x.points[rows] @ x.points[inside].T, rows, inside)
                linked[rows - at, rows - first] = False
                self._add(rows, inside, linked, False)
            for k in range(0, len(cols), 16 * BLOCK):
                some = cols[k : k + 16 * BLOCK]
                self._add(rows, some, self._decided(x.points[rows] @ y.points[some].T, rows, some), True)

    def _add(self, rows: np.ndarray, cols: np.ndarray, linked: np.ndarray, both: bool) -> None:
        self.compared += linked.size
        if not linked.any():
            return
        self.count[rows] += linked @ self.right.weight[cols]
        if both:
            self.count[cols + self.offset] += self.left.weight[rows] @ linked
        for i, j in np.argwhere(linked).tolist():
            self._join(int(rows[i]), int(cols[j]) + self.offset)

    def _run(self) -> None:
        x, y = self.left, self.right
        left_leaf, right_leaf = x.child[:, 1] == 0, y.child[:, 1] == 0
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            if left_leaf[a] and right_leaf[b]:
                self._compare(a, np.array([b]))
                continue
            # both are opened, but for a leaf, or a node less than half as wide as the other
            self_pair = self.same and a == b
            open_a = not left_leaf[a] and (right_leaf[b] or x.radius[a] >= y.radius[b] / 2)
            open_b = not right_leaf[b] and (left_leaf[a] or y.radius[b] >= x.radius[a] / 2)
            left = np.arange(*x.child[a]) if open_a else np.array([a])
            right = np.arange(*y.child[b]) if open_b else np.array([b])
            far = y.points[y.centre[right]]
            for i in range(0, len(left), BLOCK):
                l_, r = left[i : i + BLOCK], right[i:] if self_pair else right
                d = apart(x.points[x.centre[l_]], far[i:] if self_pair else far)
                radii = x.radius[l_][:, None] + y.radius[r][None, :]
                live = d - radii <= self.reach + MARGIN
                whole = d + radii < self.reach - MARGIN
                if self_pair:
                    live &= l_[:, None] <= r[None, :]
                    # a node with itself: no two of its points are further than twice its radius
                    own = np.arange(len(l_))
                    whole[own, own] = radii[own, own] < self.reach - MARGIN
                whole &= live
                for p, q in np.argwhere(whole).tolist():
                    self._take(int(l_[p]), int(r[q]))
                live &= ~whole
                leaves = live & left_leaf[l_][:, None] & right_leaf[r][None, :]
                for p in np.flatnonzero(leaves.any(axis=1)).tolist():
                    self._compare(int(l_[p]), r[leaves[p]])
                stack += [(int(l_[p]), int(r[q])) for p, q in np.argwhere(live & ~leaves).tolist()]

    def rows(self) -> dict[str, np.ndarray]:
        """id, links, root of each class that has links here."""
        count = self.count + np.cumsum(self.spread[:-1])
        some = np.flatnonzero(count > 0)
        ids = self.left.ids if self.same else np.concatenate([self.left.ids, self.right.ids])
        root = np.array([self._root(i) for i in some.tolist()], np.int64)
        return {"cls": ids[some], "links": count[some], "root": ids[root] if len(some) else ids[:0]}


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _fine(x: Column) -> Column:
    """Whether a vector can link."""
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(math.inf)), F.lit(False)))
    return F.coalesce(finite & F.exists(x, lambda e: F.coalesce(e != 0, F.lit(False))), F.lit(False))


def _classes(vectors: DataFrame, vector: str) -> tuple[DataFrame, DataFrame]:
    """(row, vec_id, cls of all rows, cls(cls, first_id, n, dim, v)): a class for each vector that can link."""
    x = F.col(vector)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull() & _fine(x), F.transform(x, lambda e: e.cast("double"))).alias("v"))
    own = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    classes = written(own.select(F.monotonically_increasing_id().alias("cls"), "first_id", "n", F.size("v").alias("dim"), "v"), "cover-classes")
    return rows, classes


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e), F.lit(0.0)))


def _centres(chosen: DataFrame) -> DataFrame:
    """cell, centres: up to FAN of a cell's chosen classes, each the farthest from those before it."""

    def pick(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = unit(_matrix(rows.sort_values("cls")["v"]))
        at, nearest = [0], apart(points, points[:1])[:, 0]
        while len(at) < min(FAN, len(points)) and nearest.max() > MARGIN:
            at.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, apart(points, points[at[-1:]])[:, 0])
        return pd.DataFrame({"cell": [key[0]], "centres": [points[at].ravel().tolist()]})

    return chosen.groupBy("cell").applyInPandas(pick, "cell string, centres array<double>")


def _nearest(points: DataFrame) -> DataFrame:
    """points(cls, n, v, cell, centres) in the cell of the nearest centre. Where there is only one centre, or centres haven't made
    a cell small enough for DEEP levels, it is split by a hash: cells are only sets with a radius, so that stays right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, out = np.array(batch.column("cell").to_pylist(), object), np.zeros(len(batch), object)
            ids = batch.column("cls").to_numpy()
            for cell in set(cells):
                some, depth = np.flatnonzero(cells == cell), cell.count("/")
                centres = batch.column("centres")[int(some[0])].as_py()
                v = unit(_matrix(batch.column("v").take(pa.array(some)).to_pylist()))
                if centres is None or len(centres) <= v.shape[1] or depth >= DEEP:
                    to = (mix(ids[some].astype(U) + U(depth + 1) * U(0x9E3779B97F4A7C15)) % U(FAN)).astype(np.int64)
                else:
                    to = apart(v, np.array(centres).reshape(-1, v.shape[1])).argmin(axis=1)
                out[some] = [f"{cell}/{j}" for j in to.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), batch.column("v"), pa.array(out.tolist(), pa.string())], names=["cls", "n", "v", "cell"])

    return points.mapInArrow(trimmed(run), "cls long, n long, v array<double>, cell string")


def _cells(classes: DataFrame, shard_rows: int) -> DataFrame:
    """cls, n, v, cell: cells of shard_rows classes at most, named by their path from the root, one root for each length."""
    points, done = classes.select("cls", "n", "v", F.col("dim").cast("string").alias("cell")), []
    while True:
        sizes = written(points.groupBy("cell").agg(F.count(F.lit(1)).alias("members")), "cover-sizes")
        total = sizes.agg(F.sum("members")).first()[0] or 0
        large = sizes.where(F.col("members") > shard_rows)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, points])
        inside = lookup(points, ["cell"], large.withColumn("of", F.col("members")), total, "inner", n="members")
        chance = F.xxhash64("cls", F.lit("centre")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
        centres = written(_centres(inside.where(chance * F.col("of") < CHOICE).select("cell", "cls", "v")), "cover-centres")
        done.append(lookup(points, ["cell"], sizes.where(F.col("members") <= shard_rows), total, "inner", n="members").select("cls", "n", "v", "cell"))
        moved = lookup(points, ["cell"], large.join(centres, "cell", "left"), total, "inner", n="members")
        points = written(_nearest(moved.select("cls", "n", "v", "cell", "centres")), "cover-cells")


def _built(cells: DataFrame, folder: str) -> DataFrame:
    """node, path, centre, radius: a cover tree for each cell, written as a file."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cls")
        tree = CoverTree(rows["cls"].to_numpy(np.int64), _matrix(rows["v"]), rows["n"].to_numpy(np.int64))
        path = f"{folder}/tree-{key[0].replace('/', '-')}.npz"
        write_file(path, tree.dump())
        return pd.DataFrame({"node": [key[0]], "path": [path], "centre": [tree.points[tree.centre[0]].tolist()], "radius": [float(tree.radius[0])]})

    return written(cells.groupBy("cell").applyInPandas(build, "node string, path string, centre array<double>, radius double"), "cover-trees")


def _nodes(leaves: DataFrame) -> DataFrame:
    """node, parent, depth, path, centre, radius of the cells' tree: a node above has the centre of its first child, and a radius
    that covers its children's."""
    parent = F.when(F.instr("node", "/") > 0, F.regexp_replace("node", "/[^/]*$", ""))
    depth = F.size(F.split("node", "/")) - 1
    level = leaves.select("node", "path", "centre", "radius", depth.alias("depth"))
    deepest = level.agg(F.max("depth")).first()[0] or 0
    out = level
    for d in range(deepest, 0, -1):
        here = out.where(F.col("depth") == d).withColumn("parent", parent)
        first = here.groupBy("parent").agg(F.min_by("centre", "node").alias("top"))
        above = here.join(first, "parent").groupBy("parent").agg(F.any_value("top").alias("centre"), F.max(_distance(F.col("top"), F.col("centre")) + F.col("radius")).alias("radius"))
        above = above.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("path"), "centre", (F.col("radius") + MARGIN).alias("radius"), F.lit(d - 1).alias("depth"))
        out = written(out.unionByName(above), "cover-nodes")
    return out.withColumn("parent", parent)


def _pairs(nodes: DataFrame, least: float) -> DataFrame:
    """a, b: the paths of the trees that may hold links between them, each pair once, by descending in pairs from the roots."""
    leaf = F.col("path").isNotNull()
    roots = nodes.where("parent IS NULL")
    pairs = roots.select(F.col("node").alias("a"), F.col("node").alias("b"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    # leaves stay as they are while others descend
    below = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("at"), "node", "centre", "radius").unionByName(nodes.where(leaf).select(F.col("node").alias("at"), "node", "centre", "radius"))
    for _ in range(deepest):
        left = below.select(F.col("at").alias("a"), F.col("node").alias("a2"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
        right = below.select(F.col("at").alias("b"), F.col("node").alias("b2"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
        met = pairs.join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2")))
        near = _distance(F.col("ca"), F.col("cb")) - F.col("ra") - F.col("rb") <= F.lit(reach(least) + MARGIN)
        pairs = written(met.where(near).select(F.col("a2").alias("a"), F.col("b2").alias("b")), "cover-pairs")
    paths = nodes.where(leaf).select("node", "path")
    return pairs.join(paths.toDF("a", "left"), "a").join(paths.toDF("b", "right"), "b").select("left", "right")


def _links(pairs: DataFrame, least: float, tasks: int) -> DataFrame:
    """cls, links, root: what each pair of trees has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, ""
        for batch in batches:
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                if left != at:
                    held, at = CoverTree.load(left), left
                found = Linked(held, held if right == left else CoverTree.load(right), least).rows()
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in found.items()})

    return pairs.repartition(tasks, "left", "right").sortWithinPartitions("left").mapInArrow(trimmed(run), "cls long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row: the other rows whose cosine with it is `least` or more."""
    spark = vectors.sparkSession
    rows, classes = _classes(vectors, vector)
    folder = new_folder(spark, "cover")
    nodes = _nodes(_built(_cells(classes, shard_rows), folder))
    pairs = written(_pairs(nodes, least), "cover-tasks")
    found = written(_links(pairs, least, max(1, min(pairs.count(), 20_000))), "cover-links")
    links = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")).where("a <> b"))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    labelled = classes.select("cls", "first_id", "n").join(counts, "cls", "left").join(links.withColumnRenamed("node", "cls"), "cls", "left")
    labelled = labelled.select("cls", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = written(labelled.join(ids, "root").join(classes.select("cls", "v", "n"), "cls").select("v", "n", "n_links", "component_id"), "cover-results")
    # equal vectors meet their class by the vector itself
    fine = rows.where("v IS NOT NULL")
    out = lookup(fine, ["v"], of_class, of_class.agg(F.sum("n")).first()[0] or 0, "inner", n="n").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
