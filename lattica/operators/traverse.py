"""Traversals of the call graph and the include graph: breadth-first levels as DataFrame jobs over pruned edges.

A frontier is a table of nodes, checkpointed where its lineage would grow, whatever its size; nothing of it goes through the driver
but its number of rows. Loops stop at the depth or at an empty frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.text import base_name, contains_like
from lattica.operators.lookup import include_edges
from lattica.session import checkpointed


def same_name_ids(symbols: DataFrame, id_: int) -> DataFrame:
    """The ids of the symbol's qualified name; the id itself if it is unknown."""
    spark = symbols.sparkSession
    own = spark.range(1).select(F.lit(id_).cast("long").alias("id"))
    name = symbols.where(F.col("id") == id_).select("qualified_name")
    return symbols.join(name, "qualified_name", "left_semi").select("id").unionByName(own).distinct()


def node_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls between logical nodes, with caller_name and callee_name: symbols of one qualified name are one node, and the name
    is the node. Snapshots keep these rows, by callee, so a traversal of an index joins no symbols."""
    name = lambda end: symbols.select(F.col("id").alias(f"{end}_id"), F.col("qualified_name").alias(f"{end}_name"))
    return calls.join(name("caller"), "caller_id").join(name("callee"), "callee_id")


def _reachable(edges: DataFrame, frontier: DataFrame, source: str, target: str) -> DataFrame:
    """node: the targets of the edges that leave the frontier. A hub among the sources is split by the skew join."""
    return edges.select(F.col(source).alias("_from"), F.col(target).alias("node")).join(frontier.select(F.col("node").alias("_from")), "_from", "left_semi").select("node").distinct()


def levels(edges: DataFrame, source: str, target: str, seeds: DataFrame, depth: int | None) -> DataFrame:
    """node, level of all nodes within depth of the seeds (a table with a column node) along edges source -> target."""
    frontier = checkpointed(seeds.select("node", F.lit(0).alias("level")).distinct())
    seen, level = frontier, 0
    while (depth is None or level < depth) and not frontier.isEmpty():
        level += 1
        new = _reachable(edges, frontier, source, target).join(seen.select("node"), "node", "left_anti")
        frontier = checkpointed(new.withColumn("level", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


def _seed(symbols: DataFrame, id_: int) -> DataFrame:
    """The node of a symbol: one look-up by id."""
    return symbols.where(F.col("id") == id_).select(F.col("qualified_name").alias("node"))


def _reached(edges: DataFrame, symbols: DataFrame, id_: int, depth: int, near: str, far: str) -> DataFrame:
    """Calls at the border of each level, one for each far name: that of the least (level, id)."""
    found = levels(edges, f"{near}_name", f"{far}_name", _seed(symbols, id_), depth)
    inner = found.where(F.col("level") < depth).select(F.col("node").alias(f"{near}_name"), (F.col("level") + 1).alias("level"))
    columns = ("id", "caller_id", "callee_id", "file_path", "line", "column", "is_virtual", "is_indirect", "level")
    hit = edges.join(inner, f"{near}_name").groupBy(f"{far}_name").agg(F.min_by(F.struct(*columns), F.struct("level", "id")).alias("first"))
    return hit.select("first.*")


def callers(edges: DataFrame, symbols: DataFrame, id_: int, depth: int = 1) -> DataFrame:
    """Calls that lead to the symbol within depth steps; nodes merge symbols of one qualified name. Calls into nodes that
    were reached before count too; of several calls from one name, that of the least (level, id) is returned."""
    return _reached(edges, symbols, id_, depth, "callee", "caller")


def callees(edges: DataFrame, symbols: DataFrame, id_: int, depth: int = 1) -> DataFrame:
    return _reached(edges, symbols, id_, depth, "caller", "callee")


def _side(calls: DataFrame, frontier: DataFrame, seen: DataFrame, near: str, far: str) -> DataFrame:
    """node, call, to: the nodes next to a frontier that its side hasn't seen, each with the least call between them."""
    met = calls.select(F.col(near).alias("to"), F.col(far).alias("node"), F.col("id").alias("call")).join(frontier.select(F.col("node").alias("to")), "to", "left_semi")
    new = met.join(seen.select("node"), "node", "left_anti")
    return checkpointed(new.groupBy("node").agg(F.min(F.struct("call", "to")).alias("x")).select("node", "x.call", "x.to"))


def shortest_path(calls: DataFrame, from_id: int, to_id: int) -> DataFrame:
    """pos, symbol_id of a shortest path over raw ids, of unbounded depth; empty if there is none.

    Two searches, from either end, of which the smaller frontier goes on until they meet. Rows hold a node and the least call that
    leads on from it towards the end, never a path: for the nodes around the end their own search finds that call, for those
    around the start it is found from the meeting back, over nodes that lead there only. Of equally short paths, this is
    the one whose sequence of first call ids is least. It is then read node by node.
    """
    spark = calls.sparkSession
    schema = "pos int, symbol_id long"
    if from_id == to_id:
        return spark.createDataFrame([(0, from_id)], schema)
    end = lambda x: spark.range(1).select(F.lit(x).cast("long").alias("node"), F.lit(None).cast("long").alias("call"), F.lit(None).cast("long").alias("to"))
    down, up = [end(from_id)], [end(to_id)]  # levels from the start, and from the end
    sizes = [1, 1]
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    while True:
        forward = sizes[0] <= sizes[1]
        own, near, far = (down, "caller_id", "callee_id") if forward else (up, "callee_id", "caller_id")
        own.append(_side(calls, own[-1], union(own), near, far))
        sizes[not forward] = own[-1].count()
        if not sizes[not forward]:
            return spark.createDataFrame([], schema)
        met = down[-1].select("node").join(up[-1].select("node"), "node", "left_semi")
        if not met.isEmpty():
            break
    # from the meeting back to the start: who leads to it, by the least call
    towards, leads = [], checkpointed(met)
    for level in reversed(down[:-1]):
        on = calls.select(F.col("caller_id").alias("node"), F.col("id").alias("call"), F.col("callee_id").alias("to")).join(level.select("node"), "node", "left_semi").join(leads.select(F.col("node").alias("to")), "to", "left_semi")
        leads = checkpointed(on.groupBy("node").agg(F.min(F.struct("call", "to")).alias("x")).select("node", "x.call", "x.to"))
        towards.append(leads)
    path = [from_id]
    for level in [*reversed(towards), *reversed(up[1:])]:
        path.append(level.where(F.col("node") == path[-1]).first()["to"])
    return spark.createDataFrame(list(enumerate(path)), schema)


def call_trace(calls: DataFrame, symbols: DataFrame, name: str, max_depth: int = 5, fan_out: int = 50, most_calls: int = 1_000_000) -> DataFrame:
    """pos, depth and symbol columns of the depth-first trace from a definition that is LIKE %name%, the least id of these.

    A caller's first fan_out calls by (callee's name, call id) are followed; a visited symbol isn't entered again, wherever
    it was met. That order decides what the depth limit cuts off, so the order is replayed on the driver: over the symbols
    within max_depth and at most fan_out calls of each, which Spark selects level by level. A trace over more than most_calls
    calls fails, rather than fill the driver or be cut.
    """
    spark = symbols.sparkSession
    entry = symbols.where("is_definition").where(contains_like(F.col("name"), name) | contains_like(F.col("qualified_name"), name))
    first = entry.orderBy("id").limit(1).select("id").collect()
    if not first:
        return spark.createDataFrame([], "pos int, depth int, id long").join(symbols, "id").orderBy("pos")
    root = first[0][0]
    named = calls.join(symbols.select(F.col("id").alias("callee_id"), F.col("name").alias("_name")), "callee_id")
    by = Window.partitionBy("caller_id").orderBy("_name", "id")
    children: dict[int, list[int]] = {}
    frontier = [root]
    for _ in range(max_depth):
        if not frontier:
            break
        ids = spark.createDataFrame([(x,) for x in frontier], "caller_id long")
        near = named.where(F.col("caller_id").isin(frontier)) if len(frontier) <= 1000 else named.join(ids, "caller_id", "left_semi")
        rows = near.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= fan_out).select("caller_id", "callee_id", "_n").orderBy("caller_id", "_n").limit(most_calls + 1).collect()
        most_calls -= len(rows)
        if most_calls < 0:
            raise ValueError("the trace is over too many calls for one driver; lower max_depth or fan_out")
        for r in rows:
            children.setdefault(r[0], []).append(r[1])
        for x in frontier:
            children.setdefault(x, [])
        frontier = sorted({c for x in frontier for c in children[x]} - children.keys())
    order, visited, stack = [], set(), [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node in visited:
            continue
        visited.add(node)
        order.append((len(order), depth, node))
        if depth < max_depth:
            stack += [(c, depth + 1) for c in reversed(children.get(node, []))]
    return spark.createDataFrame(order, "pos int, depth int, id long").join(symbols, "id").orderBy("pos")


def call_graph(edges: DataFrame, symbols: DataFrame, root: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the callees within depth; nodes are the root and all ends of the calls that callees() returns."""
    found = callees(edges, symbols, root, depth)
    spark = symbols.sparkSession
    ids = found.select(F.col("caller_id").alias("id")).unionByName(found.select(F.col("callee_id").alias("id"))).unionByName(spark.range(1).select(F.lit(root).cast("long").alias("id")))
    known = symbols.select("id", "qualified_name", F.col("kind").alias("_kind"), "file_path", "line")
    nodes = ids.distinct().join(known, "id", "left").select(
        F.col("id").cast("string").alias("id"),
        F.coalesce("qualified_name", F.concat(F.lit("symbol_"), F.col("id").cast("string"))).alias("label"),
        F.when(F.col("_kind") == "type", "Type").otherwise("Function").alias("kind"),
        "file_path", "line", F.col("id").alias("symbol_id"), F.lit(None).cast("string").alias("metadata"),
    )
    return nodes, _edge_rows(found, F.col("caller_id").cast("string"), F.col("callee_id").cast("string"), "Call")


def _edge_rows(df: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("metadata"))


def file_graph(includes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all includes by spelling; edges repeat as the includes do."""
    names = includes.select(F.col("source_file").alias("id")).unionByName(includes.select(F.col("target_file").alias("id"))).distinct()
    nodes = names.select(
        "id", base_name(F.col("id")).alias("label"), F.lit("File").alias("kind"), F.col("id").alias("file_path"),
        F.lit(None).cast("int").alias("line"), F.lit(None).cast("long").alias("symbol_id"), F.lit(None).cast("string").alias("metadata"),
    )
    return nodes, _edge_rows(includes, F.col("source_file"), F.col("target_file"), "Include")


def impact(includes: DataFrame, changed: DataFrame) -> DataFrame:
    """file: the changed paths, and all that include a changed header, directly or not. Headers are told by their ending."""
    paths = changed.select(F.col(changed.columns[0]).alias("node")).distinct()
    headers = paths.where(F.col("node").rlike(r"\.(?:h|hh|hpp|hxx)$"))
    reached = levels(include_edges(includes), "target", "source", headers, None)
    return reached.select(F.col("node").alias("file")).unionByName(paths.select(F.col("node").alias("file"))).distinct()
