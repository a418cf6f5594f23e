"""Connected components of a table of links, by hooking to the least neighbour, pointer jumping and contraction.

Every round is three joins and an aggregation over links between roots. Roots are the local minima of what is left, so
each round at least halves the nodes that still have links; a star is done in one. Only hooks and links are written;
rows are pairs of ids, and frequent keys (the middle of a star) are left to Spark's skew join.

Defined results: links hold no nulls; a link of a node with itself adds nothing, so a node with no other link isn't in the
result; repeated and reversed links count once; no links give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import drop_table, written


def _moved(df: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    """df with a column's nodes replaced by what they hook to."""
    h = hooks.select(F.col("node").alias(column), F.col("to").alias("_to"))
    return df.join(h, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def components(links: DataFrame) -> DataFrame:
    """links(a, b), without nulls -> node, root for every node in them; the root is the least node of the component."""
    ordered = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(ordered(links), "cc-links", links.count())
    used, n = [edges], edges.count()
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    left = n
    while left:
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        hooks = written(_moved(_moved(hooks, hooks, "to"), hooks, "to"), "cc-hooks", left)
        labels = _moved(labels, hooks, "root")
        edges = written(ordered(_moved(_moved(edges, hooks, "a"), hooks, "b")), "cc-links", left)
        used += [hooks, edges]
        left = edges.count()
    out = written(labels.select("node", "root"), "cc-labels", 2 * n)
    drop_table(*used)
    return out
