"""What clients do with query results: grouping, merging, positions, neighbourhoods, short names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.numbering import numbered
from lattica.operators.traverse import callees, callers


def grouped_by_file(rows: DataFrame) -> DataFrame:
    """file_path, n, pos, line, column, id: rows with the number of their file's rows and their place among them, by line."""
    own = numbered(rows.select("file_path", "line", "column", "id"), ["file_path", "line", "column", "id"], "_at")
    files = own.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    return own.join(files, "file_path").select("file_path", "n", (F.col("_at") - F.col("_first") + 1).alias("pos"), "line", "column", "id")


def merged_by_name(symbols: DataFrame) -> DataFrame:
    """One symbol of each qualified name: the first definition, else the first."""
    first = Window.partitionBy("qualified_name").orderBy(F.col("is_definition").desc(), "id")
    return symbols.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def symbol_at(symbols: DataFrame, path: str, line: int) -> DataFrame:
    """The first symbol of the file, by line, whose lines hold the given one, else the last that begins before it."""
    own = symbols.where((F.col("file_path") == path) & (F.col("line") <= line))
    holds = F.coalesce("end_line", "line") >= line
    return own.orderBy(F.when(holds, F.col("line")).asc_nulls_last(), F.col("line").desc(), "id").limit(1)


#: Lines of a stretch, as a power of two: windows run within stretches, so no file is in one task.
STRETCH = 9


def symbols_at(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """symbol_at() for a table of places(place_id, file_path, at): two as-of joins over sorted rows, in which no place ever meets
    more than one symbol.

    The last symbol that begins before a place is the nearest start below it. The first that holds it needs no intervals either:
    in the order of (line, id), the first symbol that ends at the place or later is one that ends later than all before it, and
    such symbols are ordered by their ends too. So it is the nearest end above, if that symbol has begun.
    """
    own = symbols.select("file_path", "id", "line", F.coalesce("end_line", "line").alias("end"))
    starts = own.groupBy("file_path", F.col("line").alias("pos")).agg(F.struct(F.min("line").alias("line"), F.min("id").alias("id")).alias("value"))
    ends = _outlasting(own.where(F.col("end") >= F.col("line"))).select("file_path", F.col("end").alias("pos"), F.struct("line", "id").alias("value"))
    last, first = _nearest(starts, places, True), _nearest(ends, places, False).where(F.col("value.line") <= F.col("at"))
    rank = lambda df, n: df.select("place_id", F.struct(F.lit(n).alias("rank"), F.col("value.id").alias("id")).alias("k"))
    return rank(first, 0).unionByName(rank(last, 1)).groupBy("place_id").agg(F.min("k")["id"].alias("symbol_id"))


def _stretches(rows: DataFrame, pos: str) -> DataFrame:
    return rows.withColumn("stretch", F.shiftright(pos, STRETCH))


def _outlasting(own: DataFrame) -> DataFrame:
    """The symbols that end later than all that come before them in their file, by (line, id)."""
    rows = _stretches(own, "line")
    earlier = Window.partitionBy("file_path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("file_path", "stretch").agg(F.max("end").alias("m")).select("file_path", "stretch", F.max("m").over(earlier).alias("carried"))
    before = Window.partitionBy("file_path", "stretch").orderBy("line", "id").rowsBetween(Window.unboundedPreceding, -1)
    reached = rows.withColumn("reached", F.max("end").over(before)).join(carried, ["file_path", "stretch"])
    return reached.where(F.col("end") > F.coalesce(F.greatest("reached", "carried"), F.col("end") - 1)).select(own.columns)


def _nearest(events: DataFrame, places: DataFrame, below: bool) -> DataFrame:
    """place_id, at, value of the nearest event(file_path, pos, value) at or below each place, or at or above it. A window runs
    over both within stretches of lines; what an earlier stretch leaves off with is carried into the next."""
    rows = events.select("file_path", "pos", "value", F.lit(None).cast("long").alias("place_id"), F.lit(0).alias("kind"))
    rows = rows.unionByName(places.select("file_path", F.col("at").alias("pos"), "place_id", F.lit(1).alias("kind")), allowMissingColumns=True)
    rows = _stretches(rows, "pos")
    way = (lambda c: F.col(c).asc()) if below else (lambda c: F.col(c).desc())
    known = F.when(F.col("kind") == 0, F.col("pos"))
    ends = rows.groupBy("file_path", "stretch").agg((F.max_by if below else F.min_by)("value", known).alias("v"))
    earlier = Window.partitionBy("file_path").orderBy(way("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file_path", "stretch", F.last("v", True).over(earlier).alias("carried"))
    running = Window.partitionBy("file_path", "stretch").orderBy(way("pos"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("met", F.last("value", True).over(running)).where("kind = 1").join(carried, ["file_path", "stretch"])
    return met.select("place_id", F.col("pos").alias("at"), F.coalesce("met", "carried").alias("value")).where("value IS NOT NULL")


def neighbourhood(edges: DataFrame, symbols: DataFrame, id_: int) -> DataFrame:
    """source, target of the calls to and from the symbol, each pair once, both ends known."""
    pairs = [f(edges, symbols, id_, 1).select(F.col("caller_id").alias("source"), F.col("callee_id").alias("target")) for f in (callers, callees)]
    known = symbols.select("id")
    both = pairs[0].unionByName(pairs[1]).distinct()
    return both.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")


def expanded(shown: DataFrame, more: DataFrame) -> DataFrame:
    """The edges shown and those of another neighbourhood, each pair once."""
    return shown.unionByName(more).distinct()
