"""Ranked symbol search: one representative of each qualified name, text match, rank, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.text import contains_like, like_ascii
from lattica.schema import KINDS


def representatives(symbols: DataFrame) -> DataFrame:
    """The definition, else the declaration, of least id for each qualified name; planned as a window group limit."""
    first = Window.partitionBy("qualified_name").orderBy(F.col("is_definition").desc(), "id")
    return symbols.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def _matches(query: str) -> Column:
    return contains_like(F.col("name"), query) | contains_like(F.col("qualified_name"), query)


def _found(symbols: DataFrame, query: str) -> DataFrame:
    """Representatives that match. A filter on names can't pass the window, so first only the qualified names with a
    matching row are kept, whole: representatives are chosen within a name, so no other row can matter."""
    if query == "":
        return representatives(symbols)
    names = symbols.where(_matches(query)).select("qualified_name").distinct()
    return representatives(symbols.join(names, "qualified_name", "left_semi")).where(_matches(query)).select(symbols.columns)


def search(symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Exact names first, then names that begin with the query, then the others; shorter names first."""
    rank = F.when(F.col("name") == query, 0).when(like_ascii(F.col("name"), f"{query}%"), 1).otherwise(2)
    return _found(symbols, query).orderBy(rank, F.length("name"), "id").limit(limit)


def search_by_kind(symbols: DataFrame, query: str, kind: str, limit: int = 50) -> DataFrame:
    """Only representatives of the kind: a name whose representative is of another kind isn't found."""
    return _found(symbols, query).where(F.col("kind") == kind).orderBy(F.length("name"), "id").limit(limit)


def search_api(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """An unknown kind searches all kinds."""
    return search_by_kind(symbols, query, kind, limit) if kind in KINDS else search(symbols, query, limit)


def search_tool(symbols: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Like search_api, but a kind that is given and unknown is read as function."""
    if kind is None:
        return search(symbols, query, 50)
    return search_by_kind(symbols, query, kind if kind in KINDS else "function", 50)
