"""Substring search by posting lists: which names have which three characters in a row.

An index has two tables, dealt into the buckets of a snapshot's symbols and rewritten with them. `name_heads` has a row for each
qualified name of a bucket: its place there, all spellings of its name, and the symbol that represents it within the bucket.
`name_grams` has, for every three characters (ASCII letters folded), the places of the names that contain them.

A search reads the lists of the text's own triples, intersects them bucket by bucket, reads the heads at the places that are left,
in small pages of the file that the places point at, verifies them, and picks the representative of each name over all buckets.
Texts of under three characters, those with wildcards, those that too many names contain, and names that only match
apart from their qualified name go through the scan (operators.search), so both give the same rows always.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lattica.functions.text import LOWER, UPPER, ascii_fold, contains_like, like_ascii
from lattica.operators import search
from lattica.schema import KINDS, SYMBOLS

#: Characters in a row that are looked up.
GRAM = 3
HEADS, GRAMS = "name_heads", "name_grams"
HEAD_SCHEMA = f"at bigint, qualified_name string, names array<string>, symbol struct<{SYMBOLS}>"
GRAM_SCHEMA = "gram string, places array<bigint>"
#: Rows of a page of heads, the unit that is read; ids of a bucket's names start from its number times 2**32.
PAGE_ROWS, BUCKET_BITS = 256, 32
#: Places that are read one by one at most; where more names qualify, a scan is no dearer.
MOST_PLACES = 2_000


def heads(symbols: DataFrame, bucket: Column) -> DataFrame:
    """at, qualified_name, names, symbol, bucket: the names of each bucket in their order, with the definition, else the declaration, of least id."""
    whole = F.struct(*(F.col(c) for c in symbols.columns))
    own = symbols.withColumn("bucket", bucket).groupBy("bucket", "qualified_name").agg(
        F.array_sort(F.collect_set("name")).alias("names"), F.min_by(whole, F.struct(~F.col("is_definition"), "id")).alias("symbol")
    )
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("qualified_name")) - 1
    return own.select((F.shiftleft(F.col("bucket").cast("long"), BUCKET_BITS) + place).alias("at"), "qualified_name", "names", "symbol", "bucket")


def grams_of(text: Column) -> Column:
    """The distinct triples of a text."""
    last = F.length(text) - (GRAM - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def postings(found: DataFrame) -> DataFrame:
    """gram, places, bucket of heads(); a bucket's lists are as long as it has names at most."""
    texts = F.array_union(F.array("qualified_name"), "names")
    grams = F.array_distinct(F.flatten(F.transform(texts, lambda t: grams_of(ascii_fold(F.coalesce(t, F.lit("")))))))
    return found.select("bucket", "at", F.explode(grams).alias("gram")).groupBy("bucket", "gram").agg(F.array_sort(F.collect_list("at")).alias("places")).select("gram", "places", "bucket")


def _folded(query: str) -> str:
    return query.translate(str.maketrans(UPPER, LOWER))


def looked_up(query: str) -> list[str] | None:
    """The triples of a text; none for one that the lists can't answer."""
    text = _folded(query)
    if len(text) < GRAM or set(text) & set("%_\\"):
        return None
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


def places(lists: DataFrame, grams: list[str]) -> DataFrame:
    """at: the names that have all the triples."""
    bucket = F.shiftright(F.col("places")[0], BUCKET_BITS)
    whole = lists.where(F.col("gram").isin(grams)).groupBy(bucket.alias("bucket")).agg(F.collect_list("places").alias("l")).where(F.size("l") == len(grams))
    both = F.aggregate(F.slice("l", 2, len(grams)), F.col("l")[0], lambda a, b: F.array_intersect(a, b))
    return whole.select(F.explode(both).alias("at"))


def at_places(found: DataFrame, at: list[int]) -> DataFrame:
    """The heads at some places, as ranges of a page or less, so that the filter reaches the pages of the files."""
    spans: list[list[int]] = []
    for x in sorted(at):
        if spans and x - spans[-1][1] < PAGE_ROWS // 2:
            spans[-1][1] = x
        else:
            spans.append([x, x])
    if not spans:
        return found.limit(0)
    inside = reduce(lambda a, b: a | b, (F.col("at").between(a, b) for a, b in spans))
    return found.where(inside).where(F.col("at").isin(at))


def candidates(found: DataFrame, lists: DataFrame, query: str, most: int = MOST_PLACES) -> DataFrame | None:
    """The heads that may match; None if a scan has to find them."""
    grams = looked_up(query)
    if grams is None:
        return None
    at = [r[0] for r in places(lists, grams).limit(most + 1).collect()]  # `most` numbers at most
    return None if len(at) > most else at_places(found, at)


def indexed_search(symbols: DataFrame, found: DataFrame, lists: DataFrame, query: str, kind: str | None = None, limit: int = 50, most: int = MOST_PLACES) -> DataFrame:
    """search.search_api() by the index: found, lists are the tables of heads and postings."""
    near = candidates(found, lists, query, most)
    if near is not None:
        of_qualified = contains_like(F.col("qualified_name"), query)
        apart = F.exists("names", lambda n: contains_like(n, query)) & ~of_qualified
        if near.where(apart).isEmpty():
            first = near.where(of_qualified).groupBy("qualified_name").agg(F.min_by("symbol", F.struct(~F.col("symbol.is_definition"), F.col("symbol.id"))).alias("s"))
            rows = first.select("s.*")
            if kind in KINDS:
                return rows.where(F.col("kind") == kind).orderBy(F.length("name"), "id").limit(limit)
            rank = F.when(F.col("name") == query, 0).when(like_ascii(F.col("name"), f"{query}%"), 1).otherwise(2)
            return rows.orderBy(rank, F.length("name"), "id").limit(limit)
    return search.search_api(symbols, query, kind, limit)


def schema_of(table: str) -> T.StructType:
    return T._parse_datatype_string(HEAD_SCHEMA if table == HEADS else GRAM_SCHEMA)
