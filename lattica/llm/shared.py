"""Session-level helpers: the shared work folder, written tables, fixed-size membership bitmaps."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import work_folder

#: Rows of a small table that a task writes.
ROWS_A_TASK = 250_000
#: A membership bitmap has 2**27 bits at most, 16 MB, whatever the number of keys.
MOST_BITS = 27


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: short lineage, and true sizes for the planner.

    rows: how many it has at most, if that is known; a small table is then written by few tasks, as few files.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_TASK)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out


def give_back() -> None:
    """Returns to the system what Python and Arrow have freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that returns to the system what it has freed: Spark keeps its workers for later tasks."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def same_columns(df: DataFrame, run: Callable[[Iterator], Iterator]) -> DataFrame:
    """df through mapInArrow, for functions that keep all columns in their order. They get and give batches whose columns
    have other names, since mapInArrow doesn't take every name."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    fields = [T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(df.schema.fields)]
    return plain.mapInArrow(trimmed(run), T.StructType(fields)).toDF(*df.columns)


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written(), once nothing reads them any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            drop_folder(df.sparkSession, path)


def low_bits_bitmap(keys: DataFrame, column: str, most: int = MOST_BITS) -> tuple[int, np.ndarray]:
    """(bits, words): a one-hash Bloom filter of a column that is a hash itself, by its low bits, as 64-bit words.

    About eight bits for each key as long as that is no more than 2**most bits; beyond, it lets more through. Only a
    pre-filter: it never loses a key, and an exact join follows it. Folded by Spark word by word, so the driver receives
    2**bits / 64 numbers at most.
    """
    n = keys.count()
    bits = min(most, max(12, (8 * n).bit_length()))
    bit = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("mask")).toPandas()
    )
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return bits, out


def in_bitmap(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    bit = bit.astype(np.uint64)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def lookup(left: DataFrame, key: list[str], table: DataFrame, total: int, how: str = "left", n: str = "n_rows") -> DataFrame:
    """left joined with a table of one row per key and the number n of left's rows that have it.

    Keys that hold over a thousandth of the total rows are under a thousand by arithmetic, so they are broadcast;
    the others are shuffled, and none of them is large. key columns must not be null.
    """
    hot = F.col(n) * 1000 > F.lit(total)
    first = left.join(F.broadcast(table.where(hot).drop(n).withColumn("_hot", F.lit(True))), key, "left")
    heavy = first.where("_hot").drop("_hot")
    rest = first.where("_hot IS NULL").select(left.columns).join(table.where(~hot).drop(n), key, how)
    return heavy.unionByName(rest)
