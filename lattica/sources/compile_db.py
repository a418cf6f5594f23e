"""Compile databases moved to another root: the longest common prefix of all paths, by component, is replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "directory string, file string, command string, arguments array<string>, output string"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).option("multiLine", True).json(path)


def _parts(path: Column) -> Column:
    """Components of a path; the leading / is one, empty ones and inner dots are none."""
    own = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.when(path.startswith("/"), F.concat(F.array(F.lit("/")), own)).otherwise(own)


def common_prefix(entries: DataFrame) -> DataFrame:
    """One row: prefix (null without paths, or if the paths share no component). Component sets that all paths share are
    counted by position, so nothing but one row for each distinct (position, component) is gathered."""
    paths = entries.select(F.explode(F.array("directory", "file")).alias("p")).where("p IS NOT NULL")
    total = paths.agg(F.count(F.lit(1)).alias("n"))
    each = paths.select(F.posexplode(_parts(F.col("p"))).alias("pos", "part")).groupBy("pos", "part").agg(F.count(F.lit(1)).alias("m"))
    shared = each.join(F.broadcast(total), F.col("m") == F.col("n")).agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("s"))
    # positions 0, 1, .. without a gap; a position has one such component at most
    run = F.filter("s", lambda x, i: x["pos"] == i)
    text = F.array_join(F.transform(run, lambda x: x["part"]), "/")
    return shared.select(F.when(F.size(run) > 0, F.regexp_replace(text, "^//", "/")).alias("prefix"))


def _moved(path: Column, old: Column, new: str) -> Column:
    bare = F.when(path.rlike("^/+$"), F.lit("")).otherwise(F.regexp_replace(path, "/+$", ""))
    base = F.regexp_replace(old, "/+$", "")
    rest = F.substr(bare, F.length(base) + 2)
    return F.when(old.isNull() | path.isNull(), path).when(bare == base, F.lit(new)).when(F.startswith(bare, F.concat(base, F.lit("/"))), F.concat(F.lit(f"{new}/"), rest)).otherwise(path)


def rewritten(entries: DataFrame, new_root: str) -> DataFrame:
    """entries with directory and file below new_root instead of the common prefix."""
    prefix = F.broadcast(common_prefix(entries))
    moved = entries.crossJoin(prefix)
    for c in ("directory", "file"):
        moved = moved.withColumn(c, _moved(F.col(c), F.col("prefix"), new_root))
    return moved.drop("prefix")


def include_folders(entries: DataFrame) -> DataFrame:
    """file, pos, folder of the -I flags of each entry, in their order; relative folders are below the entry's directory."""
    words = F.coalesce("arguments", F.filter(F.split("command", r"\s+"), lambda x: x != ""))
    each = entries.withColumn("_words", words).select("file", "directory", "_words", F.posexplode("_words").alias("pos", "word"))
    apart = F.when(F.col("word") == "-I", F.get("_words", F.col("pos") + 1)).when(F.col("word").startswith("-I"), F.substr("word", F.lit(3)))
    found = each.withColumn("_folder", apart).where("_folder IS NOT NULL AND _folder <> ''")
    below = F.when(F.col("_folder").startswith("/"), F.col("_folder")).otherwise(F.concat(F.regexp_replace("directory", "/+$", ""), F.lit("/"), "_folder"))
    return found.select("file", "pos", below.alias("folder"))
