"""Mixing sources to target weights, with DataFrame functions only.

Water-filling gives each source its target; a document is taken floor(target / size of the source) times and the rest is
a subset of the documents by a hash threshold. The threshold comes from histograms: sizes are summed by source and
hash bucket, cumulated, and the bucket in which the budget ends is split again by the next bits of the hash, so that
only that bucket's documents are summed anew. Nothing is sorted by document, and a rerun takes the same ones.

A source of few documents may miss its target by much, when a large one ends its budget. Where more than SLACK of a target
is missing, the threshold goes on behind that document, over documents that fit into what is left, up to FILLS times; each
time is another histogram, of such sources only. If still more is missing and the smallest document left comes
nearer to the target than none, it is taken too. So a source is off by SLACK of its target, or half of a document.

Sources are few against documents, but nothing rests on it: tables of sources are joined as their size asks for, and are
never in one task.

Defined results: null text has size 0 and is taken 0 words; null sources form one source, the last; a source of size 0 has
target 0; documents with the same id share their hash and so their fate, those of null id too; extra columns of any name
are ignored by mixed() and kept by mix(); empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.shared import written

#: Weights of the sources in their order, and what the mix takes of all sizes.
WEIGHTS, SHARE = (5.0, 2.0, 1.0), 1.5
#: A source is taken as often at most.
MOST = 2
#: Of the hash: its bits, and those that each level of the histogram reads; three levels reach 1 in 2**30 of a source.
HASH_BITS, LEVEL_BITS, LEVELS = 60, 10, 3
#: What a target may miss without another fill, as a share of it, and the fills of a source at most.
SLACK, FILLS = 0.01, 8


def words(text: Column) -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _key(source: Column) -> Column:
    """A source as a string that isn't null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _hash(doc_id: Column) -> Column:
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":mix"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with `rank`, from 0, by code point with the null source last: ranks within ranges, and the ranges' starts."""
    last = F.col("key") == ""
    ranged = written(sizes.repartitionByRange(last, "key").withColumn("part", F.spark_partition_id()), "mix-ranges", sizes.count())
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    starts = starts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("start"))  # a row for each task
    within = F.row_number().over(Window.partitionBy("part").orderBy(last, "key"))
    return ranged.withColumn("within", within).join(starts, "part").withColumn("rank", F.col("start") + F.col("within") - 1).drop("part", "start", "within")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(key, source_size), a row for each source, with its target.

    Water-filling: all sources get one level times their weight, those that this would take above their cap get the cap,
    and what they leave raises the level of the others, until none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = _ranked(sizes).select("key", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    capped = written(capped, "mix-caps", sizes.count())
    budget, total = (capped.agg(F.sum("source_size") * F.lit(share), F.sum("weight")).first()) or (None, None)
    level, before = F.lit(0.0), -1
    while total:
        full = F.col("cap") < level * F.col("weight")
        n, cap, weight_ = capped.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(full, F.col("weight"))), F.lit(0.0))).first()
        if n == before:
            break
        before = n
        level = F.lit((budget - cap) / (total - weight_) if total > weight_ else float("inf"))
    return capped.select("key", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def _filled(docs: DataFrame, budgets: DataFrame, levels: int, bits: int) -> DataFrame:
    """budgets(key, left, begin, ..) with `cut` and `end`, and `left` brought up to date: documents of docs(key, size, hash) whose
    hash lies from begin up to cut fit into left; those up to end are done with.

    Each level sums the documents of one bucket of the level before (at first of all).
    """
    names, sources = budgets.columns, budgets.count()
    top = F.lit(1 << HASH_BITS)
    state = budgets.withColumn("cut", F.lit(0).cast("long")).withColumn("over", F.lit(True))
    for level in range(levels):
        shift = HASH_BITS - bits * (level + 1)
        of = state.where("over").select("key", "begin", "most", F.shiftright("cut", shift + bits).alias("outer"))
        inside = docs.select("key", "size", "hash").join(of, "key").where((F.col("hash") >= F.col("begin")) & (F.col("size") <= F.col("most")))
        if level:
            inside = inside.where(F.shiftright("hash", shift + bits) == F.col("outer"))
        sums = inside.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        up = Window.partitionBy("key").orderBy("bucket")  # of 2**bits buckets at most
        filled = sums.withColumn("end", F.sum("words").over(up)).join(state.select("key", "left"), "key")
        fits = F.col("end") <= F.col("left")
        found = filled.groupBy("key").agg(F.coalesce(F.max(F.when(fits, F.col("end"))), F.lit(0)).alias("used"), F.min(F.when(~fits, F.col("bucket"))).alias("first"))
        left = F.col("left") - F.coalesce("used", F.lit(0))
        # without a bucket that is too much, everything is in
        cut = F.when(~F.col("over"), F.col("cut")).when(F.col("first").isNotNull(), F.shiftleft("first", shift)).otherwise(top)
        kept = [left.alias("left") if c == "left" else F.col(c) for c in names]
        state = written(state.join(found, "key", "left").select(*kept, cut.alias("cut"), (F.col("over") & F.col("first").isNotNull()).alias("over")), "mix-cut", sources)
    end = F.when(F.col("over"), F.col("cut") + (1 << (HASH_BITS - bits * levels))).otherwise(top)
    return state.withColumn("end", end).drop("over")


def thresholds(docs: DataFrame, plan: DataFrame, levels: int = LEVELS, bits: int = LEVEL_BITS) -> DataFrame:
    """plan with `copies`, and what makes up the budget of the last, partial copy: documents (key, size, hash) whose hash is below
    `cut`, or lies in one of the `fills` whose size it doesn't exceed, or is `extra`."""
    sources = plan.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    none = F.array().cast("array<struct<begin:bigint,cut:bigint,most:double>>")
    state = plan.withColumn("copies", whole).select(
        "*", (F.col("target") - F.col("copies") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("begin"), F.lit(float("inf")).alias("most"), none.alias("fills")
    )
    first = _filled(docs, state, levels, bits)
    state = written(first.select("key", "source_size", "target", "copies", "left", F.col("end").alias("begin"), "fills", "cut"), "mix-first", sources)
    missing = (F.col("left") > F.col("target") * SLACK) & (F.col("copies") < MOST)
    for _ in range(FILLS):
        short = state.where(missing & (F.col("begin") < (1 << HASH_BITS)))
        n = short.count()
        if not n:
            break
        own = written(short.withColumn("most", F.col("left")).withColumnRenamed("cut", "first_cut"), "mix-short", n)
        more = _filled(docs, own, levels, bits)
        more = more.select("key", "source_size", "target", "copies", "left", F.col("end").alias("begin"), F.array_append("fills", F.struct("begin", "cut", "most")).alias("fills"), F.col("first_cut").alias("cut"))
        state = written(state.join(more.select("key"), "key", "left_anti").unionByName(more), "mix-filled", sources)
    short = state.where(missing)
    extra = F.lit(None).cast("long")
    if short.isEmpty():
        return state.withColumn("extra", extra)
    untaken = docs.select("key", "size", "hash").join(short.select("key", "left", "cut", "fills", extra.alias("extra")), "key").where(~_inside() & (F.col("size") > 0))
    units = untaken.groupBy("key", "hash").agg(F.sum("size").alias("words"), F.any_value("left").alias("left")).where(F.col("words") < 2 * F.col("left"))
    least = units.groupBy("key").agg(F.min(F.struct("words", "hash"))["hash"].alias("extra"))
    return written(state.join(least, "key", "left"), "mix-extra", sources)


def _inside() -> Column:
    """Whether a document is in the last, partial copy."""
    fill = lambda f: (F.col("hash") >= f["begin"]) & (F.col("hash") < f["cut"]) & (F.col("size") <= f["most"])
    return (F.col("hash") < F.col("cut")) | F.exists("fills", fill) | F.coalesce(F.col("hash") == F.col("extra"), F.lit(False))


def _cut(docs: DataFrame, weights, share: float) -> tuple[DataFrame, DataFrame]:
    slim = written(docs.select("doc_id", _key(F.col("source")).alias("key"), words(F.col("text")).alias("size"), _hash(F.col("doc_id")).alias("hash")), "mix-sizes")
    sizes = written(slim.groupBy("key").agg(F.sum("size").alias("source_size")), "mix-sources", slim.count())
    return slim, thresholds(slim, written(targets(sizes, weights, share), "mix-targets", sizes.count()))


def _times() -> Column:
    return F.least(F.col("copies") + F.when(_inside(), 1).otherwise(0), F.lit(MOST)).cast("int")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target, taken for each of docs(doc_id, text, source)."""
    slim, cut = _cut(docs, weights, share)
    return slim.join(cut, "key").select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mix itself: docs, all columns, each row as often as the mix takes it."""
    _, cut = _cut(docs, weights, share)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = docs.select(whole, _key(F.col("source")).alias("key"), _hash(F.col("doc_id")).alias("hash"), F.col("text").alias("text"))
    # a text is only counted again where that decides
    rows = rows.join(cut.select("key", "copies", "cut", "fills", "extra"), "key").withColumn("size", F.when(F.size("fills") > 0, words(F.col("text"))).otherwise(0))
    return rows.select("doc", F.explode(F.array_repeat(F.lit(0), _times()))).select("doc.*")
