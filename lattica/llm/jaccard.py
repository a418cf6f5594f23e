"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds 64-bit hashes of its k-word shingles. All sets are in one global order, rare first: that of a
fixed-size table of shingle counts over the whole corpus. Of two sets that reach the similarity, the first
n - ceil(t * n) + l shingles of each share l at least, for every l. The first n - ceil(t * n) + 1 are indexed, and one of
them brings up a pair; then each document's prefix is lengthened by its estimated candidate cost (the counts of its
prefix), and the pair must share as many shingles of the lengthened prefixes as the smaller of the two l. What is left
goes by a bound on the difference of the sets (bits that hold the parity of their shingles) before whole sets are compared.

Equal sets form one class, and only classes are joined. What is asked for are the links' components, so a pair that links
connect already needs no comparison. Index rows are (shingle, size band): classes stand in the band of their size and in
the next, so two of similar size meet. In waves, the classes of each index key are compared with some of them, its pivots:
one at first, so that a group of thousands of near copies costs about as many comparisons as it has members; then WIDER
times more in each wave, chosen by a hash, until all are; keys whose classes are all of one component need no more waves.
So all pairs of an index key that aren't connected are compared, whatever its size.

Defined results: null texts and texts without words have an empty set, link with nothing and are their own component;
texts of fewer than k words have their whole sequence as one shingle; rows of the same doc_id are one node; rows of
null doc_id link nothing, and take their class's component; an empty table gives an empty table; extra columns are
ignored by joined() and kept by deduplicated().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.components import components
from lattica.llm.kernels import U, Words, column_bytes, distinct_by_text, mix, slices
from lattica.llm.shared import ROWS_A_TASK, drop_table, in_bitmap, lookup, low_bits_bitmap, trimmed, written

#: The count table has 2**18 counters, whatever the number of shingles.
COUNT_BITS, MOST_MATCHES = 18, 4
#: Parity bits of a set, as 64-bit numbers.
PARITY_WORDS = 16
#: How many times more pivots a wave has than the one before.
WIDER = 32
#: Of the two hashes of a set.
SALTS = (0x8CB92BA72F3D8DD7, 0x3C6EF372FE94F82B)
#: Texts that are handled at a time at most, so that their parity bits stay small.
_ROWS = 2048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text) of each text's set, by text and shingle."""
    return distinct_by_text(*Words(_LOWER[data], offsets).shingles(k))


def _set_hash(value: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    s = np.concatenate([np.zeros(1, U), np.cumsum(mix(value ^ U(salt)), dtype=U)])
    return (s[first[1:]] - s[first[:-1]]).view(np.int64)


def parities(value: np.ndarray, text: np.ndarray, rows: int) -> np.ndarray:
    """PARITY_WORDS numbers of each set: bit by bit, whether an odd number of its shingles fall on the bit. Two sets differ
    in at least as many shingles as their parities do in bits."""
    bits = 64 * PARITY_WORDS
    at = text * bits + (mix(value) >> U(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(at, minlength=rows * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(rows, bits), axis=1, bitorder="little").view(np.int64)


def shingle_counts(docs: DataFrame, k: int = 3) -> np.ndarray:
    """How often shingles occur in all documents, in 2**COUNT_BITS counters by hash."""
    size = 1 << COUNT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                value, _ = Words(_LOWER[data[o[0] : o[-1]]], o - o[0]).shingles(k)
                total += np.bincount((value & U(size - 1)).astype(np.int64), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["counter", "n"])

    table = docs.select("text").mapInArrow(trimmed(count), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[table["counter"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return out


def ordered_tokens(value: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Shingles as numbers in the global order. rank: the counters' places by count. The counter is the low bits of a
    shingle, so its rank and the other bits still tell all shingles apart."""
    return rank[(value & U(len(rank) - 1)).astype(np.int64)] << U(64 - COUNT_BITS) | value >> U(COUNT_BITS)


_ROW = "doc_id long, n long, h1 long, h2 long, matches int, base int, prefix array<bigint>, parity array<bigint>"


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))


def _prefixes(docs: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, n, h1, h2, matches, base, prefix, parity: size and hash of the set, l, the length of the indexed prefix, the
    first shingles in the global order, the parity bits."""
    rank = np.empty(len(counts), U)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=U)
    shared = docs.sparkSession.sparkContext.broadcast((counts, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rank = shared.value
        by_rank = counts[np.argsort(rank)]
        usual = max(1.0, float(counts.mean()))
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in slices(offsets, rows=_ROWS):
                o, rows = offsets[a : b + 1], b - a
                value, text = Words(_LOWER[data[o[0] : o[-1]]], o - o[0]).shingles(k)
                token, text = distinct_by_text(ordered_tokens(value, rank), text)
                n = np.bincount(text, minlength=rows).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(n)])
                base = n - -(-percent * n // 100) + 1
                # a set under this size reaches the similarity with its equal only
                base[n * 100 < percent * (n + 1)] = 0
                place = np.arange(len(token)) - first[text]
                head = place < base[text]
                often = by_rank[(token[head] >> U(64 - COUNT_BITS)).astype(np.int64)]
                cost = np.bincount(text[head], np.maximum(0, often / usual - 2), rows) / np.maximum(1, base)
                matches = np.clip(1 + np.log2(1 + cost).astype(np.int64) // 2, 1, MOST_MATCHES)
                length = np.where(base > 0, np.minimum(n, base + matches - 1), 0)
                columns = [
                    batch.column("doc_id").slice(a, rows), *(pa.array(x) for x in (n, _set_hash(token, first, SALTS[0]), _set_hash(token, first, SALTS[1]))),
                    pa.array(matches, pa.int32()), pa.array(base, pa.int32()), _lists(token[place < length[text]].view(np.int64), length),
                    _lists(parities(token, text, rows).reshape(-1), np.full(rows, PARITY_WORDS)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ROW.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), _ROW)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents of the ids (a column doc_id), and of few others that a bitmap lets through."""
    bit = lambda key: F.xxhash64(key)
    bits, words = low_bits_bitmap(ids.select(bit(F.col("doc_id")).alias("bit")), "bit")
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = in_bitmap(shared.value, np.asarray(batch.column("bit")).view(U) & U((1 << bits) - 1)) if len(batch) else np.zeros(0, bool)
            yield batch.select(["doc_id", "text"]).filter(pa.array(asked))

    slim = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", bit(F.col("doc_id")).alias("bit"))
    return slim.mapInArrow(trimmed(run), "doc_id long, text string")


def _with_links(links: DataFrame, pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """links, and the pairs (a, b) whose whole sets reach the similarity. Rows of one doc_id are one node: any text of it
    counts."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = _texts_of(docs, ids)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, pa.Scalar | None, np.ndarray] = 0, None, np.zeros(0, U)
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            data, offsets = column_bytes(batch.column("text_b"))
            a, left = batch.column("a").to_pylist(), batch.column("text_a")
            for s, e in slices(offsets):
                o = offsets[s : e + 1]
                value, text = shingle_sets(data[o[0] : o[-1]], o - o[0], k)
                first = np.searchsorted(text, np.arange(e - s + 1))
                for i in range(s, e):
                    # pairs come by a, so its set often is the one before
                    if held[1] is None or held[0] != a[i] or held[1] != left[i]:
                        held = a[i], left[i], shingle_sets(*column_bytes(left.slice(i, 1)), k)[0]
                    x, y = held[2], value[first[i - s] : first[i - s + 1]]
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    ok[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    found = met.mapInArrow(trimmed(compare), "a long, b long").distinct()
    return written(links.unionByName(found), "jaccard-links", links.count() + pairs.count())


def _may_link(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """Whether index rows of one shingle can be of sets that reach the similarity, by their sizes n and the places of this
    shingle (pos): of sets that share o = ceil(t / (1 + t) * (n + m)) shingles at least, some shared one is among the first
    n - o + 1 of one and among the first m - o + 1 of the other."""
    need = (x["n"] + y["n"]) * percent
    enough = [(s["n"] - s["pos"]) * (100 + percent) >= need for s in (x, y)]
    return (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent) & enough[0] & enough[1]


def _shares(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that share l shingles of their l-prefixes, l the smaller of the two documents', and whose parity bits don't
    differ in more places than sets of that similarity have different shingles."""

    def side(name: str) -> DataFrame:
        return classes.select(F.col("cls").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "matches", "base", "prefix", "parity")))

    total = F.col("n_a") + F.col("n_b")
    least = F.ceil(total * percent / F.lit(100 + percent))  # what sets of that similarity share
    matches = F.least("matches_a", "matches_b", least.cast("int"))
    cut = [F.slice(f"prefix_{x}", F.lit(1), F.col(f"base_{x}") + matches - 1) for x in ("a", "b")]
    differ = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(differ <= total - 2 * least)
    return met.where(F.size(F.array_intersect(*cut)) >= matches).select("a", "b").distinct()


def _index(classes: DataFrame, percent: int) -> DataFrame:
    """key, size, cls, n, pos: the indexed prefixes of the classes under (shingle, size band), where a key has two or more."""
    each = classes.where("base > 0").select("cls", "n", F.posexplode(F.slice("prefix", F.lit(1), F.col("base"))).alias("pos", "token"))
    n = classes.agg(F.coalesce(F.sum("base"), F.lit(0))).first()[0]
    often = written(each.groupBy("token").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").select("token"), "jaccard-tokens", n)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * 1.0001)).cast("int")
    shared = each.join(often, "token", "left_semi").withColumn("band", F.explode(F.array(band, band + 1)))
    shared = written(shared.select(F.xxhash64("token", "band").alias("key"), "cls", "n", "pos"), "jaccard-shared", 2 * n)
    keys = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    index = written(shared.join(keys, "key"), "jaccard-index", shared.count())
    drop_table(often, shared)
    return index


def _open(index: DataFrame, root: DataFrame) -> DataFrame:
    """Index rows, with root and main (the largest component of their key), of the keys with several components."""
    state = index.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    groups = state.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    keys = groups.groupBy("key").agg(F.max_by("root", F.struct(F.col("m"), -F.col("root"))).alias("main"), F.count(F.lit(1)).alias("several"))
    return written(state.join(keys.where("several > 1").select("key", "main"), "key"), "jaccard-open", index.count())


def _wave_pairs(rows: DataFrame, wave: int, percent: int) -> DataFrame:
    """Pairs of different components: of the index rows with the pivots of their key in this wave.

    At first one class of the main component, the least, which is the same for all keys of a group; then those whose hash
    is below a share of the key's classes that grows from wave to wave and wasn't below it before.
    """
    fields = ("cls", "n", "pos", "root")
    if not wave:
        main = F.col("root") == F.col("main")
        pivots = rows.where(main).groupBy("key").agg(F.min(F.struct(*fields)).alias("p"))
    else:
        u = F.shiftrightunsigned(F.xxhash64("cls", F.lit("pivot")), 1).cast("double") / F.lit(float(1 << 63))
        below, before = (u * F.col("size") < F.lit(float(WIDER**w)) for w in (wave, wave - 1))
        rows = rows if wave == 1 else rows.where(~before)  # former pivots have met all
        pivots = rows.where(below).select("key", F.struct(*fields).alias("p"))
    met = rows.select("key", *fields).join(pivots, "key")
    met = met.where((F.col("p.root") != F.col("root")) & _may_link(*({c: F.col(p + c) for c in ("n", "pos")} for p in ("p.", "")), percent))
    return met.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct()


def _one_node(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that have one doc_id and different sets."""
    twice = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y")
    of = rows.where("n > 0").select("doc_id", "h1", "h2", "n").join(twice.select("doc_id"), "doc_id", "left_semi")
    return of.join(classes.select("h1", "h2", "n", "cls"), ["h1", "h2", "n"]).select(F.least("doc_id", "cls").alias("a"), F.greatest("doc_id", "cls").alias("b")).where("a <> b")


def _waves(docs: DataFrame, classes: DataFrame, links: DataFrame, k: int, percent: int) -> DataFrame:
    """cls, root for the classes that have links."""
    index, wave = _index(classes, percent), 0
    root = components(links).withColumnRenamed("node", "cls")
    while True:
        rows = _open(index, root)
        drop_table(index)
        n = rows.count()
        if not n:
            drop_table(rows, links)
            return root
        # the last join reads all classes, so it keeps its tasks; only the pairs go to few
        likely = _shares(_wave_pairs(rows, wave, percent), classes, percent).repartition(1 + n // ROWS_A_TASK)
        likely = written(likely, "jaccard-pairs")
        if not likely.isEmpty():
            links, old = _with_links(links, likely, docs, k, percent), links
            root, old_root = components(links).withColumnRenamed("node", "cls"), root
            drop_table(old, old_root)
        drop_table(likely)
        # all pairs of a key have met once its share of pivots is whole
        index = rows.select("key", "cls", "n", "pos", "size").where(F.col("size") > (WIDER**wave if wave else 0))
        wave += 1


def links_and_components(docs: DataFrame, k: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n, h1, h2; classes: h1, h2, n, n_rows, cls, root) of docs(doc_id, text)."""
    rows = written(_prefixes(docs, shingle_counts(docs, k), k, percent), "jaccard-rows")
    full = rows.where("n > 0").groupBy("h1", "h2", "n").agg(
        F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("n_rows"), *(F.first(c).alias(c) for c in ("matches", "base", "prefix", "parity"))
    )
    n = rows.count()
    classes = written(full, "jaccard-classes", 8 * n)  # eight times as long rows as others
    slim = written(rows.select("doc_id", "n", "h1", "h2"), "jaccard-slim", n)
    drop_table(rows)
    known = classes.where("cls IS NOT NULL")
    root = _waves(docs, known, written(_one_node(slim, known), "jaccard-all", n), k, percent)
    table = classes.select("h1", "h2", "n", "n_rows", "cls").join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    table = written(table, "jaccard-roots", n)
    drop_table(classes, root)
    return slim, table


def joined(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    rows, classes = links_and_components(docs, k, percent)
    full = lookup(rows.where("n > 0"), ["h1", "h2", "n"], classes.select("h1", "h2", "n", "n_rows", "root"), rows.count())
    empty = rows.where("n = 0").withColumn("root", F.col("doc_id"))
    every = full.select("doc_id", "n", "root").unionByName(empty.select("doc_id", "n", "root"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each component; documents of null doc_id all stay, and of
    rows of one doc_id each different text."""
    part = joined(docs, k, percent)
    kept = written(part.where("doc_id = component_id").select("doc_id").distinct(), "jaccard-kept", part.count())
    own = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return own.unionByName(docs.where("doc_id IS NULL")).select(*(F.col(f"`{c}`") for c in docs.columns))
