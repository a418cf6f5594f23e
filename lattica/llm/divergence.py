"""Source divergence audit: how far each source's use of terms is from every other source's, and from its language's.

A group is a source within a language. Its counts become a vector of probabilities in billionths over the language's kept terms,
cut into blocks of terms and compressed: of each block, only the terms that the group has, the rest share one value. Groups stay in their partition
(a cached table, dealt by language, block and seat), and the peers' vectors come to them in the rounds of a round-robin tournament, in which each
two seats of a language meet once: in round r seats i and j meet if i + j = r modulo the number of seats less one. A meeting
counts for both directions, since the divergence is symmetric. A wave of some rounds is a join on the seat to visit, so what travels at a
time is bounded and the residents are never shuffled again. A language's own vector visits every group last; there a heap per block keeps
the terms that stand out most, and only those are ranked across blocks.

All arithmetic is exact: 64-bit integers, and Python's where a product would exceed them.

Defined results: null text, lang and source count as ''; texts without terms make their group occur all the same; repeated rows and repeated ids
count as documents of their own; a language that keeps no terms has pairs of value 0 and no terms; a language of one source has no pairs;
ties go to the item first in UTF-8; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.shared import drop_table, trimmed, written

#: Terms are kept that so many documents of a language have; those that a group's report names.
DOCUMENTS, TOP = 10, 10
BILLION = 1_000_000_000
#: Terms of a block, about; rounds of a wave.
BLOCK_TERMS, WAVE = 16_384, 32
#: Counts that a task holds before it passes them on; bytes of a text that are cut into terms at once.
HELD, PIECE = 150_000, 1 << 20
#: Bytes of terms as they count (A-Z as a-z); all others are spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _terms(text: bytes) -> Counter:
    """The terms of a text with their counts; cut at spaces, so that a long text isn't a list of all its terms."""
    text, found, at = text.translate(_FOLD), Counter(), 0
    while len(text) - at > PIECE:
        to = text.find(b" ", at + PIECE)
        if to < 0:
            break
        found.update(text[at:to].split())
        at = to
    found.update(text[at:].split())
    return found


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs; a row of term null for each group."""
    schema = "lang string, source string, term string, n long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed_on() -> pa.RecordBatch:
            rows = [(lang, source, term, n, held[lang, source][term]) for (lang, source), terms in sums.items() for term, n in terms.items()]
            rows += [(lang, source, None, 0, 0) for lang, source in sums]
            columns = [pa.array(list(c), pa.binary() if i == 2 else pa.int64() if i > 2 else pa.string()) for i, c in enumerate(zip(*rows))]
            columns[2] = columns[2].cast(pa.string())
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        sums: dict[tuple[str, str], Counter] = {}
        held: dict[tuple[str, str], Counter] = {}
        size = 0
        for batch in batches:
            texts = batch.column("text")
            for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                found = _terms((texts[i].as_py() or "").encode())
                n, d = sums.setdefault(group, Counter()), held.setdefault(group, Counter())
                size -= len(n)
                n.update(found)
                d.update(found.keys())
                size += len(n)
                if size > HELD:
                    yield passed_on()
                    sums, held, size = {}, {}, 0
        if sums:
            yield passed_on()

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = docs.select(name("text"), name("lang"), name("source")).mapInArrow(trimmed(run), schema)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _dictionary(counts: DataFrame, least: int, block_terms: int) -> tuple[DataFrame, DataFrame]:
    """(lang, term, block, idx, total), by UTF-8 within a block; (lang, kept, words, blocks), a row for each language."""
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = written(kept, "audit-kept")
    langs = counts.where("term IS NULL").select("lang").distinct()
    of = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("words"))
    zero = F.lit(0).cast("long")
    of = langs.join(of, "lang", "left").select("lang", F.coalesce("kept", zero).alias("kept"), F.coalesce("words", zero).alias("words"))
    of = written(of.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / block_terms)).cast("int")), "audit-langs")
    blocked = kept.join(of.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    idx = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    return written(blocked.select("lang", "term", "block", idx.alias("idx"), "total"), "audit-terms"), of


def _seats(counts: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, seat: the groups of a language numbered, one number for each."""
    groups = counts.where("term IS NULL").select("lang", "source")
    seat = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return written(groups.withColumn("seat", seat), "audit-seats")


def probabilities(count: np.ndarray, words: int, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (words + 2 * kept)), exactly."""
    if int(count.max(initial=0)) + 2 > (2**63 - 1) // BILLION:
        return np.array([1 + BILLION * (int(c) + 2) // (words + 2 * kept) for c in count.tolist()], np.int64)
    return 1 + BILLION * (count + 2) // np.int64(words + 2 * kept)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); both are at most 1 + 10**9, so the square fits."""
    return (p - q) ** 2 // (p + q)


def _packed(idx: np.ndarray, p: np.ndarray) -> bytes:
    """Ascending places as differences, and probabilities, compressed."""
    return zlib.compress(np.diff(idx, prepend=0).astype("<i4").tobytes() + p.astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<i4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _vectors(of: DataFrame, width: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, size (the block's terms), other (what terms that aren't there have), data: compressed vectors.

    of: keys, words, kept, lang, block, terms (the block's list of idx and count, null for none).
    """
    names = [*keys, "block", "size", "other", "data"]
    schema = ", ".join([*(f"{k} {'int' if k == 'seat' else 'string'}" for k in keys), "block int, size int, other long, data binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other, data = [], []
            for i in range(len(batch)):
                words, kept, terms = (batch.column(c)[i] for c in ("words", "kept", "terms"))
                words, kept = words.as_py(), kept.as_py()
                rows = terms.values if terms.is_valid else None
                idx, n = (np.zeros(0, np.int64),) * 2 if rows is None else (rows.field(c).to_numpy().astype(np.int64) for c in ("idx", "n"))
                other.append(int(probabilities(np.zeros(1, np.int64), words, kept)[0]) if kept else 1)
                data.append(_packed(idx, probabilities(n, words, kept)))
            columns = [*(batch.column(k) for k in (*keys, "block", "size")), pa.array(other, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return of.join(width, ["lang", "block"], "left").withColumn("size", F.coalesce("size", F.lit(0))).mapInArrow(trimmed(run), schema)


def _dense(size: int, other: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of all the block's terms, places of those that are there)."""
    out = np.full(size, other, np.int64)
    idx, p = _unpacked(data)
    out[idx] = p
    return out, idx


def _met(joined: DataFrame) -> DataFrame:
    """lang, seat, peer, value for what each pair of blocks adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("size", "other", "data", "peer_other", "peer_data")))
            value = [int(divergence(_dense(size, o, d)[0], _dense(size, p, e)[0]).sum()) for size, o, d, p, e in rows]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("seat"), batch.column("peer"), pa.array(value, pa.int64())], names=["lang", "seat", "peer", "value"])

    return joined.mapInArrow(trimmed(run), "lang string, seat int, peer int, value long")


def meets(seat: Column, round_: Column, seats: Column) -> Column:
    """Whom a seat meets in a round, of an even number of seats: with one less, i + j = round modulo that; who would meet
    itself meets the last seat."""
    m = seats - 1
    ring = F.pmod(round_ - seat, m)
    fixed = F.pmod(round_ * F.expr("seats div 2"), m)  # the seat i with 2 * i = round
    return F.when(seat == m, fixed).when(ring == seat, m).otherwise(ring).cast("int")


def _pairs(residents: DataFrame, peers: DataFrame, sizes: DataFrame, tasks: int, wave: int) -> DataFrame | None:
    """lang, seat, peer, value of each two seats, once."""
    most = sizes.agg(F.max("seats")).first()[0] or 0
    found = []
    for first in range(0, most - 1, wave):
        rounds = F.sequence(F.lit(first), F.least(F.lit(first + wave), F.col("seats") - 1) - 1)
        some = peers.join(sizes, "lang").where(F.col("seats") - 1 > first).withColumn("round", F.explode(rounds))
        some = some.withColumn("host", meets(F.col("seat"), F.col("round"), F.col("seats")))
        # one of the two travels, the greater in half of the meetings
        travels = (F.col("seat") > F.col("host")) == ((F.col("seat") + F.col("host")) % 2 == 0)
        some = some.where(travels).select("lang", "block", F.col("host").alias("seat"), F.col("seat").alias("peer"), F.col("other").alias("peer_other"), F.col("data").alias("peer_data"))
        met = _met(some.repartition(tasks, "lang", "block", "seat").join(residents.hint("shuffle_hash"), ["lang", "block", "seat"]).select("lang", "seat", "peer", "size", "other", "data", "peer_other", "peer_data"))
        found.append(written(met.groupBy("lang", "seat", "peer").agg(F.sum("value").alias("value")), "audit-wave"))
    if not found:
        return None
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def _standing_out(residents: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    """lang, seat, block, idx, value: of each block the `top` terms that a group has more of than its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, (size, o, d, p, e) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("size", "other", "data", "lang_other", "lang_data")))):
                own, idx = _dense(size, o, d)
                all_, _ = _dense(size, p, e)
                idx = idx[own[idx] > all_[idx]]
                f = divergence(own[idx], all_[idx])
                if len(f) > top:  # those of the top-th value and more, of which the first are kept
                    some = f >= np.partition(f, len(f) - top)[len(f) - top]
                    idx, f = idx[some], f[some]
                best = np.lexsort((idx, -f))[:top]
                out.append((np.full(len(best), at), idx[best], f[best]))
            at, idx, f = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
            rows = pa.array(at, pa.int32())
            columns = [*(batch.column(c).take(rows) for c in ("lang", "seat", "block")), pa.array(idx, pa.int32()), pa.array(f, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "seat", "block", "idx", "value"])

    visit = langs.select("lang", "block", F.col("other").alias("lang_other"), F.col("data").alias("lang_data"))
    met = residents.join(visit, ["lang", "block"]).select("lang", "seat", "block", "size", "other", "data", "lang_other", "lang_data")
    return met.mapInArrow(trimmed(run), "lang string, seat int, block int, idx int, value long")


def audit(docs: DataFrame, least: int = DOCUMENTS, top: int = TOP, block_terms: int = BLOCK_TERMS, wave: int = WAVE) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank: a group's peers, and its terms, by divergence."""
    spark = docs.sparkSession
    counts = written(counted(docs), "audit-counts")
    terms, langs = _dictionary(counts, least, block_terms)
    seats = _seats(counts, langs)
    width = written(terms.groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("size")), "audit-width")
    blocks = langs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "block", "kept")

    own = counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(terms.select("lang", "term", "block", "idx"), ["lang", "term"])
    listed = own.groupBy("lang", "source", "block").agg(F.sum("n").alias("part"), F.sort_array(F.collect_list(F.struct("idx", "n"))).alias("terms"))
    listed = written(listed.join(seats, ["lang", "source"]).drop("source"), "audit-lists")
    words = listed.groupBy("lang", "seat").agg(F.sum("part").alias("words"))
    # each group has a row for each block of its language, with or without terms
    places = seats.select("lang", "seat").join(words, ["lang", "seat"], "left").withColumn("words", F.coalesce("words", F.lit(0).cast("long"))).join(blocks, "lang")
    vectors = written(_vectors(places.join(listed.select("lang", "seat", "block", "terms"), ["lang", "seat", "block"], "left"), width, ["lang", "seat"]), "audit-vectors")
    drop_table(listed)
    all_ = terms.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("total").alias("n")))).alias("terms"))
    all_ = langs.select("lang", "words").join(blocks, "lang").join(all_, ["lang", "block"], "left")
    whole = written(_vectors(all_, width, ["lang"]), "audit-languages")

    # an even number of seats: where it is odd, the last meets nobody
    sizes = seats.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("lang", (F.col("groups") + F.col("groups") % 2).cast("int").alias("seats"))
    sizes = written(sizes, "audit-sizes")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    residents = vectors.repartition(tasks, "lang", "block", "seat").persist(StorageLevel.DISK_ONLY)
    met = _pairs(residents, vectors, sizes, tasks, wave)
    heaps = written(_standing_out(residents, whole, top), "audit-heaps")
    residents.unpersist()

    name = lambda seat: seats.select("lang", F.col("seat").alias(seat), F.col("source").alias("source" if seat == "seat" else "item"))
    in_group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(in_group))
    named = heaps.join(terms.select("lang", "block", "idx", F.col("term").alias("item")), ["lang", "block", "idx"]).join(name("seat"), ["lang", "seat"])
    out = ranked(named).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    if met is not None:
        both = met.unionByName(met.select("lang", F.col("peer").alias("seat"), F.col("seat").alias("peer"), "value"))
        both = both.join(name("seat"), ["lang", "seat"]).join(name("peer"), ["lang", "peer"])
        out = ranked(both).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(out)
    return out
