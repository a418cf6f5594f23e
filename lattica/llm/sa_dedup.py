"""Suffix-array deduplication: bytes covered by a string of `length` bytes that also starts anywhere else are removed.

A suffix array of the whole corpus isn't built at once. Every window of `length` bytes has an anchor: of the k-grams in it
(k = length / 2) the one of the least hash, leftmost among equals. Equal windows have equal anchors at the same place, so
they meet in the group of that anchor; an anchor is chosen about once in length / 4 bytes. Anchors that occur once are
dropped. Of the others, each occurrence is a region: the windows it is the anchor of. Equal regions form a class; a class
of two or more repeats whole. Classes of the same anchor that differ are sorted together: two-stage suffix sorting
(suffix_sort), then adjacent common prefixes of `length` bytes or more.

A group is sorted in one task, so groups of over GROUP_CLASSES classes are split first: each region into the windows that
have more and those that have fewer bytes before the anchor. All windows of a half hold more bytes around the anchor in
common; these bytes are the half's new group. Equal windows stay together, equal halves are a class again, and a group
that is still large is split again; after log2(length / 2) times a group has one class. All groups go the same way.

Anchors, regions and texts are told apart by 64-bit hashes: anchors only bring regions together, whose bytes are compared;
regions are equal if anchor and hash are.

Defined results: null text counts as empty; texts under `length` bytes lose nothing; strings are judged on the input, and
overlaps count; rows that repeat a document, whatever their doc_id, repeat each other; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lattica.llm.kernels import U, column_bytes, mix, slices
from lattica.llm.shared import in_bitmap, lookup, low_bits_bitmap, trimmed, written
from lattica.llm.suffix_sort import repeated_windows

LENGTH, GROUP_CLASSES = 400, 256
#: Bytes that are cut into windows, or sorted, at a time (a longer text is cut in parts that overlap), and of a sorting task.
PART, SORT_BYTES, TASK_BYTES = 1 << 21, 1 << 20, 4 << 20
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_PLACE = 24
_CODE = mix((np.arange(256, dtype=U) + U(1)) * U(0xD1B54A32D192ED03))
_BASE = 0x9E3779B97F4A7C15
_steps: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes at every place (polynomial, modulo 2**64); it only chooses anchors and brings regions together."""
    n = len(data) + 1
    if len(_steps[0]) < n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _steps[i] = np.cumprod(np.concatenate([np.ones(1, U), np.full((1 << (n - 1).bit_length()) - 1, x, U)]), dtype=U)
    sums = np.zeros(n, U)
    np.cumsum(_CODE[data] * _steps[0][: n - 1], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _steps[1][: n - k])


def regions(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor's hash, its place, first and last window) of all regions; places within the texts."""
    for a, b in slices(offsets, PART):
        if b - a == 1 and offsets[b] - offsets[a] > PART:
            size = int(offsets[b] - offsets[a])
            for s in range(0, size - length + 1, PART):
                e = min(size, s + PART + length - 1)
                part = data[offsets[a] + s : offsets[a] + e]
                yield _regions(part, np.array([0, e - s]), length, a, s)
        else:
            yield _regions(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, a, 0)


def _regions(data: np.ndarray, offsets: np.ndarray, length: int, text: int, shift: int) -> tuple[np.ndarray, ...]:
    k = length // 2
    wide = length - k + 1  # k-grams in a window
    n = len(data)
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    if n < length or not (size >= length).any():
        return none, none.astype(U), none, none, none
    gram = grams(data, k)
    key = (gram >> U(_PLACE) << U(_PLACE)) | np.arange(len(gram), dtype=U)
    # the least of each `wide` keys in a row: of blocks, the least from the left and from the right
    blocks = -(-len(key) // wide) + 1
    full = np.full(blocks * wide, ~U(0), U)
    full[: len(key)] = key
    full = full.reshape(blocks, wide)
    left = np.minimum.accumulate(full, axis=1).reshape(-1)
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = len(key) - wide + 1
    least = np.minimum(right[:windows], left[wide - 1 : wide - 1 + windows])
    # windows within one text
    room = np.repeat(offsets[1:], size)
    start = np.flatnonzero(np.arange(windows) + length <= room[:windows])
    anchor = (least[start] & U((1 << _PLACE) - 1)).astype(np.int64)
    of = np.searchsorted(offsets, start, "right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    first, last = start[head], start[np.append(head[1:], len(start)) - 1]
    anchor, of = anchor[head], of[head]
    at = offsets[of] - shift
    return of + text, gram[anchor], anchor - at, first - at, last - at


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw = memoryview(np.ascontiguousarray(data))
    return np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())), U, len(start)).view(np.int64)


def _text_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return _hashes(data, offsets[:-1], offsets[1:])


def _own_id(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(-(1 << 63)).cast(pa.int64()))


def repeated_anchors(docs: DataFrame, length: int) -> DataFrame:
    """Hashes of the anchors that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in regions(*column_bytes(batch.column("text")), length):
                yield pa.RecordBatch.from_arrays([pa.array(found[1].view(np.int64))], names=["anchor"])

    anchors = docs.select("text").mapInArrow(trimmed(run), "anchor long")
    return written(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "sa-anchors")


def occurrences(docs: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """The regions of repeated anchors (and of few others): anchor, region, own (doc_id), th (hash of the text), place, first, last."""
    bits, words = low_bits_bitmap(anchors, "anchor")
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            own, th = _own_id(batch.column("doc_id")), _text_hash(data, offsets)
            for found in regions(data, offsets, length):
                keep = in_bitmap(shared.value, found[1] & U((1 << bits) - 1))
                text, anchor, place, first, last = (x[keep] for x in found)
                at = offsets[text]
                # the same bytes around the anchor at the same place
                content = _hashes(data, at + first, at + last + length) ^ mix((place - first).astype(U)).view(np.int64)
                values = (anchor.view(np.int64), content, own[text], th[text], place, first, last)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64()] * 4 + [pa.int32()] * 3)], names=["anchor", "region", "own", "th", "place", "first", "last"])

    found = _slim(docs).mapInArrow(trimmed(run), "anchor long, region long, own long, th long, place int, first int, last int")
    return written(found, "sa-occurrences")


def _texts(docs: DataFrame, of: DataFrame) -> DataFrame:
    """own, th, data of the texts whose hash is in `of` (and of few others)."""
    bits, words = low_bits_bitmap(of, "th")
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            th = _text_hash(data, offsets)
            keep = pa.array(in_bitmap(shared.value, th.view(U) & U((1 << bits) - 1)))
            columns = [pa.array(_own_id(batch.column("doc_id"))), pa.array(th), batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["own", "th", "data"]).filter(keep)

    return _slim(docs.where("text IS NOT NULL")).mapInArrow(trimmed(run), "own long, th long, data binary")


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """anchor, region, shift, data: the bytes of one region of each wanted class, and the anchor's place in them."""
    lists = wanted.groupBy("own", "th").agg(F.collect_list(F.struct("anchor", "region", "place", "first", "last")).alias("regions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("data"))
            for i, found in enumerate(batch.column("regions").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                bytes_ = [text[r["first"] : r["last"] + length].tobytes() for r in found]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([r[c] for r in found], pa.int64()) for c in ("anchor", "region")), pa.array([r["place"] - r["first"] for r in found], pa.int32()), pa.array(bytes_, pa.binary())],
                    names=["anchor", "region", "shift", "data"],
                )

    joined = texts.join(lists, ["own", "th"]).dropDuplicates(["own", "th"]).select("data", "regions")
    return joined.mapInArrow(trimmed(run), _PIECES)


def _spans(flags: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the flagged windows."""
    at = np.flatnonzero(flags)
    if not len(at):
        return [], []
    cut = np.flatnonzero(at[1:] > at[:-1] + length)
    return at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + length).tolist()


_PIECES = "anchor long, region long, shift int, data binary"
_SPANS = "anchor long, region long, starts array<int>, ends array<int>"


def _spans_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["anchor", "region", "starts", "ends"])


def _sorted_groups(cut: DataFrame, length: int, tasks: int) -> DataFrame:
    """Spans, relative to the anchor, of windows that repeat in another region of the same anchor, by suffix sorting."""

    def solve(group: list[tuple[int, int, int, bytes]]) -> list[tuple]:
        data = np.frombuffer(b"".join(g[3] for g in group), np.uint8)
        ends = np.cumsum([len(g[3]) for g in group])
        valid = np.ones(len(data), bool)
        for e in ends.tolist():
            valid[e - length + 1 : e] = False
        flags = repeated_windows(data, valid, length)
        rows = []
        for (anchor, region, shift, d), e in zip(group, ends.tolist()):
            s, t = _spans(flags[e - len(d) : e], length)
            if s:
                rows.append((anchor, region, [x - shift for x in s], [x - shift for x in t]))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("anchor", "region", "shift", "data"))
            for anchor, region, shift, data in zip(*columns):
                if size >= SORT_BYTES and anchor != group[-1][0]:
                    yield _spans_batch(solve(group))
                    group, size = [], 0
                group.append((anchor, region, shift, data))
                size += len(data)
        if group:
            yield _spans_batch(solve(group))

    return cut.repartition(tasks, "anchor").sortWithinPartitions("anchor", "region").mapInArrow(trimmed(run), _SPANS)


def _halves(pieces: DataFrame, length: int) -> DataFrame:
    """anchor, region, sub, piece, shift, data, low, high: of pieces whose windows have low to high bytes before the anchor,
    those with fewer and those with more; sub is the hash of what all windows of such a half have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.uint64(), pa.uint64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
        for batch in batches:
            rows: list[tuple] = []
            for anchor, region, shift, data, low, high in zip(*(batch.column(c).to_pylist() for c in ("anchor", "region", "shift", "data", "low", "high"))):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    # windows with a to b bytes before the anchor, of those that the piece has
                    first, last = max(shift - b, 0), min(shift - a, len(data) - length)
                    if first > last:
                        continue
                    common, own = data[shift - a : shift - b + length], data[first : last + length]
                    seed = (anchor ^ a) & (1 << 64) - 1
                    rows.append((anchor, region, xxh3_64_intdigest(common, seed), xxh3_64_intdigest(own, shift - first), shift - first, own, a, b))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            columns[2:4] = [c.view(pa.int64()) for c in columns[2:4]]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "region", "sub", "piece", "shift", "data", "low", "high"])

    return pieces.mapInArrow(trimmed(run), "anchor long, region long, sub long, piece long, shift int, data binary, low int, high int")


def _joined_spans(spans: DataFrame) -> DataFrame:
    return spans.groupBy("anchor", "region").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")))


def _several(classes: DataFrame, cut: Callable[[DataFrame], DataFrame], length: int, most: int) -> DataFrame:
    """Spans, relative to the anchor, of windows that repeat in another class of the same anchor; a class may have two rows.

    classes: anchor, region, low, high and what cut needs to give anchor, region, shift and data of classes.
    """
    total = classes.count()
    groups = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_rows"), F.first("low").alias("low"), F.first("high").alias("high")).where("n_rows > 1")
    groups = written(groups.withColumn("large", (F.col("n_rows") > most) & (F.col("low") < F.col("high"))), "sa-groups", total)
    wanted = written(lookup(classes.drop("low", "high"), ["anchor"], groups.select("anchor", "n_rows"), total, "inner"), "sa-wanted", total)
    pieces = written(cut(wanted), "sa-cut")
    n, size = pieces.agg(F.count(F.lit(1)), F.sum(F.octet_length("data"))).first()
    tasks = min(50_000, 1 + (size or 0) // TASK_BYTES)
    if groups.where("large").isEmpty():
        return written(_sorted_groups(pieces, length, tasks), "sa-spans")
    pieces = lookup(pieces, ["anchor"], groups, n, "inner")
    spans = written(_sorted_groups(pieces.where("NOT large").select("anchor", "region", "shift", "data"), length, tasks), "sa-spans")
    halves = written(_halves(pieces.where("large"), length), "sa-halves")
    parts = halves.groupBy(F.col("sub").alias("anchor"), F.col("piece").alias("region")).agg(
        F.count(F.lit(1)).alias("n_rows"), *(F.first(c).alias(c) for c in ("shift", "low", "high", "data"))
    )
    parts = written(parts, "sa-classes")
    again = parts.where("n_rows > 1")
    whole = again.select("anchor", "region", F.array(-F.col("shift")).alias("starts"), F.array(F.octet_length("data") - F.col("shift")).alias("ends"))
    more = _several(parts.select("anchor", "region", "low", "high", "shift", "data"), lambda w: w.select("anchor", "region", "shift", "data"), length, most)
    single = _joined_spans(more).join(parts.where("n_rows = 1").select("anchor", "region"), ["anchor", "region"])
    found = whole.unionByName(single).join(parts.select("anchor", "region", "n_rows"), ["anchor", "region"])
    table = written(found.withColumnsRenamed({"anchor": "sub", "region": "piece"}), "sa-table")
    back = lookup(halves.select("anchor", "region", "sub", "piece"), ["sub", "piece"], table, halves.count(), "inner")
    return written(spans.unionByName(back.select("anchor", "region", "starts", "ends")), "sa-spans")


def repeated_spans(docs: DataFrame, length: int = LENGTH, most: int = GROUP_CLASSES) -> DataFrame:
    """own, th, s, e: byte spans to remove, by text; they may overlap."""
    found = occurrences(docs, repeated_anchors(docs, length), length)
    classes = found.groupBy("anchor", "region").agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.struct("own", "th", "place", "first", "last")).alias("r"))
    classes = written(classes, "sa-classes")
    several = _several(
        classes.select("anchor", "region", F.lit(0).alias("low"), F.lit(length - length // 2).alias("high"), "r.*"),
        lambda wanted: _cut(_texts(docs, wanted.select("th").distinct()), wanted, length),
        length,
        most,
    )
    whole = classes.where("n_rows > 1").select(
        "anchor", "region", F.array(F.col("r.first") - F.col("r.place")).alias("starts"), F.array(F.col("r.last") - F.col("r.place") + length).alias("ends"), "n_rows"
    )
    single = _joined_spans(several).join(classes.where("n_rows = 1").select("anchor", "region", "n_rows"), ["anchor", "region"])
    table = written(whole.unionByName(single), "sa-table", classes.count())
    hit = lookup(found.select("anchor", "region", "own", "th", "place"), ["anchor", "region"], table, found.count(), "inner")
    return hit.select("own", "th", "place", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select(
        "own", "th", (F.col("place") + F.col("x.starts")).alias("s"), (F.col("place") + F.col("x.ends")).alias("e")
    )


def deduplicated(docs: DataFrame, length: int = LENGTH, most: int = GROUP_CLASSES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes' digest of each document."""
    spans = written(
        repeated_spans(docs, length, most).groupBy("own", "th").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans")), "sa-removed"
    )
    bits, words = low_bits_bitmap(spans.select("th").distinct(), "th")
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            th = _text_hash(data, offsets)
            hit = in_bitmap(shared.value, th.view(U) & U((1 << bits) - 1))
            raw = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(_own_id(batch.column("doc_id"))), pa.array(th), pa.array(np.diff(offsets)),
                    pa.array([None if h else hashlib.sha256(r).hexdigest() for r, h in zip(raw, hit)], pa.string()),
                    pa.array([r if h else None for r, h in zip(raw, hit)], pa.binary()),
                ],
                names=["doc_id", "own", "th", "n_bytes", "sha", "data"],
            )

    rows = _slim(docs).mapInArrow(trimmed(split), "doc_id long, own long, th long, n_bytes long, sha string, data binary")
    done = rows.join(spans, ["own", "th"], "left").select("doc_id", "n_bytes", "sha", "data", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("data"))
            removed, n_spans, sha = [], [], batch.column("sha").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if sha[i] is not None:
                    removed.append(0)
                    n_spans.append(0)
                    continue
                text, kept, end, out, n = data[offsets[i] : offsets[i + 1]], [], 0, 0, 0
                for x in spans or []:
                    if x["s"] > end or not n:
                        kept.append(text[end : x["s"]])
                        n += 1
                    out += max(0, x["e"] - max(end, x["s"]))
                    end = max(end, x["e"])
                kept.append(text[end:])
                removed.append(out)
                n_spans.append(n)
                sha[i] = hashlib.sha256(b"".join(k.tobytes() for k in kept)).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return done.mapInArrow(trimmed(remove), SCHEMA)
