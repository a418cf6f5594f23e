"""Token ids in binary shards of patched frame-of-reference blocks.

A block of 1,024 ids is stored as its minimum, and the differences packed at the width of their 95th percentile; a
difference that doesn't fit is an exception, kept with its position in a list. The starts of the blocks, and ids and
starts of the documents, are indexed, so any document's ids can be read without unpacking the rest of the shard.

File: 8 bytes LPFOR001; then as little-endian numbers: n_docs, n_ids, n_blocks (u64); doc ids (i64), null flags (u8),
starts (u64, n_docs + 1); block starts in the body (u64, n_blocks + 1); the body. A block: minimum (u32), width (u8),
number of exceptions (u16), packed differences (low bits; 1,024 of them, the last block filled with zeros), exceptions'
positions (u16) and differences (u32).

Defined results: null text counts as empty and has the end id alone; documents of null id come first; those of equal id
follow one another by their ids' bytes; an empty table gives no shards; extra columns are ignored.

Each range of doc_id is sorted in one task, by Spark, and streams into files of bounded size: a worker never holds more
than a file's ids, however many documents have one id.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.bpe import TextEncoder, spread
from lattica.llm.files import open_file, write_file
from lattica.llm.kernels import Words, column_bytes, slices, span_keys
from lattica.llm.shared import new_folder, trimmed, written

MAGIC, BLOCK, PERCENTILE = b"LPFOR001", 1024, 95
#: Documents of a range of doc_id at least, ranges at most (the driver reads a row for each), and ids of a shard's file: it
#: ends with the document that reaches them.
RANGE_DOCS, MOST_RANGES, SHARD_IDS = 10_000, 10_000, 1 << 22
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
_MANIFEST = "shard int, part int, path string, n_docs long, n_ids long"


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """(block starts in the body, with its end; body) of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(1, np.uint64), b""
    full = np.full(blocks * BLOCK, ids[-1], np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1)
    diff = full - least[:, None]
    diff.reshape(-1)[n:] = 0
    level = np.percentile(diff, percentile, axis=1, method="higher").astype(np.uint64)
    width = np.ceil(np.log2(level + np.uint64(1))).astype(np.int64)
    over = diff.astype(np.uint64) >> width.astype(np.uint64)[:, None] > 0
    exceptions = over.sum(axis=1)
    size = 7 + width * (BLOCK // 8) + 6 * exceptions
    starts = np.concatenate([[0], np.cumsum(size)])
    body = np.zeros(starts[-1], np.uint8)
    head = np.zeros(blocks, np.dtype([("least", "<u4"), ("width", "u1"), ("n", "<u2")]))
    head["least"], head["width"], head["n"] = least, width, exceptions
    body[starts[:-1, None] + np.arange(7)] = head.view(np.uint8).reshape(blocks, 7)
    for w, of in _by_width(width):
        # the low w bits of each difference, from its four bytes
        bits = np.unpackbits(np.ascontiguousarray(diff[of]).view(np.uint8).reshape(len(of), BLOCK, 4), axis=2, bitorder="little")
        packed = np.packbits(bits[:, :, :w].reshape(len(of), -1), axis=1, bitorder="little")
        body[starts[of, None] + 7 + np.arange(packed.shape[1])] = packed
    which, position = np.nonzero(over)
    if len(which):
        rank = np.arange(len(which)) - np.concatenate([[0], np.cumsum(exceptions)])[which]
        at = starts[which] + 7 + width[which] * (BLOCK // 8)
        body[(at + 2 * rank)[:, None] + np.arange(2)] = position.astype("<u2").view(np.uint8).reshape(-1, 2)
        body[(at + 2 * exceptions[which] + 4 * rank)[:, None] + np.arange(4)] = diff[over].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts.astype(np.uint64), body.tobytes()


def _by_width(width: np.ndarray, most: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(width, some blocks of that width), so that the bits of few blocks at a time are laid out."""
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        for i in range(0, len(of), most):
            yield w, of[i : i + most]


def unpack(starts: np.ndarray, body: np.ndarray, n: int) -> np.ndarray:
    """The ids of consecutive blocks; starts: of the blocks and of the end, relative to body."""
    blocks = len(starts) - 1
    if blocks <= 0:
        return np.zeros(0, np.uint32)
    starts = starts.astype(np.int64)
    head = np.ascontiguousarray(body[starts[:-1, None] + np.arange(7)]).view(np.dtype([("least", "<u4"), ("width", "u1"), ("n", "<u2")])).reshape(-1)
    width, exceptions = head["width"].astype(np.int64), head["n"].astype(np.int64)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for w, of in _by_width(width):
        packed = body[starts[of, None] + 7 + np.arange(w * (BLOCK // 8))]
        bits = np.zeros((len(of), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(of), BLOCK, w)
        out[of] = np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(of), BLOCK)
    which = np.repeat(np.arange(blocks), exceptions)
    if len(which):
        rank = np.arange(len(which)) - np.concatenate([[0], np.cumsum(exceptions)])[which]
        at = starts[which] + 7 + width[which] * (BLOCK // 8)
        position = np.ascontiguousarray(body[(at + 2 * rank)[:, None] + np.arange(2)]).view("<u2").reshape(-1)
        out[which, position] = np.ascontiguousarray(body[(at + 2 * exceptions[which] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    return (out + head["least"][:, None]).reshape(-1)[:n]


def shard_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    starts, body = pack(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    at = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    counts = np.array([len(doc_ids), len(ids), len(starts) - 1], "<u8")
    return b"".join([MAGIC, counts.tobytes(), docs.tobytes(), null.tobytes(), at.tobytes(), starts.astype("<u8").tobytes(), body])


class Shard:
    """Reader of one shard: document ids, starts, and the ids of any range of documents."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        self.n_docs, self.n_ids, self.n_blocks = map(int, np.frombuffer(self.file.read(24), "<u8"))
        docs = np.frombuffer(self.file.read(8 * self.n_docs), "<i8")
        null = np.frombuffer(self.file.read(self.n_docs), np.uint8)
        self.doc_ids = pa.array(docs, pa.int64(), mask=null.astype(bool))
        self.starts = np.frombuffer(self.file.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.blocks = np.frombuffer(self.file.read(8 * (self.n_blocks + 1)), "<u8").astype(np.int64)
        self.body = 8 + 24 + 17 * self.n_docs + 8 + 8 * (self.n_blocks + 1)

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids of documents first .. end - 1; only their blocks are read."""
        a, b = int(self.starts[first]), int(self.starts[end])
        if a == b:
            return np.zeros(0, np.uint32)
        i, j = a // BLOCK, -(-b // BLOCK)
        self.file.seek(self.body + int(self.blocks[i]))
        data = np.frombuffer(self.file.read(int(self.blocks[j] - self.blocks[i])), np.uint8)
        return unpack(self.blocks[i : j + 1] - self.blocks[i], data, min(j * BLOCK, self.n_ids) - i * BLOCK)[a - i * BLOCK : b - i * BLOCK]

    def close(self) -> None:
        self.file.close()


_encoders: dict[str, TextEncoder] = {}


def _encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode_all(pieces: list[bytes], most: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
            """Many pieces in one text, a line each; the offsets tell which line an id is from."""
            if len(pieces) > most:
                parts = [encode_all(pieces[i : i + most]) for i in range(0, len(pieces), most)]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            lines = [p.decode() for p in pieces]
            found = tokenizer.encode("\n".join(lines), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
            at = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            return np.array(found.ids, np.uint32), np.bincount(np.searchsorted(ends, at, "right"), minlength=len(pieces))

        _encoders[path] = TextEncoder(encode_all)
    return _encoders[path]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII that is neither letter, digit nor white space; and no apostrophe, which may begin a contraction.
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def encode_words(encoder: TextEncoder, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each text) with the end id behind each text.

    For tokenizers that lower-case, drop white space, and part letters from the marks behind them: so each distinct word,
    and the marks at its end, are encoded once, in lower case. Where a special token may occur (`<|`), words stay whole and
    as they are.
    """
    plain = not bool(((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any())
    words = Words(_LOWER[data] if plain else data, offsets)
    start, end, first, keys = words.start, words.end, words.first, words.hash
    if plain and len(start):
        letter = _LETTER[data]
        # the second byte of a Latin-1 letter (but for the signs of multiplication and division)
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut = np.flatnonzero(letter[:-1] & _MARK[data[1:]]) + 1
        cut = cut[~np.isin(cut, offsets, assume_unique=False)] if len(cut) else cut
        start = np.sort(np.concatenate([start, cut]))
        end = np.sort(np.concatenate([end, cut]))
        first = np.searchsorted(start, words.start)
        first = np.append(first, len(start))[words.first]
        keys = span_keys(words.data, start, end)
    ids, size = encoder.gather(words.data, start, end, keys)
    sums = np.concatenate([[0], np.cumsum(size)])[first]
    each = sums[1:] - sums[:-1]
    n = len(each)
    out = np.full(len(ids) + n, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), each)] = ids
    return out, each + 1


def _edges(docs: DataFrame, range_docs: int) -> list[int]:
    """Ascending ids that part the documents into ranges of about equal numbers."""
    n, _ = docs.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    shards = min(MOST_RANGES, -(-n // range_docs))
    if shards < 2:
        return []
    at = [k / shards for k in range(1, shards)]
    return sorted(set(docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), 20 * shards)).first()[0] or []))


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, range_docs: int = RANGE_DOCS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes docs(doc_id, text) and writes shards in ascending doc_id order; returns shard, part, path, n_docs, n_ids.

    The shuffle carries ids, two bytes each where they fit. A shard holds a range of doc_id, in one file or several parts.
    """
    edges = _edges(docs, range_docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in slices(offsets, 1 << 20):
                o = offsets[a : b + 1]
                ids, size = encode_words(encoder, data[o[0] : o[-1]], o - o[0], end_id)
                doc = batch.column("doc_id").slice(a, b - a)
                number = np.asarray(doc.fill_null(-(1 << 63)).cast(pa.int64()))
                small = not len(ids) or int(ids.max()) < 1 << 16
                at = np.concatenate([[0], np.cumsum(size)]) * (2 if small else 4)
                flat = pa.py_buffer(ids.astype("<u2" if small else "<u4"))
                binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), flat])
                shard = np.searchsorted(np.array(edges, np.int64), number, "left")
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), doc, pa.array(np.full(len(size), 2 if small else 4), pa.int32()), binary], names=["shard", "doc_id", "bytes", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_: list[int | None] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held, part, shard = 0, 0, 0

        def closed() -> pa.RecordBatch:
            path = f"{folder}/shard-{shard:05d}-{part:06d}.pfor"
            write_file(path, shard_bytes(docs_, np.concatenate(sizes), np.concatenate(ids)))
            row = zip((shard, part, path, len(docs_), held), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], names=["shard", "part", "path", "n_docs", "n_ids"])

        for batch in batches:
            data, offsets = column_bytes(batch.column("ids"))
            width, numbers = np.asarray(batch.column("bytes")), batch.column("doc_id").to_pylist()
            size = np.diff(offsets) // width if len(width) else np.zeros(0, np.int64)
            shard = int(batch.column("shard")[0].as_py()) if len(width) else shard
            at = 0
            while at < len(width):
                # to the document that fills the file, of those of one width
                total = held + np.cumsum(size[at:])
                to = at + min(int(np.searchsorted(total, shard_ids)) + 1, len(total))
                cut = np.flatnonzero(width[at:to] != width[at])
                to = at + int(cut[0]) if len(cut) else to
                ids.append(data[offsets[at] : offsets[to]].view("<u2" if width[at] == 2 else "<u4").astype(np.uint32))
                sizes.append(size[at:to])
                docs_ += numbers[at:to]
                held, at = int(total[to - at - 1]), to
                if held >= shard_ids:
                    yield closed()
                    docs_, sizes, ids, held, part = [], [], [], 0, part + 1
        if docs_:
            yield closed()

    encoded = docs.select("doc_id", "text").mapInArrow(trimmed(encode), "shard int, doc_id long, bytes int, ids binary")
    placed = encoded.repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("doc_id", "ids")
    return written(placed.mapInArrow(trimmed(write), _MANIFEST), "pfor-manifest")


def _with_starts(manifest: DataFrame) -> DataFrame:
    """path, base, i of the shards' files: how many ids, and how many files, stand before each. The driver sees a row for
    each range."""
    ranges = sorted(tuple(r) for r in manifest.groupBy("shard").agg(F.sum("n_ids"), F.count(F.lit(1))).collect())
    before = np.cumsum([[0, 0], *(r[1:] for r in ranges)], axis=0).tolist()
    starts = manifest.sparkSession.createDataFrame([(r[0], *at) for r, at in zip(ranges, before)], "shard int, start long, files long")
    up = Window.partitionBy("shard").orderBy("part")
    own = manifest.select("shard", "part", "path", (F.sum("n_ids").over(up) - F.col("n_ids")).alias("own"))
    return own.join(F.broadcast(starts), "shard").select("path", (F.col("start") + F.col("own")).alias("base"), (F.col("files") + F.col("part")).alias("i"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the shards' files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(path)
                at = 0
                while at < shard.n_docs:  # some million ids at a time
                    to = max(at + 1, int(np.searchsorted(shard.starts, shard.starts[at] + (1 << 20), "right")) - 1)
                    ids = np.ascontiguousarray(shard.ids(at, to).astype("<u4"))
                    s = shard.starts[at : to + 1] - shard.starts[at]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(s[:-1].tolist(), s[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [shard.doc_ids.slice(at, to - at), pa.array(first + shard.starts[at:to], pa.int64()), pa.array(np.diff(s), pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at = to
                shard.close()

    tasks = max(1, min(manifest.count(), MOST_RANGES))
    return _with_starts(manifest).repartitionById(tasks, (F.col("i") % tasks).cast("int")).mapInArrow(trimmed(read), SCHEMA)


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    folder = new_folder(docs.sparkSession, "pfor")
    return read_shards(write_shards(docs, tokenizer_path, folder, end_id))
