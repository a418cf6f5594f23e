"""Byte-level BPE by prefix dynamic programming, encoding and decoding.

For every prefix of a piece exactly one token can end its encoding; a table holds that token. A candidate (a token that
ends at the position; Aho-Corasick yields them) is the one if it and the last token of the remaining prefix are
compatible, that is, if the two tokens' bytes together encode to just these two. So an append only extends the table,
and an edit re-encodes from the edited byte until the table is the old one again.

Texts are cut into pieces by numpy over code point classes, which gives the same pieces as the usual pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ ; each distinct piece of a stretch of text is
encoded once, and the ids are gathered by numpy.

Defined results: null text counts as empty (no ids); repeated rows are encoded alike; texts are whole, never prefixes; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.kernels import U, column_bytes, distinct_keys, same_spans, slices, span_keys
from lattica.llm.shared import trimmed

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Distinct pieces whose ids a worker keeps (some 60 bytes each); beyond it the store starts afresh.
KEPT_PIECES = 600_000
#: Token pairs of known compatibility that it keeps.
KEPT_PAIRS = 200_000
_LETTER, _NUMBER, _BLANK, _OTHER = range(4)
_SIDE = 1 << 24


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBpe:
    """Encoder and decoder for the ranks of a byte-level BPE; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self._pairs: dict[int, bool] = {}  # by left * _SIDE + right
        self._whole: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = {}, {}
        self._finder = ahocorasick.Automaton()
        for t, i in ranks.items():
            self._finder.add_word(t.decode("latin-1"), (i, len(t)))
        self._finder.make_automaton()
        most = max(self.tokens, default=-1) + 1
        sizes = np.zeros(most, np.int64)
        for i, t in self.tokens.items():
            sizes[i] = len(t)
        self._ends = np.cumsum(sizes)
        self._sizes, self._size_list, self.longest = sizes, sizes.tolist(), int(sizes.max(initial=1))
        self._bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(most)), np.uint8)

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """The defining encoding, by merging the adjacent pair of the least rank, leftmost first, down to `until` parts."""
        ranks, none = self.ranks, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while len(parts) > until and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def starts(self, token: int) -> bool:
        """Whether the token's bytes alone encode to it."""
        if (ok := self._whole.get(token)) is None:
            ok = self._whole[token] = self.merged(self.tokens[token]) == [token]
        return ok

    def spine(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts that stood at the token's left (0) or right (1) edge while it was merged, last first: the part's
        bytes, the rank that made it, and the rank of the merge that took it in."""
        if (found := self._spines[side].get(token)) is None:
            found, part, taken = [], token, 1 << 60
            while True:
                data = self.tokens[part]
                single = len(data) == 1
                found.append((data, -1 if single else part, taken))
                if single:
                    break
                taken, part = part, self.merged(data, 2)[-side]
            self._spines[side][token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes together encode to just these two: no parts that face each other across the
        border at any time may merge before one of them is taken in on its own side."""
        if (ok := self._pairs.get(left * _SIDE + right)) is not None:
            return ok
        x, y = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        ranks, ok = self.ranks, self.starts(right) and self.starts(left)
        while ok:
            (a, made_a, taken_a), (b, made_b, taken_b) = x[i], y[j]
            rank = ranks.get(a + b)
            # of equal ranks the left one is first
            if rank is not None and rank < taken_a and rank <= taken_b:
                ok = False
            elif made_a >= made_b and made_a >= 0:
                i += 1
            elif made_b >= 0:
                j += 1
            else:
                break
        if len(self._pairs) >= KEPT_PAIRS:
            self._pairs.clear()
        self._pairs[left * _SIDE + right] = ok
        return ok

    def table(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """last[i] is the token that ends the encoding of data[:i + 1]; a table of a prefix is extended."""
        last = last or []
        done = len(last)
        pairs, compatible, append = self._pairs, self.compatible, last.append
        # matches that end in the new part begin at most the longest token before it
        back = max(0, done - self.longest) if done else 0
        for end, (token, size) in self._finder.iter((data[back:] if back else data).decode("latin-1")):
            end += back
            if end < done:
                continue
            if end < size:
                ok = self.starts(token)
            else:
                left = last[end - size]
                ok = pairs.get(left * _SIDE + token)
                if ok is None:
                    ok = compatible(left, token)
            if ok:
                append(token)
                done = end + 1  # the other tokens that end here need no look
        return last

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """The ids that a table holds for its whole or for a prefix of `end` bytes."""
        out, at = [], len(last) if end is None else end
        sizes = self._size_list
        while at > 0:
            out.append(token := last[at - 1])
            at -= sizes[token]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None and self.starts(whole):
            return [whole]
        return self.read(self.table(piece))

    def edited(self, data: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int]]:
        """(new data, new table) once data[at:at + removed] is replaced by added.

        The table up to `at` stays. Behind the edit, once as many entries in a row as the longest token is long equal the
        old ones (each depends on no others), the rest of the old table is taken over.
        """
        new = data[:at] + added + data[at + removed :]
        shift, longest = len(added) - removed, self.longest
        table, same, old_end = last[:at], 0, len(last)
        step = at + len(added)
        while len(table) < len(new):
            step = min(len(new), max(step, len(table)) + longest)
            known = len(table)
            table = self.table(new[:step], table)
            for i in range(max(known, at + len(added)), step):
                same = same + 1 if i - shift < old_end and table[i] == last[i - shift] else 0
                if same >= longest:
                    return new, table[: i + 1] + last[i + 1 - shift :]
        return new, table

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        size = self._sizes[ids]
        return self._bytes[spread(self._ends[ids] - size, size)]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[0], .., start[0] + size[0] - 1, start[1], .. one after the other."""
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(start - (total - size), size)


_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point, by the regex library's tables (surrogates don't occur in texts)."""
    if not _classes:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        out = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
            for m in regex.finditer(pattern, every):
                s, e = m.span()
                for a, b in ((min(s, 0xD800), min(e, 0xD800)), (max(s, 0xD800) + 0x800, max(e, 0xD800) + 0x800)):
                    out[a:b] = kind
        _classes.append(out)
    return _classes[0]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces begin. points: the code points of some texts; first: where each (non-empty) text begins."""
    n = len(points)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[n] = True
    run = edge[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == _BLANK
    start = run & ~blank
    # blanks: a run of them is a piece, but its last one is apart if something other than the text's end follows
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:-1]
    start |= blank & (run | last)
    # ... and joins what follows if it is U+0020
    joined = np.flatnonzero(last & (points == 0x20))
    start[joined + 1] = False
    # contractions: an apostrophe that begins a piece, and what the pattern takes with it
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[~edge[quote + 1]]
    if len(quote):
        pad = np.append(points, [0, 0])
        a, b = pad[quote + 1], pad[quote + 2]
        two = ~edge[np.minimum(quote + 2, n)] & (((b == 0x65) & ((a == 0x72) | (a == 0x76))) | ((a == 0x6C) & (b == 0x6C)))
        one = np.isin(a, (0x73, 0x74, 0x6D, 0x64))
        for which, size in ((one, 2), (two, 3)):
            at = quote[which]
            start[at + 1] = False
            at = at[at + size < n] + size
            start[at] |= kind[at] == _LETTER  # the rest of the letters; other classes begin there anyway
    return np.flatnonzero(start)


class TextEncoder:
    """Ids of whole texts: distinct pieces are looked up by a 64-bit key in a store of what this worker has encoded.

    Keys of up to seven bytes are the pieces themselves. Longer pieces are kept, and what has the key of one is compared
    with it byte by byte; pieces that differ from the one of their key are kept by their bytes. The store is two sorted
    tables, a large one and one of recent pieces that is merged into it now and then.
    encode_all(pieces) returns (ids one after the other, number of ids of each piece); pieces are bytes.
    """

    def __init__(self, encode_all, kept: int = KEPT_PIECES):
        self.encode_all, self.kept = encode_all, kept
        self.clear()

    def clear(self) -> None:
        nothing = np.zeros(0, U), np.zeros(0, np.int32)
        self.tables = [nothing, nothing]
        self.odd: dict[bytes, int] = {}
        self.size, self.start = np.zeros(1024, np.int32), np.zeros(1024, np.int64)
        self.raw_size, self.raw_start = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.raw = np.zeros(4096, np.uint32), np.zeros(4096, np.uint8)
        self.pieces = self.used = self.raw_used = 0

    def _room(self, **least: int) -> None:
        for name, n in least.items():
            old = getattr(self, name)
            if len(old) < n:
                new = np.zeros(n + n // 4, old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def _stored(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes and stores pieces; returns their numbers."""
        ids, sizes = self.encode_all(pieces)
        long = [p if len(p) > 7 else b"" for p in pieces]
        raw, raw_sizes = b"".join(long), np.fromiter(map(len, long), np.int64, len(long))
        k, n, m, r = self.pieces, self.pieces + len(pieces), self.used + len(ids), self.raw_used + len(raw)
        self._room(size=n, start=n, raw_size=n, raw_start=n, flat=m, raw=r)
        self.size[k:n], self.raw_size[k:n] = sizes, raw_sizes
        self.start[k:n] = self.used + np.cumsum(sizes) - sizes
        self.raw_start[k:n] = self.raw_used + np.cumsum(raw_sizes) - raw_sizes
        self.flat[self.used : m] = ids
        self.raw[self.raw_used : r] = np.frombuffer(raw, np.uint8)
        self.pieces, self.used, self.raw_used = n, m, r
        return np.arange(k, n, dtype=np.int32)

    @staticmethod
    def _merged(x, y):
        keys, numbers = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], numbers[order]

    def _numbers(self, keys: np.ndarray, piece_of) -> np.ndarray:
        """The store's number of each key (distinct, ascending), encoding the pieces of new ones."""
        out = np.full(len(keys), -1, np.int32)
        for known, numbers in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[at] == keys, numbers[at], out)
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self._stored(piece_of(new))
            self.tables[1] = self._merged(self.tables[1], (keys[new], out[new]))
            if len(self.tables[1][0]) * 4 > len(self.tables[0][0]):
                self.tables = [self._merged(*self.tables), (np.zeros(0, U), np.zeros(0, np.int32))]
        return out

    def gather(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each piece) of the pieces data[start:end]. keys: of span_keys()."""
        if self.pieces > self.kept:
            self.clear()
        each, first, inverse = distinct_keys(span_keys(data, start, end) if keys is None else keys)
        number = self._numbers(each, lambda new: [data[a:b].tobytes() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])[inverse]
        size = end - start
        long = np.flatnonzero((size > 7) | (self.raw_size[number] > 7))
        fits = self.raw_size[number[long]] == size[long]
        same = long[fits]
        fits[fits] = same_spans(data, start[same], self.raw[: self.raw_used], self.raw_start[number[same]], size[same])
        other = long[~fits]
        if len(other):  # of the key of another piece
            pieces = [data[a:b].tobytes() for a, b in zip(start[other].tolist(), end[other].tolist())]
            new = [p for p in dict.fromkeys(pieces) if p not in self.odd]
            if new:
                self.odd |= zip(new, self._stored(new).tolist())
            number[other] = [self.odd[p] for p in pieces]
        size = self.size[number].astype(np.int64)
        return self.flat[spread(self.start[number], size)], size


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum())), sizes


def encode_texts(encoder: TextEncoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after the other, number of ids of each text) of UTF-8 texts."""
    n = len(offsets) - 1
    text = data.tobytes().decode()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    bounds = lead[offsets]
    filled = bounds[1:] > bounds[:-1]
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(n, np.int64)
    start = piece_starts(points, bounds[:-1][filled])
    where = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    ids, size = encoder.gather(data, where[start], where[np.append(start[1:], len(points))])
    sums = np.concatenate([[0], np.cumsum(size)])
    at = np.searchsorted(start, bounds)
    return ids, sums[at[1:]] - sums[at[:-1]]


_workers: dict[str, tuple[PrefixBpe, TextEncoder]] = {}


def _worker(ranks_path: str) -> tuple[PrefixBpe, TextEncoder]:
    if ranks_path not in _workers:
        bpe = PrefixBpe(read_ranks(ranks_path))
        _workers[ranks_path] = bpe, TextEncoder(lambda pieces: flattened([bpe.encode(p) for p in pieces]))
    return _workers[ranks_path]


def must_decode(bpe: PrefixBpe, ids: np.ndarray, size: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Raises unless each text's ids (size of them) decode to its bytes."""
    ids = ids.astype("<u4")
    at = np.concatenate([[0], np.cumsum(size)])
    ends = np.concatenate([[0], np.cumsum(bpe._sizes[ids])])[at]
    if not np.array_equal(ends, offsets - offsets[0]) or not np.array_equal(np.frombuffer(bpe.decode(ids), np.uint8), data[offsets[0] : offsets[-1]]):
        raise ValueError("ids do not decode to their text")


def tokenized(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, text -> doc_id, ids (array<int>): the encoding itself, which is decoded again and compared with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = _worker(ranks_path)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in slices(offsets, 1 << 19):
                o = offsets[a : b + 1]
                ids, size = encode_texts(encoder, data[o[0] : o[-1]], o - o[0])
                must_decode(bpe, ids, size, data, o)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, ids array<int>")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encodes each text, decodes the ids again, and returns the digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = _worker(ranks_path)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in slices(offsets, 1 << 19):
                o = offsets[a : b + 1]
                ids, size = encode_texts(encoder, data[o[0] : o[-1]], o - o[0])
                ids = ids.astype("<u4")
                decoded = bpe.decode(ids)
                at = np.concatenate([[0], np.cumsum(size)])
                to = np.concatenate([[0], np.cumsum(bpe._sizes[ids])])[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(size, pa.int64()),
                        pa.array([hashlib.sha256(ids[s:e]).hexdigest() for s, e in zip(at[:-1].tolist(), at[1:].tolist())], pa.string()),
                        pa.array([hashlib.sha256(decoded[s:e]).hexdigest() for s, e in zip(to[:-1].tolist(), to[1:].tolist())], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)
