"""Vectorised text kernels over Arrow string columns: words, lines, shingles, keys and hashes in numpy.

Texts are handled as UTF-8 bytes. Every separator is an ASCII byte, so byte positions cut texts correctly; code points
are counted where a contract asks for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

U = np.uint64
#: The bytes between words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: The prime 2**61 - 1, and a base below it.
_PRIME, _BASE = U((1 << 61) - 1), 0x16A09E667F3BCC90
_LOW, _HIGH = U((1 << 32) - 1), U((1 << 29) - 1)
_powers: list[np.ndarray] = [np.ones(1, U)]
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)], U)
#: Spans of more bytes are hashed, and compared, one by one.
_LONG = 256


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> U(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo 2**61 - 1, of numbers below it, by halves of 32 bits."""
    a, b, c, d = x >> U(32), x & _LOW, y >> U(32), y & _LOW
    cross = _folded(a * d) + _folded(b * c)
    # a * c counts 2**64 = 8 times, cross 2**32 times: its upper part wraps around the prime
    return _folded(_folded(_folded(a * c << U(3)) + _folded(b * d)) + _folded((cross >> U(29)) + ((cross & _HIGH) << U(32))))


def powers(n: int) -> np.ndarray:
    """The base to the powers 0 .. n-1, kept between calls."""
    while len(_powers[0]) < n:
        up = _powers[0]
        step = pow(_BASE, len(up), int(_PRIME))
        _powers[0] = np.concatenate([up, times(up, np.full(len(up), step, U))])
    return _powers[0][:n]


class Rolling:
    """Polynomial hashes modulo 2**61 - 1 of stretches of a token sequence: stretches of equal tokens have equal hashes.

    Modulo a power of two such hashes collide on regular sequences whatever the tokens' codes; modulo a prime they don't.
    """

    def __init__(self, tokens: np.ndarray):
        code = times(_folded(mix(tokens.astype(U))), powers(len(tokens)))
        high, low = np.cumsum(code >> U(32), dtype=U), np.cumsum(code & _LOW, dtype=U)
        self.sums = np.zeros(len(tokens) + 1, U)
        self.sums[1:] = _folded(times(_folded(high), np.full(len(high), 1 << 32, U)) + _folded(low))

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` tokens from a and from b on have one hash."""
        x, y = (_folded(self.sums[at + size] + _PRIME - self.sums[at]) for at in (a, b))
        first, last = np.minimum(a, b), np.maximum(a, b)
        ahead = np.where(a <= b, x, y)
        return times(ahead, powers(len(self.sums))[last - first]) == np.where(a <= b, y, x)


def loads(data: np.ndarray) -> np.ndarray:
    """At every byte, and at the end, the eight bytes from there on as a little-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ascontiguousarray(np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)))


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of byte spans. Up to seven bytes the key holds the span itself, so no two share one; longer spans have
    the top bit set and a hash of 63 bits, by mixing eight bytes at a time."""
    word, size = loads(data), end - start
    out = word[start] & _MASKS[np.minimum(size, 7)] | size.astype(U) << U(56)
    long = np.flatnonzero(size > 7)
    if not len(long):
        return out
    middle = long[size[long] <= _LONG]
    at, n = start[middle], size[middle]
    h = mix(word[at] + n.astype(U) * U(0xA24BAED4963EE407))
    live, k = np.arange(len(middle)), 8
    while len(live := live[n[live] > k]):
        h[live] = mix(h[live] * U(0x9E3779B97F4A7C15) ^ word[np.minimum(at[live] + k, at[live] + n[live] - 8)])
        k += 8
    out[middle] = h
    for i in long[size[long] > _LONG].tolist():
        out[i] = xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    out[long] |= U(1 << 63)
    return out


def same_spans(x: np.ndarray, at: np.ndarray, y: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` (at least eight) bytes of x from at on are those of y from to on: compared byte by byte."""
    left = loads(x)
    right = left if y is x else loads(y)
    ok = left[at + size - 8] == right[to + size - 8]
    live, k = np.flatnonzero(ok & (size <= _LONG)), 0
    while len(live := live[size[live] > k + 8]):
        same = left[at[live] + k] == right[to[live] + k]
        ok[live[~same]] = False
        live, k = live[same], k + 8
    for i in np.flatnonzero(ok & (size > _LONG)).tolist():
        ok[i] = np.array_equal(x[at[i] : at[i] + size[i]], y[to[i] : to[i] + size[i]])
    return ok


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct keys, a place of each, the number of each key among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def span_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each byte span, the same for spans of equal bytes and for no others."""
    _, first, number = distinct_keys(span_keys(data, start, end))
    size = end - start
    long = np.flatnonzero(size > 7)
    at = first[number[long]]
    fits = size[at] == size[long]
    fits[fits] = same_spans(data, start[long[fits]], data, start[at[fits]], size[long[fits]])
    more: dict[bytes, int] = {}
    for i in long[~fits].tolist():  # spans of one hash and different bytes
        number[i] = more.setdefault(data[start[i] : end[i]].tobytes(), len(first) + len(more))
    return number


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = 1 << 18, rows: int = (1 << 16) - 1) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, and of `rows` rows, at the utmost; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n, at + rows)
        yield at, to
        at = to


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of set flags within each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set flags that don't cross texts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some texts: byte spans, 64-bit keys and the text each is in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.start, self.end = runs(~SPACE[data], offsets)
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = span_keys(data, self.start, self.end)
        self.count = np.bincount(self.text, minlength=len(offsets) - 1).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def shingles(self, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of each k-word shingle; a text of fewer words, but at least one, has its whole sequence."""
        n = len(self.hash)
        if not n:
            return np.zeros(0, U), np.zeros(0, np.int64)
        factors = mix(np.arange(1, k + 1, dtype=U)) | U(1)
        code = mix(self.hash)
        start = np.arange(max(0, n - k + 1))
        start = start[self.text[start] == self.text[start + k - 1]]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        value = np.zeros(len(start) + len(short), U)
        for i in range(k):
            value[: len(start)] += code[start + i] * factors[i]
            some = np.flatnonzero(self.count[short] > i)
            value[len(start) + some] += code[self.first[short[some]] + i] * factors[i]
        value[len(start) :] ^= self.count[short].astype(U)
        return mix(value), self.text[np.concatenate([start, self.first[short]])]


def distinct_by_text(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, value) pairs, by text and value. texts: under 2**16 of them."""
    order = np.argsort(value)
    order = order[np.argsort(text[order].astype(np.uint16), kind="stable")]
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], text[new]
