"""Two-stage suffix sorting of byte strings, vectorised, and windows that occur more than once.

Stage one sorts directly only the suffixes that are smaller than their successors (type S). Stage two scans the buckets of
first bytes in ascending order and induces the others (type L): the predecessor of a suffix in a bucket, if it is of type L,
follows in the bucket of its own first byte. Suffixes are ordered to a depth of `depth` bytes at least. Bytes themselves are
compared, eight at a time; nothing rests on hashes.
"""

from __future__ import annotations

import numpy as np

from lattica.llm.kernels import U, loads


def is_smaller(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor (the end is smaller than any byte)."""
    n = len(data)
    if not n:
        return np.zeros(0, bool)
    start = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]]))
    up = np.zeros(len(start), bool)
    up[:-1] = data[start[1:]] > data[start[:-1]]
    return np.repeat(up, np.diff(np.append(start, n)))


def needed(small: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes and those that these are induced from: all up to the next one of type S."""
    n = len(small)
    to = np.where(small, np.arange(n), n - 1)
    to = np.minimum.accumulate(to[::-1])[::-1]
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(wanted)
    edge[at] += 1
    np.subtract.at(edge, to[at] + 1, 1)
    return np.cumsum(edge[:-1]) > 0


def sort_directly(word: np.ndarray, at: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The suffixes at `at` of n bytes in order to `depth` bytes; word: the eight bytes at each place, first one highest.

    All groups that tie go on by eight bytes in every round: a group of equal ones as it is, any other in new order.
    """

    def by(keys: np.ndarray, place: np.ndarray, group: np.ndarray | None) -> np.ndarray:
        if len(place) and place.max() + 8 > n:  # the end comes before a zero byte
            return np.lexsort((np.minimum(8, n - place), keys, *(() if group is None else (group,))))
        order = np.argsort(keys)
        if group is None:
            return order
        narrow = group.astype(np.uint16) if group[-1] < 1 << 16 else group
        return order[np.argsort(narrow[order], kind="stable")]

    def fresh(keys: np.ndarray, place: np.ndarray, group: np.ndarray | None) -> np.ndarray:
        length = np.clip(n - place, 0, 8)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (length[1:] != length[:-1])
        if group is not None:
            new[1:] |= group[1:] != group[:-1]
        return new

    order = by(word[at], at, None)
    out = at[order]
    new = fresh(word[out], out, None)
    place, member, skip = np.arange(len(out)), out, 0
    while True:
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        skip += 8
        place, member = place[tied], member[tied]
        if skip >= depth or not len(place):
            return out
        group = group[tied]
        group = np.cumsum(np.append(0, group[1:] != group[:-1]))
        keys = word[np.minimum(member + skip, n)]
        new = fresh(keys, member + skip, group)
        head = np.ones(len(group), bool)
        head[1:] = group[1:] != group[:-1]
        mixed = np.bincount(group, new & ~head)[group] > 0
        some = np.flatnonzero(mixed)
        if len(some):
            order = some[by(keys[some], np.minimum(member[some] + skip, n), group[some])]
            member[some], keys[some] = member[order], keys[order]
            out[place[some]] = member[some]
            new[some] = fresh(keys[some], member[some] + skip, group[some])


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in order, or those that `wanted` flags and others that they were induced from."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    small = is_smaller(data)
    asked = np.ones(n, bool) if wanted is None else needed(small, wanted)
    direct = sort_directly(loads(data).byteswap(), np.flatnonzero(small & asked), n, depth)
    bounds = np.searchsorted(data[direct], np.arange(257))
    larger = asked & ~small
    coming: list[list[np.ndarray]] = [[] for _ in range(256)]
    if asked[n - 1]:
        coming[data[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        found = coming[c]
        wave = np.concatenate(found) if found else np.zeros(0, np.int64)
        found = [wave]
        while len(wave):  # runs of the byte: predecessors in the same bucket
            wave = wave[wave > 0] - 1
            wave = wave[(data[wave] == c) & larger[wave]]
            found.append(wave)
        bucket = np.concatenate([*found, direct[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(data[before] > c) & larger[before]]
        if len(before):
            byte = data[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for part in np.split(before, cuts):
                coming[data[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefix(word: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix, up to `most`, of suffixes that have `most` bytes at least; word: as loads() gives it."""
    size = np.full(len(a), most)
    live, k = np.arange(len(a)), 0
    while k < most and len(live):
        other = word[a[live] + k] ^ word[b[live] + k]
        ends = other != 0
        lowest = other[ends] & (~other[ends] + U(1))
        size[live[ends]] = np.minimum(most, k + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8)
        live, k = live[~ends], k + 8
    return size


def repeated_windows(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Flags of the valid starts whose `length` bytes also start at another valid place."""
    order = suffix_array(data, length, valid)
    order = order[valid[order]]
    twice = common_prefix(loads(data), order[:-1], order[1:], length) >= length
    flags = np.zeros(len(data), bool)
    flags[order[:-1][twice]] = True
    flags[order[1:][twice]] = True
    return flags
