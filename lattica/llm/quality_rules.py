"""Quality rules: word, symbol and line counts, and repetition by suffix array.

Per text, the word suffixes that share a first pair of words are sorted by prefix doubling; adjacent common prefixes
(word-hash binary descent) give the longest-common-prefix intervals. A suffix's deepest interval is its longest repeat,
and the union of those spans is the union of all maximal repeated substrings of at least `min_repeat` words. A text is
rejected if the union covers more than `max_covered` of its words or one repeat has more than `max_longest` words. The
defaults: 15 % of the words in repeats of five and more, which is the limit that web corpora commonly set for repeated
5-grams, and a repeat of over 50 words, longer than a line or a refrain.

Words and lines are equal if their bytes are; the lengths of repeats come from hashes modulo 2**61 - 1.

Defined results: null or empty text has no words, so base_failed and not kept; repeated documents are judged one by one
alike; an empty table gives an empty table; extra columns are ignored. A text is handled whole, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.kernels import SPACE, U, Rolling, Words, column_bytes, distinct_keys, per_text, runs, slices, span_numbers
from lattica.llm.shared import trimmed

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeats(word: np.ndarray, text: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(position, length) of the longest repeat within its text that starts at each position, where >= least (>= 2).

    word: numbers from 0, equal for equal words. The suffix array holds only suffixes whose first two words occur again in
    their text; all others repeat nothing.
    """
    n = len(word)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    follow = np.zeros(n, np.int64)
    follow[:-1] = np.where(text[1:] == text[:-1], word[1:] + 1, 0)
    m = int(word.max()) + 2
    _, _, pair = distinct_keys((text * m + word) * m + follow)
    count = np.bincount(pair)
    # A rank is the number of suffixes before the group, so groups can be split without renumbering others.
    rank = (np.cumsum(count) - count)[pair]
    ends = np.searchsorted(text, text, "right")
    live = np.flatnonzero((count[pair] > 1) & (follow > 0))
    active, h = live, 2
    while len(active):
        ahead = active + h
        second = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[active]))
        active, second, old = active[by], second[by], rank[active[by]]
        at = np.arange(len(active))
        opens = np.ones(len(active), bool)
        opens[1:] = old[1:] != old[:-1]
        splits = opens.copy()
        splits[1:] |= second[1:] != second[:-1]
        first = np.maximum.accumulate(np.where(opens, at, 0))
        head = np.maximum.accumulate(np.where(splits, at, 0))
        rank[active] = old + head - first
        size = np.bincount(np.cumsum(splits) - 1)
        active = active[np.repeat(size, size) > 1]
        h *= 2
    order = live[np.argsort(rank[live], kind="stable")]
    if not len(order):
        return order, order
    shared = common_prefix(Rolling(word), order[:-1], order[1:], ends)
    longest = np.maximum(np.append(shared, 0), np.insert(shared, 0, 0))
    keep = longest >= least
    return order[keep], longest[keep]


def common_prefix(roll: Rolling, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b within their texts (0 across texts), by binary descent over hashes."""
    most = np.where(ends[a] == ends[b], ends[a] - np.maximum(a, b), 0)
    size = np.zeros(len(a), np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step:
        to = size + step
        can = np.flatnonzero(to <= most)
        same = roll.same(a[can], b[can], to[can])
        size[can[same]] = to[can[same]]
        step >>= 1
    return size


def covered(position: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Flags of the positions in the union of the spans."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, position, 1)
    np.add.at(edges, position + length, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of the contract, and the repetition by suffix array, for each text."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    text = words.text
    inside = ~SPACE[data]
    out = {"n_words": words.count, "word_chars": per_text(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_text(_SYMBOL[data], offsets)}

    start, end = runs(data != 0x0A, offsets)
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=seen[1:])
    full = seen[end] > seen[start]
    start, end = start[full], end[full]
    line_text = np.searchsorted(offsets, start, "right") - 1
    _, first, _ = distinct_keys(line_text * (len(start) + 1) + span_numbers(data, start, end))
    out["n_dup_lines"] = np.bincount(line_text, minlength=n) - np.bincount(line_text[first], minlength=n)

    word = span_numbers(data, words.start, words.end)
    again = np.zeros(len(text), bool)
    if len(text) > 2:
        window, m = np.flatnonzero(text[2:] == text[:-2]), len(word) + 1
        group = text[window]
        for k in range(3):
            _, _, group = distinct_keys(group * m + word[window + k])
        found = window[np.bincount(group)[group] > 1]
        for k in range(3):
            again[found + k] = True
    out["n_repeat_words"] = np.bincount(text[again], minlength=n)

    position, length = repeats(word, text, min_repeat)
    out["covered_words"] = np.bincount(text[covered(position, length, len(text))], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, text[position], length)
    out["longest_repeat"] = longest
    return out


def quality_rules(docs: DataFrame, min_repeat: int = 5, max_covered: float = 0.15, max_longest: int = 50) -> DataFrame:
    """Verdicts on documents(doc_id, text); no shuffle, one pass over the text column only."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                m = measure(data[o[0] : o[-1]], o - o[0], min_repeat)
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                kept = ~failed & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
                arrays = [batch.column("doc_id").slice(a, b - a), *(pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
                arrays += [pa.array(failed), pa.array(kept), pa.array(m["covered_words"], pa.int64()), pa.array(m["longest_repeat"], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(trimmed(judge), SCHEMA)
