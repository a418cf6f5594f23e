"""Secret scans: base patterns, and sliding-window Shannon entropy per character class.

Candidates are the maximal runs of [A-Za-z0-9+/=_-] with 20 characters or more, found by numpy over the UTF-8 bytes.
Windows of 20 to 24 characters slide over each candidate; the counts of a window's characters change by one in and one out,
and the entropy follows from a running sum of c*log2(c). The threshold of a class is in bits for 24 characters and scaled by
the logarithms of the lengths for shorter windows, so a secret of 20 characters is found as well alone as within a longer
candidate. Windows at or over the threshold are joined into spans of kind `entropy`. The allow-list suppresses entropy spans
only, never base ones; filler such as `example` cuts a candidate, and what stands beside it is scored like any other part.

Defined results: null text counts as empty and has no spans; spans are in code points, end exclusive; ties and repeated
rows are scanned alike; an empty table gives an empty table; extra columns are ignored by scan() and kept by redact().
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.kernels import column_bytes, runs
from lattica.llm.shared import same_columns, trimmed

#: Kinds in their order, and the base patterns.
KINDS = ("assign", "access", "hex", "entropy")
_KEY = "".join(f"[{c.upper()}{c}]" for c in "password"), "".join(f"[{c.upper()}{c}]" for c in "passwd"), "".join(f"[{c.upper()}{c}]" for c in "secret"), "".join(f"[{c.upper()}{c}]" for c in "token"), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"({'|'.join(_KEY)})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
#: (class, its characters, bits per character of 24): a window counts if it reaches the bits of any class that holds it.
CLASSES = (("hex", frozenset("0123456789abcdefABCDEF"), 3.0), ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), 3.8))
#: Characters of the windows; the bits are those of the last.
WIDTHS = (20, 21, 22, 23, 24)
#: Never an entropy finding, as a candidate or a span: UUIDs, plain words or paths without digits, digits only, and words and
#: numbers in a row, none of which mixes letters and digits (but for v1, v2, ..).
ALLOW = tuple(map(re.compile, (r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z", r"[A-Za-z/_=+-]+\Z", r"[0-9_-]+\Z", r"(?:(?:[a-z]{1,12}|v?[0-9]{1,8})[-_/])+(?:[a-z]{1,12}|v?[0-9]{1,8})\Z")))
#: Documented examples, and ascending or telling filler: no window holds any of them.
FILLER = re.compile(r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|je7MtGbClwBF/2Zp9Utk/h3yCo8nvbEXAMPLEKEY|EXAMPLE|example|0123456789|abcdefgh|ABCDEFGH")

_CANDIDATE_BYTE = np.zeros(256, bool)
_CANDIDATE_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")] = True
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def entropy_windows(text: str, characters: frozenset[str], width: int, least: float) -> list[tuple[int, int]]:
    """Spans of the union of the windows within one class whose entropy is `least` or more."""
    log = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, held, out = 0.0, 0, []
    for i, c in enumerate(text):
        if c not in characters:
            counts, total, held = {}, 0.0, 0
            continue
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += log[n + 1] - log[n]
        held += 1
        if held > width:
            old = text[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += log[n - 1] - log[n]
            held = width
        if held == width and math.log2(width) - total / width >= least - 1e-9:
            if out and out[-1][1] >= i + 1 - width:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i + 1 - width, i + 1))
    return out


def _parts(candidate: str) -> list[tuple[int, int]]:
    """What lies between filler."""
    ends = [(m.start(), m.end()) for m in FILLER.finditer(candidate)]
    return list(zip([0, *(e for _, e in ends)], [*(s for s, _ in ends), len(candidate)]))


def _joined_spans(spans: list[tuple[int, int]], touching: bool) -> list[tuple[int, int]]:
    """The union of spans that overlap, or also of those that touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1] + touching:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def entropy_spans(candidate: str, classes=CLASSES, allow=ALLOW, widths=WIDTHS) -> list[tuple[int, int]]:
    """Entropy spans of one candidate string, unless the allow-list matches it or the span; overlapping ones are joined."""
    if any(p.match(candidate) for p in allow):
        return []
    parts = [(a, candidate[a:b]) for a, b in _parts(candidate) if b - a >= widths[0]]
    found: list[tuple[int, int]] = []
    for _, characters, least in classes:
        scaled = [(w, least * math.log2(w) / math.log2(widths[-1])) for w in widths]
        spans = _joined_spans([(a + s, a + e) for a, part in parts for w, bits in scaled for s, e in entropy_windows(part, characters, w, bits)], True)
        found += [(s, e) for s, e in spans if not any(p.match(candidate[s:e]) for p in allow)]
    return _joined_spans(found, False)


def find(text: str, long_run: bool = True, classes=CLASSES, allow=ALLOW) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start and kind. long_run: the text has a run of 20 candidate characters."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if long_run:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        for c in CANDIDATE.finditer(text):
            # a run of 24 hex digits lies in a candidate, but may begin before the match's part of it: both are maximal
            out += [(c.start() + m.start(), c.start() + m.end(), "hex") for m in HEX.finditer(c[0]) if m.end() - m.start() >= 24]
            out += [(c.start() + s, c.start() + e, "entropy") for s, e in entropy_spans(c[0], classes, allow)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _scanned(column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, str]]]]:
    data, offsets = column_bytes(column)
    s, e = runs(_CANDIDATE_BYTE[data], offsets)
    long = np.zeros(len(offsets) - 1, bool)
    long[np.searchsorted(offsets, s[e - s >= 20], "right") - 1] = True
    for i in range(len(column)):
        text = column[i].as_py() or ""
        yield text, find(text, bool(long[i]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Spans of each document's text, with counts by kind; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, spans in _scanned(batch.column("text")):
                base = [x for x in spans if x[2] != "entropy"]
                n = [sum(x[2] == k for x in spans) for k in KINDS]
                rows.append((n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), n[3]))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)


def redact(docs: DataFrame, mask: str = "[REDACTED]", length_column: str | None = "n_chars") -> DataFrame:
    """docs with each secret replaced by the mask (overlapping spans as one), and the length column brought up to date.

    A null text stays null; texts without secrets, and all other columns, stay as they are.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, column = names.index("text"), batch.column(names.index("text"))
            texts, touched = [], []
            for i, (text, spans) in enumerate(_scanned(column)):
                parts, end = [], 0
                for s, e, _ in spans:
                    if s >= end:
                        parts += [text[end:s], mask]
                    end = max(end, e)
                touched.append(bool(spans))
                texts.append("".join([*parts, text[end:]]) if spans else column[i].as_py())
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, column.type)
            if length_column in names:
                k = names.index(length_column)
                lengths = [len(t) if hit else old for t, hit, old in zip(texts, touched, arrays[k].to_pylist())]
                arrays[k] = pa.array(lengths, arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return same_columns(docs, run)
