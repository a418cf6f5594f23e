"""The source divergence audit, against a recount in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import divergence
from tests.llm.test_edges import clashing
from tests.llm.test_queries import DOCS, documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, top=10):
    docs = [((lang or ""), (source or ""), Counter(t.translate(UPPER) for t in TERM.findall(text or ""))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, c in own for t in c)
        kept = sorted((t for t, n in df.items() if n >= least), key=lambda t: t.encode())
        v = len(kept)

        def p(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}

        counts = {s: sum((c for _, s2, c in own if s2 == s), Counter()) for s in {s for _, s, _ in own}}
        groups = {s: p(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = p(sum((c for _, _, c in own), Counter()))
        for s in groups:
            pairs = [(sum(f(groups[s][t], groups[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(groups[s][t], q[t]), t) for t in kept if counts[s][t] and groups[s][t] > q[t]]
            order = lambda x: (-x[0], x[1].encode())
            out += [(lang, s, "pair", o, value, i + 1) for i, (value, o) in enumerate(sorted(pairs, key=order))]
            out += [(lang, s, "term", t, value, i + 1) for i, (value, t) in enumerate(sorted(terms, key=order)[:top])]
    return out


def table(seed, n=260):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé中") for _ in range(r.randrange(1, 4))) for _ in range(120)] + ["Foo", "foo", "FOO", "É", "\U00010000x"]
    rows = documents(seed, 30)
    for i in range(n):
        lang = r.choice(["en", "en", "de", None, "", "solo"])
        source = "only" if lang == "solo" else r.choice(["a", "b", "É", "z", None, "", "\U00010000", "中"])
        weights = [1 + (hash_ % 7) for hash_ in range(len(words))] if source != "a" else None
        rows.append((1000 + i, r.choice([" ", "-", "9", "\x00"]).join(r.choices(words, weights, k=r.randrange(0, 40))), lang, source, 0))
    rows += [(5000, None, "none", "x", 0), (5001, "", "none", "y", 0), (5002, "1 2 3", "none", "w", 0), (1000, "foo", "en", "a", 3), (1000, "foo", "en", "a", 3), (None, "foo foo", "en", "a", 3)]
    return rows


@pytest.mark.parametrize("block_terms, wave", [(16_384, 32), (20, 3)])
def test_audit(spark, block_terms, wave):
    rows = table(block_terms)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = divergence.audit(df, block_terms=block_terms, wave=wave)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(r[2] == "term" for r in want) and ("none", "x", "pair", "w", 0, 1) in want


def test_empty_and_clashing(spark):
    df = spark.createDataFrame(table(3, 60), DOCS)
    assert divergence.audit(df.limit(0)).collect() == []
    wide = clashing(df).withColumn("block", F.lit(1)).withColumn("seat", F.lit("x")).withColumn("term", F.lit(2))
    assert sorted(map(tuple, divergence.audit(wide).collect())) == sorted(map(tuple, divergence.audit(df).collect()))


def test_long_texts(spark, monkeypatch):
    """Texts longer than a piece, a term longer than one, and counts passed on in parts."""
    rows = [(i, "alpha BETA " * 120_000 + "x" * (3 << 20), "en", f"s{i % 3}", 0) for i in range(12)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, divergence.audit(df).collect())) == sorted(brute(rows))
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = "ab cd " * 50 + "y" * 100 + " É" * 9
    assert divergence._terms(text.encode()) == Counter(t.encode() for t in TERM.findall(text))


@pytest.mark.parametrize("seats", [2, 20])
def test_every_two_seats_meet_once(spark, seats):
    rounds = spark.range(seats).select(F.col("id").cast("int").alias("seat"), F.lit(seats).alias("seats")).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(seats - 2))))
    met = [tuple(r) for r in rounds.select("round", "seat", divergence.meets(F.col("seat"), F.col("round"), F.col("seats"))).collect()]
    assert Counter((a, b) for _, a, b in met) == Counter((a, b) for a in range(seats) for b in range(seats) if a != b)
    assert all((r, b, a) in set(met) for r, a, b in met)


def test_exact_probabilities():
    """Counts whose product with 10**9 exceeds 64 bits."""
    count = np.array([0, 5, 10**10, 4 * 10**15])
    words, kept = int(count.sum()), len(count)
    assert divergence.probabilities(count, words, kept).tolist() == [1 + 10**9 * (c + 2) // (words + 2 * kept) for c in count.tolist()]
    p, q = np.array([1 + 10**9]), np.array([1])
    assert divergence.divergence(p, q).tolist() == [10**18 // (10**9 + 2)]
    idx, p = np.array([0, 3, 4, 900]), np.array([1, 2, 10**9 + 1, 7])
    assert [x.tolist() for x in divergence._unpacked(divergence._packed(idx, p))] == [idx.tolist(), p.tolist()]
