"""Operators on Spark, against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lattica.llm import bpe, components, jaccard, mixing, nbsvm, pfor, quality_rules, sa_dedup, secrets, shared, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, rows = prose(90), []
    for i in range(n):
        text = prose(r.randrange(1, 200))
        if i % 7 == 1:
            text = f"{text}\n{passage}\n{prose(20)}"
        if i % 5 == 2 and rows:
            text = rows[-1][1] or ""
        if i % 6 == 3 and rows and rows[-1][1]:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "edited"
            text = " ".join(words)
        rows.append((i, text, "en", r.choice(["b", "a", "c", "é"]), len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, "\n \t", "en", "a", 3), (n + 3, "two words", "en", None, 9), (n + 4, "x" * 50_000, "en", "zero", 50_000), (n + 5, "Two Words", "en", "a", 9)]
    rows.append((n + 6, 'key token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" end', "en", "b", 58))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_rules(docs, nothing):
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(rows) == docs.count()
    for i, text, *_ in documents():
        words = WORD.findall(text or "")
        r = rows[i]
        assert r["n_words"] == len(words)
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
        assert r["kept"] == (not r["base_failed"] and r["covered_words"] <= 0.15 * len(words) and r["longest_repeat"] <= 50)
    assert quality_rules.quality_rules(nothing).count() == 0


def test_secrets(docs, nothing):
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    last = documents()[-1]
    assert (got[last[0]]["n_assign"], got[last[0]]["n_hex"], got[last[0]]["n_entropy"]) == (1, 1, 1)
    base = ",".join(x for x in got[last[0]]["spans"].split(",") if not x.startswith("entropy"))
    assert got[last[0]]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    clean = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    for i, text, lang, source, n in documents():
        if i == last[0]:
            assert clean[i]["text"] == "key [REDACTED] end"[:14] + '" end' and clean[i]["n_chars"] == len(clean[i]["text"])
        else:
            assert tuple(clean[i]) == (i, text, lang, source, n)
    assert secrets.scan(nothing).count() == 0 and secrets.redact(nothing).columns == nothing.columns


def test_redaction_of_a_secret_behind_a_hex_id(spark):
    token = "kX9vQ2mZ7LpR4tWc8NfYb3HsJd6GaUe1TiKoVx5M"
    rows = [(i, f"see {before}{token}{after} twice {before}{token}{after}") for i, (before, after) in enumerate([("deadbeef" * 4 + "_", ""), ("0a1b2c3d" * 4 + "/", "=="), ("", "_example"), ("id=", "")])]
    for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert "[REDACTED]" in r["text"] and token[8:32] not in r["text"] and r["text"].startswith("see ") and " twice " in r["text"]


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)


def test_mixing(spark, docs, nothing):
    rows = mixing.mixed(docs).collect()
    source = {i: s for i, _, _, s, _ in documents()}
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in documents()}
    sums = collections.Counter()
    for i in size:
        sums[source[i]] += size[i]
    target, taken = brute_targets(sums), collections.Counter()
    assert len(rows) == len(size)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    # off by the slack, or by half of the smallest document that is left
    for s in sums:
        untaken = [r["size"] for r in rows if source[r["doc_id"]] == s and 0 < r["size"] and r["taken"] <= r["size"] * (target[s] // max(1, sums[s]))]
        assert abs(taken[s] - target[s]) <= max(mixing.SLACK * target[s], min(untaken, default=0) / 2) + 1e-6, s
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == sorted(map(tuple, rows))
    copies = collections.Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in rows)
    assert mixing.mixed(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_mixing_fills_behind_large_documents(spark):
    """Sources of a few very different documents, copies and rows of one id among them, against first fit in the hash's order."""
    r = random.Random(4)
    rows = [(i, "w " * r.choice([1, 2, 3, 5, 8, 60, 700, 2000]), "en", f"s{i % 5}", 0) for i in range(120)]
    rows += [(7, "w " * 50, "en", "s2", 0), (7, "w " * 50, "en", "s2", 0), (None, "w " * 9, "en", "s1", 0), (None, "w", "en", "s1", 0)]
    got = mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()
    by = collections.defaultdict(list)
    for x, (i, text, _, source, _) in zip(sorted(got, key=lambda x: (str(x["doc_id"]), x["size"])), sorted(rows, key=lambda x: (str(x[0]), x[1].count("w")))):
        assert (x["doc_id"], x["size"]) == (i, text.count("w"))
        by[source].append(x)
    for source, own in by.items():
        target, total = own[0]["target"], own[0]["source_size"]
        key = lambda x: int(hashlib.md5(f"{'' if x['doc_id'] is None else x['doc_id']}:mix".encode()).hexdigest()[:15], 16)
        copies = int(target // total)
        left, first, inside = target - copies * total, True, set()
        for h in sorted({key(x) for x in own}):
            some = [j for j, x in enumerate(own) if key(x) == h]
            if first or left > mixing.SLACK * target:
                words = sum(own[j]["size"] for j in some)
                if words <= left:
                    inside |= set(some)
                    left -= words
                else:
                    first = False
        assert abs(sum(x["taken"] for x in own) - target) <= abs(left) + mixing.SLACK * target, source


def test_mixing_runs_no_python(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_bpe_and_blocks(spark, docs, nothing):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken
    from tokenizers import Tokenizer

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.digests(docs, P.path("byte_bpe_multi_50k.tiktoken")).collect()}
    for i, text, *_ in documents():
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    manifest = pfor.write_shards(docs, P.path("word_bpe_49k.json"), shared.new_folder(spark, "t"), 1, 20, 500)
    assert manifest.select("shard").distinct().count() > 2 and manifest.where("part > 1").count() > 2
    start = 0
    read = {r["doc_id"]: r for r in pfor.read_shards(manifest).collect()}
    for i, text, *_ in sorted(documents()):
        ids = np.array(words.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert tuple(read[i])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert pfor.encode_and_read(nothing, P.path("word_bpe_49k.json")).count() == 0
    twice = spark.createDataFrame([(None, "b"), (5, "x"), (5, "x"), (None, "a")], "doc_id long, text string")
    assert [r["doc_id"] for r in pfor.encode_and_read(twice, P.path("word_bpe_49k.json")).orderBy("start").collect()] == [None, None, 5, 5]


def test_classifier(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = nbsvm.train(docs, labels)
    rows = {r["doc_id"]: r for r in nbsvm.scored(docs, model).collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    assert nbsvm.train(docs, labels.limit(0)) is None and nbsvm.train(nothing, labels) is None
    assert {r["score"] for r in nbsvm.scored(docs, None).collect()} == {0.5}
    kept = {r["doc_id"] for r in nbsvm.scored(docs, model, keep=0.5).collect()}
    assert kept == {i for i, r in rows.items() if r["score"] >= 0.5}


def test_warc(spark):
    html = ["<p>a</p>", "", None, "<p>é</p>", "<p>a</p>", "", "<p>a</p>"]
    pages = spark.createDataFrame([(7 - i, f"http://h/{i}" if i else None, h) for i, h in enumerate(html)] + [(None, "u", "<p>é</p>"), (1, "u", "<p>a</p>")], "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archived(pages).collect()), key=str)
    want = [(7, "revisit", 1, 8), (6, "revisit", 2, 0), (5, "revisit", 2, 0), (4, "response", None, 9), (3, "revisit", 1, 8), (2, "response", None, 0), (1, "response", None, 8), (0, "revisit", 4, 9), (1, "response", None, 8)]
    assert got == sorted(want, key=str)
    assert warc.archived(pages.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(240, 5)).astype("float32")
    vectors[50:120] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 5), (1003, [float("inf")] * 5), (1020, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    q = np.floor(64 * vectors.astype("float64")).astype(np.int64)
    for sizes in ((1000, 1000), (40, 3)):
        got = collections.defaultdict(list)
        for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20, 64, *sizes).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        assert set(got) == set(range(0, 240, 20))
        for i, found in got.items():
            want = sorted((-int(q[j] @ q[i]), j) for j in range(240) if j != i)[:20]
            assert found == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_components(rows, k, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall((text or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(spark, docs, nothing):
    r = random.Random(9)
    base = ["w%d" % r.randrange(500) for _ in range(120)]
    near = []
    for i in range(50):  # a chain of near copies: neighbours link, ends don't
        base[r.randrange(len(base))] = f"e{i}"
        near.append((1000 + i, " ".join(base), "en", "a", 0))
    rows = documents() + near
    for k, percent in ((3, 90), (5, 80)):
        df = spark.createDataFrame(rows, DOCS)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.joined(df, k, percent).collect()}
        want = brute_components(rows, k, percent)
        assert got == want
    kept = {x["doc_id"] for x in jaccard.deduplicated(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}
    assert jaccard.joined(nothing).count() == 0


def test_jaccard_in_many_waves(spark, monkeypatch):
    """Keys of many classes, most of which don't link: pivots grow by two, so several waves are needed."""
    monkeypatch.setattr(jaccard, "WIDER", 2)
    r = random.Random(12)
    common = [f"c{i}" for i in range(18)]
    rows = []
    for group in range(14):
        own = [f"g{group}w{r.randrange(10**6)}" for _ in range(2)]
        for copy in range(4):
            text = [*common, *own, *([f"x{group}"] if copy % 2 else [])]
            rows.append((group * 10 + copy, " ".join(text[copy // 2 :]), "en", "a", 0))
    for k, percent in ((3, 90), (2, 70)):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.joined(spark.createDataFrame(rows, DOCS), k, percent).collect()}
        assert got == brute_components(rows, k, percent)
    assert len({c for _, c in got.values()}) < 56


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(300, i) for i in range(200, 240)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def brute_removal(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = {}
    for (i, *_), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [256, 1])
def test_suffix_array_dedup(spark, nothing, most):
    """With groups of one class at most, every group is split until its windows are alone."""
    rows = [x if x[0] != 64 else (64, "x" * 2_000, *x[2:]) for x in documents(n=40)] + [(900, "q" * 39, "en", "a", 39), (901, "ab" * 200, "en", "a", 400)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in sa_dedup.deduplicated(df, 40, most).collect()}
    assert got == brute_removal(rows, 40)
    assert sa_dedup.deduplicated(nothing, 40, most).count() == 0


def test_hot_keys_are_looked_up(spark):
    left = spark.createDataFrame([(1 if i < 900 else i, i) for i in range(3000)], "k long, v long")
    from pyspark.sql import functions as F

    table = left.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.min("v").alias("least"))
    got = {r["v"]: r["least"] for r in shared.lookup(left, ["k"], table, 3000).collect()}
    assert len(got) == 3000 and got[5] == 0 and got[2000] == 2000


def test_bitmap_loses_nothing(spark):
    from pyspark.sql import functions as F

    keys = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("h"))
    found = keys.toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    for most in (27, 12, 6):
        bits, words = shared.low_bits_bitmap(keys, "h", most)
        assert bits <= most and shared.in_bitmap(words, found & np.uint64((1 << bits) - 1)).all()


def brute_mix(rows):
    """How often the mix takes each document of unique ids: first fit in the order of the hash, in fills, then the nearest."""
    by = collections.defaultdict(list)
    for i, text, _, source, _ in rows:
        by[source].append((int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:15], 16), len(WORD.findall(text or "")), i))
    sizes = {s: sum(n for _, n, _ in own) for s, own in by.items()}
    target, times = brute_targets(sizes), {}
    for s, own in by.items():
        copies = int(target[s] // sizes[s]) if sizes[s] else 0
        left, slack, most, fills, inside, full = target[s] - copies * sizes[s], mixing.SLACK * target[s], float("inf"), 0, set(), copies >= 2
        for _, n, i in sorted(own):
            if n <= most and fills <= mixing.FILLS and not full:
                if n <= left:
                    left -= n
                    inside.add(i)
                else:  # a fill ends behind what is too large
                    most, fills, full = left, fills + 1, left <= slack
        rest = sorted((n, h, i) for h, n, i in own if i not in inside and 0 < n < 2 * left)
        if rest and left > slack and copies < 2:
            inside.add(rest[0][2])
        times |= {i: min(2, copies + (i in inside)) for _, _, i in own}
    return times


def test_pipeline(spark, tmp_path):
    """Every stage of the chain against brute force over what its predecessor left."""
    P = pytest.importorskip("public_tokenizers")
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import tiktoken

    r = random.Random(8)
    key = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    rows = [(i, f"{text} id_{key()} password = {key()[:9]}" if text and i % 4 == 0 else text, lang, source, n) for i, text, lang, source, n in documents(n=200)]
    rows = [(i, text, lang, source, len(text) if text is not None else None) for i, text, lang, source, _ in rows]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, checked = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, shared.written(stage(spark, docs, str(tmp_path)), name)
        old, new = ([tuple(x) for x in df.collect()] for df in (before, docs))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        if name == "quality_classifier":
            scores = {x["doc_id"]: x["score"] for x in nbsvm.scored(before, nbsvm.train(before, labels)).collect()}
            want = [x for x in old if scores[x[0]] >= 0.7]
            assert 0 < len(want) < len(old)
        elif name == "near_duplicates":
            part = brute_components(old, 5, 80)
            want = [x for x in old if part[x[0]][1] == x[0]]
        elif name == "secret_scans":
            want = []
            for i, text, lang, source, n in old:
                hidden = set()
                for a, b, _ in secrets.find(text or ""):
                    hidden |= set(range(a, b))
                clean = None if text is None else "".join("[REDACTED]" if j in hidden and j - 1 not in hidden else "" if j in hidden else c for j, c in enumerate(text))
                want.append((i, clean, lang, source, len(clean) if hidden else n))
            assert any("[REDACTED]" in (x[1] or "") for x in want)
        elif name == "mix_sources":
            times = brute_mix(old)
            want = [x for x in old for _ in range(times[x[0]])]
        else:
            want = [(i, library.encode_ordinary(text or "")) for i, text, *_ in old]
        assert sorted(map(str, new)) == sorted(map(str, want)), name
        checked.append(len(new))
    assert min(checked) > 20


def test_jaccard_of_one_id_with_two_texts(spark):
    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    one, other = words(60), words(400)
    near = [*one[:59], "changed"]
    rows = [(7, " ".join(one)), (7, " ".join(other)), (9, " ".join(near))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    roots = {(x["doc_id"], x["n_shingles"]): x["component_id"] for x in jaccard.joined(table, 3, 90).collect()}
    assert roots[(9, 58)] == 7
    kept = jaccard.deduplicated(table, 3, 90).collect()
    assert sorted(x["text"] for x in kept) == sorted(x[1] for x in rows[:2])
