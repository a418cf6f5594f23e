"""All ten operators and all stages on awkward tables: extra columns with clashing names, nulls, repeats, nothing, long texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import bpe, jaccard, mixing, nbsvm, pfor, quality_rules, sa_dedup, secrets, topk, warc
from tests.llm.test_queries import DOCS, WORD, brute_components, brute_removal, documents

#: Names that operators use themselves, as columns of the input.
CLASHING = ["_hot", "_copies", "_cut", "_source", "_copy", "_sha", "a", "b", "anchor", "bit", "bucket", "cls", "copies", "cut", "data", "doc", "first_id", "h1", "h2", "hash", "ids", "key", "label", "left", "n", "n_rows", "own", "page", "part", "refers_to", "region", "root", "row", "score", "shard", "size", "target", "th", "times", "token", "v", "dim", "with space", "dotted.name"]


def paths():
    return pytest.importorskip("public_tokenizers").path


def trained(docs):
    labels = docs.sparkSession.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    return nbsvm.train(docs, labels)


OPERATORS = {
    "quality_rules": lambda d: quality_rules.quality_rules(d),
    "secrets": lambda d: secrets.scan(d),
    "token_blocks": lambda d: pfor.encode_and_read(d, paths()("word_bpe_49k.json")),
    "mixed": lambda d: mixing.mixed(d),
    "classifier": lambda d: nbsvm.scored(d, trained(d)),
    "jaccard": lambda d: jaccard.joined(d, 3, 90),
    "bpe": lambda d: bpe.digests(d, paths()("byte_bpe_multi_50k.tiktoken")),
    "suffix_arrays": lambda d: sa_dedup.deduplicated(d, 60),
}
STAGES = {
    "kept": lambda d: nbsvm.scored(d, trained(d), keep=0.3),
    "deduplicated": lambda d: jaccard.deduplicated(d),
    "redacted": lambda d: secrets.redact(d),
    "mix": lambda d: mixing.mix(d),
}


@pytest.fixture(scope="module")
def awkward(spark):
    rows = documents(seed=5, n=40)
    rows += [rows[3], rows[3], rows[8], (None, "text of no id " * 9, None, None, None), (None, None, None, None, None), (7, "another text of the id", "en", "a", 22)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def clashing(df):
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING if c not in df.columns))


def sorted_rows(df, columns):
    return sorted(map(tuple, df.select(*(F.col(f"`{c}`") for c in columns)).collect()), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_ignore_extra_columns(awkward, name):
    want = OPERATORS[name](awkward)
    got = OPERATORS[name](clashing(awkward))
    assert got.columns == want.columns
    rows = sorted_rows(want, want.columns)
    assert sorted_rows(got, want.columns) == rows and len(rows) == awkward.count()
    assert OPERATORS[name](clashing(awkward.limit(0))).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_extra_columns(awkward, name):
    wide = clashing(awkward)
    got = STAGES[name](wide)
    assert got.columns == wide.columns
    assert sorted_rows(got, awkward.columns) == sorted_rows(STAGES[name](awkward), awkward.columns)
    assert all(r[c] == f"own {c}" for r in got.collect() for c in CLASHING)
    assert STAGES[name](wide.limit(0)).count() == 0


def test_pipeline_on_nothing(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    paths()
    for n in (0, 3):  # without documents, then without labels
        folder = tmp_path / str(n)
        spark.createDataFrame(documents(n=n)[:n], DOCS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(folder))
            assert docs.count() == 0, name
        assert docs.columns == ["doc_id", "ids"]


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "u", "<p>"), (2, None, "<p>"), (2, None, "<p>"), (None, "u", None), (3, "u", "")], "page_id long, url string, html string")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted_rows(warc.archived(clashing(pages)), columns) == sorted_rows(warc.archived(pages), columns)
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(60, 4)))]
    rows += [rows[0], rows[0], rows[5], rows[5], (None, rows[1][1]), (20, [9.0, 9.0, 9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = F.col("vec_id") % 20 == 0
    found = sorted_rows(topk.top_k(vectors, asked, 20, 64, 20, 2), ["query_id", "rank", "vec_id", "score"])
    assert found == sorted_rows(topk.top_k(clashing(vectors), asked, 20, 64, 1000, 1000), ["query_id", "rank", "vec_id", "score"])
    assert [x[:2] for x in found] == sorted(((q, k) for q in (0, 20, 40) for k in range(1, 21)), key=str)
    # the row twice is one query, and two candidates
    mine = [x[2] for x in found if x[0] == 0]
    assert 0 not in mine and mine.count(5) in (0, 2)


def test_very_long_texts(spark):
    P = paths()
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    long, longer = prose(240_000), prose(500_000)
    assert len(long) > 1 << 20 and len(longer) > 1 << 21
    rows = [(1, long), (2, long + " one more word"), (3, prose(30) + longer[-3000:]), (4, longer), (5, None), (6, "tail token=abcdef123 " + "q" * (1 << 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    by_id = lambda df: {x["doc_id"]: x for x in df.collect()}
    got = by_id(quality_rules.quality_rules(df)), by_id(secrets.scan(df)), by_id(pfor.encode_and_read(df, P("word_bpe_49k.json")))
    bytes_ = by_id(bpe.digests(df, P("byte_bpe_multi_50k.tiktoken")))
    ranks = bpe.read_ranks(P("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = Tokenizer.from_file(P("word_bpe_49k.json"))
    start = 0
    for i, text in rows:
        text = text or ""
        found = WORD.findall(text)
        assert (got[0][i]["n_words"], got[0][i]["word_chars"]) == (len(found), sum(map(len, found)))
        assert got[1][i]["n_assign"] == (i == 6)
        ids = np.array(words.encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert tuple(got[2][i])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert tuple(bytes_[i])[1:] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    part = brute_components(rows, 3, 90)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.joined(df, 3, 90).collect()} == part and part[2][1] == 1
    assert {x["doc_id"]: tuple(x)[1:] for x in sa_dedup.deduplicated(df, 400).collect()} == brute_removal(rows, 400)


def test_classifier_takes_no_more_features_than_it_may(spark, awkward):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert nbsvm.train(awkward, labels, most_features=5) is None
    some, all_ = nbsvm.train(awkward, labels, most_features=6000), nbsvm.train(awkward, labels)
    assert some is not None and not np.array_equal(some.ratio, all_.ratio)
