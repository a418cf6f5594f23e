"""The queries of this subpackage, as __spark_entry__ registers them, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.secrets_sql import OP2_SQL


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.quality_rules import quality_rules

    return quality_rules(_docs(spark, sf_dir)).drop("longest_repeat")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.secrets import scan

    return scan(_docs(spark, sf_dir))


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm.pfor import encode_and_read

    return encode_and_read(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.mixing import mixed

    return mixed(_docs(spark, sf_dir))


def op5_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.nbsvm import scored, train

    docs = _docs(spark, sf_dir)
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.warc import archived

    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lattica.llm.topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.jaccard import joined

    return joined(_docs(spark, sf_dir), k=3, percent=90)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm.bpe import digests

    return digests(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.sa_dedup import deduplicated

    return deduplicated(_docs(spark, sf_dir), length=400)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.divergence import audit

    return audit(_docs(spark, sf_dir))


def op12_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.elkan import clustered

    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10)


def op13_cover_tree_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.cover_tree import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


#: Windows of a text that occur twice: of three words for n_repeat_words, of five for covered_words, of 51 for the longest.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), r AS (
  SELECT row_number() OVER () AS i, * FROM d
), u AS (
  SELECT i, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: {'pos': p, 'words': array_to_string(w[p : p + k - 1], ' ')})) AS x
  FROM r, (VALUES (3), (5), (51)) AS v(k)
), again AS (
  SELECT i, k, x.pos AS pos FROM u QUALIFY count(*) OVER (PARTITION BY i, k, x.words) > 1
), held AS (
  SELECT i, k, count(DISTINCT place) AS n FROM (SELECT i, k, unnest(range(pos, pos + k)) AS place FROM again) GROUP BY i, k
), n AS (
  SELECT i, max(n) FILTER (k = 3) AS n3, max(n) FILTER (k = 5) AS n5, max(n) FILTER (k = 51) AS n51 FROM held GROUP BY i
), c AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(coalesce(n3, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n5, 0) AS BIGINT) AS covered_words, coalesce(n51, 0) AS n51
  FROM r LEFT JOIN n USING (i)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND covered_words <= 0.15 * n_words AND n51 = 0 AS kept, covered_words
FROM b
"""

def _op4_sql(fills: int = 8) -> str:
    """Water-filling in closed form; then first fit in the order of the hash, in steps of what ends at a document that is too large."""
    steps = "".join(
        f""", b{n} AS MATERIALIZED (
  SELECT d.key, hash >> 30 AS bucket, sum(sum(size)) OVER (PARTITION BY d.key ORDER BY hash >> 30) AS total
  FROM d JOIN s{n} USING (key) WHERE left_ > slack AND hash >= begin_ AND size <= most GROUP BY d.key, hash >> 30
), f{n} AS MATERIALIZED (
  SELECT key, left_, begin_, most, coalesce(max(total) FILTER (total <= left_), 0) AS used, min(bucket) FILTER (total > left_) AS over_
  FROM s{n} LEFT JOIN b{n} USING (key) WHERE left_ > slack GROUP BY ALL
), s{n + 1} AS MATERIALIZED (
  SELECT key, (SELECT CASE WHEN copies < 2 THEN target * 0.01e0 ELSE 1e18 END FROM c WHERE c.key = s.key) AS slack, CASE WHEN used IS NULL THEN s.left_ ELSE s.left_ - used END AS left_, CASE WHEN over_ IS NULL THEN 1::BIGINT << 60 ELSE (over_ + 1) << 30 END AS begin_,
    CASE WHEN used IS NULL THEN s.left_ ELSE s.left_ - used END AS most
  FROM s{n} AS s LEFT JOIN f{n} AS f USING (key)
)"""
        for n in range(fills + 1)
    )
    taken = " UNION ALL ".join(f"SELECT key, begin_, coalesce(over_ << 30, 1::BIGINT << 60) AS cut, most FROM f{n}" for n in range(fills + 1))
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS i, doc_id, coalesce('=' || source, '') AS key,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 15) AS BIGINT) AS hash
  FROM documents
), g AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY key = '', encode(key)) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * 2e0 AS cap FROM g
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER before, 0e0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0e0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT key, source_size, least(cap, coalesce((SELECT min_by(level, cap / weight) FROM l WHERE cap >= level * weight) * weight, cap)) AS target FROM l
), c AS MATERIALIZED (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t
), s0 AS MATERIALIZED (
  SELECT key, CASE WHEN copies < 2 THEN -1 ELSE 1e18 END AS slack, target - copies * source_size AS left_, 0::BIGINT AS begin_, 'inf'::DOUBLE AS most FROM c
){steps}, k AS MATERIALIZED ({taken}
), n AS MATERIALIZED (
  SELECT d.*, EXISTS (SELECT 1 FROM k WHERE k.key = d.key AND d.hash >= k.begin_ AND d.hash < k.cut AND d.size <= k.most) AS inside FROM d
), u AS (
  SELECT n.key, hash, sum(size) AS words FROM n JOIN s{fills + 1} AS s USING (key) WHERE NOT inside AND size > 0 AND left_ > slack GROUP BY n.key, hash, left_ HAVING sum(size) < 2 * left_
), e AS (
  SELECT key, min({{'w': words, 'h': hash}}).h AS extra FROM u GROUP BY key
)
SELECT doc_id, size, source_size, target, CAST(size * least(copies + CASE WHEN inside OR hash = extra THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM n JOIN c USING (key) LEFT JOIN e USING (key)
"""


#: Scores by brute force, for the exact search.
OP7_SQL = """
WITH v AS (
  SELECT vec_id, len(embedding) AS dim, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(v.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.dim = v.dim AND q.vec_id <> v.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: sha1() gives hex digits; base32 is spelt out from their bits, five at a time.
OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id,
    list_aggregate(list_transform(range(0, 40), lambda i: CASE substr(hex, i + 1, 1)
      WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011'
      WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111'
      WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011'
      WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END), 'string_agg', '') AS bits
  FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
    + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER)
    + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM g
"""


#: Digests of all windows of 400 bytes; the union of those that occur twice; what is left, by hexadecimal digits.
OP10_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT i, unnest(list_transform(range(0, len(x) // 2 - 399), lambda p: {'p': p, 'h': md5(substr(x, 2 * p + 1, 800))})) AS w FROM d WHERE len(x) >= 800
), r AS (
  SELECT i, w.p AS p FROM w QUALIFY count(*) OVER (PARTITION BY w.h) > 1
), c AS (
  SELECT i, p, sum(CASE WHEN p > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY i ORDER BY p) AS run FROM (SELECT i, p, lag(p, 1, -401) OVER (PARTITION BY i ORDER BY p) AS before FROM r)
), s AS (
  SELECT i, min(p) AS s, max(p) + 400 AS e FROM c GROUP BY i, run
), k AS (
  SELECT i, count(*) AS n_spans, sum(e - s) AS n_removed, list({'s': s, 'e': e} ORDER BY s) AS spans FROM s GROUP BY i
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN spans IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(spans) + 2), lambda j:
    substr(x, CASE WHEN j = 1 THEN 1 ELSE 2 * spans[j - 1].e + 1 END, CASE WHEN j > len(spans) THEN len(x) ELSE 2 * spans[j].s - CASE WHEN j = 1 THEN 0 ELSE 2 * spans[j - 1].e END END)), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (i)
"""

#: All pairs of documents that share a shingle, and a closure over the links.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.m AS component_id
FROM documents AS d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) AS m USING (doc_id)
"""

#: All terms by group, with 0 where a group lacks one; every two groups of a language.
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (SELECT i, lang, source, unnest(terms) AS term FROM d
), k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10
), c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term
), g AS (SELECT DISTINCT lang, source FROM d
), x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, k.n AS all_count FROM g JOIN k ON k.lang = g.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT *, CAST(sum(count) OVER w AS HUGEINT) AS n, count(*) OVER w AS v, CAST(sum(all_count) OVER w AS HUGEINT) AS all_n FROM x WINDOW w AS (PARTITION BY lang, source)
), p AS (
  SELECT lang, source, term, count, 1 + (1000000000::HUGEINT * (count + 2)) // (n + 2 * v) AS p, 1 + (1000000000::HUGEINT * (all_count + 2)) // (all_n + 2 * v) AS q FROM s
), m AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(m.value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE count > 0 AND p > q
), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds spelt out, with every distance; i: vectors, j: centroids, d: components."""
    distances = lambda r: f"SELECT i, j, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS d FROM x JOIN c{r} AS c ON x.d = c.d GROUP BY i, j"
    nearest = lambda r: f"SELECT i, j, d FROM ({distances(r)}) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 1"
    steps = "".join(
        f""", a{r} AS MATERIALIZED ({nearest(r)}), m{r} AS MATERIALIZED (
  SELECT j, x.d, CAST(sum(x.x) AS BIGINT) AS s, count(*) AS n FROM a{r} AS a JOIN x USING (i) GROUP BY j, x.d
), c{r + 1} AS MATERIALIZED (
  SELECT c.j, c.d, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{r} AS c LEFT JOIN m{r} AS m ON m.j = c.j AND m.d = c.d
)"""
        for r in range(rounds)
    )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT i, unnest(range(1, 65)) AS d, unnest(v) AS x FROM v
), o AS (
  SELECT i, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS j FROM v
), c0 AS MATERIALIZED (
  SELECT j, d, x FROM o JOIN x USING (i) WHERE j < {k}
){steps}, a AS MATERIALIZED ({nearest(rounds)}), h AS (
  SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY j
)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a JOIN v USING (i) JOIN h USING (j)
"""


#: All pairs by cosine, and a closure over the links.
OP13_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) AS n,
    coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND vec_id IS NOT NULL, false) AS fine
  FROM embeddings
), l AS MATERIALIZED (
  SELECT a.i AS x, b.i AS y, a.vec_id AS from_id, b.vec_id AS to_id FROM v AS a JOIN v AS b ON a.n = b.n AND a.i <> b.i
  WHERE a.fine AND b.fine AND list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9
), r(i, m) AS (
  SELECT i, vec_id FROM v UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.i
), c AS (SELECT i, min(m) AS m FROM r GROUP BY i
), n AS (SELECT x AS i, count(*) AS n FROM l GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.m AS component_id, coalesce(v.vec_id = c.m, false) AS kept
FROM v JOIN c USING (i) LEFT JOIN n USING (i)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": OP11_SQL, "op12_elkan_clusters": _op12_sql(), "op13_cover_tree_duplicates": OP13_SQL, "op1_quality_rules": OP1_SQL, "op2_secret_scans": OP2_SQL, "op4_mix_sources": _op4_sql(), "op8_ngram_jaccard": OP8_SQL, "op6_warc_normaliser": OP6_SQL, "op7_ball_tree_top_k": OP7_SQL, "op10_suffix_array_dedup": OP10_SQL}
