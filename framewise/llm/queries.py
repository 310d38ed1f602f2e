"""The numbered operators as registered queries over the given tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import audit, bpe, convtrie, decontaminate, langid, lattice, linededup, mixing, quality, runindex, simhash, topk, urlfilter
from framewise.session import cut_lineage, read_table

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return rows.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = cut_lineage(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")))
    m = mixing.mix(sized, size_col="words", weights=(5, 2, 1), share=1.5, max_epochs=2)
    return m.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(read_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = cut_lineage(topk.binary_codes(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    found = topk.search(codes, codes.where(F.col("id") % 100 == 0), k=10)
    return found.select(F.col("query_id"), "rank", F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.removal_report(read_table(spark, sf_dir, "documents"), length=50)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, by source."""
    return audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with its members and what sharing it saves."""
    return convtrie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word passages of the benchmark."""
    found = decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        "contaminated")


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_mix_sources, op3_bpe, op4_language_id, op5_line_dedup,
                                   op6_url_filter, op7_topk_search, op8_embedding_near_dedup,
                                   op9_suffix_dedup, op10_quality, op11_filter_audit, op12_conversation_trie,
                                   op13_decontaminate)}

WORDS_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

ORACLE = {
    "op2_mix_sources": f"""
WITH d AS (SELECT doc_id, source, CAST({WORDS_SQL} AS BIGINT) AS size, md5('mix:' || doc_id) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS cap,
        CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, row_number() OVER r AS k, coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_caps,
        sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_weight
      FROM w WINDOW r AS (ORDER BY CAST(cap AS DOUBLE) / weight, source)),
l AS (SELECT min_by((1.5 * (SELECT sum(source_size) FROM s) - full_caps) / free_weight, k) AS level FROM o
      WHERE cap > (CAST(1.5 * (SELECT sum(source_size) FROM s) AS DOUBLE) - full_caps) / free_weight * weight),
t AS (SELECT source, source_size, least(weight * CAST((SELECT level FROM l) AS DOUBLE), CAST(cap AS DOUBLE)) AS target FROM w),
p AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p),
x AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS need,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
y AS (SELECT *, CAST(epochs * size + greatest(0, least(size, need - start)) AS BIGINT) AS taken FROM x)
SELECT doc_id, size, source_size, target, taken, source,
       CAST(CASE WHEN size > 0 THEN (2 * taken + size) // (2 * size) ELSE epochs + CASE WHEN start < need THEN 1 ELSE 0 END END AS BIGINT) AS copies
FROM y""",
    "op6_url_filter": r"""
WITH u AS (SELECT page_id,
             translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op11_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
      FROM w LEFT JOIN l USING (doc_id)),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
      WHERE length(replace(replace(replace(replace(replace('ABCDE', a.f, ''), b.f, ''), c.f, ''), d.f, ''), e.f, '')) = 0),
s AS (SELECT filter_order, step, substring(filter_order, step, 1) AS f, '[' || substring(filter_order, 1, step - 1) || '_]' AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
r AS (SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER (NOT contains(fails, f) AND NOT regexp_matches(fails, before)), 0) AS kept,
        coalesce(sum(n) FILTER (contains(fails, f) AND NOT regexp_matches(fails, before)), 0) AS removed,
        coalesce(sum(n) FILTER (contains(fails, f) AND regexp_matches(fails, before)), 0) AS redundant,
        coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
        coalesce(sum(good) FILTER (contains(fails, f) AND NOT regexp_matches(fails, before)), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (contains(fails, f) AND NOT regexp_matches(fails, before)), 0) AS toxic_lost
      FROM g, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
    "op12_conversation_trie": r"""
WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), sha256(coalesce(text, ''))) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
bit AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS crc FROM t
      UNION ALL
      SELECT c, s, k + 1, CASE WHEN b & 1 = 1 THEN xor(b >> 1, CAST(3988292384 AS BIGINT)) ELSE b >> 1 END
      FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(crc, CAST(ascii(substring(s, CAST(k // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE crc END AS b
            FROM bit WHERE k < 8 * length(s))),
h AS (SELECT c, c - c % 20 AS base, xor(crc, CAST(4294967295 AS BIGINT)) % 4 AS h FROM bit WHERE k = 8 * length(s)),
r AS (SELECT h.c, 0 AS part, pos, role, text FROM h JOIN t ON t.c = h.base WHERE pos < h
      UNION ALL SELECT h.c, 1, pos, role, text FROM h JOIN t ON t.c = h.c WHERE pos >= h),
p AS (SELECT h.c, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY part, pos) FILTER (part IS NOT NULL), []) AS path,
        coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY part, pos) FILTER (part IS NOT NULL), []) AS words
      FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
m AS (SELECT c, d, len(path) AS n, array_to_string(path[1:d], '') AS prefix, array_to_string(path[1:d - 1], '') AS parent,
        CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM p)),
n AS (SELECT d, prefix, CASE WHEN d > 0 THEN any_value(parent) END AS parent, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(w) AS own,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM m GROUP BY d, prefix),
k AS (SELECT parent, count(*) AS kids FROM n WHERE d > 0 GROUP BY parent),
v AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON k.parent = n.prefix),
s AS (SELECT a.prefix, count(*) FILTER (b.kids = 0) AS leaves, sum(b.own) AS saved
      FROM v a JOIN v b ON b.d >= a.d AND starts_with(b.prefix, a.prefix) GROUP BY a.prefix)
SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, q.c AS parent_conv_id, CAST(v.n AS BIGINT) AS n_convs, CAST(v.kids AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN s ON s.prefix = v.prefix LEFT JOIN n q ON v.d > 0 AND q.d = v.d - 1 AND q.prefix = v.parent""",
    "op13_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS passage
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT x.row, x.i, p.m, p.item
      FROM (SELECT row, i, m, array_to_string(w[i:i + m - 1], ' ') AS passage
            FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)) x
      JOIN p ON p.m = x.m AND p.passage = x.passage),
h AS (SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS word FROM o) GROUP BY row),
k AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM o) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN k USING (row)""",
}
