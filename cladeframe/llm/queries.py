"""Queries opN_* of the corpus operators over the standard tables, and their SQL where there is one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloomlm, bpe, decontam, langid, licenses, minhash, rules, tokenfile, toxicity, urls
from .common import fold, table, written


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file: the folder in CLADEFRAME_TOKENIZERS, or the installed package's."""
    folder = os.environ.get("CLADEFRAME_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.train_fold(docs))
    out = langid.predict(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenfile.write_tokens(docs, tokenizer_path("word_bpe_49k.json"), tokenfile.fresh_path(spark), end_id=2)
    return tokenfile.digest(tokenfile.read_tokens(spark, path))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(rules.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "quality-statistics")
    found = rules.fit(stats, table(spark, sf_dir, "labels"))
    out = rules.judge(stats, found)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bloomlm.score(docs, docs.where(fold("doc_id", 7) != 2))
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = fold("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learned), table(spark, sf_dir, "labels").where(learned))
    out = toxicity.score(docs, model)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch time, so one day of 2024 follows from the page id; the dated list is made
    by rule from the pages' hosts and their first path segments, beside one advertising domain."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    pages = pages.withColumn("fetched", day.cast("timestamp"))
    return urls.filter_urls(pages, dated_list(pages))


def dated_list(pages: DataFrame) -> DataFrame:
    """Dated entries (key, category, action, effective) for the hosts and host/segments of ``pages``."""
    h, s = F.coalesce(urls.host(F.col("url")), F.lit("")), F.coalesce(urls.segment(F.col("url")), F.lit(""))
    seen = pages.select(h.alias("h"), s.alias("s")).where("h <> ''")
    names = seen.select(F.col("h").alias("key")).union(seen.where("s in ('en', 'de', 'fr', 'es')").select(F.concat("h", F.lit("/"), "s"))).distinct()
    code = F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int")
    names = names.withColumn("code", code).where(F.col("code") % 5 < 2)
    day = lambda n: F.date_add(F.lit("2023-12-01").cast("date"), n).cast("timestamp")
    turn = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), (F.col("code") % 211 + n).alias("n")) for a, n in (("add", 0), ("remove", 47), ("add", 120))]))
    category = F.when(F.col("code") % 3 == 0, "adult").when(F.col("code") % 3 == 1, "malware").otherwise("spam")
    made = names.select("key", category.alias("category"), turn.alias("t")).select("key", "category", "t.action", day(F.col("t.n")).alias("effective"))
    ads = pages.sparkSession.range(1).select(F.lit("ads-track.example.com").alias("key"), F.lit("ads").alias("category"), F.lit("add").alias("action"), day(F.lit(91)).alias("effective"))
    return made.union(ads)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = licenses.scan(docs, licenses.fit(docs))
    return out.select("doc_id", "n_paragraphs", "n_predicted", "n_confirmed", "family", F.array_join("families", ",").alias("families"), "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.find_benchmark(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_token_files, op3_bpe, op4_quality_rules, op5_bloom_lm, op6_toxicity,
        op7_url_filter, op8_jaccard_join, op9_license_scan, op10_decontamination, pipeline,
    )
}

_OP7 = r"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS TIMESTAMP) AS fetched,
    coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS h,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1), '') AS s
  FROM pages),
names AS (
  SELECT h AS key FROM p WHERE h <> '' UNION SELECT h || '/' || s FROM p WHERE h <> '' AND s IN ('en', 'de', 'fr', 'es')),
coded AS (SELECT key, CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) AS code FROM names),
entries AS (
  SELECT key, CASE code % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'spam' END AS category, t.action,
    CAST(DATE '2023-12-01' + (code % 211 + t.n) AS TIMESTAMP) AS effective
  FROM coded, (VALUES ('add', 0), ('remove', 47), ('add', 120)) t(action, n) WHERE code % 5 < 2
  UNION ALL SELECT 'ads-track.example.com', 'ads', 'add', CAST(DATE '2023-12-01' + 91 AS TIMESTAMP)),
spans AS (
  SELECT key, category, effective AS valid_from, action,
    lead(effective) OVER (PARTITION BY key, category ORDER BY effective) AS valid_to FROM entries),
asked AS (
  SELECT page_id, fetched, h, s, list_concat(
      list_transform(range(1, greatest(2, len(string_split(h, '.')))), lambda k: array_to_string(string_split(h, '.')[k:], '.')),
      CASE WHEN s <> '' THEN [h || '/' || s] ELSE [] END) AS keys FROM p WHERE h <> ''),
active AS (
  SELECT a.page_id, a.fetched, a.h, a.s, x.key, x.category, x.valid_from
  FROM (SELECT DISTINCT page_id, fetched, h, s, unnest(keys) AS key FROM asked) a JOIN spans x ON a.key = x.key
  WHERE x.action = 'add' AND x.valid_from <= a.fetched AND (x.valid_to IS NULL OR a.fetched < x.valid_to)),
best AS (
  SELECT *, count(*) OVER (PARTITION BY page_id, h, s) AS n_active,
    row_number() OVER (PARTITION BY page_id, h, s ORDER BY length(key) DESC, key, category, valid_from) AS rn FROM active)
SELECT p.page_id, p.fetched, b.page_id IS NOT NULL AS blocked, coalesce(b.n_active, 0) AS n_active,
  b.key AS list_key, b.category, b.valid_from AS listed_since
FROM p LEFT JOIN best b ON p.page_id = b.page_id AND p.h = b.h AND p.s = b.s AND b.rn = 1
"""

_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w WHERE len(w) > 0),
classes AS (SELECT s, md5(array_to_string(s, chr(10))) AS k, min(doc_id) AS copy_id, count(*) AS n_copies FROM sets GROUP BY s),
items AS (SELECT copy_id, len(s) AS n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.copy_id AS x, b.copy_id AS y FROM items a JOIN items b ON a.g = b.g AND a.copy_id <> b.copy_id
  GROUP BY a.copy_id, b.copy_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach AS (SELECT copy_id AS x, copy_id AS y FROM classes UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
grp AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS n_links FROM pairs GROUP BY x)
SELECT d.doc_id, coalesce(g.class_id, d.doc_id) AS class_id, coalesce(e.n_links, 0) AS n_links,
  coalesce(c.copy_id, d.doc_id) AS copy_id, coalesce(c.n_copies, 1) AS n_copies
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN classes c ON s.s = c.s
LEFT JOIN grp g ON g.x = c.copy_id LEFT JOIN deg e ON e.x = c.copy_id
"""

_OP10 = r"""
WITH t AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents
  UNION ALL SELECT 'i', CAST(item_id AS VARCHAR), NULL, text FROM benchmark),
w AS (
  SELECT kind, id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM t),
sizes AS (SELECT DISTINCT least(10, len(w)) AS k FROM w WHERE kind = 'i' AND len(w) > 0),
pats AS (
  SELECT DISTINCT id AS item, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i+least(10, len(w))-1], ' '))) AS p
  FROM w WHERE kind = 'i' AND len(w) > 0),
wins AS (
  SELECT w.doc_id, s.k, unnest(range(1, len(w.w) - s.k + 2)) AS i, unnest(list_transform(range(1, len(w.w) - s.k + 2), lambda i: array_to_string(w.w[i:i+s.k-1], ' '))) AS p
  FROM w, sizes s WHERE kind = 'd' AND len(w.w) >= s.k),
hits AS (SELECT wins.doc_id, wins.k, wins.i, pats.item FROM wins JOIN pats ON wins.p = pats.p AND wins.k = pats.k),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
  sha256(coalesce(f.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id) WHERE kind = 'd'
"""

ORACLE_SQL = {"op7_url_filter": _OP7, "op8_jaccard_join": _OP8, "op10_decontamination": _OP10}
