"""The subpackage's queries over the driver's tables, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.llm import (
    byte_bpe,
    decontaminate,
    html_text,
    jaccard_join,
    line_dedup,
    periodic_runs,
    phrase_prints,
    quality,
    substring_dedup,
    suffix_dedup,
    token_shards,
    url_filter,
    whitening,
)
from tidemeter.llm.memo import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RANKS = "byte_bpe_50k.tiktoken"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf}/{table}.parquet")


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


@query
def op1_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(read(spark, sf, "pages"))


@query
def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf, "documents"), size=20)


@query
def op3_token_shards(spark: SparkSession, sf: str) -> DataFrame:
    return token_shards.materialised(read(spark, sf, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, seed=20260101)


@query
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf, "documents"))


@query
def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf, "documents"), size=4, num=85, den=100)


@query
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.judged(read(spark, sf, "documents"), base=True)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"),
                        "kept", "p_good", *[c for c in found.columns if c.startswith("vote_")])


@query
def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.encode_documents(read(spark, sf, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


#: (verdict, host and path)
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query
def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The list holds the pages that copy an earlier page's article; no name of a host, nor anything else in a page's own URL, decides it."""
    pages = read(spark, sf, "pages")
    return url_filter.judge(pages, URL_RULES, url_filter.later_copies(pages))


oracle("op8_url_filter", f"""
WITH p AS (
  SELECT page_id, url, CASE WHEN contains(html, '</article>') AND contains(split_part(html, '</article>', 1), '<article')
      THEN split_part(split_part(html, '</article>', 1), '<article', -1) END AS article,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^.*?://[^?#]*\\?([^#]*)', 1, 's'), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_.*|ref=.*)', 's'))) AS query
  FROM pages),
n AS (
  SELECT page_id, host, path, article, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www\\.|m\\.)+', '')
    || regexp_replace(path, '(\\.html|/)$', '', 's') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS name
  FROM p),
listed AS (SELECT DISTINCT name FROM n JOIN (SELECT article, min(page_id) AS earliest FROM n GROUP BY article) USING (article) WHERE page_id > earliest AND name IS NOT NULL),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{t}', '{t[:t.index('/')]}', '{t[t.index('/'):]}')" for v, t in URL_RULES)}) AS r(verdict, rule, rule_host, rule_path)),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rules.verdict, length(rule)) AS said
  FROM n JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT n.page_id, host, path, rule, coalesce(said, CASE WHEN l.name IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.name IS NOT NULL AS listed
FROM n LEFT JOIN fits USING (page_id) LEFT JOIN listed l ON n.name = l.name""")


@query
def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.benchmark_hits(read(spark, sf, "documents"), read(spark, sf, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf, "documents"), size=50)


@query
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = periodic_runs.with_periodic_tails(read(spark, sf, "documents"))
    return periodic_runs.periodic_runs(docs, min_length=12).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query
def op12_phrase_prints(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_prints.with_edited(read(spark, sf, "documents"))


@query
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(read(spark, sf, "embeddings"))
