"""The ten queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, license, linededup, pii, quality, simhash, toxicity, urlfilter, warc
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_documents(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", F.col("clean").alias("text"), "n_removed_lines", "n_removed_chunks")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(quality.ledger(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_bpe, op2_pii, op3_simhash, op4_license, op5_decontamination, op6_warc, op7_toxicity, op8_line_dedup, op9_url_filter, op10_quality)
    return {f.__name__: f for f in found}


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS response FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN size >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id <> response THEN response END AS refers_to,
       (SELECT coalesce(any_value(url), '-') FROM pages q WHERE q.page_id = g.page_id) AS url, '2024-01-01T00:00:00Z' AS date
FROM g
"""

OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rule, host_part, path_part, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN rules
  ON (host = host_part OR ends_with(host, '.' || host_part)) AND starts_with(path, path_part) GROUP BY page_id),
pat(name, regex) AS (VALUES ('casino', '(^|[^a-z0-9])casino([^a-z0-9]|$)'), ('porn', '(^|[^a-z0-9])porn([^a-z0-9]|$)'), ('torrent', '(^|[^a-z0-9])torrent/'),
  ('ad-server', '^ads?\.[^/]*/click'), ('executable', '\.(exe|msi)$')),
hit AS (SELECT page_id, min(name) AS method_rule FROM p JOIN pat ON regexp_matches(host || path, regex) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, CASE WHEN method_rule IS NOT NULL THEN 'block' END, 'allow') AS verdict, method_rule
FROM p LEFT JOIN best USING (page_id) LEFT JOIN hit USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op9_url_filter": OP9_SQL}
