"""The contract's queries: each applies one operator to its whole table, and oracle() has DuckDB's SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import fingerprints, langid, matroska, mixing, packing, simhash, substrings, toxicity, urlrules, warc
from quillspark.llm.common import crc_mod, stored, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages"))), "warc")
    return warc.read_archives(archives, payloads=False, strict=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(stored(matroska.encode_texts(table(spark, sf_dir, "documents")), "media"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, ~held_out)
    found = langid.identify(docs, model, reject=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("source")


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first_id, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.*, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND n > 1 AND payload_bytes >= 1000
"""

URL_SQL = r"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(rule, rule_host, rule_path, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM c JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT c.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM c LEFT JOIN b ON c.page_id = b.page_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_fingerprints, op2_warc, op3_matroska, op4_langid, op5_toxicity, op6_urlrules, op7_mixing, op8_simhash, op9_substrings, op10_packing)}


def oracle() -> dict[str, str]:
    return {"op2_warc": WARC_SQL, "op6_urlrules": URL_SQL, "op7_mixing": mixing.MIX_SQL, "op9_substrings": substrings.REPEAT_SQL}
