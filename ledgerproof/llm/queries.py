"""The registered queries of this subpackage, and the SQL that some of them must match."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.llm import byte_bpe, conversations, dedup, gam, html_text, mixing, quality_rules, simhash, spelling, token_counts, token_file, toxicity, url_rules
from ledgerproof.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKEN_LIMIT = 2048
# Appended to every document of the token file.
END_ID = 2
# (action, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.prefix_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_mixing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query("op4_quality_gam")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return gam.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_quality_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


@query(
    "op6_url_rules",
    r"""
    WITH cut AS (
      SELECT page_id, coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', ['host', 'path']), {'host': '', 'path': ''}) AS u FROM pages
    ), parts AS (
      SELECT page_id, translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, u.path AS path FROM cut
    ), rules(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
    fit AS (
      SELECT page_id, h || p AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS k
      FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    )
    SELECT parts.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fit WHERE k = 1) f ON f.page_id = parts.page_id
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"), URL_RULES)


@query("op7_byte_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rows = byte_bpe.encode_decode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids, decoded = F.col("token_ids"), F.col("decoded")
    return rows.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


@query("op8_simhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_groups(table(spark, folder, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_token_file")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    token_file.write(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_file.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


@query(
    "op10_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
    ), g AS (
      SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_groups(table(spark, folder, "documents"))


@query("op11_spelling")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repaired(table(spark, folder, "conversations"))


@query("op13_html_text")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages"))
