"""The queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprints, language_id, near_dedup, packing, quality, token_counts, training_order, url_filter
from .common import crc_mod, shared_dir, table
from .vocab import default_path


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, size, slots = shared_dir(spark), 256, 32_768
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training_order.materialise(docs, folder, default_path("byte_bpe_50k.json"), default_path("byte_bpe_50k.tiktoken"), size=size, slots=slots)
    read = training_order.read_shards(spark, folder, size, slots)
    return read.select("doc_id", "part", "slot", F.floor(F.col("slot") / slots).alias("shard"), (F.pmod("slot", F.lit(slots)) * training_order.stride(size)).alias("byte_offset"), "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    scored = quality.score(docs, quality.fit(docs, labels), threshold=0.3)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


#: The rules of op3.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=75)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = token_counts.prefix_table(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
    return token_counts.truncate(stored, 512)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprints.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("body")
    cut = F.floor(n / 4).cast("int")
    edited = docs.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.col("body").substr(F.lit(1), n - cut), F.col("next_body").substr(F.lit(1), cut))})
    both = edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("fingerprint").alias("own"), fingerprints.fingerprint(F.col("edited")).alias("other"), F.col("next_fingerprint").alias("after"))
    like, text = fingerprints.likeness, fingerprints.as_text
    own, other, after = F.col("own"), F.col("other"), F.col("after")
    return both.select("doc_id", "n_chars", "edited_sha256", text(own).alias("fingerprint"), text(other).alias("edited_fingerprint"), like(own, other).alias("near_edited"), like(own, after).alias("near_next"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path("word_bpe_49k.json"), size=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(crc_mod("doc_id", 3) != 1))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path("byte_bpe_50k.json")
    ids = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_training_order, op2_quality, op3_url_filter, op4_near_dedup, op5_token_counts, op6_fingerprints, op7_packing, op8_exact_dedup, op9_language_id, op10_bpe)
    return {f.__name__: f for f in own}


_OP3 = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""

_OP8 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _OP3, "op8_exact_dedup": _OP8}
