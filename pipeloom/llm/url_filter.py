"""URL filters by hashed expressions.

A rule is a host and a path, with a verdict. A url is expanded into expressions: each suffix of its host (whole labels)
followed by each prefix of its path, of the sizes that occur among the rules. Expressions meet rules in an equi-join on the
first four bytes of their SHA-256; the full digests confirm; the longest rule decides (host and path together; of equal
rules with several verdicts, block).

Host: after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased (port and user name belong to it). Path: from
there up to `?`, `#` or the end. Null, or without `://`: both empty. Without a fitting rule the verdict is `default` and the rule null.
Each distinct url is judged once; rows of equal urls get equal results, null urls aren't moved to one task. Rows with repeated or null keys are
rows of their own. Only key and url are read, so other columns' names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rules up to this number (of some 100 bytes each) are broadcast; more are shuffled by hash prefix.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """key, host, path, rule, verdict of each row of pages. rules: host, path, verdict (null paths count as empty, rules without host don't count)."""
    known = (
        rules.where(F.col("host").isNotNull() & (F.col("host") != ""))
        .select(F.translate("host", _UPPER, _LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("verdict"))
        .groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
        .select(F.concat("h", "p").alias("rule"), (F.size(F.split("h", r"\.")) * 1).alias("labels"), F.length("p").alias("chars"), "verdict")
    )
    # the sizes that occur: a few even among millions of rules
    sizes = sorted((r["labels"], r["chars"]) for r in known.select("labels", "chars").distinct().collect())
    rows = pages.select(F.col(key), F.col(url).alias("__url"))
    if not sizes:
        return rows.select(key, host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hashed = known.select("rule", "verdict", F.sha2("rule", 256).alias("digest")).withColumn("start", F.substring("digest", 1, 8))
    if known.count() <= broadcast_rules:
        hashed = F.broadcast(hashed)

    urls = rows.where(F.col("__url").isNotNull()).select("__url").distinct().select("__url", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    parts = urls.withColumn("labels", F.split("host", r"\.")).withColumn("n", F.size("labels"))
    # one expression, however many sizes there are
    at = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(c).alias("chars")) for a, c in sizes])
    fits = F.filter(at, lambda z: (F.col("n") >= z["labels"]) & (F.length("path") >= z["chars"]))
    made = F.transform(fits, lambda z: F.concat(F.array_join(F.slice("labels", F.col("n") - z["labels"] + 1, z["labels"]), "."), F.substring("path", F.lit(1), z["chars"])))
    expanded = parts.select("__url", F.explode(made).alias("expression")).withColumn("full", F.sha2("expression", 256)).withColumn("start", F.substring("full", 1, 8))
    best = cut(
        expanded.join(hashed, "start").where((F.col("full") == F.col("digest")) & (F.col("expression") == F.col("rule")))
        .groupBy("__url").agg(F.max(F.struct(F.length("rule").alias("size"), F.col("rule"), F.col("verdict"))).alias("best"))
        .select(F.col("__url").alias("__of"), "best")
    )
    # no url that a rule fits is without "://", so what null urls join by meets nothing
    met = rows.withColumn("__by", F.coalesce("__url", F.concat(F.lit("null:"), F.col(key).cast("string")), F.lit(""))).join(best, F.col("__by") == F.col("__of"), "left")
    return met.select(key, host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
