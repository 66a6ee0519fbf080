"""URL filters: every URL against allow and block rules, in DataFrame operations only.

A rule is a host and the start of a path; it fits its host, all subdomains and every path with that start.
Each distinct host and path is expanded into host suffixes joined with path prefixes, only those with as many
labels and characters as some rule has.  Expressions meet rules by the first 32 bits of their SHA-256 in an
equi-join, whole digests confirm the match, and the longest rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, start of the path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(("verdict", "host", "path"), r, strict=True))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def url_verdicts(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """One row for each page: id_column, host, path, rule (host and path of the deciding rule, or null), verdict.

    Of rules that fit, the longest (host and path together) decides; of equal ones block does.  Without a rule
    the verdict is ``default``.  Null and malformed URLs have empty host and path and fit no rule; repeated rows
    are judged alike; null ids stay null; other columns are ignored.
    """
    host, path = url_parts(F.coalesce(F.col(url_column), F.lit("")))
    parsed = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    # rule tables without rows: no expression, every page gets the default
    facts = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    labels = F.split("host", r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - F.lit((facts.labels or 1) - 1))
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in facts.lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    known = parsed.where("host <> ''").select("host", "path").distinct().withColumn("labels", labels)
    digest = F.sha2(F.col("expression"), 256)
    asked = known.select("host", "path", F.explode(expressions).alias("expression")).select("host", "path", digest.alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    rule = F.concat("host", "path")
    listed = rules.select(rule.alias("rule"), F.col("verdict").alias("ruled"), F.sha2(rule, 256).alias("rule_digest")).withColumn("short", F.substring("rule_digest", 1, 8))
    fits = asked.join(listed, "short").where(F.col("digest") == F.col("rule_digest"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("length"), "ruled", "rule")).alias("best"))
    out = parsed.join(best, ["host", "path"], "left")
    return out.select(F.col(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.ruled", F.lit(default)).alias("verdict"))
