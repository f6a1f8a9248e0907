"""URL rules by hashed expressions, in DataFrame functions alone.

Each URL is expanded into host suffixes and path prefixes. An expression's SHA-256
digest is looked up by its first bytes in an equi-join with the rules' short
prefixes; a full digest then confirms the match, and the longest rule wins.
Path prefixes are made for the lengths that the rules' paths have and no others,
and host suffixes for the numbers of labels that their hosts have, so the number
of expressions follows the rules and not the length of a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import aliased

#: Hex digits of the short prefix: four bytes.
SHORT = 8
#: Rule tables up to so many rows (some 200 bytes each) are broadcast; beyond, the expressions are shuffled by prefix.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` and for null."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def expand_rules(rules: DataFrame) -> DataFrame:
    """The rules (host, path, verdict) with rule, digest, short; null hosts and paths are empty."""
    host, path = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    named = rules.select(F.translate(host, UPPER, LOWER).alias("r_host"), path.alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    digest = F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256)
    return named.select("*", F.concat("r_host", "r_path").alias("r_rule"), digest.alias("r_digest"), F.substring(digest, 1, SHORT).alias("short"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A rule fits its host and all subdomains when the path starts with the rule's
    path; the longest rule (host and path together) wins, then the longer host,
    then block. Where none fits, rule is null and verdict is ``default``. Null
    URLs and those without ``://`` have an empty host and path; URLs of any length
    are read whole; repeated rows are judged each; columns of these names are
    replaced and all others pass, whatever their names; a table without rules
    gives ``default`` for all, and one without pages an empty one.
    """
    lengths = [r[0] for r in rules.select(F.length(F.coalesce("path", F.lit(""))).alias("n")).distinct().orderBy("n").collect()]
    levels = [r[0] for r in rules.select(F.size(F.split(F.coalesce("host", F.lit("")), r"\.")).alias("n")).distinct().orderBy("n").collect()]
    hashed = expand_rules(rules)
    if rules.count() <= BROADCAST_RULES:
        hashed = F.broadcast(hashed)
    taken = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in taken - {url.lower()}]
    named, at = aliased(pages.select(*kept))
    rows = named.select("*", url_host(F.col(at[url])).alias("host"), url_path(F.col(at[url])).alias("path")).withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(F.array(*[F.lit(n) for n in levels]).cast("array<int>"), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.array_distinct(F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)))
    digests = F.flatten(F.transform(F.array_distinct(suffixes), lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat(h, F.lit("\n"), p), 256))))
    looked = rows.withColumn("_digest", F.explode_outer(digests)).withColumn("short", F.substring("_digest", 1, SHORT)).join(hashed, "short", "left")
    fits = F.when(F.col("r_digest") == F.col("_digest"), F.struct(F.length("r_rule").alias("n"), F.length("r_host").alias("m"), F.col("r_verdict").alias("verdict"), F.col("r_rule").alias("rule")))
    best = looked.groupBy("_row").agg(*[F.first(c).alias(c) for c in [*named.columns, "host", "path"]], F.max(fits).alias("_best"))
    out = best.select(*named.columns, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
    return out.toDF(*kept, "host", "path", "rule", "verdict")
