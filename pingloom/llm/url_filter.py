"""URL filters: expressions of each URL equi-joined with rules on short hash prefixes.

Each distinct URL is expanded into host suffixes and path prefixes that end in a slash (and the empty one), no deeper
than the deepest rule. A rule's path is cut behind its last slash; URLs and rules meet on the first 8 hex digits of the
SHA-256 of (host, directory), and a meeting counts once the full digests agree and the URL's path goes on with the rest
of the rule's. Of the rules that fit, the longest wins (host and path together), then the one with the longer host,
then block before allow.

Defined results: a null URL or one without ``://`` has an empty host and path and gets the default verdict (rules
without a host fit nothing); repeated rows each keep their row; a very long URL has no more expressions than the rules'
depth allows; empty tables of pages or rules give an empty result or the default; other columns, whatever their
names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each page: ``key, host, path, rule, verdict``.

    ``rules`` has string columns host, path and verdict; equal (host, path) pairs are one rule, where block
    beats allow. ``default`` is the verdict where no rule fits.
    """
    rules = rules.filter("host <> '' and path is not null").groupBy(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    rules = rules.withColumn("r_dir", F.regexp_extract("r_path", "^(?s).*/", 0))
    rules = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_dir"))).withColumn("prefix", F.substring("r_digest", 1, 8))
    slashes = lambda path: F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    deepest = rules.agg(F.coalesce(F.max(F.size(F.split("r_host", "\\.", -1))), F.lit(1)).alias("labels"), F.coalesce(F.max(slashes(F.col("r_dir"))), F.lit(0)).alias("dirs")).first()
    host, path = split_url(F.col(url))
    # pages without a host meet nothing and are spread by their key
    pages = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("at", F.when(F.col("host") == "", F.xxhash64(key)).otherwise(F.xxhash64("host", "path")))
    urls = pages.filter("host <> ''").select("host", "path", "at").distinct()
    suffixes = F.sequence(F.lit(1), F.least(F.size(F.split("host", "\\.", -1)), F.lit(deepest.labels)))
    dirs = F.sequence(F.lit(0), F.least(slashes(F.col("path")), F.lit(deepest.dirs)))
    forms = F.flatten(F.transform(suffixes, lambda i: F.transform(dirs, lambda k: F.struct(i.alias("i"), k.alias("k")))))
    cut = F.expr("CASE WHEN e.k = 0 THEN '' ELSE concat(substring_index(path, '/', e.k), '/') END")
    found = (
        urls.select("host", "path", "at", F.explode(forms).alias("e"))
        .select("host", "path", "at", _digest(F.expr("substring_index(host, '.', -e.i)"), cut).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, 8))
        .join(rules, "prefix")
        .filter("digest = r_digest and startswith(path, r_path)")
        .groupBy("host", "path", "at")
        .agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("m"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))).alias("best"))
    )
    return pages.join(found, ["at", "host", "path"], "left").select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
