"""Operator 6: URL filters.

Pattern rules, each indexed under its rarest literal token.  The tokens of a
URL fetch candidate rules, and only those run their regular expressions.

A rule is (host, path, verdict): it fits its host and all subdomains of it, if
the path of the URL starts with the rule's path.  Literal tokens of a rule are
the labels of its host and those path parts that end at a slash; all of them
must stand in a fitting URL, so one of them is enough to find the rule.  How
rare a token is, is counted over the URLs.  A rule without a literal token is
kept under the empty token, which every URL has.

Where several rules fit, the longest (host and path together) wins, and of
equally long ones the first by text, then ``allow``.  The method's own verdict
comes from rules of the same index: a word rule blocks URLs that have its word
between other characters than a-z and 0-9, is fetched by that word, and gives
way to every rule of the caller.  What no rule fits is allowed.

Null URLs and URLs without ``://`` have empty host and path, and no rule with
a host fits them.  Repeated rows are judged each on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: The rule index is broadcast up to this many rules, and shuffled on its tokens beyond.
BROADCAST_RULES = 50_000
RULE_SCHEMA = "host string, path string, verdict string"
#: Words of the method's own rules.
BLOCKED_TOKENS = ("adult", "casino", "porn", "xxx", "viagra")

_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, *_LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_tokens(host: Column, path: Column) -> Column:
    """Literal tokens that every fitting URL has: h:label for the host, p:part for whole parts of the path."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))  # the last part may go on
    return F.array_distinct(F.concat(labels, F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))))


def url_tokens(host: Column, path: Column) -> Column:
    """Tokens of a URL: labels of the host, parts of the path, words (w:word) of both, and the empty token."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    words = F.transform(F.regexp_extract_all(ascii_lower(F.concat_ws("/", host, path)), F.lit("[a-z0-9]+"), 0), lambda x: F.concat(F.lit("w:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, parts, words))


def word_rules(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    """The method's own rules in the form of index_rules."""
    rows = [(None, "block", rf"(?<![a-z0-9])\Q{w}\E(?![a-z0-9])", f"w:{w}", True) for w in dict.fromkeys(words)]
    return spark.createDataFrame(rows, "rule string, verdict string, regex string, token string, own boolean")


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """rule, verdict, regex, token, own: each rule under the token that the fewest URLs have."""
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(F.col(c), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    compiled = F.concat(
        F.lit(r"\A"),
        F.when(F.col("host") == "", F.lit("[^/]*")).otherwise(F.concat(F.lit(r"(?:[^/]*\.)?"), quoted("host"))),
        F.when(F.col("path") == "", F.lit(r"(?:/|\z)")).otherwise(quoted("path")),
    )
    rules = (
        rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .distinct()
        .withColumns({"rule": F.concat("host", F.when(F.col("path") == "", "/").otherwise(F.col("path"))), "regex": compiled, "token": F.explode_outer(rule_tokens(F.col("host"), F.col("path")))})
        .withColumn("token", F.coalesce("token", F.lit("")))
    )
    wanted = rules.select("token").distinct()
    seen = urls.select(F.explode("url_tokens").alias("token")).join(_small(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = rules.join(seen, "token", "left").groupBy("host", "path", "verdict", "rule", "regex").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    return ranked.select("rule", "verdict", "regex", F.col("least.token").alias("token"), F.lit(False).alias("own"))


def _small(rules: DataFrame) -> DataFrame:
    """Broadcast while the number of rules is small; joined by a shuffle otherwise."""
    return F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules


def judge(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], *, key: str = "page_id", url: str = "url", blocked_tokens: Sequence[str] = BLOCKED_TOKENS) -> DataFrame:
    """One row for each row of ``pages``: key, host, path, rule (null if none of the caller's fits) and verdict."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), RULE_SCHEMA)
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # the same host and path get the same answer, so candidates are found once for each
    sites = rows.select("host", "path").distinct().withColumn("url_tokens", url_tokens(F.col("host"), F.col("path")))
    scratch = Scratch(spark, "url-rules")
    index = scratch.save(index_rules(rules, sites).unionByName(word_rules(spark, blocked_tokens)), "index")
    found = sites.select("host", "path", F.explode("url_tokens").alias("token")).join(_small(index), "token")
    address = F.when(F.col("own"), ascii_lower(F.concat_ws("/", "host", "path"))).otherwise(F.concat("host", "path"))
    found = found.where(F.rlike(address, F.col("regex")))
    best = F.min(F.struct("own", (-F.length("rule")).alias("size"), "rule", "verdict")).alias("best")
    found = scratch.save(found.groupBy("host", "path").agg(best), "found")
    tried = rows.join(found, ["host", "path"], "left")
    return tried.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
