"""URL filter: host-suffix and path-prefix expressions against a rule table.

Every URL is expanded into ``host suffix + path prefix`` expressions.  Their
SHA-256 digests meet the rules' digests in an equi-join on the first 32 bits;
the full digest confirms a hit, and rule precedence picks the winner.

Precedence: the longest ``host + path`` wins; at equal length the longer
host, then block over allow.  A URL that no rule fits gets ``default``.

Defined results
    null url, or one without ``://``: host and path are empty strings, and
    only a rule for the empty host could fit.  Repeated rows are judged one
    by one and all returned.  Rules with a null host, path or verdict are
    ignored.  An empty page table gives no rows, an empty rule table gives
    every page the default verdict.  Columns of the input other than the
    key and the url are not looked at, whatever their names.

Scale
    The expressions of a URL are (labels of its host) x (distinct lengths of
    rule paths), so a URL costs the same at any table size; the suffixes take
    half the square of the host's labels, of which a valid host (253
    characters) has at most 127.  Only expressions
    that hit a rule are shuffled, aggregated map-side per (host, path).  The
    rule side is broadcast by Catalyst only under the session's size
    threshold; a larger table is shuffled, where it holds one row per rule
    and adaptive execution splits a hot prefix on the page side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._native import ascii_lower, cut, let

RULE_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``; A-Z lower-cased; '' if none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?`` or ``#``; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain of it."""
    return let(
        F.split(host, r"\.", -1),
        lambda labels: F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")),
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict) on the driver."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page row: key, host, path, rule, verdict."""
    digest = lambda text: F.sha2(text, 256)
    rules = (
        rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .dropna()
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))  # block sorts after allow
        .withColumn("r_digest", digest(F.concat("r_host", "r_path")))
        .withColumn("r_short", F.substring("r_digest", 1, 8))
    )
    # One row: its array has at most as many entries as the longest rule path has characters.
    lengths = rules.agg(F.collect_set(F.length("r_path")).alias("lengths"))

    judged = pages.select(F.col(key).alias("k"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    suffix = (
        judged.select("host", "path")
        .crossJoin(F.broadcast(lengths))
        .withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
    )
    expressions = suffix.select(
        "host",
        "path",
        "suffix",
        F.explode(
            F.transform(
                F.filter("lengths", lambda n: n <= F.length("path")),
                lambda n: F.substring(F.col("path"), F.lit(1), n),
            )
        ).alias("prefix"),
    ).withColumn("digest", digest(F.concat("suffix", "prefix")))
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"),
        F.length("r_host").alias("host_size"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    best = cut(  # so that both sides of the last join are exchanges and a hot URL can be split
        expressions.join(rules, F.substring("digest", 1, 8) == F.col("r_short"))
        # the digest is of the joined text: host and path confirm where one ends
        .where((F.col("digest") == F.col("r_digest")) & (F.col("suffix") == F.col("r_host")) & (F.col("prefix") == F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max(rank).alias("best"))
    )
    return judged.join(best, ["host", "path"], "left").select(
        F.col("k").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
