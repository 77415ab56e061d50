"""URL filter lists: hashed host-suffix and path-prefix expressions, in DataFrame functions only.

A rule names a host and the start of a path. Each URL is expanded into the expressions a rule
could have: its host and parent domains that have as many labels as some rule's host, with each
prefix of its path that has the length of some rule's path. Expressions meet rules in an equi-join on the first 32 bits of a SHA-256;
the full digests confirm the match, and the longest rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
PREFIX_HEX = 8  # hex digits of the digest that are joined on
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://``, lower-cased in A-Z; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_suffixes(host: str, counts: str) -> Column:
    """The host or its parent domains with as many labels as ``counts`` says; a host of n labels has no others to try."""
    return F.expr(f"transform(filter({counts}, n -> n <= size(split({host}, '[.]'))), n -> substring_index({host}, '.', -n))")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, the deciding ``rule`` (host and path start, else null) and ``verdict``.

    ``rules``: (host, path, verdict). The longest matching rule wins; of equally long ones the
    longer host, then ``allow`` before ``block``. Without a rule the verdict is ``default``.

    Only distinct (host, path) pairs are expanded, so a URL that fills a third of the table is
    looked up once; the answer is joined back by that pair. Host suffixes are taken only at the
    label counts and path prefixes only at the lengths that rules have, so neither a host of very
    many labels nor a very long path makes more expressions. No side is broadcast by hint.

    A null URL, or one without ``://``, has an empty host and path and matches a rule with an
    empty host only. Rules with a null host, path or verdict are ignored; a repeated rule
    counts once. Repeated pages and pages with null ids come back as often as they came; other
    columns are kept, but columns named like the four new ones are replaced. An empty table of
    pages or rules gives no rows, or the default everywhere.
    """
    digest = F.substring("digest", 1, PREFIX_HEX)
    listed = (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .groupBy("digest").agg(*[F.min(c).alias(c) for c in ("rule_host", "rule_path", "rule_verdict")])
        .withColumn("short", digest)
    )
    lengths = listed.agg(F.collect_set(F.char_length("rule_path")).alias("n")).scalar()  # as many as rule lengths
    labels = listed.agg(F.collect_set(F.size(F.split("rule_host", "[.]"))).alias("n")).scalar()
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    asked = base.select("host", "path").distinct()
    prefixes = F.transform(F.filter(F.col("lengths"), lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        asked.withColumns({"lengths": lengths, "labels": labels})
        .withColumns({"h": F.explode(host_suffixes("host", "labels")), "ps": prefixes})
        .withColumn("p", F.explode("ps"))
        .withColumn("asked_digest", _digest(F.col("h"), F.col("p")))
        .select("host", "path", "asked_digest", F.substring("asked_digest", 1, PREFIX_HEX).alias("short"))
    )
    found = expressions.join(listed, "short").where(F.col("asked_digest") == F.col("digest"))
    rank = F.struct(
        F.char_length("rule_host") + F.char_length("rule_path"), F.char_length("rule_host"), (F.col("rule_verdict") == "allow").cast("int")
    )
    best = found.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), rank).alias("won")
    )
    return (
        base.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("won.rule"), "verdict": F.coalesce("won.verdict", F.lit(default))})
        .drop("won")
    )


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH rules(rh, rp, rv) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
),
rest AS (
  SELECT row_number() OVER () AS rn, page_id,
    CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS s FROM pages
),
parsed AS (
  SELECT rn, page_id,
    translate(regexp_extract(s, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(s, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
),
hits AS (
  SELECT rn, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
  FROM parsed JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rn
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN hits USING (rn)
"""
