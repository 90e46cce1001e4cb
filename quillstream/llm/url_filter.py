"""URL filters [native]: host-suffix and path-prefix expressions, short hash prefixes, full digests, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: The rules of the query: (host, path, action).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Rules up to this many are broadcast; more are joined by shuffling both sides on the hash prefix.
BROADCAST_RULES = 50_000
#: Hex digits of the short hash prefix (32 bits).
PREFIX = 8


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; no :// or null: empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; no :// or null: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict appended (columns of these names are replaced).

    rules: host, path, action (allow or block). A rule fits its host and all subdomains when the url's path
    starts with the rule's path. The longest host plus path wins; ties go to the longer host, then to block.
    Without a fitting rule the verdict is `default`. Null urls have an empty host and path and take the
    default. Each distinct url is judged once, so repeated urls neither skew nor multiply. Rules with a null
    part are ignored; an empty rule table leaves every url at the default.

    Only path prefixes of a length that some rule has are made (at most as many lengths as a path can have).
    """
    spark = pages.sparkSession
    ruled = (
        rules.where("host is not null and path is not null and action is not null")
        .select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), "action")
        .distinct()
        .withColumn("r_rule", F.concat("r_host", "r_path"))
        .withColumn("r_digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256))
        .withColumn("prefix", F.substring("r_digest", 1, PREFIX))
    )
    lengths = [r[0] for r in ruled.select(F.length("r_path")).distinct().collect()]
    small = ruled.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    urls = pages.select(F.col(url_col).alias("u")).where("u is not null").distinct().withColumn("h", url_host(F.col("u"))).withColumn("p", url_path(F.col("u")))
    labels = F.split("h", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wanted = F.array(*[F.lit(n) for n in sorted(lengths)]) if lengths else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(wanted, lambda n: n <= F.length("p")), lambda n: F.substr(F.col("p"), F.lit(1), n))
    tried = (
        urls.select("u", F.explode(suffixes).alias("s"), prefixes.alias("ps"))
        .select("u", "s", F.explode("ps").alias("x"))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "s", "x"), 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX))
        .select("u", "digest", "prefix")
    )
    met = tried.join(F.broadcast(ruled) if small else ruled, "prefix").where("digest = r_digest")
    order = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("m"), (F.col("action") == "block").alias("b"), F.col("r_rule").alias("rule"), "action")
    best = met.groupBy("u").agg(F.max(order).alias("best")).select(F.col("u").alias("__u"), F.col("best.rule").alias("__rule"), F.col("best.action").alias("__action"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    joined = pages.select(*kept, F.col(url_col).alias("__url")).join(best, F.col("__url") == F.col("__u"), "left")
    return joined.select(*kept, url_host(F.col("__url")).alias("host"), url_path(F.col("__url")).alias("path"), F.col("__rule").alias("rule"), F.coalesce("__action", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url by RULES; null urls, ties, repeats and no pages as in judge_urls, other columns ignored."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH rules(h, p, action) AS (
  VALUES ('com','/en/','block'), ('example.com','/en/7','allow'), ('net','/de/','allow'), ('example.net','/de/8','block'), ('org','/es/','block')
), u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path,
  (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS rule,
  coalesce((SELECT action FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1), 'allow') AS verdict
FROM u
"""
