"""URL filters by expressions of host suffixes and path prefixes.

Each URL is expanded into (host suffix + path prefix) expressions, as in the Safe
Browsing protocol. An expression meets the rules over the first PREFIX_BYTES bytes of its
SHA-256 in an equi-join; the full digests confirm a hit, and the longest rule decides.
Only expressions whose host and path are as long as those of some rule are made, which
leaves none out: a rule's host ends the URL's host and its path begins the URL's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, unused

#: Bytes of a digest that the join is on.
PREFIX_BYTES = 4
#: Rules (some 100 bytes each) up to which the rule side is broadcast.
BROADCAST_RULES = 200_000
#: Rules of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The verdict of a URL that no rule fits.
NO_RULE = "allow"

_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; ''
    for a null or a URL without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, _HOST, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' where host_of() has no host."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def expressions(host: Column, path: Column, hosts: list[int], paths: list[int]) -> Column:
    """Array of (host, path): suffixes of ``host`` that begin it or follow a dot, of the
    lengths ``hosts``, with prefixes of ``path`` of the lengths ``paths``."""
    n = F.length(host)
    whole = F.filter(F.array(*map(F.lit, hosts)), lambda k: (k == n) | ((k < n) & (F.substring(host, n - k, F.lit(1)) == ".")))
    begun = F.filter(F.array(*map(F.lit, paths)), lambda k: k <= F.length(path))
    pair = lambda h, p: F.struct(F.right(host, h).alias("host"), F.left(path, p).alias("path"))
    return F.flatten(F.transform(whole, lambda h: F.transform(begun, lambda p: pair(h, p))))


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path, verdict): the longest rule that fits each URL of ``urls`` (a
    column url), for URLs that some rule fits; each URL once.

    Longest is the rule with most characters of host and path; of equal ones that with
    more of the host, then `block` before any other verdict. Rules with a null host or
    path fit nothing; repeated rules count once; a rule's host is taken in lower case.
    """
    known = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    known = known.groupBy("rule_host", "rule_path").agg(F.max_by("verdict", F.struct(F.coalesce(F.col("verdict") == "block", F.lit(False)), "verdict")).alias("verdict"))
    known = stored(known.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))), "url-rules")
    # distinct lengths: no more than a host and a URL have characters
    lengths = known.agg(F.collect_set(F.length("rule_host")), F.collect_set(F.length("rule_path")), F.count("*")).first()
    hosts, paths, size = sorted(lengths[0]), sorted(lengths[1]), lengths[2]
    if not size:
        return urls.sparkSession.createDataFrame([], "url string, host string, path string, verdict string")
    # only the hosts' dots and the paths' lengths decide how many expressions a URL has
    each = urls.filter("url IS NOT NULL").select("url", F.explode(expressions(host_of(F.col("url")), path_of(F.col("url")), hosts, paths)).alias("e"))
    each = each.select("url", _digest(F.col("e.host"), F.col("e.path")).alias("of"))
    short = lambda c: F.substring(c, 1, 2 * PREFIX_BYTES)
    each, known = each.withColumn("short", short(F.col("of"))), known.withColumn("short", short(F.col("digest")))
    hits = each.join(F.broadcast(known) if size <= BROADCAST_RULES else known, "short").filter(F.col("of") == F.col("digest"))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "rule_host")
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule_host", "rule_path", "verdict"), rank).alias("r"))
    return best.select("url", F.col("r.rule_host").alias("host"), F.col("r.rule_path").alias("path"), F.col("r.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = NO_RULE) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row for each row of ``pages``.

    A rule fits its host and all its subdomains if the path begins with the rule's; the
    longest decides (fitting_rules()). A URL that none fits has a null rule and the verdict
    ``default``, as has a null URL, an empty one and one without ``://``, whose host and
    path are ''. Repeated rows come back as often, rows with a null id too. Hosts and paths
    of any length are read whole. Other columns are ignored; an empty table gives an empty
    result, an empty rule table the default for all rows.
    """
    found = fitting_rules(pages.select("url"), rules)
    url, host, path, verdict = unused(pages, "rule_url", "rule_host", "rule_path", "rule_verdict")
    # cut off from its aggregate, so that the rows of a much-repeated URL can be split
    found = stored(found.toDF(url, host, path, verdict), "url-verdicts")
    both = pages.select("page_id", "url").join(found, F.col("url") == F.col(url), "left")
    rule = F.concat(host, path).alias("rule")
    return both.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), rule, F.coalesce(verdict, F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, default: str = NO_RULE) -> DataFrame:
    """The rows of ``pages`` whose URL is not blocked, columns unchanged; nulls and repeated
    rows as judge() says. Blocked URLs alone are joined, never the pages' other columns
    before that."""
    (url,) = unused(pages, "blocked_url")
    found = fitting_rules(pages.select("url"), rules)
    if default == "block":
        good = stored(found.filter(~F.col("verdict").eqNullSafe("block")).select(F.col("url").alias(url)), "url-allowed")
        return pages.join(good, F.col("url") == F.col(url), "left_semi")
    bad = stored(found.filter("verdict = 'block'").select(F.col("url").alias(url)), "url-blocked")
    return pages.join(bad, F.col("url") == F.col(url), "left_anti")
