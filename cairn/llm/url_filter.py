"""Operator 5, URL filters: rules first, then an empirical-Bayes reputation of the host.

Labelled outcomes of pages (good or not) are beta-binomial counts. The prior of a suffix is the overall rate, that of a
registered domain its suffix's shrunk rate, that of a host its domain's; how strongly each level is
drawn to the one above is estimated by moments. A host passes if the lower bound of its posterior
reaches `least_good`. Only aggregates over hosts are formed, with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.llm.shared import cut, table

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Public suffixes of two labels that the registered domain must keep.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column) -> tuple[Column, Column]:
    """(domain, suffix): the suffix is the last label, or two for the listed ones; the domain has one label more."""
    two = F.substring_index(host, ".", -2)
    suffix = F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))
    return F.when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two), suffix


def _strength(units: DataFrame) -> float:
    """The prior's weight in pages, by moments: units have n, good and the rate `up` of what they belong to."""
    n, rate, up = F.col("n"), F.col("good") / F.col("n"), F.col("up")
    seen, spread, noise = units.where("n > 0").agg(F.sum(n), F.sum(n * (rate - up) * (rate - up)), F.sum(up * (1 - up))).first()
    if not seen:
        return 2.0
    level, between = noise / units.where("n > 0").count(), (spread - noise) / seen
    return 1000.0 if between <= level / 1000.0 else max(2.0, level / between - 1)


def host_reputation(pages: DataFrame, z: float = 1.645) -> DataFrame:
    """Per host: domain, suffix, n, good, posterior mean and lower bound. pages: (host, good), good 0, 1 or null for unlabelled."""
    hosts = pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    domain, suffix = registered_domain(F.col("host"))
    hosts = cut(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good"))
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("up", F.lit(((good or 0) + 1.0) / ((n or 0) + 2.0)))
    for name, below in (("suffix", "domain"), ("domain", None)):
        strength = _strength(level)
        level = level.select(name, ((F.col("good") + F.lit(strength) * F.col("up")) / (F.col("n") + F.lit(strength))).alias("up"))
        if below:
            units = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
            level = units.join(level, "suffix")
    level = hosts.join(level, "domain")
    strength = _strength(level)
    a = F.col("good") + F.lit(strength) * F.col("up")
    b = F.col("n") - F.col("good") + F.lit(strength) * (1 - F.col("up"))
    mean = a / (a + b)
    level = level.withColumn("mean", mean).withColumn("bound", mean - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    return level.select("host", "domain", "suffix", "n", "good", "mean", "bound")


def url_filter(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, least_good: float = 0.8, z: float = 1.645) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, bound (the host's).

    `outcomes` has (page_key, good) with page_key the first number in a url's path; good is 0 or 1, null or a missing row
    means unlabelled, and several rows of one key are averaged to 0 or 1 (half counts as good). A null url, or one without ://, has an empty host and path,
    which form a host like any other. With no labels at all every prior is 1/2 and nothing reaches the bound. Repeated rows
    count as pages of their own; other columns play no part.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("page_key", F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})', 1), '') as bigint)"))
    known = outcomes.groupBy("page_key").agg((F.avg("good") >= 0.5).cast("int").alias("good"))
    seen = host_reputation(rows.join(known, "page_key", "left").select("host", "good"), z)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    out = rows.join(seen.select("host", "bound"), "host", "left")
    own = F.when(F.col("bound") >= least_good, F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document that its url numbers, so that document's quality label is the page's outcome."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_key"), F.col("quality").alias("good"))
    return url_filter(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH r AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), k AS (
  SELECT *, try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})', 1), '') AS BIGINT) AS page_key FROM p
), l AS (
  SELECT doc_id AS page_key, CAST(avg(quality) >= 0.5 AS INT) AS good FROM labels GROUP BY 1
), h AS (
  SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix,
         count(good) AS n, coalesce(sum(good), 0)::DOUBLE AS good FROM k LEFT JOIN l USING (page_key) GROUP BY 1
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (sum(good) + 1.0) / (sum(n) + 2.0) FROM h) AS up FROM h GROUP BY 1
), sk AS (
  SELECT sum(n) AS seen, sum(n * (good / n - up) * (good / n - up)) AS spread, sum(up * (1 - up)) AS noise, count(*) AS c FROM s0 WHERE n > 0
), ss AS (
  SELECT CASE WHEN coalesce(seen, 0) = 0 THEN 2.0 WHEN (spread - noise) / seen <= noise / c / 1000.0 THEN 1000.0
         ELSE greatest(2.0, noise / c / ((spread - noise) / seen) - 1) END AS k FROM sk
), s1 AS (SELECT suffix, (good + k * up) / (n + k) AS up FROM s0, ss
), d0 AS (
  SELECT suffix, domain, x.n, x.good, up FROM (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM h GROUP BY 1, 2) x JOIN s1 USING (suffix)
), dk AS (
  SELECT sum(n) AS seen, sum(n * (good / n - up) * (good / n - up)) AS spread, sum(up * (1 - up)) AS noise, count(*) AS c FROM d0 WHERE n > 0
), ds AS (
  SELECT CASE WHEN coalesce(seen, 0) = 0 THEN 2.0 WHEN (spread - noise) / seen <= noise / c / 1000.0 THEN 1000.0
         ELSE greatest(2.0, noise / c / ((spread - noise) / seen) - 1) END AS k FROM dk
), d1 AS (SELECT domain, (good + k * up) / (n + k) AS up FROM d0, ds
), h0 AS (SELECT h.*, up FROM h JOIN d1 USING (domain)
), hk AS (
  SELECT sum(n) AS seen, sum(n * (good / n - up) * (good / n - up)) AS spread, sum(up * (1 - up)) AS noise, count(*) AS c FROM h0 WHERE n > 0
), hs AS (
  SELECT CASE WHEN coalesce(seen, 0) = 0 THEN 2.0 WHEN (spread - noise) / seen <= noise / c / 1000.0 THEN 1000.0
         ELSE greatest(2.0, noise / c / ((spread - noise) / seen) - 1) END AS k FROM hk
), ab AS (SELECT host, good + k * up AS a, n - good + k * (1 - up) AS b FROM h0, hs
), rep AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN bound >= 0.8 THEN 'allow' ELSE 'block' END AS verdict
FROM ruled LEFT JOIN rep USING (host)
"""
