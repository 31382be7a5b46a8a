"""URL filtering by rules and by the empirical-Bayes reputation of hosts.

Labelled pages give outcomes, good or bad. The share of bad pages is shrunk level by level: the
suffix towards all pages, the registered domain towards its suffix, and the host towards its
domain. At each level a group's pages are beta-binomial around the mean that the level above gives
it; how strongly they hold together (rho, hence the prior's weight (1 - rho) / rho) is estimated by
moments from all groups of that level. A host is blocked when the posterior's lower bound, mean
less Z deviations, is above LIMIT: where labels are few the bound is wide and the page stays.

For reputation a host is taken without user, port and final dots. An IPv4 or bracketed address is its
own domain and suffix, and so is a host of one label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: host, path, action
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LIMIT, Z, RHO_LEAST, RHO_MOST = 0.5, 1.645, 0.001, 0.9
#: Labels that, before a country's label, belong to the suffix, and names under which hosts of many owners stand.
SECOND_LEVEL = "ac asn co com edu gob gouv gov gub id info ltd me mil muni ne net nhs nom or org plc sch web".split()
SHARED = "blogspot.com github.io gitlab.io herokuapp.com netlify.app pages.dev vercel.app web.app wordpress.com".split()
SUFFIX = rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|{'|'.join(s.replace('.', chr(92) + '.') for s in SHARED)})$"
ADDRESS = r"^(?:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*)$"
BARE = r"^[^@]*@|:[0-9]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From behind the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one string; of equally long ones the first by name), and its action."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, a in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, a).otherwise(action)
    return name, action


def name_of(host: Column) -> Column:
    """The host's name without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(host, BARE, ""), r"\.+$", "")


def suffix_of(name: Column) -> Column:
    """The public suffix: the last label, or one of two labels such as co.uk; an address as it is."""
    return F.when(name.rlike(ADDRESS), name).when(name.rlike(SUFFIX), F.regexp_extract(name, SUFFIX, 1)).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))


def domain_of(name: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and the label before it, or the name where there is none."""
    left = F.substring(name, F.lit(1), F.length(name) - F.length(suffix) - 1)
    return F.when(F.length(name) > F.length(suffix) + 1, F.concat(F.regexp_extract(left, r"([^.]*)$", 1), F.lit("."), suffix)).otherwise(name)


def _weight(groups: DataFrame) -> float:
    """The prior weight of a level from its groups (n, b, m): moments of all of them."""
    v = F.col("m") * (1 - F.col("m"))
    r = groups.agg(F.sum(F.col("n") * F.pow(F.col("b") / F.col("n") - F.col("m"), 2) - v).alias("over"), F.sum((F.col("n") - 1) * v).alias("room")).first()
    rho = r.over / r.room if r.room else 0.0
    rho = min(RHO_MOST, max(RHO_LEAST, rho))
    return (1 - rho) / rho


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, n, mean and bound (the posterior's lower bound of its share of bad pages) of every host
    of outcomes (host string, bad int, null where a page has no label). A host without labels has its
    domain's mean. Pages are read once: the levels are summed from the table of hosts, which is
    written to the shared folder. One row of sums a level goes to the driver."""
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    named = counts.withColumn("name", name_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("name")))
    hosts = cut(named.withColumn("domain", domain_of(F.col("name"), F.col("suffix"))))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    base = (whole.b + 1) / (whole.n + 2)

    def shrunk(groups: DataFrame) -> tuple[DataFrame, float]:
        w = _weight(groups.filter("n > 0"))
        return groups.withColumn("mean", (F.col("b") + w * F.col("m")) / (F.col("n") + w)), w

    suffixes, _ = shrunk(suffixes.withColumn("m", F.lit(base)))
    domains, _ = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix"))
    hosts, w = shrunk(hosts.join(domains.select("domain", F.col("mean").alias("m")), "domain"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + w + 1))
    return hosts.select("host", "n", "mean", (F.col("mean") - Z * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame | None = None, rules=RULES, key: str = "page_id", url: str = "url", limit: float = LIMIT) -> DataFrame:
    """key, host, path, rule and verdict of every page.

    outcomes (key, bad 0 or 1) labels pages; of several rows of a page the worst counts, and null
    labels count nothing. A fitting rule decides (the longest one), otherwise the host's bound.
    Null urls and urls without :// have an empty host and path, fit no rule and are judged as one
    host. Hosts that differ in user, port or final dots are hosts of their own in one domain. Repeated rows are judged each by itself, an empty table gives no row, and other columns
    are ignored.
    """
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("action", action)
    if outcomes is None:
        labelled = rows.select("host", F.lit(None).cast("int").alias("bad"))
    else:
        known = outcomes.select(F.col(key).alias("key"), F.col("bad").cast("int").alias("bad")).groupBy("key").agg(F.max("bad").alias("bad"))
        labelled = rows.select("key", "host").join(known, "key", "left").select("host", "bad")
    bad = reputations(labelled).filter(F.col("bound") > limit).select("host", F.lit("block").alias("judged"))
    out = rows.join(bad, "host", "left")
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("action", "judged", F.lit("allow")).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all pages. A page shows the document whose number its path ends in, and that
    document's labels are the page's outcome: bad if of low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1).try_cast("long")
    outcomes = pages.select("page_id", number.alias("doc_id")).join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
    return judge(pages, outcomes)


_LEVEL = """{name}_w AS (
  SELECT (1 - rho) / rho AS w FROM (
    SELECT least(0.9, greatest(0.001, CASE WHEN coalesce(sum((n - 1) * m * (1 - m)), 0) = 0 THEN 0
      ELSE sum(n * pow(b / n - m, 2) - m * (1 - m)) / sum((n - 1) * m * (1 - m)) END)) AS rho
    FROM {name}_m WHERE n > 0)),
{name}_r AS (SELECT g.*, (b + w * m) / (n + w) AS mean, w FROM {name}_m g, {name}_w)"""

ORACLE = f"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u),
o AS (
  SELECT u.page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
  FROM u JOIN labels l ON l.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[./]|$)', 1) AS BIGINT) GROUP BY 1),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS b FROM u LEFT JOIN o USING (page_id) GROUP BY 1),
hn AS (SELECT *, regexp_replace(regexp_replace(host, '{BARE}', '', 'g'), '\\.+$', '') AS name FROM h),
hs AS (
  SELECT *, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name WHEN regexp_matches(name, '{SUFFIX}') THEN regexp_extract(name, '{SUFFIX}', 1) ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix FROM hn),
hd AS (
  SELECT *, CASE WHEN length(name) > length(suffix) + 1
    THEN regexp_extract(left(name, length(name) - length(suffix) - 1), '([^.]*)$', 1) || '.' || suffix ELSE name END AS domain FROM hs),
d AS (SELECT suffix, domain, sum(n) AS n, sum(b) AS b FROM hd GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM d GROUP BY 1),
s_m AS (SELECT s.*, (SELECT (sum(b) + 1) / (sum(n) + 2) FROM s) AS m FROM s),
{_LEVEL.format(name="s")},
d_m AS (SELECT d.*, s_r.mean AS m FROM d JOIN s_r USING (suffix)),
{_LEVEL.format(name="d")},
h_m AS (SELECT hd.*, d_r.mean AS m FROM hd JOIN d_r USING (domain)),
{_LEVEL.format(name="h")}
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN mean - {Z} * sqrt(mean * (1 - mean) / (n + w + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN h_r USING (host)
"""
