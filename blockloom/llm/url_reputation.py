"""URL filters: rules first, then the reputation of the host.

Labelled page outcomes are summed for each host.  A host's rate of good pages shrinks towards
its registered domain's, that towards its suffix's, that towards the global rate; each step is
a beta-binomial prior whose strength is fitted to the spread between the groups.  A page is
blocked if even the upper posterior bound of its host's rate is low.  Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.session import checkpoint

#: A rule: (action, host, path).  It holds for the host and its subdomains and for paths that begin with its path.
Rule = tuple[str, str, str]
#: The upper posterior bound lies this many deviations above the mean.
DEVIATIONS = 1.645
#: Hosts whose rate of good pages is below this even at the bound are blocked.
BLOCK_BELOW = 0.5
#: Suffixes of two labels.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
STRENGTH = (1.0, 5000.0)
#: Pages of one host meet its reputation in this many places.
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ? or #; A-Z lower-cased; null or no :// give an empty host."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end to the next ? or #."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more."""
    return F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule as host and path, its action) of the longest rule that fits, or nulls."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(action)
    return name, action


def strength(groups: DataFrame) -> float:
    """How many pages a prior is worth; groups has n, good and the prior's rate."""
    p = F.least(F.greatest("rate", F.lit(0.001)), F.lit(0.999))
    r = groups.agg(
        F.sum(F.pow(F.col("good") - F.col("n") * p, 2) - F.col("n") * p * (1 - p)).alias("beyond"),
        F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p)).alias("scale"),
    ).first()
    if not r["scale"] or r["beyond"] <= 0:
        return STRENGTH[1]
    return float(min(max(r["scale"] / r["beyond"] - 1, STRENGTH[0]), STRENGTH[1]))


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """_host, good_rate, upper: every host's posterior mean and upper bound.

    pages has page_id and _host; outcomes has page_id and good (0 or 1), several of one page
    count as their least.  Hosts without outcomes take their domain's rate.
    """
    known = outcomes.where(F.col("good").isin(0, 1) & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.min("good").alias("good"))
    named = pages.where("page_id IS NOT NULL").join(known, "page_id", "left").select("_host", "good")
    hosts = named.unionByName(pages.where("page_id IS NULL").select("_host", F.lit(None).cast("int").alias("good")))  # these meet no outcome, and not each other
    hosts = hosts.groupBy("_host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = checkpoint(hosts.withColumns({"_domain": domain_of(F.col("_host")), "_suffix": suffix_of(F.col("_host"))}))  # read by every level
    domains = hosts.groupBy("_domain", "_suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("_suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    level = suffixes.withColumn("rate", F.lit(((total["good"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)))
    for below, key, parent in ((domains, "_suffix", "_suffix"), (hosts, "_domain", "_domain")):
        s = strength(level)
        level = level.withColumn("rate", (F.col("good") + s * F.col("rate")) / (F.col("n") + s)).select(parent, "rate")
        level = below.join(level, key)
    s = strength(level)
    mean = (F.col("good") + s * F.col("rate")) / (F.col("n") + s)
    out = level.select("_host", "n", mean.alias("good_rate"))
    return out.select("_host", "good_rate", (F.col("good_rate") + DEVIATIONS * F.sqrt(F.col("good_rate") * (1 - F.col("good_rate")) / (F.col("n") + s + 1))).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, good_rate of every page.

    Null urls and urls without :// have empty host and path and share one reputation.
    Repeated rows are repeated; no rows give no rows; other columns are ignored.
    """
    own = pages.select("page_id", host_of(F.col("url").cast("string")).alias("_host"), path_of(F.col("url").cast("string")).alias("_path"))
    hosts = reputation(own, outcomes).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = own.withColumn("_salt", F.pmod(F.xxhash64("page_id", "_path"), F.lit(SALTS)).cast("int"))
    name, action = rule_of(F.col("_host"), F.col("_path"), rules)
    method = F.when(F.col("upper") < BLOCK_BELOW, "block").otherwise("allow")
    return salted.join(hosts, ["_host", "_salt"]).select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), name.alias("rule"), F.coalesce(action, method).alias("verdict"), F.round("good_rate", 6).alias("good_rate"))


RULES: list[Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

ORACLE = f"""
WITH own AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), known AS (
  SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id
), hosts AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good,
    string_split(host, '.') AS labels,
    array_to_string(labels[-2:], '.') IN ({", ".join(f"'{x}'" for x in LONG_SUFFIXES)}) AS long,
    array_to_string(labels[(CASE WHEN long THEN -3 ELSE -2 END):], '.') AS domain,
    array_to_string(labels[(CASE WHEN long THEN -2 ELSE -1 END):], '.') AS suffix
  FROM own LEFT JOIN known USING (page_id) GROUP BY host
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain, suffix
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY suffix
), a AS (
  SELECT *, (SELECT (sum(good) + 1.0) / (sum(n) + 2.0) FROM suffixes) AS rate FROM suffixes
), sa AS (
  SELECT CASE WHEN scale = 0 OR beyond <= 0 THEN 5000.0 ELSE least(greatest(scale / beyond - 1, 1.0), 5000.0) END AS s
  FROM (SELECT sum(pow(good - n * p, 2) - n * p * (1 - p)) AS beyond, sum(n * (n - 1) * p * (1 - p)) AS scale FROM (SELECT *, least(greatest(rate, 0.001), 0.999) AS p FROM a))
), b AS (
  SELECT d.domain, d.n, d.good, (a.good + s * a.rate) / (a.n + s) AS rate FROM domains d JOIN a USING (suffix), sa
), sb AS (
  SELECT CASE WHEN scale = 0 OR beyond <= 0 THEN 5000.0 ELSE least(greatest(scale / beyond - 1, 1.0), 5000.0) END AS s
  FROM (SELECT sum(pow(good - n * p, 2) - n * p * (1 - p)) AS beyond, sum(n * (n - 1) * p * (1 - p)) AS scale FROM (SELECT *, least(greatest(rate, 0.001), 0.999) AS p FROM b))
), c AS (
  SELECT h.host, h.n, h.good, (b.good + s * b.rate) / (b.n + s) AS rate FROM hosts h JOIN b USING (domain), sb
), sc AS (
  SELECT CASE WHEN scale = 0 OR beyond <= 0 THEN 5000.0 ELSE least(greatest(scale / beyond - 1, 1.0), 5000.0) END AS s
  FROM (SELECT sum(pow(good - n * p, 2) - n * p * (1 - p)) AS beyond, sum(n * (n - 1) * p * (1 - p)) AS scale FROM (SELECT *, least(greatest(rate, 0.001), 0.999) AS p FROM c))
), hosts_rated AS (
  SELECT host, n, s, (good + s * rate) / (n + s) AS good_rate FROM c, sc
), rules(action, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(action, length(rule_host || rule_path)) AS action
  FROM (SELECT DISTINCT host, path FROM own) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, own.host AS host, own.path AS path, rule,
  coalesce(action, CASE WHEN good_rate + 1.645 * sqrt(good_rate * (1 - good_rate) / (n + s + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  round(good_rate, 6) AS good_rate
FROM own JOIN hosts_rated USING (host) LEFT JOIN fitting ON fitting.host = own.host AND fitting.path = own.path
"""
