"""URL filter: explicit rules first, then a host's reputation from labelled pages by empirical Bayes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
MOST_TIMES = 1.0  # a host is blocked if its share of bad pages, by the lower bound, is more than this many times that of all labelled pages
Z = 1.645  # standard deviations between posterior mean and bound
LEVELS = ("suffix", "domain", "host")
#: Public suffixes of two labels; all other suffixes count as one label.
PUBLIC_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au",
    "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "or.kr", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.tw", "com.hk", "com.sg", "ac.in", "co.in", "gov.in", "net.in", "org.in", "co.id", "co.th", "com.my", "com.ph", "com.vn", "com.br", "gov.br", "net.br", "org.br", "com.ar", "com.mx",
    "com.co", "com.pe", "co.za", "org.za", "com.ng", "com.eg", "com.tr", "gov.tr", "org.tr", "com.ua", "com.pl", "co.il", "org.il", "com.sa", "co.at", "or.at",
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the host stands after the first :// up to /, ? or #, the path then up to ? or #. No ://, or null: both empty."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null. rules: a list as people keep it by hand; it becomes one expression."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def with_levels(df: DataFrame) -> DataFrame:
    """suffix: the public suffix of the host without user and port; domain: that and the label before it. An address of numbers is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    last = F.substring_index(name, ".", -2)
    known = last.isin(*PUBLIC_SUFFIXES)
    number = name.rlike(r"^(\[.*|[0-9.]+)$")
    suffix = F.when(number, name).when(known, last).otherwise(F.substring_index(name, ".", -1))
    return df.withColumns({"domain": F.when(number, name).when(known, F.substring_index(name, ".", -3)).otherwise(last), "suffix": suffix})


def shrunk(counts: DataFrame, level: str) -> DataFrame:
    """counts has level, m, n, bad; adds a and b, the posterior of each unit of a level, given the mean m of the unit above.

    The strength of the prior is fitted to the level by moments: with d the spread of rates around the prior mean
    and v the binomial variance, both weighted by n, strength = sum n (v - d) / (sum n d - sum v), from 1 to 1000, over
    units with labelled pages. The others have the prior, of that strength.
    """
    p = F.col("bad") / F.nullif(F.col("n"), F.lit(0))
    d, v = (p - F.col("m")) ** 2, F.col("m") * (1 - F.col("m"))
    fit = counts.where("n > 0").agg(F.sum(F.col("n") * (v - d)).alias("top"), F.sum(F.col("n") * d - v).alias("low"))
    k = F.when((F.col("low") <= 0) | F.col("low").isNull(), 1000.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.col("top") / F.col("low"))))
    joined = counts.crossJoin(F.broadcast(fit.select(k.alias("k"))))  # one row
    return joined.withColumns({"a": F.col("k") * F.col("m") + F.col("bad"), "b": F.col("k") * (1 - F.col("m")) + F.col("n") - F.col("bad")}).drop("k")


def reputation(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", z: float = Z) -> DataFrame:
    """Posterior of each host's share of bad pages: (host, domain, suffix, n, mean, bound, overall).

    pages: id_col, host. outcomes: (id, bad), any number of rows an id; an id is bad if one of its rows is. Beta
    priors go down from all pages to the suffix, to the registered domain, to the host; units without labelled
    pages have the prior that comes from above. bound: posterior mean less z standard deviations; overall: the share
    of bad pages among all labelled ones, with half a bad and half a good page added.
    """
    bad = outcomes.where("id is not null and bad is not null").groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counts = pages.join(bad, F.col(id_col) == F.col("id"), "left").groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    hosts = materialize(with_levels(counts), "hosts")  # a row a host, read by every level
    base = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("overall"))
    above = None
    for i, level in enumerate(LEVELS):
        units = hosts.groupBy(*LEVELS[i::-1]).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        prior = units.crossJoin(F.broadcast(base)).withColumn("m", F.col("overall")) if above is None else units.join(above, LEVELS[i - 1])
        done = materialize(shrunk(prior, level), level)  # so that the next level reads it once
        above = done.select(level, "overall", (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    a, b = F.col("a"), F.col("b")
    return done.select("host", "domain", "suffix", "n", (a / (a + b)).alias("mean"), (a / (a + b) - z * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))).alias("bound"), "overall")


def filter_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] | None = None, most_times: float = MOST_TIMES, z: float = Z) -> DataFrame:
    """Verdict on each page: (id_col, host, path, rule, verdict, bound), one row per input row.

    The longest rule that fits decides. Without one, a page is blocked if the lower posterior bound of its host's
    share of bad pages is over most_times the share of all labelled pages: if it is surely worse than usual. Null urls
    and urls without :// have an empty host, which has a reputation like others; without labelled pages nothing is
    blocked but by a rule. Rows with a null or repeated id each keep their row; a null id has no outcome; an empty table
    gives no rows. Counts are taken by host before the shuffle, so a host with very many pages costs a row per task.
    Other columns are not read.
    """
    rules = RULES if rules is None else rules
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    known = materialize(reputation(rows.select(id_col, "host"), outcomes, id_col, z).select("host", "bound", "overall"), "reputation")  # so that its size is known to the join
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_rule = reduce(lambda out, r: F.when(F.col("rule") == r, F.lit(rules[r])).otherwise(out), rules, F.lit(None).cast("string"))
    judged = rows.join(known, "host").withColumn("rule", rule)
    by_host = F.when(F.col("bound") > most_times * F.col("overall"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(id_col, "host", "path", "rule", F.coalesce(by_rule, by_host).alias("verdict"), F.round("bound", 6).alias("bound"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; labels, by doc_id, are outcomes of the page with that id: bad if toxic or of quality 0."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.greatest(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(1))) > 0
    return filter_urls(pages, labels.select(F.col("doc_id").alias("id"), bad.alias("bad")))


FIT_SQL = """SELECT CASE WHEN low <= 0 OR low IS NULL THEN 1000.0 ELSE greatest(1.0, least(1000.0, top / low)) END AS k FROM (
  SELECT sum(n * (m * (1 - m) - (bad / n - m) ** 2)) AS top, sum(n * (bad / n - m) ** 2 - m * (1 - m)) AS low FROM {} WHERE n > 0)"""
OP5_SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id, max(CASE WHEN toxic > 0 OR quality < 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
c AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM u LEFT JOIN o ON page_id = doc_id GROUP BY 1),
l AS (SELECT *, regexp_matches(name, '^(\[.*|[0-9.]+)$') AS number, regexp_extract(name, '[^.]*(?:\.[^.]*)?$') IN {PUBLIC_SUFFIXES} AS known FROM c),
h AS (SELECT host, n, bad, CASE WHEN number THEN name WHEN known THEN regexp_extract(name, '[^.]*(?:\.[^.]*)?(?:\.[^.]*)?$') ELSE regexp_extract(name, '[^.]*(?:\.[^.]*)?$') END AS domain,
  CASE WHEN number THEN name WHEN known THEN regexp_extract(name, '[^.]*(?:\.[^.]*)?$') ELSE regexp_extract(name, '[^.]*$') END AS suffix FROM l),
t AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS overall FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT overall FROM t) AS m FROM h GROUP BY 1),
sk AS ({FIT_SQL.format("s0")}), s1 AS (SELECT suffix, (k * m + bad) / (k + n) AS m FROM s0, sk),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM h JOIN s1 USING (suffix) GROUP BY 1, 2),
dk AS ({FIT_SQL.format("d0")}), d1 AS (SELECT domain, (k * m + bad) / (k + n) AS m FROM d0, dk),
h0 AS (SELECT host, n, bad, m FROM h JOIN d1 USING (domain)),
hk AS ({FIT_SQL.format("h0")}), h1 AS (SELECT host, k * m + bad AS a, k * (1 - m) + n - bad AS b FROM h0, hk),
b AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS bound FROM h1),
r AS (SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, r.host, path, rule, round(bound, 6) AS bound,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > {MOST_TIMES} * (SELECT overall FROM t) THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN b ON r.host = b.host
"""
