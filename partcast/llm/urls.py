"""URL filters: rules, and elsewhere the host's reputation by empirical Bayes.

Labelled pages (good or bad) are counted by host, registered domain and suffix.  Each level
has a beta-binomial model whose strength is estimated from how far its groups' shares spread
beyond chance; a group's prior mean is the posterior mean of the level above, the suffix's
that of all.  A page whose host's posterior for badness has its lower bound above the
threshold is blocked.  Hosts without labels have their domain's posterior, and so on upward.

Rules are a short hand-written list (``MAX_RULES``), tried longest first.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and
the overall reputation; an empty host is a group of its own; very long urls, hosts and
paths are read whole; of rules that fit, the longest decides (of equally long ones the later by
code point); rows of one page_id are judged
each, and a page_id labelled several times counts each label; without labels nothing is
blocked but by rules; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partcast.llm.base import materialise

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MAX_RULES = 500
#: Standard deviations below the posterior mean, and the share of bad pages it must exceed.
DEVIATIONS, THRESHOLD = 1.645, 0.5
#: Highest intra-group correlation used: a prior counts as two pages at least, so that one
#: labelled page never blocks a host.
MOST_CORRELATED = 0.333
SALTS = 16


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null: its host is the page's or above it, and the
    page's path starts with its path."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(text)).otherwise(found)
    return found


def _strength(groups: DataFrame) -> DataFrame:
    """Strength of the prior (one row) from the spread of the groups' shares: the moment
    estimate of the intra-group correlation r, as 1/r - 1."""
    n, p = F.col("n"), F.col("bad") / F.col("n")
    sums = groups.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum("bad").alias("B"), F.sum(n * n).alias("N2"),
                      F.sum(n * p * p).alias("S2"))
    mean = F.col("B") / F.col("N")
    within = mean * (1 - mean)
    spread = F.col("S2") - F.col("N") * mean * mean
    size = F.col("N") - F.col("N2") / F.col("N") - (F.col("k") - 1)
    r = F.when((within > 0) & (size > 0), (spread / within - (F.col("k") - 1)) / size)
    return sums.select(mean.alias("mean"), (1 / F.least(F.greatest(F.coalesce(r, F.lit(0.001)), F.lit(0.001)), F.lit(MOST_CORRELATED)) - 1).alias("strength"))


def _level(groups: DataFrame, prior: Column) -> Column:
    """Posterior mean with the level's strength."""
    return (F.col("strength") * prior + F.col("bad")) / (F.col("strength") + F.col("n"))


def reputation(hosts: DataFrame) -> DataFrame:
    """hosts: host, n (labelled pages), bad; every host a row.  Returns host, mean, lower."""
    named = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad")
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def with_strength(groups: DataFrame) -> DataFrame:
        one = _strength(groups.where("n > 0")).select(F.struct("mean", "strength").alias("fit"))
        # one row for all: a join on a constant that Spark sends to every task
        return (groups.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")
                .withColumn("strength", F.coalesce(F.col("fit.strength"), F.lit(999.0))))

    s = with_strength(suffixes)
    s = s.select("suffix", _level(s, F.coalesce(F.col("fit.mean"), F.lit(0.0))).alias("prior"))
    d = with_strength(domains).join(s, "suffix")
    d = d.select("domain", _level(d, F.col("prior")).alias("prior"))
    h = with_strength(named).join(d, "domain")
    mean, total = _level(h, F.col("prior")), F.col("strength") + F.col("n")
    return (h.select("host", mean.alias("mean"), total.alias("total"))
            .select("host", "mean", (F.col("mean") - DEVIATIONS * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("total") + 1))).alias("lower")))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict.  ``labels``: doc_id of a page, quality, toxic; a
    page of quality 0 or that is toxic is a bad one."""
    rows = materialise(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "pages")
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long")
    outcomes = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(bad).alias("bad"))
    known = rows.join(outcomes, rows["page_id"] == outcomes["doc_id"], "left")
    hosts = known.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    lower = reputation(hosts).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("host", "_host")
    blocked = [r for r, action in rules if action == "block"]
    return (rows.withColumn("_s", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
            .join(lower, (F.col("host") == F.col("_host")) & (F.col("_s") == F.col("_salt")), "left")
            .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
            .withColumn("verdict", F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(blocked), "block").otherwise("allow"))
                        .when(F.col("lower") > THRESHOLD, "block").otherwise("allow"))
            .select("page_id", "host", "path", "rule", "verdict"))


ORACLE = r"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
p AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
r AS (SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                     WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p),
o AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix,
             CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad FROM p LEFT JOIN o ON page_id = doc_id GROUP BY 1, 2, 3),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
g AS (SELECT 'h' AS lv, n, bad FROM h WHERE n > 0 UNION ALL SELECT 'd', n, bad FROM d WHERE n > 0 UNION ALL SELECT 's', n, bad FROM s WHERE n > 0),
m AS (SELECT lv, count(*) AS k, sum(n) AS nn, sum(bad) / sum(n) AS mean, sum(n * n) AS n2, sum(bad * bad / n) AS s2 FROM g GROUP BY lv),
z AS (SELECT lv, mean, mean * (1 - mean) AS wi, s2 - nn * mean * mean AS sp, nn - n2 / nn - (k - 1) AS sz, k FROM m),
f AS (SELECT lv, mean, 1 / least(greatest(coalesce(CASE WHEN wi > 0 AND sz > 0 THEN (sp / wi - (k - 1)) / sz END, 0.001), 0.001), 0.333) - 1 AS st FROM z),
sp AS (SELECT suffix, (coalesce((SELECT st FROM f WHERE lv = 's'), 999) * coalesce((SELECT mean FROM f WHERE lv = 's'), 0) + bad)
                      / (coalesce((SELECT st FROM f WHERE lv = 's'), 999) + n) AS prior FROM s),
dp AS (SELECT domain, (coalesce((SELECT st FROM f WHERE lv = 'd'), 999) * prior + bad) / (coalesce((SELECT st FROM f WHERE lv = 'd'), 999) + n) AS prior
       FROM d JOIN sp USING (suffix)),
hp AS (SELECT host, (coalesce((SELECT st FROM f WHERE lv = 'h'), 999) * prior + bad) / (coalesce((SELECT st FROM f WHERE lv = 'h'), 999) + n) AS mean,
              coalesce((SELECT st FROM f WHERE lv = 'h'), 999) + n AS total FROM h JOIN dp USING (domain))
SELECT page_id, r.host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN hp ON r.host = hp.host
"""
