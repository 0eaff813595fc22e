"""URL filters: rules, and an empirical-Bayes reputation of hosts (operator 10); DataFrame functions only.

Reputation: pages with a known outcome (bad or not) are counted by host. The share of bad pages is shrunk through beta
priors, from the corpus to the public suffix, to the registered domain, to the host: each level's posterior mean is
the mean of the next level's prior, and the prior's weight is fitted by moments to how much groups of the level differ from
their parents beyond binomial chance. A host is blocked if its share of bad pages exceeds LIMIT even at the lower
posterior bound (mean less Z standard deviations), so hosts of which little is known are let through.

Rules (host, path, verdict) fit their host, all its subdomains and paths that start with theirs; the longest wins, over
any reputation. Null urls and urls without :// have an empty host and path; they are judged as one host. Rows that
repeat a page_id are judged each; several labels of a page count each. Rules are joined with distinct hosts and cost a row for each
level of a host's name. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import cut, table

#: Fixed values of the contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Public suffixes of two labels (the last label alone is the suffix of other names).
SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk"]
LIMIT, Z = 0.5, 1.645
LEVELS = ("suffix", "domain", "host")


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)


def levels(hosts: DataFrame) -> DataFrame:
    """host with its registered domain and suffix; a name that is an address, or a suffix itself, is its own domain."""
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), "(:[0-9]*)?[.]*$", "")
    labels = F.split(name, "[.]")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    width = F.when(two.isin(SUFFIXES), 2).otherwise(1)
    address = F.rlike(name, F.lit(r"^([0-9]+[.]){3}[0-9]+$")) | F.startswith(name, F.lit("["))
    suffix = F.when(address, F.lit("")).otherwise(F.array_join(F.slice(labels, F.greatest(n - width + 1, F.lit(1)), width), "."))
    domain = F.when(address, name).otherwise(F.array_join(F.slice(labels, F.greatest(n - width, F.lit(1)), width + 1), "."))
    return hosts.select("*", suffix.alias("suffix"), domain.alias("domain"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, k, mean, low; outcomes: host, n (labelled pages), k (bad ones), of every host."""
    rows = levels(outcomes)
    total = rows.agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    prior = total.select(((F.coalesce("k", F.lit(0)) + 0.5) / (F.coalesce("n", F.lit(0)) + 1.0)).alias("above"))
    parent, above = [], prior
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        groups = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        groups = groups.join(above, parent) if parent else groups.crossJoin(F.broadcast(above))  # one row
        rate = F.try_divide(F.col("k"), F.col("n"))
        spread = F.sum(F.when(F.col("n") > 1, F.col("n") * (rate - F.col("above")) ** 2 / (F.col("above") * (1 - F.col("above"))) - 1))
        fit = groups.agg((F.coalesce(F.try_divide(spread, F.sum(F.when(F.col("n") > 1, F.col("n") - 1))), F.lit(0.0))).alias("rho"))
        fit = fit.select((1.0 / F.least(F.greatest("rho", F.lit(0.001)), F.lit(0.999)) - 1.0).alias("weight"))
        groups = groups.crossJoin(F.broadcast(fit))  # one row
        a, size = F.col("k") + F.col("weight") * F.col("above"), F.col("n") + F.col("weight")
        mean = a / size
        low = mean - Z * F.sqrt(mean * (1 - mean) / (size + 1))
        above = groups.select(*keys, mean.alias("above"), low.alias("low"), "n", "k")
        if level == "host":
            return above.select("host", "n", "k", F.col("above").alias("mean"), "low")
        parent, above = keys, above.select(*keys, "above")
    raise AssertionError


def rule_table(pages: DataFrame, rules=None) -> DataFrame:
    """The rules as literals of a plan, so that no worker but the JVM makes them."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules or RULES]
    return pages.sparkSession.range(1).select(F.inline(F.array(*rows)))


def judged(pages: DataFrame, outcomes: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url); outcomes: page_id, bad (boolean) of some."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.groupBy("page_id").agg(F.count("bad").alias("n"), F.count_if("bad").alias("k"))
    counts = rows.join(known, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    hosts = cut(counts, "hosts")
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = hosts.select(F.col("host").alias("of"), F.explode(above).alias("host")).join(rules, "host")
    rule = F.concat("host", "path")
    fits = fits.groupBy(F.col("of").alias("host")).agg(F.collect_list(F.struct(F.length(rule).alias("size"), rule.alias("rule"), F.col("path").alias("path"), "verdict")).alias("rules"))
    standing = reputation(hosts).select("host", F.when(F.col("low") > LIMIT, "block").otherwise("allow").alias("standing"))
    of = standing.join(fits, "host", "left")
    out = rows.join(of, "host")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    out = out.withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "standing").alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    """Outcomes: the labels with a page's id; a page is bad that is of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return judged(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), rule_table(pages))


ORACLE = r"""
with rules(rhost, rpath, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p as (
  select page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages
), l as (
  select doc_id, count(*) as n, count(*) filter (quality = 0 or toxic = 1) as k from labels group by 1
), h as (
  select host, cast(coalesce(sum(n), 0) as double) as n, cast(coalesce(sum(k), 0) as double) as k,
         string_split(regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?[.]*$', ''), '.') as parts
  from p left join l on p.page_id = l.doc_id group by host
), g as (
  select host, n, k, parts[-1] as suffix, array_to_string(parts[-2:], '.') as domain from h
), t as (
  select (sum(k) + 0.5) / (sum(n) + 1.0) as above from g
), s1 as (
  select suffix, sum(n) as n, sum(k) as k, any_value(above) as above from g, t group by 1
), s2 as (
  select 1.0 / least(greatest(coalesce(sum(case when n > 1 then n * pow(k / n - above, 2) / (above * (1 - above)) - 1 end) / nullif(sum(case when n > 1 then n - 1 end), 0), 0), 0.001), 0.999) - 1.0 as w from s1
), s as (
  select suffix, (k + w * above) / (n + w) as above from s1, s2
), d1 as (
  select g.suffix, domain, sum(n) as n, sum(k) as k, any_value(above) as above from g join s on g.suffix = s.suffix group by 1, 2
), d2 as (
  select 1.0 / least(greatest(coalesce(sum(case when n > 1 then n * pow(k / n - above, 2) / (above * (1 - above)) - 1 end) / nullif(sum(case when n > 1 then n - 1 end), 0), 0), 0.001), 0.999) - 1.0 as w from d1
), d as (
  select suffix, domain, (k + w * above) / (n + w) as above from d1, d2
), h1 as (
  select host, n, k, above from g join d on g.suffix = d.suffix and g.domain = d.domain
), h2 as (
  select 1.0 / least(greatest(coalesce(sum(case when n > 1 then n * pow(k / n - above, 2) / (above * (1 - above)) - 1 end) / nullif(sum(case when n > 1 then n - 1 end), 0), 0), 0.001), 0.999) - 1.0 as w from h1
), r as (
  select host, (k + w * above) / (n + w) as m, n + w as size from h1, h2
), best as (
  select p.page_id, p.host, p.path, rhost || rpath as rule, verdict, length(rhost || rpath) as size
  from p join rules on (p.host = rhost or ends_with(p.host, '.' || rhost)) and starts_with(p.path, rpath)
)
select p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, case when m - 1.645 * sqrt(m * (1 - m) / (size + 1)) > 0.5 then 'block' else 'allow' end) as verdict
from p join r on p.host = r.host
left join (select page_id, host, path, max_by(rule, size) as rule, max_by(verdict, size) as verdict from best group by all) b on p.page_id = b.page_id and p.host = b.host and p.path = b.path
"""
