"""URL filter: allow and block rules first, then an empirical-Bayes reputation.

Labelled page outcomes (good or bad) are counted per host. The share of bad
pages of a host is shrunk towards that of its registered domain, the domain's
towards that of its public suffix, and the suffix's towards the overall share,
each by a beta-binomial prior:

    mean(level) = (bad + c * mean(parent)) / (n + c)

with c, the prior's weight in pages, estimated for each level from all its
members by the method of moments. The host's posterior is
Beta(c * m + bad, c * (1 - m) + good) for its domain's mean m; a page is blocked
when even the lower bound of its host's bad share, z standard deviations below
the posterior mean, is above the threshold.

A user name, a port and a closing dot don't count for a host's reputation. Its
registered domain is the public suffix and one label more; public suffixes come from a
table of rules as public suffix lists have them: `co.uk`, `*.ck` for any label before
it, `!www.ck` for an exception; a host that no rule fits has its last label as suffix.
Of an address in numbers all three are the address.

DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

#: Rules for public suffixes of more than one label; a longer list comes as a table.
#: Fixed values.
SUFFIX_RULES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "net.au", "org.au", "org.uk")


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case; path:
    from there up to ?, # or the end. Both empty without :// or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def bare_host(host: Column) -> Column:
    """Without user name, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def default_suffix_rules(hosts: DataFrame) -> DataFrame:
    """SUFFIX_RULES as a table."""
    return hosts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SUFFIX_RULES))).alias("rule"))


def with_domains(hosts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """hosts (distinct names, column name) with suffix and domain. rules: column rule; of
    several that fit an exception wins, else the one of most labels."""
    rules = default_suffix_rules(hosts) if rules is None else rules
    rule = F.trim("rule")
    exception, wild = rule.startswith("!"), rule.startswith("*.")
    tail = F.when(exception, F.substr(rule, F.lit(2))).when(wild, F.substr(rule, F.lit(3))).otherwise(rule)
    size = F.size(F.split(tail, r"\.")) + F.when(exception, F.lit(-1)).when(wild, F.lit(1)).otherwise(F.lit(0))
    known = rules.where("rule is not null").select(tail.alias("tail"), F.struct(exception.alias("exception"), size.alias("labels")).alias("fit")).distinct()
    named = hosts.withColumns({"labels": F.split("name", r"\."), "address": F.col("name").rlike(r"^([0-9.]+|\[.*)$")})
    n = F.size("labels")
    last = lambda k: F.array_join(F.slice("labels", F.greatest(n - k + 1, F.lit(1)), k), ".")
    tails = named.where(~F.col("address") & (n > 1)).select("name", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), n), last)).alias("tail"))
    fits = tails.join(known, "tail").where("fit.labels <= n").groupBy("name").agg(F.max("fit").alias("fit"))
    k = F.coalesce(F.col("fit.labels"), F.lit(1))
    part = lambda size: F.when(F.col("address"), F.col("name")).otherwise(last(size))
    return named.join(fits, "name", "left").select(*hosts.columns, part(k).alias("suffix"), part(k + 1).alias("domain"))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.rule)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


#: Least and most weight of a prior, in pages.
PRIOR_WEIGHT = (2.0, 200.0)


def _level(stats: DataFrame) -> tuple[float, float, float]:
    """Pages, bad pages and the weight c of the prior of a level with columns n and
    bad, by moments: the shares spread by m (1 - m) / (c + 1) beyond binomial noise."""
    n = F.col("n").cast("double")
    row = stats.agg(F.sum(n).alias("n"), F.sum("bad").cast("double").alias("bad"), F.count(F.lit(1)).alias("k"), F.sum(F.col("bad") * F.col("bad") / n).alias("q"), F.sum(n * n).alias("n2")).first()
    if not row.n:
        return 0.0, 0.0, PRIOR_WEIGHT[1]
    m = row.bad / row.n
    free = row.n - row.n2 / row.n
    spread = (row.q - row.n * m * m - (row.k - 1) * m * (1 - m)) / free if free > 0 else 0.0
    c = m * (1 - m) / spread - 1 if spread > 0 else PRIOR_WEIGHT[1]
    return row.n, row.bad, min(max(c, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])


def judge_hosts(seen: DataFrame, z: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """seen with mean and low (lower bound) of the bad share, and method_verdict. seen:
    name, domain, suffix, and n and bad, the host's labelled pages and the bad ones of
    them."""
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = seen.where("n > 0")
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    pages, bad, c_host = _level(hosts)
    c_domain, c_suffix = _level(domains)[2], _level(suffixes)[2]
    overall = F.lit((bad + 1.0) / (pages + 2.0))

    by_suffix = suffixes.select("suffix", ((F.col("bad") + c_suffix * overall) / (F.col("n") + c_suffix)).alias("ms"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", ((F.col("bad") + c_domain * F.col("ms")) / (F.col("n") + c_domain)).alias("md"))
    m = F.coalesce(F.col("md"), F.col("ms"), overall)
    joined = seen.join(by_domain, "domain", "left").join(by_suffix, "suffix", "left")
    joined = joined.withColumns({"a": c_host * m + F.col("bad"), "b": c_host * (1 - m) + F.col("n") - F.col("bad")})
    total = F.col("a") + F.col("b")
    mean, sd = F.col("a") / total, F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    low = F.greatest(mean - z * sd, F.lit(0.0))
    return joined.select(*seen.columns, mean.alias("mean"), low.alias("low")).withColumn("method_verdict", F.when(F.col("low") > threshold, F.lit("block")).otherwise(F.lit("allow")))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], z: float = 1.0, threshold: float = 0.5, suffix_rules: DataFrame | None = None) -> DataFrame:
    """Every row of pages with page_id, host, path, rule and verdict, and the bad
    share's posterior mean and lower bound.

    outcomes: page_id and bad (0 or 1, null counts for nothing). A page without a
    url has an empty host, which has the reputation of its own labelled pages.
    Ports, user names and addresses in numbers: see the module. Repeated rows are
    judged alike. Empty tables give an empty result; without outcomes everything but
    the rules' blocks is allowed. Other columns of pages don't matter.
    """
    host, path = host_and_path(F.col("url"))
    page = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("name", bare_host(F.col("host")))
    labelled = outcomes.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("bigint").alias("bad"))
    once = page.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.min("name").alias("name"))
    counted = once.join(labelled, "page_id").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    names = with_domains(page.groupBy("name").agg(F.count(F.lit(1)).alias("pages")), suffix_rules)
    zero = F.lit(0).cast("bigint")
    seen = written(names.join(counted, "name", "left").withColumns({"n": F.coalesce("n", zero), "bad": F.coalesce("bad", zero)}), "hosts")
    verdicts = written(judge_hosts(seen, z, threshold).select("name", "pages", "mean", "low", "method_verdict"), "verdicts")
    n = seen.agg(F.coalesce(F.sum("pages"), zero)).first()[0]
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return join_counted(page, verdicts, "name", "pages", n).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("method_verdict")).alias("verdict"), F.col("mean").alias("bad_mean"), F.col("low").alias("bad_low"))
