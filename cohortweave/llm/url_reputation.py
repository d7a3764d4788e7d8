"""Verdicts on urls: fixed host and path rules, else the reputation of the host.

Reputation is empirical Bayes over labelled page outcomes.  The share of bad pages of
a host is shrunk toward its registered domain, the domain's toward its suffix and the
suffix's toward all pages, each by a beta-binomial prior whose strength is fitted to
the groups of that level by moments.  A host is blocked if the lower bound of its
posterior exceeds a limit, so a few bad pages don't block a host.

Main path: built-in functions only.  Outcomes are summed per host before anything else
moves, and written once; the joins that follow are on these sums.  Pages meet their host's verdict in a join whose
large side adaptive execution splits where a host is hot; only blocked hosts are on its other side.

Cases: a null url, or one without ``://``, has an empty host and path, follows no rule and
is allowed; outcomes without page or label are ignored; several outcomes of a page all
count; repeated pages are judged row by row; a page without id has no outcome; without any
outcome nothing is blocked but by rule; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.common import pick
from cohortweave.session import materialize

#: Suffixes of two labels under which names are registered.
DOUBLE_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp",
    "co.nz", "com.br", "com.mx", "com.ar", "com.cn", "com.tr", "co.in", "co.kr", "co.za",
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A host is blocked if this much of its pages is bad, at the posterior bound below.
BAD_LIMIT = 0.5
#: The bound lies this many posterior standard deviations under the mean.
BOUND_DEVIATIONS = 1.645
#: Correlation of pages within a group; the prior's strength is 1 / correlation - 1.
LEAST_CORRELATION, MOST_CORRELATION = 0.001, 0.5


@dataclass(frozen=True)
class UrlRule:
    """``host`` with its subdomains and every path that starts with ``path``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    UrlRule("allow", "com/"),
    UrlRule("block", "example.com/en/"),
    UrlRule("allow", "www.example.com/en/"),
    UrlRule("block", "net/es/"),
    UrlRule("block", "net/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without its port; an only label is its own domain."""
    labels = F.split(F.regexp_extract(host, "^[^:]*", 0), "\\.")
    n = F.size(labels)
    last = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    width = F.when(last.isin(list(DOUBLE_SUFFIXES)), 2).otherwise(1)

    def tail(k: Column) -> Column:
        return F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), n), ".")

    return tail(width + 1), F.when(n > width, tail(width)).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule] = RULES) -> Column:
    """Text and verdict of the longest rule that fits, as a struct; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(
            path, F.lit(rule.path)
        )
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame, mean: str, n: str, bad: str) -> float:
    """Strength of the prior of groups around their parents' means, by moments."""
    share = F.col(mean) * (1 - F.col(mean))
    sums = groups.filter(F.col(n) > 0).agg(
        F.sum(F.pow(F.col(bad) - F.col(n) * F.col(mean), 2) / F.col(n)).alias("spread"),
        F.sum(share).alias("alone"),
        F.sum(share * (F.col(n) - 1)).alias("together"),
    ).first()
    correlation = (sums.spread - sums.alone) / sums.together if sums.together else MOST_CORRELATION
    return round(1 / min(max(correlation, LEAST_CORRELATION), MOST_CORRELATION) - 1, 6)


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior per host from page outcomes (host, is_bad): n, bad, mean and the lower ``bound``.

    ``outcomes`` has a row per page; rows without label (null) only make their host known.
    """
    known = F.col("is_bad").isNotNull()
    hosts = (
        pick(outcomes, "host", "is_bad")
        .groupBy("host")
        .agg(
            F.sum(F.when(known, 1).otherwise(0)).alias("n"),
            F.sum(F.when(F.col("is_bad"), 1).otherwise(0)).alias("bad"),
        )
        .select("*", *[c.alias(a) for c, a in zip(domain_and_suffix(F.col("host")), ("domain", "suffix"))])
    )
    # every level's fit reads the sums; the pages are read once for them
    hosts = materialize(hosts, "host-sums")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n_d"), F.sum("bad").alias("bad_d"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n_d").alias("n_s"), F.sum("bad_d").alias("bad_s"))
    total = suffixes.agg(F.sum("n_s").alias("n"), F.sum("bad_s").alias("bad")).first()
    mean = ((total.bad or 0) + 1) / ((total.n or 0) + 2)

    def shrunk(groups: DataFrame, n: str, bad: str, parent: str) -> DataFrame:
        strength = _strength(groups, parent, n, bad)
        weight = F.col(n) + F.lit(strength)
        return groups.withColumn("weight", weight).withColumn(
            "mean", (F.col(bad) + F.lit(strength) * F.col(parent)) / weight
        )

    of_suffix = shrunk(suffixes.withColumn("parent", F.lit(mean)), "n_s", "bad_s", "parent").select(
        "suffix", F.col("mean").alias("mean_s")
    )
    of_domain = shrunk(domains.join(of_suffix, "suffix"), "n_d", "bad_d", "mean_s").select(
        "domain", F.col("mean").alias("mean_d")
    )
    of_host = shrunk(hosts.join(of_domain, "domain"), "n", "bad", "mean_d")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return of_host.select(
        "host", "domain", "suffix", "n", "bad", "mean", (F.col("mean") - BOUND_DEVIATIONS * deviation).alias("bound")
    )


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[UrlRule] = RULES, limit: float = BAD_LIMIT
) -> DataFrame:
    """page_id, host, path, rule and verdict of all pages (page_id, url).

    ``outcomes`` (page_id, is_bad) labels some pages.  A rule's verdict comes
    before the reputation's.
    """
    split = pick(pages, "page_id", "url")
    host, path = host_and_path(F.col("url"))
    split = split.select("page_id", host.alias("host"), path.alias("path"))
    labelled = pick(outcomes, "page_id", "is_bad").filter("page_id IS NOT NULL AND is_bad IS NOT NULL")
    seen = split.select("page_id", "host").join(labelled, "page_id", "left").select("host", "is_bad")
    blocked = host_reputation(seen).filter((F.col("bound") > limit) & (F.col("host") != "")).select(
        "host", F.lit(True).alias("_blocked")
    )
    by_rule = matching_rule(F.col("host"), F.col("path"), rules)
    judged = split.join(blocked, "host", "left").select("page_id", "host", "path", "_blocked", by_rule.alias("_rule"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("_blocked"), "block").otherwise("allow")).alias("verdict"),
    )
