"""URL filter: listed rules first, then the reputation of the host by empirical Bayes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Suffixes of two labels below which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.kr", "com.cn", "com.mx", "co.za")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BOUND_Z = 1.64
LEAST_GOOD = 0.5


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict), or null. Of equally long ones block goes first.

    The list is a literal of the plan, so it is limited to 1,000 rules.
    """
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules fit into one expression")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in ordered
    ]
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fits, none)


def host_suffix(host: Column) -> Column:
    pair = F.substring_index(host, ".", -2)
    return F.when(pair.isin(*TWO_LABEL_SUFFIXES), pair).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    """The suffix and the label before it; a bare suffix or a host without a dot stands for itself."""
    pair = F.substring_index(host, ".", -2)
    return F.when(pair.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(pair)


def _strength(children: DataFrame, parent: str) -> DataFrame:
    """Beta strength a + b of a level by beta-binomial moments, in one row.

    A child of n outcomes with share s of good ones under a parent of mean m has
    E[n (s - m)^2] = m (1 - m) (1 + (n - 1) rho), so rho = sum(n (s - m)^2 - m (1 - m)) / sum((n - 1) m (1 - m)),
    and the strength is 1 / rho - 1. Spread no larger than that of sampling (rho <= 0, or no child of two
    outcomes to tell) pools the level: null, for a strength without end. Spread beyond the largest possible
    (rho >= 1) is strength 0.
    """
    m = F.col("mean")
    spread = m * (1 - m)
    share = F.col("good") / F.col("n")
    moments = children.where(F.col("n") > 0).agg(
        F.sum(F.col("n") * (share - m) ** 2 - spread).alias("v"), F.sum((F.col("n") - 1) * spread).alias("s")
    )
    rho = F.when(F.col("s") > 0, F.round(F.col("v") / F.col("s"), 9))
    return moments.select(F.when(rho >= 1, 0.0).when(rho > 0, 1 / rho - 1).alias(parent))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, good, n) to posterior (host, reputation, bound), shrunk host -> domain -> suffix -> all.

    ``outcomes`` has one row a host, hosts without labelled pages included (n = 0). Every level's mean
    is (good + strength * parent's mean) / (n + strength); the strength comes from the spread of the
    children's shares around it beyond that of sampling. A pooled level has its parent's posterior.
    ``bound``, at most 1, is mean + z * sd of the host's beta posterior: how good the host may still be.
    """
    hosts = outcomes.select("host", host_suffix(F.col("host")).alias("suffix"), registered_domain(F.col("host")).alias("domain"), "good", "n")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    whole = suffixes.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("mean"), (F.sum("n") + 2.0).alias("held"))

    def shrunk(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
        joined = children.join(parents, on) if on else children.join(F.broadcast(parents))  # one row
        strength = _strength(joined, "strength")
        own = F.col("n") + F.col("strength")  # null where the level is pooled: it is as its parent
        posterior = F.when(own > 0, (F.col("good") + F.col("strength") * F.col("mean")) / own).otherwise(F.col("mean"))
        found = joined.join(F.broadcast(strength))  # one row
        return found.withColumns({"posterior": posterior, "weight": F.coalesce(own, F.col("held"))})

    keys = lambda df, *names: df.select(*names, F.col("posterior").alias("mean"), F.col("weight").alias("held"))
    by_suffix = shrunk(suffixes, whole, [])
    by_domain = shrunk(domains, keys(by_suffix, "suffix"), ["suffix"])
    by_host = shrunk(hosts, keys(by_domain, "suffix", "domain"), ["suffix", "domain"])
    m = F.col("posterior")
    bound = F.least(F.lit(1.0), m + BOUND_Z * F.sqrt(m * (1 - m) / (F.col("weight") + 1)))
    return by_host.select("host", F.round(m, 9).alias("reputation"), F.round(bound, 9).alias("bound"))


def judged_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    url: str = "url",
    least_good: float = LEAST_GOOD,
) -> DataFrame:
    """Every row with host, path, rule, verdict and the host's reputation and bound.

    Rules decide where one fits; their verdicts are also the labelled outcomes from which the hosts'
    reputations are learnt. Elsewhere a host is blocked when even its posterior bound stays below
    ``least_good``, so a host without evidence is not blocked for lack of it. Null urls and those without ``://`` have an empty host, judged like any other.
    Columns of the input named like the added ones are replaced. No rows give no rows.
    """
    added = ("host", "path", "rule", "verdict", "reputation", "bound")
    found = pages.drop(*added).select(
        "*", url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )
    fitting = f"_rule_{uuid.uuid4().hex}"  # no column of the input has this name
    found = found.withColumn(fitting, matching_rule(F.col("host"), F.col("path"), rules))
    outcomes = found.groupBy("host").agg(
        F.sum(F.when(F.col(f"{fitting}.verdict") == "allow", 1).otherwise(0)).alias("good"), F.count(fitting).alias("n")
    )
    known = host_reputation(outcomes)
    judged = found.join(known, "host", "left")
    by_method = F.when(F.col("bound") >= least_good, "allow").otherwise("block")
    return judged.select(
        *[c for c in found.columns if c != fitting],
        F.col(f"{fitting}.rule").alias("rule"),
        F.coalesce(F.col(f"{fitting}.verdict"), by_method).alias("verdict"),
        "reputation",
        "bound",
    )
