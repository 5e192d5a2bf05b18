"""The strength of host reputations on simulated outcomes, and names of the input that clash."""

import numpy as np

from driftwatch.llm import urls


def reputations(spark, hosts):
    found = urls.host_reputation(spark.createDataFrame(hosts, "host string, good long, n long")).collect()
    return {r["host"]: (r["reputation"], r["bound"]) for r in found}


def strength(spark, children):
    return urls._strength(spark.createDataFrame(children, "good long, n long, mean double"), "k").first()["k"]


def test_strength_of_simulated_beta_binomials(spark):
    rng = np.random.default_rng(3)
    for a, b in ((2.0, 2.0), (6.0, 2.0), (0.5, 0.5)):
        n = rng.integers(1, 60, 3000)
        good = rng.binomial(n, rng.beta(a, b, 3000))
        children = [(int(g), int(k), a / (a + b)) for g, k in zip(good, n, strict=True)]
        assert abs(strength(spark, children) / (a + b) - 1) < 0.15


def test_sampling_noise_is_no_spread(spark):
    """One page a host, half of them good: no host is blocked for its single bad page."""
    found = reputations(spark, [(f"h{i}.example.org", i % 2, 1) for i in range(2000)])
    assert all(abs(r - 0.5) < 0.01 and 0.5 < b < 0.55 for r, b in found.values())
    assert strength(spark, [(1, 1, 0.5), (0, 1, 0.5)]) is None  # no child of two outcomes
    assert strength(spark, [(5, 10, 0.5), (5, 10, 0.5)]) is None  # less spread than sampling gives


def test_the_largest_spread_shrinks_nothing(spark):
    assert strength(spark, [(10, 10, 0.5), (0, 10, 0.5)]) == 0.0
    hosts = [(f"h{i}.site{i}.org", 20 * (i % 2), 20) for i in range(40)] + [("new.site99.org", 0, 0)]
    found = reputations(spark, hosts)
    assert all(found[f"h{i}.site{i}.org"][1] < 0.5 for i in range(0, 40, 2))
    assert all(found[f"h{i}.site{i}.org"][0] > 0.9 for i in range(1, 40, 2))
    assert found["new.site99.org"][1] >= 0.5  # not blocked for lack of evidence
    assert all(b <= 1 for _, b in found.values())


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "http://a.com/x", "p", "q", "r")], "page_id long, url string, _host string, _rule string, host string")
    row = urls.judged_urls(rows).first()
    assert (row["_host"], row["_rule"], row["host"], row["rule"], row["verdict"]) == ("p", "q", "a.com", "com/", "allow")
