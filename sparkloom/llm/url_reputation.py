"""Url filter: rule list first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host, and each rate is shrunk towards its
parent: host -> registered domain -> suffix -> all pages.  How strongly is learnt
from the data: at every level the prior's strength is the method-of-moments
estimate of a beta-binomial (children that differ more than a binomial allows get
a weaker prior), and never more pseudo-pages than the parent has pages.  A host is blocked if the lower posterior bound of its share of
bad pages lies above ``threshold``.

Only counts travel: one row per host and task is shuffled, so a host that has a
third of all pages costs no more than any other, and the verdicts come back by an
equi-join whose large side AQE may split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

#: (host, path prefix, action)
Rule = tuple[str, str, str]

MAX_RULES = 1000


@dataclass(frozen=True)
class Prior:
    """Bounds of a prior's strength in pseudo-pages, and the decision rule."""

    least: float = 1.0
    most: float = 1000.0
    z: float = 1.645
    threshold: float = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; '' without ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


#: Second-level labels that registries of countries sell names under.
SHARED_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Two labels such as co.uk are one suffix.
PAIRED_SUFFIX = rf"(?:{'|'.join(SHARED_LABELS)})\.[a-z]{{2}}"
SUFFIX = rf"(?:^|\.)({PAIRED_SUFFIX}|[^.]*)$"
DOMAIN = rf"(?:^|\.)([^.]*\.{PAIRED_SUFFIX}|[^.]*\.[^.]*|[^.]*)$"


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and the label before it."""
    return F.regexp_extract(host, DOMAIN, 1)


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where they are like co.uk."""
    return F.regexp_extract(host, SUFFIX, 1)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule string, action) of the longest fitting rule, or NULLs.

    The list becomes one CASE, so it is limited to ``MAX_RULES``.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the limit is {MAX_RULES}")
    rule = action = F.lit(None).cast("string")
    for h, p, act in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _strength(level: DataFrame, prior: Prior) -> float:
    """Pseudo-pages of the prior that ties children (n, bad) to parents (pn, pbad)."""
    m = F.try_divide("pbad", "pn")
    v = m * (1 - m)
    row = level.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.try_divide("bad", "n") - m, 2)).alias("s"),
        F.sum(v).alias("v"),
        F.sum((F.col("n") - 1) * v).alias("d"),
    ).first()
    if not row.d:
        return prior.most
    rho = (row.s - row.v) / row.d
    return prior.most if rho <= 1 / (1 + prior.most) else max(prior.least, 1 / rho - 1)


def host_reputation(outcomes: DataFrame, prior: Prior = Prior()) -> DataFrame:
    """One row per host: n, bad, posterior_mean, lower_bound.

    ``outcomes`` has host and bad (1, 0 or NULL for pages without label).  Hosts
    without labels get their domain's rate, and so on upwards; with no label at all
    every rate is 0.5.
    """
    hosts = stored(
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}),
        "hosts",
    )
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"))
    total = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("n"), F.coalesce(F.sum("sbad"), F.lit(0)).alias("bad")).first()
    p0 = (total.bad + 1) / (total.n + 2)
    k_s = _strength(suffixes.select(F.col("sn").alias("n"), F.col("sbad").alias("bad"), F.lit(total.n).alias("pn"), F.lit(total.bad).alias("pbad")), prior)
    d = domains.join(suffixes, "suffix")
    k_d = _strength(d.select(F.col("dn").alias("n"), F.col("dbad").alias("bad"), F.col("sn").alias("pn"), F.col("sbad").alias("pbad")), prior)
    h = hosts.join(d.drop("suffix"), "domain")
    k_h = _strength(h.select("n", "bad", F.col("dn").alias("pn"), F.col("dbad").alias("pbad")), prior)
    # a parent's rate is known no better than from its own pages
    k_s, k_d, k_h = F.lit(float(min(k_s, total.n + 2))), F.least(F.lit(k_d), F.col("sn") + 2), F.least(F.lit(k_h), F.col("dn") + 2)
    p_s = (F.col("sbad") + k_s * p0) / (F.col("sn") + k_s)
    p_d = (F.col("dbad") + k_d * p_s) / (F.col("dn") + k_d)
    h = h.withColumns({"p_d": p_d, "k": k_h})
    a = F.col("bad") + F.col("k") * F.col("p_d")
    b = F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("p_d"))
    h = h.select("host", "n", "bad", a.alias("a"), b.alias("b"))
    t = F.col("a") + F.col("b")
    mean = F.col("a") / t
    low = mean - F.lit(prior.z) * F.sqrt(F.col("a") * F.col("b") / (t * t * (t + 1)))
    return h.select("host", "n", "bad", F.round(mean, 6).alias("posterior_mean"), F.round(low, 6).alias("lower_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], prior: Prior = Prior()) -> DataFrame:
    """A verdict for every row of ``pages`` (page_id, url).

    ``outcomes`` has page_key and bad; ``pages`` rows find theirs by the first number that
    begins a segment of the path ('/825', '/825/', '/825.html', '/825-title').  The longest fitting rule decides; else 'block' where
    the host's lower bound exceeds the threshold, 'allow' elsewhere.

    NULL or odd urls have host and path '' and are judged as the host ''.  Repeated
    rows are judged one by one.  Extra columns are ignored.  An empty table gives an
    empty result.
    """
    url = F.col("url")
    p = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    p = p.withColumn("page_key", F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT)"))
    marks = outcomes.filter("page_key IS NOT NULL AND bad IS NOT NULL").groupBy("page_key").agg(F.max("bad").alias("bad"))
    # every page names its host; only those with a number look for a mark, so no row joins by NULL
    seen = p.select("host", F.lit(None).cast("int").alias("bad"))
    found = p.filter("page_key IS NOT NULL").select("host", "page_key").join(marks, "page_key").select("host", "bad")
    rep = stored(host_reputation(seen.unionByName(found), prior), "reputation")
    rule, action = match_rule(F.col("host"), F.col("path"), rules)
    return (
        p.drop("page_key").join(rep, "host", "left")
        .select("page_id", "host", "path", rule.alias("rule"),
                F.coalesce(action, F.when(F.col("lower_bound") > prior.threshold, "block").otherwise("allow")).alias("verdict"),
                F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad"), "posterior_mean", "lower_bound")
    )
