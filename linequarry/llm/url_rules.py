"""URL verdicts: longest matching host/path rule, else an empirical-Bayes host reputation.

Hosts with few labelled pages borrow from their registered domain, domains from
their suffix and suffixes from the whole table, by beta-binomial shrinkage:

* At each level a group with ``n`` labelled pages, ``k`` of them bad, has the
  prior Beta(s m, s (1 - m)), where m is the posterior mean of its parent.
* The prior's weight ``s = 1 / rho - 1`` is fitted once per level by moments:
  rho = sum((k - n m)^2 / n - m (1 - m)) / sum((n - 1) m (1 - m)), held in
  [rho_min, rho_max].
* A host is blocked when the posterior rate of bad pages exceeds ``max_bad``
  even at its lower bound, mean - z * deviation.

Only aggregates per host are shuffled with partial sums; pages meet their
host's verdict in a join that adaptive execution may split at a hot host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOMAIN = r"[^.]*\.(?:(?:co|com|org|net|ac|gov|edu)\.[a-z][a-z]|[^.]*)$"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def domain_of(host: Column) -> Column:
    found = F.regexp_extract(host, DOMAIN, 0)
    return F.when(found == "", host).otherwise(found)


def suffix_of(domain: Column) -> Column:
    at = F.instr(domain, ".")
    return F.when(at > 0, F.substring(domain, at + 1, F.length(domain))).otherwise(domain)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path-prefix`` that fits, nulls if none does.

    Of two rules of one length that both fit, a block goes before an allow,
    then the alphabetically first.
    """
    rule = verdict = None
    for text, says in sorted(set(rules), key=lambda r: (-len(r[0]), r[1] != "block", r[0])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _shrunk(groups: DataFrame, keys: list[str], parent_mean: Column, rho_min: float, rho_max: float) -> DataFrame:
    """Adds s (the level's prior weight) and m (the parent's mean) to one row per group with n and k."""
    g = groups.withColumn("m", parent_mean)
    mm = F.col("m") * (1 - F.col("m"))
    fit = g.where("n > 0").agg(
        (F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), F.lit(2.0)) / F.col("n") - mm) / F.nullif(F.sum((F.col("n") - 1) * mm), F.lit(0.0))).alias("rho")
    )
    rho = F.greatest(F.lit(rho_min), F.least(F.lit(rho_max), F.coalesce(F.col("rho"), F.lit(rho_max))))
    return g.crossJoin(F.broadcast(fit.select((1 / rho - 1).alias("s"))))  # one row


def host_reputation(pages: DataFrame, outcomes: DataFrame, rho_min: float = 0.001, rho_max: float = 0.9) -> DataFrame:
    """One row per host: n, k, alpha, beta of the posterior rate of bad pages.

    ``pages`` has page_id and host; ``outcomes`` page_id and bad (0/1, nulls
    ignored; of repeated rows the worst counts).  No labels at all: every
    posterior is the flat prior's mean of one half.
    """
    worst = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    counts = pages.join(worst, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    counts = counts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    counts = Scratch(pages.sparkSession).keep(counts)  # the levels below all start from it; pages are read once
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m0"))

    mean = (F.col("k") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s"))
    level1 = _shrunk(suffixes.crossJoin(F.broadcast(whole)), ["suffix"], F.col("m0"), rho_min, rho_max)
    level1 = level1.select("suffix", mean.alias("m1"))
    level2 = _shrunk(domains.join(level1, "suffix"), ["domain"], F.col("m1"), rho_min, rho_max).select("domain", mean.alias("m2"))
    level3 = _shrunk(counts.join(level2, "domain"), ["host"], F.col("m2"), rho_min, rho_max)
    alpha = F.col("k") + F.col("s") * F.col("m")
    beta = F.col("n") - F.col("k") + F.col("s") * (1 - F.col("m"))
    return level3.select("host", "n", "k", alpha.alias("alpha"), beta.alias("beta"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], max_bad: float = 0.25, z: float = 1.0, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, bad_rate, bad_low (posterior mean and lower bound).

    Null or malformed urls have empty host and path and share one reputation.
    A host is what the contract's rule yields, so a port or user name is part of
    it; hosts that are addresses have their last numbers for a domain.
    Other columns of the inputs are not read.
    """
    host, path = split_url(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    a, b = F.col("alpha"), F.col("beta")
    total = a + b
    rate = a / total
    low = rate - z * F.sqrt(a * b / (total * total * (total + 1)))
    standing = host_reputation(base, outcomes).select("host", rate.alias("bad_rate"), low.alias("bad_low"))
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("bad_low") > max_bad, "block").otherwise("allow"))
    out = base.join(standing, "host")
    return out.select(F.col("page_id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_rate", "bad_low")


def oracle(rules: Sequence[tuple[str, str]], max_bad: float, z: float) -> str:
    """DuckDB twin over ``pages`` and ``labels`` (rates rounded by the query)."""
    cases = {"rule": "", "said": ""}
    for text, says in sorted(set(rules), key=lambda r: (-len(r[0]), r[1] != "block", r[0])):
        name, _, tail = text.partition("/")
        fits = f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{tail}')"
        cases["rule"] += f"{fits} then '{text}' "
        cases["said"] += f"{fits} then '{says}' "

    def shrink(src: str) -> str:
        return f"""(select greatest(0.001, least(0.9, coalesce(sum((k - n * m) ** 2 / n - m * (1 - m)) filter (n > 0)
            / nullif(sum((n - 1) * m * (1 - m)) filter (n > 0), 0), 0.9))) rho from {src})"""

    return f"""
with r as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) path from r),
w as (select doc_id page_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) bad from labels where doc_id is not null group by 1),
c0 as (select host, count(bad) n, coalesce(sum(bad), 0) k from h left join w using (page_id) group by 1),
c1 as (select *, case when regexp_extract(host, '{DOMAIN}', 0) = '' then host else regexp_extract(host, '{DOMAIN}', 0) end as dom from c0),
c as (select *, case when strpos(dom, '.') > 0 then substr(dom, strpos(dom, '.') + 1) else dom end suf from c1),
d as (select dom, suf, sum(n) n, sum(k) k from c group by all),
s as (select suf, sum(n) n, sum(k) k from d group by all),
s0 as (select *, (select (coalesce(sum(k), 0) + 1)::double / (coalesce(sum(n), 0) + 2) from s) m from s),
s1 as (select suf, (k + (1 / rho - 1) * m) / (n + (1 / rho - 1)) mean from s0, {shrink('s0')}),
d0 as (select d.*, mean m from d join s1 using (suf)),
d1 as (select dom, (k + (1 / rho - 1) * m) / (n + (1 / rho - 1)) mean from d0, {shrink('d0')}),
g0 as (select c.*, mean m from c join d1 using (dom)),
g1 as (select host, k + (1 / rho - 1) * m a, n - k + (1 / rho - 1) * (1 - m) b from g0, {shrink('g0')}),
g as (select host, a / (a + b) bad_rate, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) bad_low from g1),
o as (select page_id, host, path, case {cases['rule']} end as rule, case {cases['said']} end as said, bad_rate, bad_low from h join g using (host))
select page_id, host, path, rule, coalesce(said, case when bad_low > {max_bad} then 'block' else 'allow' end) verdict,
  round(bad_rate, 6) bad_rate, round(bad_low, 6) bad_low from o"""
