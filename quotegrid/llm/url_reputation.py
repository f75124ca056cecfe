"""URL filter: list rules first, else the host's reputation by empirical Bayes, with DataFrame functions only.

Labelled page outcomes (bad or not) are counted per host. Means are shrunk from the whole table to suffix, to
registered domain, to host: at each level a beta-binomial prior is centred on the parent's shrunk mean and its
strength is fitted by moments over all children of the level. A page is blocked when the lower posterior bound of its
host's bad rate lies above ``max_bad``; hosts without labels inherit their domain's, suffix's or the overall prior.

Only counts per host are ever grouped (partial sums first), the tables of hosts, domains and suffixes are joined by
key, and pages meet their host's judgement in one join whose hot hosts AQE can split.

Defined cases: a null url or one without ``://`` has empty host and path and is judged like any host named ``''``; a
page with a null id or without a label has no outcome; labels that repeat an id count as bad if one of them is;
a label with nulls only is none; repeated pages count and are judged each; without any label all means are 0.5 and
nothing is blocked; an empty table gives an empty result; only the id and url columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Second-level names under country domains that are suffixes themselves (fixed values, a parameter of the regular
# expression below).
SECOND_LEVEL = "ac|co|com|edu|gov|net|org"
SUFFIX = rf"(?:^|\.)((?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]*)\z"
DOMAIN = rf"(?:^|\.)([^.]+\.(?:(?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]*))\z"
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
Rule = tuple[str, str, str]  # verdict, host, path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix; an address of digits is its own domain and has an empty suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*\z", "")
    digits = name.rlike(r"^[0-9.]+\z")
    found = F.regexp_extract(name, DOMAIN, 1)
    domain = F.when(digits | (found == ""), name).otherwise(found)
    suffix = F.when(digits, F.lit("")).otherwise(F.regexp_extract(name, SUFFIX, 1))
    return domain, suffix


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones a blocking one."""
    out: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(children: DataFrame) -> DataFrame:
    """One row: the prior's strength, fitted by moments over rows (n, k, parent mean m).

    Terms are summed as decimals, so the order of partial sums does not matter.
    """
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    spread = n * (k / n - m) * (k / n - m)
    even = m * (1 - m)
    exact = lambda c: F.sum(c.cast("decimal(30,12)")).cast("double")
    sums = children.where("n > 0").agg(
        exact(spread).alias("s"), exact(even).alias("e"), exact((n - 1) * even).alias("d")
    )
    rho = F.when(F.col("d") > 0, (F.col("s") - F.col("e")) / F.col("d"))
    return sums.select(
        F.when(rho.isNull() | (rho <= 1 / (1 + MAX_STRENGTH)), F.lit(MAX_STRENGTH))
        .when(rho >= 1 / (1 + MIN_STRENGTH), F.lit(MIN_STRENGTH))
        .otherwise(1 / rho - 1)
        .alias("strength")
    )


def _shrunk(children: DataFrame) -> DataFrame:
    """Adds strength and the shrunk mean; ``_strength`` is one row."""
    return children.crossJoin(F.broadcast(_strength(children))).withColumn(
        "mean", (F.col("k") + F.col("strength") * F.col("m")) / (F.col("n") + F.col("strength"))
    )


def reputations(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, domain, suffix, n, k, bad_mean, bad_bound) of every host in ``pages`` (page_id, host).

    ``outcomes`` has (page_id, bad: 0 or 1), one row per page.
    """
    domain, suffix = levels(F.col("host"))
    hosts = stage(
        pages.join(outcomes, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("k"))
        .withColumn("domain", domain)
        .withColumn("suffix", suffix),
        "hosts",
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))
    suffixes = stage(_shrunk(suffixes.crossJoin(F.broadcast(overall))), "suffixes")
    domains = stage(
        _shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix")), "domains"
    )
    shrunk = _shrunk(hosts.join(domains.select("domain", "suffix", F.col("mean").alias("m")), ["domain", "suffix"]))
    a = F.col("k") + F.col("strength") * F.col("m")
    b = F.col("n") - F.col("k") + F.col("strength") * (1 - F.col("m"))
    return shrunk.select(
        "host",
        "domain",
        "suffix",
        "n",
        "k",
        F.col("mean").alias("bad_mean"),
        (F.col("mean") - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bad_bound"),
    )


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule] = (),
    max_bad: float = 0.5,
    z: float = 1.645,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, domain, suffix, labelled, bad, bad_mean, bad_bound.

    ``labels`` has (doc_id, quality, toxic); a page is bad if its label says quality 0 or toxic 1.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0
    )
    outcomes = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    known = stage(reputations(parsed.select("page_id", "host"), outcomes, z), "reputations")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    return (
        parsed.withColumn("m", rule)
        .join(known, "host")
        .select(
            "page_id",
            "host",
            "path",
            F.col("m.rule").alias("rule"),
            F.coalesce("m.verdict", F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")).alias("verdict"),
            "domain",
            "suffix",
            F.col("n").alias("labelled"),
            F.col("k").alias("bad"),
            F.round("bad_mean", 6).alias("bad_mean"),
            F.round("bad_bound", 6).alias("bad_bound"),
        )
    )
