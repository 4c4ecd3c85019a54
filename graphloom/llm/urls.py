"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Labelled pages are counted by host, registered domain and suffix. Each level
is a beta-binomial whose prior mean is the shrunken mean of the level above
and whose strength is fitted by the method of moments over all groups of the
level. A host is blocked when the lower posterior bound of its rate of bad
pages lies above a limit. Hosts without labelled pages inherit the level above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, UPPER
from graphloom.plans.scratch import Scratch

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
#: Rules of the query: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
Z, LIMIT = 1.645, 0.3
STRENGTH = (1.0, 1000.0)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def suffix_of(host: Column, two_label=TWO_LABEL_SUFFIXES) -> Column:
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(two.isin(*two_label), two).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


def domain_of(host: Column, two_label=TWO_LABEL_SUFFIXES) -> Column:
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    three = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    return F.when(two.isin(*two_label) & (three != ""), three).when(two != "", two).otherwise(host)


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none. Rules are a literal list of the caller."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, being longer, win
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> tuple[float, float]:
    """(overall rate, prior strength) of a level by the method of moments; one row reaches the driver."""
    g = groups.filter("n > 0")
    n, k, groups_n, n2, kk = g.agg(
        F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0)), F.count("*"),
        F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)), F.coalesce(F.sum(F.col("k") * F.col("k") / F.col("n")), F.lit(0.0)),
    ).first()
    if not n:
        return 0.5, STRENGTH[1]
    p = k / n
    spread, free = p * (1 - p), groups_n - 1
    scale = n - n2 / n
    if spread <= 0 or free <= 0 or scale <= free:
        return p, STRENGTH[1]
    rho = ((kk - n * p * p) / spread - free) / (scale - free)
    if rho <= 0:
        return p, STRENGTH[1]
    return p, min(STRENGTH[1], max(STRENGTH[0], (1 - rho) / rho))


def reputations(outcomes: DataFrame, scratch: Scratch, z: float = Z, two_label=TWO_LABEL_SUFFIXES) -> DataFrame:
    """Rows (host, lower) for every host of outcomes(host, bad); bad is null, 0.0 or 1.0.

    two_label lists the suffixes of two labels; a caller with a public suffix list passes its own.

    Counts are summed before they are shuffled, so a hot host costs one row a task.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("k"))
    hosts = scratch.save(hosts.select("host", domain_of(F.col("host"), two_label).alias("domain"), suffix_of(F.col("host"), two_label).alias("suffix"), "n", "k"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    (p, s_suffix), (_, s_domain), (_, s_host) = map(_strength, (suffixes, domains, hosts))
    suffixes = suffixes.select("suffix", ((F.lit(s_suffix * p) + F.col("k")) / (F.lit(s_suffix) + F.col("n"))).alias("m2"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((F.lit(s_domain) * F.col("m2") + F.col("k")) / (F.lit(s_domain) + F.col("n"))).alias("m1"))
    a, b = F.lit(s_host) * F.col("m1") + F.col("k"), F.lit(s_host) * (1 - F.col("m1")) + F.col("n") - F.col("k")
    mean = a / (a + b)
    return hosts.join(domains, ["domain", "suffix"]).select("host", (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", rules=RULES, limit: float = LIMIT, two_label=TWO_LABEL_SUFFIXES) -> DataFrame:
    """Rows (id, host, path, rule, verdict) for every row of pages.

    outcomes(_page, bad) labels pages by id. A url that is null or without ``://``
    has an empty host and path; an empty host is judged as any other. Of rules
    that fit and are equally long the last given wins. Rows repeat as they do in
    pages, null ids stay null; other columns of pages are ignored; an empty table
    gives none.
    """
    parts = pages.select(F.col(id_col).alias("_page"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labelled = parts.select("_page", "host").join(outcomes.select("_page", "bad"), "_page", "left")
    blocked = reputations(labelled, scratch, two_label=two_label).filter(F.col("lower") > limit).select("host", F.lit("block").alias("_rep"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    out = parts.join(blocked, "host", "left")
    return out.select(F.col("_page").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("_rep"), F.lit("allow")).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(_page, bad): a page shows the document whose number ends its path; bad if labelled of quality 0.

    Pages without a number, and documents without a label, give no row.
    A document labelled more than once counts by its mean.
    """
    doc = F.expr("try_cast(regexp_extract(url, '(?s)^.*?://[^/?#]*/(?:[^/?#]*/)*?([0-9]{1,18})(?:[.]html)?/?(?:[?#].*)?$', 1) as long)")
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.avg(1.0 - F.col("quality")).alias("bad"))
    of = pages.select(F.col("page_id").alias("_page"), doc.alias("_doc")).filter("_page is not null and _doc is not null")
    return of.join(marks, of["_doc"] == marks["doc_id"]).groupBy("_page").agg(F.avg("bad").alias("bad"))


def oracle() -> str:
    """The same judgement in DuckDB SQL over `pages` and `labels`."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{k}'" for k, h, p in ordered) + " END"
    two = "regexp_extract(host, '([^.]+[.][^.]+)$', 1)"
    listed = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    three = "regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1)"
    stats = """SELECT coalesce(sum(n), 0.0) n, coalesce(sum(k), 0.0) k, count(*) g, sum(n * n) n2, sum(k * k / n) kk FROM {0} WHERE n > 0"""
    lo, hi = STRENGTH
    rho = "((kk - n * (k / n) * (k / n)) / nullif((k / n) * (1 - k / n), 0) - (g - 1)) / nullif(n - n2 / n - (g - 1), 0)"
    s = f"SELECT CASE WHEN n = 0 THEN 0.5 ELSE k / n END p, CASE WHEN n = 0 OR g <= 1 OR n - n2 / n <= g - 1 OR coalesce({rho}, 0) <= 0 THEN {hi} ELSE least({hi}, greatest({lo}, (1 - {rho}) / {rho})) END s FROM ({stats})"
    return f"""
WITH marks AS (SELECT doc_id, avg(1.0 - quality) bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path,
  try_cast(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*/(?:[^/?#]*/)*?([0-9]{{1,18}})(?:[.]html)?/?(?:[?#].*)?$', 1), '') AS BIGINT) doc FROM pages),
out0 AS (SELECT page_id, avg(bad) bad FROM parts JOIN marks ON doc = doc_id WHERE page_id IS NOT NULL GROUP BY page_id),
hosts AS (SELECT host, CASE WHEN {two} IN ({listed}) AND {three} <> '' THEN {three} WHEN {two} <> '' THEN {two} ELSE host END domain,
  CASE WHEN {two} IN ({listed}) THEN {two} ELSE regexp_extract(host, '([^.]*)$', 1) END suffix, n, k
  FROM (SELECT host, CAST(count(bad) AS DOUBLE) n, coalesce(sum(bad), 0.0) k FROM parts LEFT JOIN out0 USING (page_id) GROUP BY host)),
domains AS (SELECT domain, suffix, sum(n) n, sum(k) k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) n, sum(k) k FROM domains GROUP BY suffix),
ss AS ({s.format("suffixes")}), sd AS ({s.format("domains")}), sh AS ({s.format("hosts")}),
m2 AS (SELECT suffix, (ss.s * ss.p + k) / (ss.s + n) m FROM suffixes, ss),
m1 AS (SELECT domain, d.suffix, (sd.s * m2.m + k) / (sd.s + n) m FROM domains d JOIN m2 ON d.suffix = m2.suffix, sd),
ab AS (SELECT host, sh.s * m1.m + k a, sh.s * (1 - m1.m) + n - k b FROM hosts h JOIN m1 ON h.domain = m1.domain AND h.suffix = m1.suffix, sh),
bad AS (SELECT host FROM ab WHERE a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > {LIMIT})
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM parts"""
