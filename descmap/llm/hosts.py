"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host and shrunk through beta-binomial
priors: the suffix's bad rate towards the corpus, the registered domain's towards its
suffix, the host's towards its domain. How strongly each level shrinks comes from how
much its groups differ beyond chance (method of moments). A host is blocked if its bad rate exceeds `limit` with
probability `sure` at least under its beta posterior, that is, if the posterior's lower bound at that level exceeds it; hosts
without labels have their domain's prior. Explicit rules go first: the longest that fits.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up
to `?`, `#` or the end; both empty for a null url or one without `://`. Reputations belong to the host without user and
port. Its suffix is the longest of `suffixes` (public suffixes of several labels; a parameter) that it ends with, else its last label; its registered
domain is the suffix and one label more. Addresses (IPv4, or in brackets) are their own domain and suffix.
Outcomes of unknown pages, and null ids, count nowhere; repeated rows count repeatedly. Extra columns are ignored.

Everything is counted with partial sums before a shuffle, once, and the counts by host are written. What the pages or hosts are then matched with
is broadcast up to a stated number of rows; beyond, its rows are copied for each of the parts that a host's pages are dealt to (`matched`).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.llm._util import checkpointed, column, matched, table

#: (host, path prefix, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SURE, LIMIT = 0.95, 0.5
#: Public suffixes of two labels (fixed values); others end with their last label.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: Steps of the posterior's integral to each side of the limit, and their size.
STEPS, STEP = 160, 0.05
#: Pseudo-observations of a prior: at least and at most.
STRENGTH = (1.0, 1000.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    u = column(pages, url)
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    return pages.select("*", F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER).alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def with_rule(parts: DataFrame, rules=RULES) -> DataFrame:
    """parts with the longest fitting rule and its verdict, null where none fits."""
    rule = verdict = None
    for host, path, what in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return parts.select("*", (none if rule is None else rule).alias("rule"), (none if verdict is None else verdict).alias("rule_verdict"))


def _strength(groups: DataFrame, p: float) -> float:
    """Pseudo-observations of the prior that groups (n, k) with pooled rate p suggest."""
    r = groups.where("n > 0").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2)).alias("s")).first()
    if not r.n or r.g < 2 or not 0 < p < 1:
        return STRENGTH[1]
    room = p * (1 - p) * (r.n - r.nn / r.n - (r.g - 1))
    rho = (r.s - p * (1 - p) * (r.g - 1)) / room if room > 0 else 0.0
    return min(STRENGTH[1], max(STRENGTH[0], (1 - rho) / rho)) if rho > 0 else STRENGTH[1]


def with_domain(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """hosts (column host, without user and port) with domain and suffix."""
    labels = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(n)), n), ".")
    address = F.rlike("host", F.lit(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*)$"))
    n = F.lit(1)
    for k in sorted({x.count(".") + 1 for x in suffixes}):
        n = F.when(last(k).isin([x for x in suffixes if x.count(".") + 1 == k]), F.lit(k)).otherwise(n)
    suffix = F.element_at(F.array(*[last(k) for k in range(1, 2 + max([0, *(x.count(".") for x in suffixes)]))]), n)
    whole = F.array_join(F.slice(labels, -F.least(F.size(labels), n + 1), n + 1), ".")
    return hosts.withColumns({"domain": F.when(address, F.col("host")).otherwise(whole), "suffix": F.when(address, F.col("host")).otherwise(suffix)})


def site(host):
    """A url's host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")


def below(a, b, limit: float):
    """The probability that a beta(a, b) number is at most limit.

    Both tails are summed over y = log(x / (1 - x)), in steps that grow with the distance from the limit: there the density x^a (1 - x)^b is smooth for
    all a and b. Logarithms are taken relative to the density's peak.
    """
    center, spread = F.log(a / b), F.sqrt(1 / a + 1 / b)
    log_x = lambda y: F.least(y, F.lit(0.0)) - F.log1p(F.exp(-F.abs(y)))
    log_f = lambda y: a * log_x(y) + b * log_x(-y)
    at = F.asinh((F.lit(math.log(limit / (1 - limit))) - center) / spread)
    top = log_f(center)

    def total(k: range):
        def add(sum_, i):
            s = at + (i + 0.5) * STEP
            return sum_ + F.exp(log_f(center + spread * F.sinh(s)) - top) * F.cosh(s)

        return F.aggregate(F.sequence(F.lit(k[0]), F.lit(k[-1])), F.lit(0.0), add)

    left, right = total(range(-STEPS, 0)), total(range(STEPS))
    return left / (left + right)


def reputation(parts: DataFrame, outcomes: DataFrame, page_id: str = "page_id", suffixes=SUFFIXES, limit: float = LIMIT) -> DataFrame:
    """Each host of parts (without user and port) with its labelled pages n, bad ones k, posterior a and b, and the probability bad_above that its bad rate exceeds limit.

    outcomes: columns id and bad (boolean).
    """
    own = parts.select(column(parts, page_id).alias("id"), site(F.col("host")).alias("host")).join(outcomes.where("bad is not null"), "id", "left")
    hosts = own.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0)).alias("k"))
    hosts = checkpointed(with_domain(hosts, suffixes))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes_ = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    p = ((total.k or 0.0) + 0.5) / ((total.n or 0.0) + 1.0)
    m_suffix, m_domain, m_host = (_strength(x, p) for x in (suffixes_, domains, hosts))
    s = suffixes_.select("suffix", ((F.col("k") + m_suffix * p) / (F.col("n") + m_suffix)).alias("s"))
    d = matched(domains, s, "suffix", "domain").select("domain", ((F.col("k") + m_domain * F.col("s")) / (F.col("n") + m_domain)).alias("d"))
    a, b = F.col("k") + m_host * F.col("d"), F.col("n") - F.col("k") + m_host * (1 - F.col("d"))
    found = matched(hosts.select("host", "domain", "n", "k"), d, "domain", "host").select("host", "n", "k", a.alias("a"), b.alias("b"))
    # Hosts without labels of one domain have one posterior: each is integrated once.
    kinds = found.select("a", "b").distinct().withColumn("bad_above", 1 - below(F.col("a"), F.col("b"), limit))
    return found.join(kinds, ["a", "b"]).select("host", "n", "k", "a", "b", "bad_above")


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", sure: float = SURE, limit: float = LIMIT, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    parts = with_parts(pages.select(column(pages, page_id).alias("page_id"), column(pages, url).alias("url")))
    blocked = checkpointed(reputation(parts, outcomes, "page_id", suffixes, limit).where(F.col("bad_above") >= sure).select(F.col("host").alias("site"), F.lit(True).alias("blocked")))
    found = matched(with_rule(parts, rules).withColumn("site", site(F.col("host"))), blocked, "site", "page_id")
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"))


def outcomes(labels: DataFrame) -> DataFrame:
    """A page is bad if the label of its number says toxic or of low quality."""
    return labels.select(F.col("doc_id").alias("id"), (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))


def op4_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes(table(spark, sf_dir, "labels")))


def op4_sql() -> str:
    cases = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in cases]
    rule = " ".join(f"{f} '{h}{p}'" for f, (h, p, _) in zip(fits, cases, strict=True))
    verdict = " ".join(f"{f} '{v}'" for f, (_, _, v) in zip(fits, cases, strict=True))

    def strength(groups: str) -> str:
        return f"""(SELECT CASE WHEN sn IS NULL OR sn = 0 OR g < 2 OR room <= 0 OR over <= 0 THEN {STRENGTH[1]} ELSE least({STRENGTH[1]}, greatest({STRENGTH[0]}, (1 - over / room) / (over / room))) END
          FROM (SELECT g, sn, p * (1 - p) * (sn - nn / sn - (g - 1)) AS room, s - p * (1 - p) * (g - 1) AS over
            FROM (SELECT any_value(p) AS p, count(*) AS g, sum(n) AS sn, sum(n * n) AS nn, sum(n * power(k / n - p, 2)) AS s FROM {groups}, total WHERE n > 0)))"""

    y, at = "(c + w * sinh(s))", f"asinh(({math.log(LIMIT / (1 - LIMIT))!r} - c) / w)"
    log_x = lambda v: f"(least({v}, 0) - ln(1 + exp(-abs({v}))))"
    log_f = lambda v: f"(a * {log_x(v)} + b * {log_x('-' + v)})"
    two = [x for x in SUFFIXES if x.count(".") == 1]
    address = r"regexp_matches(host, '^(\d{1,3}(\.\d{1,3}){3}|\[.*)$')"
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    sites AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\\d*$', '') AS site FROM parts),
    outcome AS (SELECT doc_id AS id, (coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS bad FROM labels),
    h0 AS (SELECT site AS host, count(bad)::DOUBLE AS n, coalesce(sum(bad::INT), 0)::DOUBLE AS k FROM sites LEFT JOIN outcome ON page_id = id GROUP BY site),
    hosts AS (SELECT host, n, k, string_split(host, '.') AS l, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({", ".join(f"'{x}'" for x in two)}) THEN 2 ELSE 1 END AS w FROM h0),
    h AS (SELECT host, n, k, CASE WHEN {address} THEN host ELSE array_to_string(l[-w:], '.') END AS suffix, CASE WHEN {address} THEN host ELSE array_to_string(l[-w - 1:], '.') END AS domain FROM hosts),
    d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
    s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
    total AS (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS p FROM s),
    m AS (SELECT {strength("s")} AS ms, {strength("d")} AS md, {strength("h")} AS mh),
    s2 AS (SELECT suffix, (k + ms * p) / (n + ms) AS s FROM s, total, m),
    d2 AS (SELECT domain, (k + md * s2.s) / (n + md) AS d FROM d JOIN s2 USING (suffix), m),
    h2 AS (SELECT host, k + mh * d2.d AS a, n - k + mh * (1 - d2.d) AS b FROM h JOIN d2 USING (domain), m),
    h3 AS (SELECT *, ln(a / b) AS c, sqrt(1 / a + 1 / b) AS w FROM h2),
    grid AS (SELECT h3.*, {at} + (i + 0.5) * {STEP} AS s, i < 0 AS low FROM h3, range(-{STEPS}, {STEPS}) t(i)),
    mass AS (SELECT host, low, exp({log_f(y)} - {log_f("c")}) * cosh(s) AS f FROM grid),
    bad AS (SELECT host FROM mass GROUP BY host HAVING 1 - sum(f) FILTER (low) / sum(f) >= {SURE})
    SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, CASE WHEN site IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
    FROM sites"""
