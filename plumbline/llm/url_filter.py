"""URL filter: host rules, else an empirical-Bayes reputation of the host, all in built-in expressions.

Each page has an outcome, good or bad, judged from its own content. Outcomes are counted by host;
hosts add up to registered domains, domains to public suffixes, suffixes to all. Going down again,
each level's rate is shrunk towards its parent's with the strength that the spread between the
parent's children supports (a beta-binomial fitted by moments). A host's posterior is then a beta
distribution; the method allows its pages when its rate is at least ``least`` with a probability of
``sure`` or more, that is, when the posterior's quantile at 1 - ``sure`` reaches ``least``.

The given tables label no pages, so an outcome is read off the page itself; there hosts differ by no
more than chance (README), and no host is blocked for its reputation.

A hot host is pre-aggregated before the shuffle and joined back by adaptive skew handling; the
driver receives one row of totals. Null urls and urls without ``://`` have empty host and path and
share one reputation. Null html is a bad outcome. Empty tables give empty results; repeated rows
count twice; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.exprs import let
from plumbline.session import checkpointed

#: Rule (host and path) and verdict.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)

#: Public suffixes of two labels that registries sell names under; all others end at the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "ne.jp", "co.nz", "com.br", "co.za", "co.in", "com.cn", "com.mx")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIDDEN = r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&[a-z]+;"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    three = F.substring_index(host, ".", -3)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as written; null where none does."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, _, rest = rule.partition("/")
        fits.append(F.when(((host == own) | host.endswith("." + own)) & path.startswith("/" + rest), rule))
    return F.coalesce(*fits)


def good_page(html: Column, most_symbols: float = 0.1, least_chars: int = 100) -> Column:
    """A page's outcome: 1 where its visible text is long enough and not littered with symbols."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    symbols = F.length(seen) - F.length(F.regexp_replace(seen, r"[#*$%|~^=_]", ""))
    return ((F.length(F.trim(seen)) >= least_chars) & (symbols <= most_symbols * F.length(seen))).cast("int")


def _spread(level: str, parent: str):
    """Sums from which a level's strength is fitted: observed spread, sampling spread, weight."""
    p, m, n = F.col(f"{level}_k") / F.col(f"{level}_n"), F.col(f"{parent}_k") / F.col(f"{parent}_n"), F.col(f"{level}_n")
    return [F.sum(n * (p - m) * (p - m)), F.sum(m * (1 - m)), F.sum(m * (1 - m) * (n - 1))]


def _strength(observed, sampling, weight) -> float:
    share = 0.5 if not weight else min(0.99, max(0.001, (observed - sampling) / weight))
    return (1 - share) / share


#: Points at which a posterior is summed up, within so many deviations of its mean.
POINTS, REACH = 512, 8.0


def beta_above(a: Column, b: Column, least: float) -> Column:
    """The share of a beta(a, b) distribution at or above ``least``, by the midpoint rule around its mean."""
    mean = a / (a + b)
    reach = REACH * F.sqrt(mean * (1 - mean) / (a + b + 1))
    low, high = F.greatest(mean - reach, F.lit(0.0)), F.least(mean + reach, F.lit(1.0))
    points = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: low + (high - low) * (i + 0.5) / POINTS)
    log = lambda p: (a - 1) * F.ln(p) + (b - 1) * F.ln(1 - p)

    def share(found: Column) -> Column:
        def of(top: Column) -> Column:
            add = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + F.exp(x["l"] - top))
            return add(F.filter(found, lambda x: x["p"] >= least)) / add(found)

        return let(F.array_max(F.transform(found, lambda x: x["l"])), of)

    # each point's logarithms are taken once, and so is their maximum
    return let(F.transform(points, lambda p: F.struct(p.alias("p"), log(p).alias("l"))), share)


def host_reputation(outcomes: DataFrame, least: float = 0.5) -> DataFrame:
    """(host, n_pages, n_good, mean, above) of (host, good) rows, shrunk host to domain to suffix to all; ``above`` is the probability of a rate of ``least`` or more."""
    hosts = checkpointed(outcomes.groupBy("host").agg(F.count("*").alias("host_n"), F.sum("good").alias("host_k")))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("host_n").alias("domain_n"), F.sum("host_k").alias("domain_k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("domain_n").alias("suffix_n"), F.sum("domain_k").alias("suffix_k"))
    total = suffixes.agg(F.sum("suffix_n"), F.sum("suffix_k")).first()
    n, k = int(total[0] or 0), int(total[1] or 0)
    suffixes = suffixes.withColumn("all_n", F.lit(max(n, 1))).withColumn("all_k", F.lit(k))
    domains = domains.join(suffixes, "suffix")
    strengths = [
        _strength(*table.agg(*_spread(level, parent)).first())
        for table, level, parent in ((suffixes, "suffix", "all"), (domains, "domain", "suffix"), (hosts.drop("suffix").join(domains, "domain"), "host", "domain"))
    ]
    mean = F.lit(k / n if n else 0.5)
    levels = {}
    for level, s in zip(("suffix", "domain"), strengths, strict=False):
        mean = (F.col(f"{level}_k") + s * mean) / (F.col(f"{level}_n") + s)
        levels[level] = mean
    s = strengths[2]
    a, b = F.col("host_k") + s * levels["domain"], F.col("host_n") - F.col("host_k") + s * (1 - levels["domain"])
    joined = hosts.drop("suffix").join(domains, "domain").withColumn("a", a).withColumn("b", b)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    return joined.select("host", F.col("host_n").alias("n_pages"), F.col("host_k").alias("n_good"), mean.alias("mean"), beta_above(F.col("a"), F.col("b"), least).alias("above"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, least: float = 0.5, sure: float = 0.9, outcomes: DataFrame | None = None) -> DataFrame:
    """Every page with host, path, rule, verdict, its host's shrunken rate and the probability that this is ``least`` or more.

    ``outcomes`` (host, good) may be given; else each page's content is its outcome.
    """
    host = host_of(F.col(url_col))
    outcomes = pages.select(host.alias("host"), good_page(F.col(html_col)).alias("good")) if outcomes is None else outcomes
    reputation = host_reputation(outcomes, least)
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = judged.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)).join(reputation.select("host", "mean", "above"), "host", "left")
    own = reduce(lambda w, r: w.when(F.col("rule") == r[0], r[1]), rules, F.when(F.lit(False), ""))
    method = F.when(F.coalesce("above", F.lit(1.0)) >= sure, "allow").otherwise("block")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(own, method).alias("verdict"), F.round("mean", 6).alias("rate"), F.round("above", 6).alias("above"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every page's verdict."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_FITS = ", ".join(
    f"CASE WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}' END"
    for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
)
_RHO = "CASE WHEN coalesce({w}, 0) = 0 THEN 0.5 ELSE least(0.99, greatest(0.001, ({q} - {v}) / {w})) END"


def _sums(level: str, parent: str) -> str:
    p, m = f"({level}_k::DOUBLE / {level}_n)", f"({parent}_k::DOUBLE / {parent}_n)"
    rho = _RHO.format(q=f"sum({level}_n * ({p} - {m}) * ({p} - {m}))", v=f"sum({m} * (1 - {m}))", w=f"sum({m} * (1 - {m}) * ({level}_n - 1))")
    return f"SELECT (1 - ({rho})) / ({rho}) AS s"


ORACLE = rf"""
WITH urls AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_replace(coalesce(html, ''), '{_HIDDEN}', ' ', 'g') AS seen
  FROM pages),
good AS (
  SELECT host, CASE WHEN length(trim(seen, ' ')) >= 100 AND length(seen) - length(regexp_replace(seen, '[#*$%|~^=_]', '', 'g')) <= 0.1::DOUBLE * length(seen) THEN 1 ELSE 0 END AS good FROM urls),
hosts AS (
  SELECT host, count(*) AS host_n, sum(good) AS host_k,
         array_to_string(list_slice(string_split(host, '.'), CASE WHEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN ({_TWO}) THEN -3 ELSE -2 END, -1), '.') AS domain,
         array_to_string(list_slice(string_split(host, '.'), CASE WHEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN ({_TWO}) THEN -2 ELSE -1 END, -1), '.') AS suffix
  FROM good GROUP BY host),
domains AS (SELECT domain, min(suffix) AS suffix, sum(host_n) AS domain_n, sum(host_k) AS domain_k FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, sum(domain_n) AS suffix_n, sum(domain_k) AS suffix_k FROM domains GROUP BY suffix),
whole AS (SELECT sum(suffix_n) AS all_n, sum(suffix_k) AS all_k FROM suffixes),
t AS (SELECT h.*, d.domain_n, d.domain_k, s.suffix_n, s.suffix_k, w.all_n, w.all_k FROM hosts h JOIN domains d USING (domain) JOIN suffixes s ON s.suffix = d.suffix, whole w),
s0 AS ({_sums("suffix", "all")} FROM suffixes, whole),
s1 AS ({_sums("domain", "suffix")} FROM domains JOIN suffixes USING (suffix)),
s2 AS ({_sums("host", "domain")} FROM hosts JOIN domains USING (domain)),
means AS (
  SELECT host, host_n, host_k, s2.s AS s, (domain_k + s1.s * ((suffix_k + s0.s * (all_k::DOUBLE / all_n)) / (suffix_n + s0.s))) / (domain_n + s1.s) AS m FROM t, s0, s1, s2),
beta AS (SELECT host, host_k + s * m AS a, host_n - host_k + s * (1 - m) AS b FROM means),
spans AS (SELECT host, a, b, a / (a + b) AS mean, {REACH} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS reach FROM beta),
points AS (
  SELECT host, mean, a, b, greatest(mean - reach, 0) + (least(mean + reach, 1) - greatest(mean - reach, 0)) * (i + 0.5::DOUBLE) / {POINTS} AS p
  FROM spans, range({POINTS}) AS r(i)),
logs AS (SELECT host, mean, p, (a - 1) * ln(p) + (b - 1) * ln(1 - p) AS l FROM points),
bounds AS (
  SELECT host, mean, sum(exp(l - top)) FILTER (p >= 0.5) / sum(exp(l - top)) AS above
  FROM (SELECT *, max(l) OVER (PARTITION BY host) AS top FROM logs) GROUP BY host, mean),
fits AS (SELECT page_id, host, path, coalesce({_FITS}) AS rule FROM urls)
SELECT page_id, f.host, path, rule,
       CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)} WHEN coalesce(above, 1) >= 0.9 THEN 'allow' ELSE 'block' END AS verdict,
       round(mean, 6) AS rate, round(above, 6) AS above
FROM fits f LEFT JOIN bounds b ON f.host = b.host
"""
