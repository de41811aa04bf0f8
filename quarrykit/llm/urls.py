"""URL filters (4): rules for hosts and paths, and empirical-Bayes host reputation where no rule fits.

Labelled page outcomes are counted per host. Good rates shrink through beta-binomial priors: the suffix towards all
pages, the registered domain towards its suffix, the host towards its domain. How strongly is estimated at every level by
moments of the groups' rates. A host is blocked when the upper bound of its posterior good rate (a beta quantile) is
under the limit, which the data set: the good rate of all labelled pages less `margin`. So a host goes when it is worse
than pages in general beyond doubt, whether labels are mostly good or mostly bad.

All DataFrame operations. Hosts and rules meet through the host's own suffixes, once per distinct host; pages meet the
host table in one join, whose hot hosts the engine may split.

Defined cases: null urls and urls without `://` have empty host and path, fit no rule and have no reputation of their
own (they count as a host named ''); labels of unknown pages are ignored, several labels of a document count once with the
least; repeated rows are judged alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
MARGIN, Z = 0.0, 1.645  # Z: 95 % of the posterior lies under the upper bound
LEAST, MOST = 2.0, 1000.0  # range of a prior's strength in pages


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and all its parents: a.b.c, b.c, c."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def registered_domain(host: Column, double_suffixes: list[str] | None = None) -> tuple[Column, Column]:
    """(domain, suffix): the public suffix is the last label, or one of `double_suffixes`; the domain has one label more."""
    n = F.lit(2) if not double_suffixes else F.when(F.substring_index(host, ".", -2).isin(double_suffixes), 3).otherwise(2)
    part = lambda k: F.array_join(F.slice(F.split(host, "\\."), -F.least(k, F.size(F.split(host, "\\."))), F.least(k, F.size(F.split(host, "\\.")))), ".")
    return part(n), part(n - 1)


def _strength(groups: DataFrame, by: list[str]) -> DataFrame:
    """Strength of the prior for groups (n, good, prior): how little their rates vary beyond chance, per parent `by`."""
    n, spread = F.col("n"), F.col("prior") * (1 - F.col("prior"))
    excess = F.sum(n * F.pow(F.col("good") / n - F.col("prior"), 2) - spread) / F.sum(n)
    return groups.groupBy(*by).agg(excess.alias("v"), F.avg(spread).alias("s")).select(*by, F.when(F.col("v") > 0, F.least(F.greatest(F.col("s") / F.col("v") - 1, F.lit(LEAST)), F.lit(MOST))).otherwise(F.lit(MOST)).alias("k"))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, double_suffixes: list[str] | None = None) -> DataFrame:
    """Posterior good rate of all `hosts` (host) and of `outcomes` (host, good: 0 or 1): mean, a and b of the beta
    distribution, and `whole`, the good rate of all outcomes."""
    domain, suffix = registered_domain(F.col("host"), double_suffixes)
    counted = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.sum("good").alias("good"))
    every = hosts.select("host").union(counted.select("host")).distinct()
    h = every.join(counted, "host", "left").fillna(0, ["n", "good"]).withColumns({"domain": domain, "suffix": suffix})
    h = materialize(h, "hosts")  # every level of the shrinkage reads it
    d = h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    s = d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = s.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("prior"))

    def shrunk(level: DataFrame, parents: DataFrame, on: list[str], name: str) -> DataFrame:
        with_prior = level.join(parents, on) if on else level.join(F.broadcast(parents))
        k = _strength(with_prior.where("n > 0"), [])
        rated = with_prior.join(F.broadcast(k)).withColumn("k", F.coalesce("k", F.lit(MOST)))
        return rated.withColumn(name, (F.col("good") + F.col("k") * F.col("prior")) / (F.col("n") + F.col("k")))

    s_rate = shrunk(s, whole, [], "rate").select("suffix", F.col("rate").alias("prior"))
    d_rate = shrunk(d, s_rate, ["suffix"], "rate").select("suffix", "domain", F.col("rate").alias("prior"))
    h_rate = shrunk(h, d_rate, ["suffix", "domain"], "mean")
    a, b = F.col("mean") * (F.col("n") + F.col("k")), (1 - F.col("mean")) * (F.col("n") + F.col("k"))
    rated = h_rate.select("host", "domain", "suffix", "n", "good", "mean", a.alias("a"), b.alias("b"))
    return rated.join(F.broadcast(whole.select(F.col("prior").alias("whole"))))  # one row


def beta_bound(a: Column, b: Column, z: float) -> Column:
    """Quantile of a beta distribution: its log-odds have mean psi(a) - psi(b) and variance psi'(a) + psi'(b), and are nearly
    normal. Both functions come from their series at x + 6, stepped back six times."""

    def digamma(x: Column) -> Column:
        y = x + 6
        return F.log(y) - 0.5 / y - 1 / (12 * y**2) + 1 / (120 * y**4) - sum((1 / (x + i) for i in range(6)), F.lit(0.0))

    def trigamma(x: Column) -> Column:
        y = x + 6
        return 1 / y + 0.5 / y**2 + 1 / (6 * y**3) - 1 / (30 * y**5) + sum((1 / (x + i) ** 2 for i in range(6)), F.lit(0.0))

    return 1 / (1 + F.exp(-(digamma(a) - digamma(b) + z * F.sqrt(trigamma(a) + trigamma(b)))))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules (array of length, rule, path, action; longest first) for hosts that any rule's host covers."""
    cut = F.instr("rule", "/")
    split_rules = rules.select("action", "rule", F.expr("substring(rule, 1, instr(rule, '/') - 1)").alias("parent"), F.expr("substring(rule, instr(rule, '/'))").alias("path")).where(cut > 0)
    met = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("parent")).join(split_rules, "parent")
    return met.groupBy("host").agg(F.sort_array(F.collect_set(F.struct(F.length("rule").alias("length"), "rule", "path", "action")), asc=False).alias("rules"))


def judge_pages(pages: DataFrame, rules: DataFrame, outcomes: DataFrame, margin: float = MARGIN, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, good_rate, upper_bound for every row of `pages` (page_id, url)."""
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = parsed.select("host").distinct()
    known = host_reputation(outcomes, hosts).join(host_rules(hosts, rules), "host", "left")
    fit = F.element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), 1)
    upper = beta_bound(F.col("a"), F.col("b"), z)
    made = parsed.join(known, "host", "left").withColumn("_fit", F.when(F.exists("rules", lambda r: F.startswith(F.col("path"), r["path"])), fit))
    own = F.when(upper < F.col("whole") - margin, "block").otherwise("allow")
    return made.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.action"), own).alias("verdict"), F.col("mean").alias("good_rate"), upper.alias("upper_bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, good: the quality label of the document that a page's path ends with (`/en/853`, `/en/853.html`)."""
    host, path = split_url(F.col("url"))
    named = F.regexp_extract(path, "/([0-9]{1,18})(?:\\.[a-z]+)?/?$", 1)
    ids = pages.select(host.alias("host"), named.alias("doc"))
    ids = ids.where("doc <> ''").select("host", F.col("doc").cast("long").alias("doc_id"))
    least = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return ids.join(least, "doc_id").select("host", (F.col("quality") > 0).cast("long").alias("good"))


def op4_host_reputation(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rules = spark.createDataFrame(RULES, "action string, rule string")
    return judge_pages(pages, rules, page_outcomes(pages, labels)).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, keys: str, parent: str, on: str) -> str:
    return f"""{name}p AS (SELECT x.*, p.prior FROM {name} x JOIN {parent} p ON {on}),
{name}k AS (SELECT CASE WHEN v > 0 THEN least(greatest(s / v - 1, {LEAST}), {MOST}) ELSE {MOST} END AS k FROM (SELECT sum(n * pow(good / n - prior, 2) - prior * (1 - prior)) / sum(n) AS v, avg(prior * (1 - prior)) AS s FROM {name}p WHERE n > 0)),
{name}r AS (SELECT {keys}, n, k, (good + k * prior) / (n + k) AS prior FROM {name}p, {name}k)"""


_DIGAMMA = "ln({x} + 6) - 0.5 / ({x} + 6) - 1 / (12 * ({x} + 6) ** 2) + 1 / (120 * ({x} + 6) ** 4)" + "".join(f" - 1 / ({{x}} + {i})" for i in range(6))
_TRIGAMMA = "1 / ({x} + 6) + 0.5 / ({x} + 6) ** 2 + 1 / (6 * ({x} + 6) ** 3) - 1 / (30 * ({x} + 6) ** 5)" + "".join(f" + 1 / ({{x}} + {i}) ** 2" for i in range(6))

ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
o AS (SELECT host, CAST(quality > 0 AS BIGINT) AS good FROM (SELECT host, regexp_extract(path, '/([0-9]{{1,18}})(?:\\.[a-z]+)?/?$', 1) AS doc FROM p) JOIN l ON doc <> '' AND try_cast(doc AS BIGINT) = doc_id),
h AS (SELECT host, coalesce(n, 0) AS n, coalesce(good, 0) AS good, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM (SELECT DISTINCT host FROM p) LEFT JOIN (SELECT host, count(*) AS n, sum(good) AS good FROM o GROUP BY host) USING (host)),
d AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
w AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS prior FROM s),
{_level("s", "suffix", "w", "true")},
{_level("d", "suffix, domain", "sr", "x.suffix = p.suffix")},
{_level("h", "host", "dr", "x.suffix = p.suffix AND x.domain = p.domain")},
b AS (SELECT host, prior * (n + k) AS a, (1 - prior) * (n + k) AS b FROM hr),
v AS (SELECT host, CASE WHEN 1 / (1 + exp(-({_DIGAMMA.format(x="a")} - ({_DIGAMMA.format(x="b")}) + {Z} * sqrt({_TRIGAMMA.format(x="a")} + {_TRIGAMMA.format(x="b")})))) < prior - {MARGIN} THEN 'block' ELSE 'allow' END AS verdict FROM b, w),
rules(action, rule, rhost, rpath) AS (VALUES {", ".join(f"('{a}', '{r}', '{r.split('/')[0]}', '/{r.split('/', 1)[1]}')" for a, r in RULES)}),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, v.verdict) AS verdict FROM p LEFT JOIN m USING (page_id) JOIN v USING (host)
"""
