"""URL filters: listed rules first, then the reputation of the host.

Reputation is empirical Bayes. Labelled pages give outcomes: a label of the same id as the page is taken as its
label (an assumption about the tables), and bad if of low quality or toxic. A beta-binomial prior shrinks the
corpus rate into each public suffix, that into each registered domain, and that into each host; how strongly
each level is shrunk is fitted: of the strengths in GRID the one with the highest marginal likelihood of the
level's outcomes. A url without a rule is blocked if its host's bad rate is above BLOCK_ABOVE with a posterior
probability of SURE at least, that is, if the lower bound of its beta posterior is.

For reputation a host is taken without user and port. A public suffix is its last label, or its last two where
they are in SUFFIXES; the registered domain has one label more. An address in numbers is a domain of its own.

Defined cases: a null url or one without `://` has an empty host and path and the empty host's reputation; urls
of any length are read whole; repeated rows are judged alike; a host without labels takes its domain's
posterior, and that its suffix's; labels that disagree on one id all count; without any label nothing is blocked
but by a rule; other columns of the input pass through `judge_urls` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.llm.shared import BROADCAST_KEYS, ascii_lower, fresh, stored

#: Fixed rules: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
BLOCK_ABOVE, SURE = 0.5, 0.95
#: The normal quantile of SURE.
Z = 1.6448536269514722
#: Strengths that a level may have, in pseudo-observations; terms of the series for small posteriors; salts of a shuffled join.
GRID = [float(2**k) for k in range(11)]
TERMS, EXACT, SALTS = 400, 1000.0, 16
#: Common public suffixes of two labels.
SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk com.au net.au org.au edu.au gov.au co.nz org.nz co.jp ne.jp or.jp ac.jp go.jp com.br org.br net.br com.cn net.cn org.cn gov.cn co.in net.in org.in co.kr or.kr co.za org.za com.mx com.ar com.tr com.tw com.hk com.sg com.my co.id co.il co.th com.ua com.pl com.es com.pt com.vn com.ph"
).split()


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)


def bare_of(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def levels_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host without user and port."""
    number = host.rlike(r"^([0-9.]+|\[.*\])$")
    two = F.substring_index(host, ".", -2).isin(SUFFIXES)
    domain = F.when(number, host).when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return domain, F.when(number, "").when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up."""
    y = x + 8
    steps = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(steps)


def likelihood(k: Column, n: Column, mean: Column, s: Column) -> Column:
    """Log beta-binomial likelihood of k in n, but for the binomial factor."""
    a, b = mean * s, (1 - mean) * s
    return log_gamma(k + a) + log_gamma(n - k + b) - log_gamma(n + s) + log_gamma(s) - log_gamma(a) - log_gamma(b)


def fitted(level: DataFrame) -> float:
    """The strength in GRID that makes the outcomes k of n under the means `up` likeliest; the largest of equals."""
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    tried = level.where("n > 0").withColumn("s", F.explode(F.array(*map(F.lit, GRID))))
    sums = tried.groupBy("s").agg(F.sum(likelihood(k, n, F.col("up"), F.col("s"))).alias("l")).collect()  # a row for each strength
    return max(((round(r["l"], 6), r["s"]) for r in sums), default=(0.0, GRID[-1]))[1]


def surely_above_half(a: Column, b: Column) -> Column:
    """Whether a rate with a beta posterior (a, b) is above one half with probability SURE: by a series, or for large a + b by the normal curve."""
    # the distribution function at 1/2 is first * (1 + sum of a product of ratios); it only matters where a > b
    first = F.exp(log_gamma(a + b) - log_gamma(a + 1) - log_gamma(b) - (a + b) * math.log(2))
    step = F.aggregate(
        F.sequence(F.lit(0), F.lit(TERMS - 1)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda x, i: F.struct((x["term"] * 0.5 * (a + b + i) / (a + 1 + i)).alias("term"), (x["sum"] + x["term"] * 0.5 * (a + b + i) / (a + 1 + i)).alias("sum")),
    )
    mean = a / (a + b)
    far = mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1)) > BLOCK_ABOVE
    return (a > b) & F.when(a + b <= EXACT, first * step["sum"] <= 1 - SURE).otherwise(far)


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        out = F.when(fits(host, path, h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, rate, bad): the posterior mean bad rate of each host, and whether it is surely above BLOCK_ABOVE, as a stored table.

    A small row per host; labels are counted per host before anything else is shuffled."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcome = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"), F.sum(bad).alias("k"))
    host = bare_of(host_of(F.col("url")))
    hosts = pages.select("page_id", host.alias("host")).join(outcome, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    domain, suffix = levels_of(F.col("host"))
    hosts = stored(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"))
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    whole = ((k or 0) + 1) / ((n or 0) + 2)

    def shrunk(level: DataFrame, names: list[str]) -> tuple[DataFrame, float]:
        s = fitted(level)
        return level.select(*names, "n", "k", "up", ((F.col("k") + F.lit(s) * F.col("up")) / (F.col("n") + F.lit(s))).alias("rate")), s

    suffixes, _ = shrunk(stored(suffixes.withColumn("up", F.lit(whole))), ["suffix"])
    domains, _ = shrunk(stored(domains.join(suffixes.select("suffix", F.col("rate").alias("up")), "suffix")), ["domain", "suffix"])
    hosts, s = shrunk(stored(hosts.join(domains.select("domain", "suffix", F.col("rate").alias("up")), ["domain", "suffix"])), ["host"])
    a, b = F.col("k") + F.lit(s) * F.col("up"), F.col("n") - F.col("k") + F.lit(s) * (1 - F.col("up"))
    return stored(hosts.select("host", "rate", surely_above_half(a, b).alias("bad")))


def judge_urls(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """pages and one struct more, whose name is returned too: host, path, rule, verdict.

    Only bad hosts are looked up: broadcast if they are few, else in a join salted against hosts of very many pages."""
    bad = stored(reputations(pages, labels).where("bad").select(F.col("host").alias("__hs_bad")))
    into = fresh("__hs_url", [*pages.columns, "__hs_bad", "__hs_salt"])
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule = rule_of(host, path)
    d = pages.withColumn(into, F.struct(host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), rule["verdict"].alias("verdict")))
    here = F.col(f"`{into}`")
    looked_up = F.when(here["verdict"].isNull(), bare_of(here["host"]))
    if bad.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        d = d.join(F.broadcast(bad), looked_up == bad["__hs_bad"], "left")
    else:
        many = bad.withColumn("__hs_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = d.join(many, (looked_up == many["__hs_bad"]) & (F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)) == many["__hs_salt"]), "left")
    verdict = F.coalesce(here["verdict"], F.when(F.col("__hs_bad").isNotNull(), "block").otherwise("allow"))
    return d.withColumn(into, here.withField("verdict", verdict)).select(*[F.col(f"`{c}`") for c in pages.columns], into), into


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the contract for op3."""
    d, into = judge_urls(pages.select("page_id", "url"), labels)
    return d.select("page_id", *[F.col(f"{into}.{c}").alias(c) for c in ("host", "path", "rule", "verdict")])
