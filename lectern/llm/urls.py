"""URL filters with Empirical-Bayes host reputation (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, let, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict and rule (host, then path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Second-level labels that belong to the suffix below a country's domain, by country.
SECOND_LEVEL = {
    "ar": "com edu gob net org", "at": "ac co gv or", "au": "asn com edu gov id net org", "br": "com edu gov net org", "cn": "ac com edu gov net org",
    "hk": "com edu gov net org", "id": "ac co go or web", "il": "ac co gov net org", "in": "ac co edu firm gen gov ind net nic org res",
    "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "mx": "com edu gob net org", "my": "com edu gov net org",
    "nz": "ac co geek gen govt iwi kiwi maori net org school", "pl": "com edu gov info net org", "sg": "com edu gov net org",
    "th": "ac co go in net or", "tr": "av bel com edu gen gov net org", "tw": "club com edu gov idv net org", "ua": "com edu gov in net org",
    "uk": "ac co gov ltd me net nhs org plc police sch", "za": "ac co edu gov law net org school web",
}
#: A host is blocked if the quantile 1 - LEVEL of the posterior of its rate of bad pages is above LIFT times the rate of all labelled pages.
LIFT, LEVEL = 1.0, 0.9
#: Rate of bad pages where nothing is labelled, counting as one page; the most pages that a prior counts as.
PRIOR, MOST_PRIOR = 0.1, 10
#: Points of the grid on which quantiles are found, and its half width in standard deviations.
GRID, WIDE = 512, 16


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def bare_host(host: Column) -> Column:
    """A host without a user before `@` and a port after `:`."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def registered_domain(host: Column) -> Column:
    """Last two labels of a bare host, three below a second-level suffix such as co.uk; an IPv4 address whole."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    top, second = F.get(parts, n - 1), F.get(parts, n - 2)
    suffixes = [f"{s}.{c}" for c, labels in SECOND_LEVEL.items() for s in labels.split()]
    keep = F.when((n > 2) & F.concat_ws(".", second, top).isin(suffixes), 3).otherwise(2)
    return F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(F.array_join(F.slice(parts, F.greatest(n - keep + 1, F.lit(1)), keep), "."))


def suffix_of(domain: Column) -> Column:
    """A registered domain without its first label; itself where it has one label."""
    return F.when(F.contains(domain, F.lit(".")), F.substr(domain, F.instr(domain, ".") + 1)).otherwise(domain)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, the first of equals; null if none fits."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        of, _, start = rule.partition("/")
        fits.append(
            F.when(
                ((host == of) | host.endswith("." + of)) & path.startswith("/" + start),
                F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")),
            )
        )
    return F.coalesce(*fits)


def _strength(children: DataFrame) -> float:
    """Prior sample size of a level by the method of moments, at most MOST_PRIOR.

    children: n, k and the parent's mean `mu`.  One row comes to the driver.
    """
    v = F.col("mu") * (1 - F.col("mu"))
    over = F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("mu"), 2) - v
    got = children.where("n > 0").agg(F.sum(over).alias("over"), F.sum(v * (F.col("n") - 1)).alias("room")).first()
    rho = got["over"] / got["room"] if got["room"] else 0.0
    rho = min(max(rho, 1 / (MOST_PRIOR + 1)), 0.5)
    return round(1 / rho - 1, 6)


def beta_quantile(a: Column, b: Column, p: float) -> Column:
    """Quantile p of Beta(a, b), to about a thousandth of its standard deviation.

    On log-odds t the density is exp(a t - (a + b) log(1 + exp(t))), smooth
    with one mode, so sums over an even grid about the mode give its integral;
    the quantile is interpolated within the cell that passes p.
    """
    spread = F.sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b))
    shape = F.struct(a.alias("a"), b.alias("b"), F.log(a / b).alias("mode"), (spread * (2.0 * WIDE / GRID)).alias("step"))
    at = lambda q, i: q["mode"] + (i - GRID // 2) * q["step"]
    log_density = lambda q, t: q["a"] * t - (q["a"] + q["b"]) * (F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t))))
    weights = lambda q: F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda i: F.exp(log_density(q, at(q, i)) - log_density(q, q["mode"])))
    goal = lambda ws: F.aggregate(ws, F.lit(0.0), lambda s, w: s + w) * p

    def pass_by(acc: Column, w: Column, goal: Column) -> Column:
        cum = acc["cum"] + w
        here = (acc["cum"] < goal) & (cum >= goal)
        cell = F.when(here, acc["k"] + 0.5 - (cum - goal) / w).otherwise(acc["cell"])
        return F.struct(cum.alias("cum"), (acc["k"] + 1).alias("k"), cell.alias("cell"))

    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("k"), F.lit(0.0).alias("cell"))
    cell = lambda ws, g: F.aggregate(ws, start, lambda acc, w: pass_by(acc, w, g), lambda acc: acc["cell"])
    return let(shape, lambda q: 1 / (1 + F.exp(-at(q, let(weights(q), lambda ws: let(goal(ws), lambda g: cell(ws, g)))))))


def host_reputation(outcomes: DataFrame) -> tuple[DataFrame, float]:
    """Posterior of the rate of bad pages for every host (host, n, k, mean, bound) and the rate of all labelled pages.

    outcomes: host and bad (0, 1 or null for a page without a label).  A
    beta-binomial prior passes from all pages to suffixes, from suffixes to
    registered domains and from those to hosts; each level's strength comes
    from its own spread.  `bound` is the quantile 1 - LEVEL of the host's Beta
    posterior.
    """
    hosts = materialize(
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
        .withColumn("domain", registered_domain(bare_host(F.col("host"))))
        .withColumn("suffix", suffix_of(F.col("domain"))),
        "hosts",
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = ((total["k"] or 0) + PRIOR) / ((total["n"] or 0) + 1)
    post = lambda m: (F.col("k") + m * F.col("mu")) / (F.col("n") + m)

    suffixes = suffixes.withColumn("mu", F.lit(mean))
    suffixes = materialize(suffixes.select("suffix", post(_strength(suffixes)).alias("mu")), "suffixes").withColumnRenamed("suffix", "s_")
    domains = join_small(domains, suffixes, F.col("suffix") == F.col("s_"), "inner")
    domains = materialize(domains.select("domain", post(_strength(domains)).alias("mu")), "domains").withColumnRenamed("domain", "d_")
    hosts = join_small(hosts, domains, F.col("domain") == F.col("d_"), "inner")
    m = _strength(hosts)
    a, b = F.col("k") + m * F.col("mu"), F.col("n") - F.col("k") + m * (1 - F.col("mu"))
    return hosts.select("host", "n", "k", post(m).alias("mean"), beta_quantile(a, b, 1 - LEVEL).alias("bound")), mean


def url_filter(
    pages: DataFrame,
    labels: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    lift: float = LIFT,
) -> DataFrame:
    """Verdict for every row of pages: page_id, host, path, rule, verdict, and the host's n_labelled, mean and bound.

    labels: page_id and bad (0 or 1) of some pages; a page labelled several
    times is bad if any label says so, one with a null label has none.  The
    longest rule decides, else the host's reputation: block if its posterior
    bound is above `lift` times the rate of all labelled pages.  Null and empty
    addresses and those without `://` share the empty host; an address of any
    length is read whole.  Rows that repeat are answered one by one, and of
    equally long rules the first decides.  Without pages the result is empty,
    without labels nothing is blocked but by rules.  Further columns of either
    table are not read.  A host with a third of all pages is pre-aggregated
    before its counts shuffle, and its pages are split again by adaptive
    execution where they meet its reputation.
    """
    labels = labels.where("bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"))
    rows = rows.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rows = materialize(rows.join(labels, "page_id", "left"), "pages")
    known, rate = host_reputation(rows)
    known = known.select(F.col("host").alias("h_"), F.col("n").alias("n_labelled"), F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"))
    judged = join_small(rows, materialize(known, "reputation"), F.col("host") == F.col("h_"), "left").withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    return judged.select(
        "page_id", "host", "path", F.col("_r")["rule"].alias("rule"),
        F.coalesce(F.col("_r")["verdict"], F.when(F.col("bound") > lift * rate, "block").otherwise("allow")).alias("verdict"),
        "n_labelled", "mean", "bound",
    )
