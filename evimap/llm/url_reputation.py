"""URL filter by rules, then by empirical-Bayes host reputation.

A host's labelled pages are good or bad outcomes. Its rate is shrunk to that of
its registered domain, the domain's to that of its suffix, the suffix's to that of
all pages; at each level a beta-binomial prior, fitted by moments over the children,
says how strongly. A page is blocked only if its host is credibly worse than all
pages: if the posterior's upper bound lies below their rate. A page's outcome is that
of the documents with its own text. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimap.llm.common import ascii_lower

ALL = "*"


@dataclass(frozen=True)
class Rule:
    """A host and a path's beginning; the host stands for its subdomains too."""

    host: str
    path: str
    verdict: str


#: the bounds are ``Z`` standard deviations from the posterior mean
Z = 1.645
#: the least and the most pages that a prior weighs
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty without ``://``."""
    rest = F.substring_index(F.substring_index(F.substring_index(_behind(url), "/", 1), "?", 1), "#", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    """From the host's end to the next ``?`` or ``#``; empty without ``://``."""
    behind = F.substring_index(F.substring_index(_behind(url), "?", 1), "#", 1)
    at = F.instr(behind, "/")
    return F.when(at > 0, F.substr(behind, at)).otherwise("")


def _behind(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host, ".", -1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _priors(children: DataFrame, by: str) -> DataFrame:
    """For each parent: its outcomes and, by moments over its children, the weight of its rate as a prior.

    With n_i outcomes and k_i good ones of child i, mean m and the weighted variance of
    the children's rates give the share of variance between children; the prior
    weight is (1 - share) / share, held between the least and the most.
    """
    sums = children.groupBy(by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.expr("case when n > 0 then k * k / n end")).alias("kk"),
                                    F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.expr("cast(n > 0 as int)")).alias("c"))
    # nulls where nothing is known: no division by zero, and no share
    m, n, c = F.expr("k / nullif(n, 0)"), F.expr("nullif(n, 0)"), F.col("c")
    between = F.expr("kk - k * k / nullif(n, 0)")  # sum of n_i (rate_i - m)^2
    size = (n - F.col("nn") / n) / F.expr("nullif(c - 1, 0)")
    spread = m * (1 - m)
    share = F.when((c > 1) & (spread > 0) & (size > 1), (between / F.expr("nullif(c - 1, 0)") - spread) / F.nullif((size - 1) * spread, F.lit(0.0))).otherwise(0.0)
    weight = F.when(share > 0, F.greatest(F.lit(LEAST_PRIOR), F.least(F.lit(MOST_PRIOR), (1 - share) / share))).otherwise(MOST_PRIOR)
    return sums.select(by, "n", "k", weight.alias("weight"))


def reputations(outcomes: DataFrame, host: str = "host", good: str = "good") -> DataFrame:
    """(host, n, k, mean, bound, upper, overall) of each host among ``outcomes``, whose ``good`` is 0 or 1, or null if unknown.

    Outcomes are added up for each host before anything else is shuffled, so a hot
    host is one row of each task. Hosts without outcomes rest on their domain's prior.
    ``bound`` and ``upper`` enclose the mean; ``overall`` is the rate of all pages.
    """
    hosts = outcomes.groupBy(F.col(host).alias("host")).agg(F.count(good).alias("n"), F.coalesce(F.sum(F.col(good).cast("double")), F.lit(0.0)).alias("k")) \
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host")), "root": F.lit(ALL)})
    domains = _priors(hosts, "domain").withColumns({"suffix": suffix_of(F.col("domain")), "root": F.lit(ALL)})
    suffixes = _priors(domains.select("suffix", "n", "k"), "suffix").withColumn("root", F.lit(ALL))
    root = _priors(suffixes.select("root", "n", "k"), "root").select("root", F.expr("case when n > 0 then k / n else 0.5 end").alias("up"), F.col("weight").alias("w")).withColumn("overall", F.col("up"))

    def shrunk(level: DataFrame, above: DataFrame, by: str) -> DataFrame:
        return level.join(above, by).withColumn("mean", F.expr("(k + w * up) / (n + w)"))

    suffix_rate = shrunk(suffixes, root, "root").select("suffix", F.col("mean").alias("up"), F.col("weight").alias("w"), "overall")
    domain_rate = shrunk(domains, suffix_rate, "suffix").select("domain", F.col("mean").alias("up"), F.col("weight").alias("w"), "overall")
    reach = Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("w") + 1))
    return shrunk(hosts, domain_rate, "domain").select("host", "n", "k", "mean", (F.col("mean") - reach).alias("bound"), (F.col("mean") + reach).alias("upper"), "overall")


def page_text(html: Column) -> Column:
    """Text of the first ``article`` without its ``h1``, or of the whole page if it has none: no comments, scripts, styles or tags, the five escapes of ``html.escape`` undone."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    article = r"(?is)<article\b[^>]*>(.*?)</article\s*>"
    out = F.when(F.regexp_like(bare, F.lit(article)), F.regexp_extract(bare, article, 1)).otherwise(bare)
    out = F.regexp_replace(out, r"(?is)<h1\b.*?</h1\s*>|<[^>]*>", " ")
    for escape, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(escape), F.lit(char))
    return out


def text_key(text: Column) -> Column:
    """Digest of a text's characters other than white space, null for null: markup moves white space only."""
    return F.sha2(F.regexp_replace(text, r"(?U)\s+", ""), 256)


def content_outcomes(pages: DataFrame, documents: DataFrame, labels: DataFrame, id_col: str = "page_id", html: str = "html", doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, good) of each page whose text is that of a labelled document.

    Equal documents give the mean of their labels, added up before pages meet them,
    so a text meets one row. Pages without html or without such a document have no row.
    """
    known = documents.select(F.col(doc_id).alias("__doc"), text_key(F.col(text)).alias("__key")).where("__key is not null") \
        .join(labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("__doc"), F.col(label).cast("double").alias("__label")), "__doc") \
        .groupBy("__key").agg(F.avg("__label").alias("good"))
    return pages.select(F.col(id_col), text_key(page_text(F.col(html))).alias("__key")).join(known, "__key").select(id_col, "good")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url: str = "url", good: str = "good", floor: float | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) of each page; ``outcomes`` has (id, good).

    A fitting rule decides; else the page is blocked if its host's upper bound is below
    ``floor``, by default the rate of all pages, so little evidence never blocks by itself. A null url or one without ``://`` has an empty host, which is judged
    like any other. An id with several outcomes counts once, as their mean. Null ids
    have no outcome; repeated pages each give a row; empty tables give no row.
    """
    urls = pages.select(F.col(id_col).alias("__id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = outcomes.where(F.col(good).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.avg(F.col(good).cast("double")).alias("__good"))
    hosts = reputations(urls.join(known, "__id", "left"), good="__good").select("host", "upper", "overall")
    choice = longest_rule(F.col("host"), F.col("path"), rules)
    judged = urls.withColumn("__rule", choice).join(hosts, "host", "left")
    method = F.when(F.col("upper") < (F.col("overall") if floor is None else F.lit(floor)), "block").otherwise("allow")
    return judged.select(F.col("__id").alias(id_col), "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", method).alias("verdict"))
