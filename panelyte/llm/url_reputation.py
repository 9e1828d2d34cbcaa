"""URL filtering by rules and by empirical-Bayes host reputation, in DataFrame functions only.

Pages with labels give outcomes (bad or not) to their hosts. A host's rate of bad pages is shrunk through
beta-binomial priors: the overall rate is the prior mean of a suffix, a suffix's posterior mean that of its
registered domains, a registered domain's that of its hosts. Each level's prior strength comes from the corpus: the
beta-binomial's intra-class correlation by the method of moments over that level's groups. A host is blocked when the
lower bound of its posterior lies above the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the query's contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Labels that form a public suffix with a country's label.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "or", "org"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null where none fits; of equal lengths the earlier one."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    return F.coalesce(*[F.when(fit, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))) for fit, (verdict, h, p) in zip(fits, ordered, strict=True)])


def strength(groups: DataFrame, least: float, most: float) -> DataFrame:
    """One row (mean, strength): prior weight in pages, from the spread of the groups' rates beyond binomial noise."""
    total = groups.agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"), F.count(F.lit(1)).alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("sq"))
    mean = F.coalesce(F.try_divide(F.col("bad"), F.col("n")), F.lit(0.0))
    noise = F.col("mean") * (1 - F.col("mean"))
    between = F.col("sq") - F.col("n") * F.col("mean") * F.col("mean") - (F.col("k") - 1) * noise  # beyond noise, in pages
    rho = F.try_divide(between, (F.col("n") - F.col("k")) * noise)
    weight = F.when(rho > 0, F.try_divide(1 - rho, rho))
    return total.withColumn("mean", mean).select("mean", F.least(F.greatest(F.coalesce(weight, F.lit(most)), F.lit(least)), F.lit(most)).alias("strength"))


def host_reputation(pages: DataFrame, labels: DataFrame, z: float, least: float, most: float) -> DataFrame:
    """(host, domain, suffix, n, bad, alpha, beta, bound): posterior of each host's rate of bad pages.

    pages has (id, host), labels (id, bad); hosts without labelled pages get what their domain predicts. A port does
    not count; the suffix is the last label, or the last two of three and more where they are one of SECOND_LEVEL and a
    label of two letters; the registered domain has one label more.
    """
    parts = F.split(F.regexp_replace("host", ":[0-9]*$", ""), r"\.")
    size = F.size(parts)
    double = (size > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, size - 2).isin(SECOND_LEVEL)
    labels_of = F.when(double, 2).otherwise(1)
    hosts = (
        pages.join(labels, "id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("suffix", F.concat_ws(".", F.slice(parts, size - labels_of + 1, labels_of)))
        .withColumn("domain", F.concat_ws(".", F.slice(parts, F.greatest(size - labels_of, F.lit(1)), labels_of + 1)))
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    judged = [x.filter("n > 0") for x in (hosts, domains, suffixes)]
    of_host, of_domain, of_suffix = (F.broadcast(strength(x, least, most)) for x in judged)  # one row each
    shrunk = lambda mean, s: (F.col("bad") + s * mean) / (F.col("n") + s)
    suffixes = suffixes.crossJoin(of_suffix).select("suffix", shrunk(F.col("mean"), F.col("strength")).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").crossJoin(of_domain.select("strength")).select("domain", shrunk(F.col("suffix_rate"), F.col("strength")).alias("domain_rate"))
    alpha = F.col("bad") + F.col("strength") * F.col("domain_rate")
    beta = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("domain_rate"))
    rate = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    spread = F.sqrt(rate * (1 - rate) / (F.col("alpha") + F.col("beta") + 1))
    return (
        hosts.join(domains, "domain")
        .crossJoin(of_host.select("strength"))
        .select("host", "domain", "suffix", "n", "bad", alpha.alias("alpha"), beta.alias("beta"))
        .withColumn("bound", rate - z * spread)
    )


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    limit: float = 0.3,
    z: float = 1.645,
    least: float = 2.0,
    most: float = 200.0,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n, bad, bound), one row per row of pages.

    pages has page_id and url; labels has doc_id, quality and toxic, and marks the page of the same id: bad when
    quality is 0 or toxic is 1 (any of repeated labels counts; a label with both null counts as none). A page takes
    its rule's verdict, else block when its host's posterior lower bound (mean - z standard deviations) is above
    limit. A null url or one without "://" has empty host and path, and is judged as the host "". Without labels no
    host is blocked. Repeated or null page ids give one row each. Empty table: no rows. Other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).fillna("", ["host", "path"])
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long")
    marks = labels.filter("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(bad).alias("bad"))
    hosts = host_reputation(rows.select(F.col("page_id").alias("id"), "host"), marks, z, least, most)
    found = rule_of(F.col("host"), F.col("path"), rules)
    return (
        rows.join(hosts, "host")
        .withColumn("found", found)
        .select(
            "page_id", "host", "path", F.col("found.rule").alias("rule"),
            F.coalesce(F.col("found.verdict"), F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
            "n", "bad", F.round("bound", 6).alias("bound"),
        )
    )


def oracle(limit: float = 0.3, z: float = 1.645, least: float = 2.0, most: float = 200.0) -> str:
    """DuckDB SQL for filter_urls() with RULES."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fit = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    rule = "case " + " ".join(f"when {fit(h, p)} then '{h}{p}'" for _, h, p in ordered) + " end"
    verdict = "case " + " ".join(f"when {fit(h, p)} then '{v}'" for v, h, p in ordered) + f" when bound > {limit} then 'block' else 'allow' end"

    def weight(source: str) -> str:
        return f"""select mean, least(greatest(coalesce(case when rho > 0 then (1 - rho) / rho end, {most}), {least}), {most}) as strength from (
            select mean, case when (n - k) * mean * (1 - mean) <> 0 then (sq - n * mean * mean - (k - 1) * mean * (1 - mean)) / ((n - k) * mean * (1 - mean)) end as rho
            from (select n, k, sq, coalesce(bad / nullif(n, 0), 0.0) as mean from (
            select sum(n)::double as n, sum(bad)::double as bad, count(*) as k, sum(bad * bad / n::double) as sq from {source} where n > 0)))"""

    return f"""
    with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    r as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
    marks as (select doc_id as id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where quality is not null or toxic is not null group by 1),
    hosts0 as (select host, count(bad) as n, coalesce(sum(bad), 0)::bigint as bad, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as ls from r left join marks on page_id = id group by host),
    hosts1 as (select *, case when len(ls) > 2 and length(ls[-1]) = 2 and ls[-2] in ({', '.join(f"'{x}'" for x in SECOND_LEVEL)}) then 2 else 1 end as k from hosts0),
    hosts as (select host, n, bad, array_to_string(ls[len(ls) - k + 1:], '.') as suffix, array_to_string(ls[greatest(len(ls) - k, 1):], '.') as domain from hosts1),
    domains as (select domain, suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from hosts group by 1, 2),
    suffixes as (select suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from domains group by 1),
    ws as ({weight("suffixes")}), wd as ({weight("domains")}), wh as ({weight("hosts")}),
    s2 as (select suffix, (bad + strength * mean) / (n + strength) as suffix_rate from suffixes, ws),
    d2 as (select domain, (bad + strength * suffix_rate) / (n + strength) as domain_rate from domains join s2 using (suffix), (select strength from wd)),
    h1 as (select host, n, bad, bad + strength * domain_rate as alpha, n - bad + strength * (1 - domain_rate) as beta from hosts join d2 using (domain), (select strength from wh)),
    h2 as (select host, n, bad, alpha / (alpha + beta) - {z} * sqrt((alpha / (alpha + beta)) * (1 - alpha / (alpha + beta)) / (alpha + beta + 1)) as bound from h1)
    select page_id, host, path, {rule} as rule, {verdict} as verdict, n, bad, round(bound, 6) as bound from r join h2 using (host)
    """
