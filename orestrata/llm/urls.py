"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes (blocked or not) are counted per host. A host's rate of
blocked pages has a beta prior centred on its registered domain's shrunken rate,
the domain's on its suffix's and the suffix's on the overall rate; how strongly a
level pulls is estimated from the spread of the rates below it (method of
moments). A page without a rule is blocked if a lower bound of its host's
posterior rate passes the limit.

Defined cases: a null url, or one without ``://``, has empty host and path, and
its pages share the reputation of the empty host; a host nobody labelled has its
domain's prior, and with no outcome at all the overall rate is 0, so all pages
are allowed; of rules of one length the first in code point order wins; repeated
rows count as often as they come; an empty table gives no rows; other columns
are kept by ``judge`` (its own start with ``_u_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orestrata.llm.common import cut, spread_join, table

# The rules of the registered query (host and path beginning, verdict).
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "org.uk", "co.jp", "ne.jp", "or.jp", "com.au", "net.au", "org.au", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "co.za"]
#: Prior strength when no spread can be estimated, and its limits.
STRENGTH, LEAST, MOST = 10.0, 1.0, 100.0
#: Standard deviations below the posterior mean, and the rate that the bound must pass to block.
Z, LIMIT = 1.645, 0.5

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits the host or a domain above it and begins the path."""
    out = F.lit(None).cast("string")
    for rule in sorted((r for r, _ in rules), key=lambda r: (len(r), [-ord(c) for c in r])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def _strength(level: DataFrame, by: list[str]) -> DataFrame:
    """Prior strength for the members ``n, k`` of each group: from how far their rates spread beyond binomial noise."""
    seen = level.where(F.col("n") > 0)
    mean = F.sum("k") / F.sum("n")
    spread = F.sum(F.col("k") * F.col("k") / F.col("n")) / F.sum("n") - mean * mean
    noise = mean * (1 - mean) * F.sum(1 / F.col("n")) / F.count("*")
    s = (mean * (1 - mean) - spread) / F.when(spread - noise > 1e-12, spread - noise)
    return seen.groupBy(*by).agg(F.when(F.count("*") > 1, F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.coalesce(s, F.lit(MOST))))).alias("s"))


def reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``_u_host``, ``n`` (its rows in ``hosts``), posterior ``_u_alpha`` and ``_u_beta`` of its blocked pages, and the lower bound ``_u_bound``.

    ``outcomes`` has ``_u_host`` and ``_u_blocked`` (0 or 1); every host of
    either table gets a row. Counts combine on the map side, and from there on
    all tables have a row per host, per domain or per suffix.
    """
    counts = outcomes.groupBy("_u_host").agg(F.count("*").alias("n"), F.sum("_u_blocked").alias("k"))
    pages = hosts.groupBy("_u_host").agg(F.count("*").alias("_u_pages"))
    h = pages.join(counts, "_u_host", "full").na.fill(0, ["n", "k", "_u_pages"])
    h = h.withColumn("dom", domain_of(F.col("_u_host"))).withColumn("suf", suffix_of(F.col("_u_host")))
    d = h.groupBy("suf", "dom").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    s = d.groupBy("suf").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    top = s.agg(F.coalesce(F.sum("k") / F.when(F.sum("n") > 0, F.sum("n")), F.lit(0.0)).alias("mean"))
    # A one-row table each: the overall rate and the strength of its pull.
    s = s.join(F.broadcast(top), how="left").join(F.broadcast(_strength(s, [])), how="left")
    shrunk = lambda: (F.col("k") + F.coalesce("s", F.lit(STRENGTH)) * F.col("mean")) / (F.col("n") + F.coalesce("s", F.lit(STRENGTH)))
    s = s.select("suf", shrunk().alias("mean"))
    d2 = d.join(s, "suf").join(_strength(d, ["suf"]), "suf", "left").select("dom", "suf", shrunk().alias("mean"))
    h2 = h.join(d2, ["dom", "suf"]).join(_strength(h, ["dom", "suf"]), ["dom", "suf"], "left").withColumn("s", F.coalesce("s", F.lit(STRENGTH)))
    a = F.col("k") + F.col("s") * F.col("mean")
    b = F.col("n") - F.col("k") + F.col("s") * (1 - F.col("mean"))
    h2 = h2.withColumn("_u_alpha", a).withColumn("_u_beta", b)
    t = F.col("_u_alpha") + F.col("_u_beta")
    deviation = F.sqrt(F.col("_u_alpha") * F.col("_u_beta") / (t * t * (t + 1)))
    return h2.select("_u_host", F.col("_u_pages").alias("n"), "_u_alpha", "_u_beta", F.round(F.col("_u_alpha") / t - Z * deviation, 9).alias("_u_bound"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, outcomes: DataFrame | None = None, url: str = "url") -> DataFrame:
    """``pages`` with ``_u_host, _u_path, _u_rule, _u_bound, _u_verdict``.

    Without other ``outcomes``, the pages that a rule decides are the labelled ones.
    """
    p = pages.withColumn("_u_host", host_of(F.col(url))).withColumn("_u_path", path_of(F.col(url)))
    p = p.withColumn("_u_rule", rule_of(F.col("_u_host"), F.col("_u_path"), rules))
    verdict = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in r]), F.col("_u_rule")) if rules else F.lit(None).cast("string")
    p = p.withColumn("_u_ruled", verdict)
    if outcomes is None:
        outcomes = p.where(F.col("_u_ruled").isNotNull()).select("_u_host", (F.col("_u_ruled") == "block").cast("int").alias("_u_blocked"))
    r = cut(reputation(p, outcomes).select("_u_host", F.col("n").alias("_u_n"), "_u_bound"))
    p = spread_join(p, r, "_u_host", n="_u_n").drop("_u_n")
    method = F.when(F.col("_u_bound") > LIMIT, "block").otherwise("allow")
    return p.withColumn("_u_verdict", F.coalesce("_u_ruled", method)).drop("_u_ruled")


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    p = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return p.select(
        "page_id",
        F.col("_u_host").alias("host"),
        F.col("_u_path").alias("path"),
        F.col("_u_rule").alias("rule"),
        F.col("_u_verdict").alias("verdict"),
        F.col("_u_bound").alias("bound"),
    )


_IN = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)


def _sql_strength(source: str, by: str) -> str:
    g = f"{by}, " if by else ""
    return f"""select {g}case when c > 1 then least({MOST}, greatest({LEAST}, coalesce(
    (m * (1 - m) - v) / case when v - w > 1e-12 then v - w end, {MOST}))) end as s from (
  select {g}count(*) as c, sum(k)::double / sum(n) as m, sum(k * k / n::double) / sum(n) - (sum(k)::double / sum(n)) * (sum(k)::double / sum(n)) as v,
    (sum(k)::double / sum(n)) * (1 - sum(k)::double / sum(n)) * sum(1.0::double / n) / count(*) as w
  from {source} where n > 0 {"group by " + by if by else ""})"""


OP9_SQL = rf"""
with p0 as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
r as (select * from (values {", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)}) t(rule, name, start, v)),
p as (select *, (select arg_max(rule, length(rule)) from r where (host = name or ends_with(host, '.' || name)) and starts_with(path, start)) as rule from p0),
o as (select p.*, r.v as ruled from p left join r using (rule)),
h0 as (select host, count(ruled) as n, count(*) filter (where ruled = 'block') as k,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare from o group by host),
h1 as (select *, string_split(bare, '.') as l from h0),
h2 as (select *, array_to_string(list_slice(l, -2, -1), '.') as two from h1),
h as (select host, n, k, case when two in ({_IN}) then two else l[-1] end as suf,
    case when two in ({_IN}) then array_to_string(list_slice(l, -3, -1), '.') else two end as dom from h2),
d as (select suf, dom, sum(n) as n, sum(k) as k from h group by all),
s as (select suf, sum(n) as n, sum(k) as k from d group by all),
t as (select coalesce(sum(k)::double / case when sum(n) > 0 then sum(n) end, 0) as mean from s),
ss as ({_sql_strength("s", "")}),
ds as ({_sql_strength("d", "suf")}),
hs as ({_sql_strength("h", "suf, dom")}),
s2 as (select suf, (k + coalesce(ss.s, {STRENGTH}) * t.mean) / (n + coalesce(ss.s, {STRENGTH})) as mean from s left join t on true left join ss on true),
d2 as (select d.suf, dom, (k + coalesce(ds.s, {STRENGTH}) * s2.mean) / (n + coalesce(ds.s, {STRENGTH})) as mean from d join s2 using (suf) left join ds using (suf)),
h3 as (select host, k + coalesce(hs.s, {STRENGTH}) * d2.mean as a, n - k + coalesce(hs.s, {STRENGTH}) * (1 - d2.mean) as b
  from h join d2 using (suf, dom) left join hs using (suf, dom)),
b as (select host, round(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) as bound from h3)
select page_id, host, path, rule, coalesce(ruled, case when bound > {LIMIT} then 'block' else 'allow' end) as verdict, bound from o join b using (host)
"""
