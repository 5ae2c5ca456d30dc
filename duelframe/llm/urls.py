"""URL filter: rules on hosts and paths, and trust that spreads over links between hosts.

Trust starts at hosts with pages that a rule allows and follows links (personalised PageRank). Distrust starts at hosts
with pages that a rule blocks and follows links backwards: who links to bad hosts is suspect. A host is blocked if its
distrust is higher than its trust and above ``MIN_LIFT`` times what its number of pages would give it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.common import ascii_lower, small
from duelframe.storage import materialise

#: Verdict, host and path prefix, as in the task's contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

DAMPING = 0.85
ROUNDS = 30
TOLERANCE = 1e-6
MIN_LIFT = 1.0

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# The host of a link that names one, with or without a scheme; relative links stay on their host.
_LINK = r"(?i)href\s*=\s*[\x22']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\x22'<>\s]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and for text without ``://``."""
    part = [F.coalesce(F.regexp_extract(url, _URL, i), F.lit("")) for i in (1, 2)]
    return ascii_lower(part[0]), part[1]


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (NULL if none does) and its verdict. ``rules`` is a fixed list of a few hundred at most."""
    found, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for says, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, prefix = rule.partition("/")
        fits = (host == name) | host.endswith("." + name)
        fits = fits & path.startswith(slash + prefix)
        found, verdict = found.when(fits, F.lit(rule)), verdict.when(fits, F.lit(says))
    return found, verdict


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, links) between different hosts."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1)), ascii_lower))
    links = pages.where(F.col(html).contains("//")).select(F.col(host).alias("src"), F.explode(targets).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagated(hosts: DataFrame, links: DataFrame, damping=DAMPING, rounds=ROUNDS, tolerance=TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from hosts with seed shares (host, seed_trust, seed_distrust) and their links.

    Each round is one stored table, so a lost executor costs a round. It ends after ``rounds`` rounds, or when the ranks
    of all hosts together change by less than ``tolerance``. Rank that reaches a host without links out leaves the graph.
    """
    out_links = links.groupBy(F.col("src").alias("s")).agg(F.sum("links").alias("n_out"))
    in_links = links.groupBy(F.col("dst").alias("d")).agg(F.sum("links").alias("n_in"))
    edges = links.join(out_links, F.col("src") == F.col("s")).join(in_links, F.col("dst") == F.col("d"))
    edges = edges.select("src", "dst", (F.col("links") / F.col("n_out")).alias("go"), (F.col("links") / F.col("n_in")).alias("back"))
    edges = materialise(edges, "host-edges")
    base = hosts.select("host", *[(F.col(f"seed_{k}") * (1 - damping)).alias(f"base_{k}") for k in ("trust", "distrust")])
    base = materialise(base, "host-seeds")
    ranks = base.select("host", F.col("base_trust").alias("trust"), F.col("base_distrust").alias("distrust"))
    if edges.isEmpty():
        return ranks
    for _ in range(rounds):
        forward = edges.join(ranks, F.col("src") == F.col("host")).select(F.col("dst").alias("at"), (F.col("trust") * F.col("go")).alias("t"), F.lit(0.0).alias("d"))
        backward = edges.join(ranks, F.col("dst") == F.col("host")).select(F.col("src").alias("at"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        got = forward.union(backward).groupBy("at").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        new = base.join(got, F.col("host") == F.col("at"), "left").join(ranks.select(F.col("host").alias("h"), F.col("trust").alias("t0"), F.col("distrust").alias("d0")), F.col("host") == F.col("h"))
        new = new.select(
            "host",
            (F.col("base_trust") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            (F.col("base_distrust") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
            "t0",
            "d0",
        )
        new = materialise(new, "host-ranks")
        change = new.agg(F.sum(F.abs(F.col("trust") - F.col("t0")) + F.abs(F.col("distrust") - F.col("d0")))).first()[0] or 0.0
        ranks = new.select("host", "trust", "distrust")
        if change < tolerance:
            break
    return ranks


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, min_lift: float = MIN_LIFT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; one row per row, other columns kept.

    A page that a rule fits gets the rule's verdict, any other its host's. Pages without a host, and hosts without rank,
    are allowed. NULL and empty pages have no links; repeated pages count as often as they occur. Columns of ``pages``
    with the new names are replaced. An empty table gives an empty table.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url))
    slim = pages.select(F.col(url), F.col(html)).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    per_host = (
        slim.withColumn("verdict", verdict)
        .where("host <> ''")
        .groupBy("host")
        .agg(F.count("*").alias("pages"), F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    )
    links = materialise(host_links(slim, "host", html), "host-links")
    unseen = links.select(F.col("dst").alias("host")).distinct()
    zero = [F.lit(0).cast("long").alias(c) for c in ("pages", "good", "bad")]
    per_host = materialise(per_host.unionByName(unseen.select("host", *zero)).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "good", "bad")]), "hosts")
    totals = per_host.agg(*[F.sum(c).alias(c) for c in ("pages", "good", "bad")]).first()
    share = {c: F.col(c) / F.lit(float(totals[c] or 0) or 1.0) for c in ("pages", "good", "bad")}
    seeds = per_host.select("host", share["good"].alias("seed_trust"), share["bad"].alias("seed_distrust"))
    ranks = propagated(seeds, links)
    judged = per_host.join(ranks, "host").select(
        "host",
        F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") > min_lift * share["pages"]) , "block").otherwise("allow").alias("_host_verdict"),
    )
    blocked = materialise(judged.where("_host_verdict = 'block'"), "blocked-hosts")
    out = pages.select(*kept).withColumn("host", host).withColumn("path", path)
    out = out.withColumn("rule", rule).withColumn("_rule_verdict", verdict).join(small(blocked), "host", "left")
    final = F.coalesce("_rule_verdict", "_host_verdict", F.lit("allow"))
    return out.select(*kept, "host", "path", "rule", final.alias("verdict"))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Query op5_url_trust: the verdict on every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same in SQL, every round a table expression of its own."""
    cases = {"rule": "", "says": ""}
    for says, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, prefix = rule.partition("/")
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{prefix}') THEN"
        cases["rule"] += f" {fits} '{rule}'"
        cases["says"] += f" {fits} '{says}'"
    rounds = ["r0 AS MATERIALIZED (SELECT host, bt AS trust, bd AS distrust FROM base)"]
    for i in range(ROUNDS):
        rounds.append(
            f"r{i + 1} AS MATERIALIZED (SELECT b.host, any_value(bt) + {DAMPING} * coalesce(sum(t), 0) AS trust,"
            f" any_value(bd) + {DAMPING} * coalesce(sum(d), 0) AS distrust FROM base b LEFT JOIN ("
            f" SELECT dst AS at, trust * go AS t, 0.0 AS d FROM edges JOIN r{i} ON src = host UNION ALL"
            f" SELECT src, 0.0, distrust * back FROM edges JOIN r{i} ON dst = host) g ON b.host = g.at GROUP BY b.host)"
        )
    return rf"""
WITH parts AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (SELECT *, CASE {cases["rule"]} END AS rule, CASE {cases["says"]} END AS says FROM parts),
found AS (
  SELECT host AS src, unnest(list_distinct(list_transform(
    regexp_extract_all(html, '(?i)href\s*=\s*[\x22\x27]?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\x22\x27<>\s]*)', 1), lambda x: lower(x)))) AS dst FROM parts),
links AS (SELECT src, dst, count(*) AS links FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
edges AS MATERIALIZED (SELECT src, dst, links / sum(links) OVER (PARTITION BY src) AS go, links / sum(links) OVER (PARTITION BY dst) AS back FROM links),
hosts AS (
  SELECT host, sum(pages) AS pages, sum(good) AS good, sum(bad) AS bad FROM (
    SELECT host, 1 AS pages, CASE WHEN says = 'allow' THEN 1 ELSE 0 END AS good, CASE WHEN says = 'block' THEN 1 ELSE 0 END AS bad FROM ruled WHERE host <> ''
    UNION ALL SELECT dst, 0, 0, 0 FROM links) GROUP BY host),
shares AS (SELECT host, pages / greatest(sum(pages) OVER (), 1) AS mass, good / greatest(sum(good) OVER (), 1) AS st, bad / greatest(sum(bad) OVER (), 1) AS sd FROM hosts),
base AS MATERIALIZED (SELECT host, {1 - DAMPING} * st AS bt, {1 - DAMPING} * sd AS bd FROM shares),
{", ".join(rounds)}
SELECT page_id, p.host, path, rule, coalesce(says, CASE WHEN r.distrust > r.trust AND r.distrust > {MIN_LIFT} * s.mass THEN 'block' END, 'allow') AS verdict
FROM ruled p LEFT JOIN r{ROUNDS} r ON p.host = r.host LEFT JOIN shares s ON p.host = s.host
"""


SQL = _sql()
