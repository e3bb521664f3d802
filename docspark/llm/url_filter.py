"""URL filters: host and path rules, then link-graph propagation for what no rule decides.

A rule ``host/path`` fits its host and all subdomains when the url's path starts with the
rule's; the longest wins (the earlier of equals). Hosts whose root a block rule decides
are blocked seeds, with pages of their own or only linked to; hosts with pages that an allow rule decides are trusted seeds, unless
blocked. Over the edges between hosts (absolute links in the pages' html) trust flows along links
(personalised PageRank from the trusted seeds) and distrust against them (the same
from the blocked seeds over reversed edges). Every seed restarts with 1 - ``alpha`` of its own, not with a share of
one unit for all, so that a host's ranks and the ``threshold`` mean the same however many seeds there are;
what reaches a host without further links ends there. A host is blocked when its distrust reaches
``threshold`` and exceeds its trust. Rounds end once no rank moves by ``tolerance``, after ``rounds`` at the latest,
when less than ``alpha`` ** ``rounds`` (0.006 %) of a seed's rank is still on its way.

Edges are summed per pair of hosts before they are joined; the ranks are a table with a row
per host and direction, written to the shared folder every few rounds. Joins with hosts leave a
hot host's rows to be split, or the ranks broadcast where their measured size allows.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is
allowed; a url without a path has an empty path; null html has no links; links of a host to
itself don't count; pages that repeat are judged alike; an empty table gives an empty
result. Columns beyond page_id, url and html are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
AZ, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A tag ends at the next angle bracket, so that broken html isn't searched again and again.
LINKS = r"""(?i)<a\s[^<>]*?href\s*=\s*(?:["']\s*)?((?:https?:)?//[^"'>\s]+)"""


def host_of(url) -> F.Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), AZ, LOWER)


def path_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def first_rule(host, path, rules=RULES) -> F.Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts."""
    link = F.explode(F.regexp_extract_all("html", F.lit(LINKS), F.lit(1)))
    found = pages.select(host_of(F.col("url")).alias("src"), link.alias("link"))
    dst = host_of(F.concat(F.when(F.startswith("link", F.lit("//")), F.lit("http:")).otherwise(F.lit("")), F.col("link")))
    return found.select("src", dst.alias("dst")).where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


ROUNDS = 60


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, alpha: float = 0.85, every: int = 4, tolerance: float = 1e-12) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, direction 'trust' or 'distrust')."""
    out = edges.groupBy("src").agg(F.sum("links").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("all"))
    along = edges.join(out, "src").select(F.lit("trust").alias("direction"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("links") / F.col("all")).alias("share"))
    against = edges.join(into, "dst").select(F.lit("distrust").alias("direction"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("links") / F.col("all")).alias("share"))
    moves = materialize(along.unionByName(against))
    start = materialize(seeds.distinct().withColumn("rank", F.lit(1 - alpha)))
    rank = last = start
    for i in range(0 if moves.isEmpty() else rounds):
        moved = moves.join(rank, ["direction", "host"]).select("direction", F.col("to").alias("host"), (F.col("share") * F.col("rank") * alpha).alias("rank"))
        rank = start.unionByName(moved).groupBy("direction", "host").agg(F.sum("rank").alias("rank"))
        if i % every == every - 1:
            rank = materialize(rank)
            change = rank.unionByName(last.withColumn("rank", -F.col("rank"))).groupBy("direction", "host").agg(F.abs(F.sum("rank")).alias("change"))
            settled = change.where(F.col("change") > tolerance).isEmpty()
            if last is not start:
                discard(last)
            last = rank
            if settled:
                break
    return rank.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("rank"))), F.lit(0.0)).alias(d) for d in ("trust", "distrust")))


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.02, **how) -> DataFrame:
    """page_id, host, path, rule and verdict, a row per page."""
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("_rule", first_rule(F.col("host"), F.col("path"), rules))
    hosts = own.groupBy("host").agg(F.max(F.coalesce(F.col("_rule.verdict") == "allow", F.lit(False))).alias("vouched"))
    root = F.coalesce(first_rule(F.col("host"), F.lit("/"), rules)["verdict"], F.lit(""))
    direction = F.when(root == "block", "distrust").when((root == "allow") | F.col("vouched"), "trust")
    edges = materialize(host_edges(pages))
    linked = edges.select("src").union(edges.select("dst")).toDF("host").withColumn("vouched", F.lit(False))
    hosts = hosts.unionByName(linked).groupBy("host").agg(F.max("vouched").alias("vouched"))
    seeds = hosts.where("host != ''").select("host", direction.alias("direction")).where("direction IS NOT NULL")
    ranks = propagate(seeds, edges, **how)
    bad = ranks.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("_host"))
    judged = own.join(bad, "host", "left")
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), F.col("_host"), F.lit("allow")).alias("verdict"))


def _oracle(rules=RULES, rounds: int = ROUNDS, alpha: float = 0.85, threshold: float = 0.02) -> str:
    """The same rows in DuckDB's SQL: propagation as a chain of common table expressions."""

    def chain(what, host, path):
        cases = "".join(
            f" WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h + p if what == 'rule' else v}'"
            for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
        )
        return f"CASE{cases} END"

    host, path = (f"coalesce(regexp_extract({{u}}, '(?s)^.*?://([^/?#]*)([^?#]*)', {i}), '')" for i in (1, 2))
    lower = f"translate({host}, '{AZ}', '{LOWER}')"
    pattern = LINKS.replace("'", "''")
    steps = "".join(
        f"""r{i + 1} AS (SELECT direction, host, sum(rank) AS rank FROM (SELECT direction, host, rank FROM r0 UNION ALL
        SELECT m.direction, m.dest, m.share * r.rank * {alpha} FROM moves m JOIN r{i} r ON m.direction = r.direction AND m.host = r.host) GROUP BY ALL),\n"""
        for i in range(rounds)
    )
    return f"""
WITH own AS (SELECT page_id, {lower.format(u='url')} AS host, {path.format(u='url')} AS path, html FROM pages),
ruled AS (SELECT page_id, host, path, {chain('rule', 'host', 'path')} AS rule, {chain('verdict', 'host', 'path')} AS by_rule FROM own),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{pattern}', 1)) AS link FROM own),
named AS (SELECT src, {lower.format(u="(CASE WHEN starts_with(link, '//') THEN 'http:' ELSE '' END || link)")} AS dst FROM found),
edges AS (SELECT src, dst, count(*) AS links FROM named WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
named_hosts AS (SELECT host, coalesce(by_rule = 'allow', false) AS allowed FROM ruled WHERE host <> ''
  UNION ALL SELECT src, false FROM edges UNION ALL SELECT dst, false FROM edges),
hosts AS (SELECT host, bool_or(allowed) AS vouched, {chain('verdict', 'host', "'/'")} AS root FROM named_hosts GROUP BY host),
r0 AS (SELECT host, CASE WHEN root = 'block' THEN 'distrust' ELSE 'trust' END AS direction, {1 - alpha} AS rank FROM hosts
       WHERE root IS NOT NULL OR vouched),
moves AS (SELECT 'trust' AS direction, src AS host, dst AS dest, links / sum(links) OVER (PARTITION BY src) AS share FROM edges
          UNION ALL SELECT 'distrust', dst, src, links / sum(links) OVER (PARTITION BY dst) FROM edges),
{steps}bad AS (SELECT host FROM r{rounds} GROUP BY host
        HAVING coalesce(sum(rank) FILTER (direction = 'distrust'), 0) >= {threshold}
           AND coalesce(sum(rank) FILTER (direction = 'distrust'), 0) > coalesce(sum(rank) FILTER (direction = 'trust'), 0))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""


ORACLE = _oracle()
