"""URL filters: rules first, then the link graph's verdict on hosts.

Pages that a rule allows make their hosts trusted seeds, pages that a rule blocks make theirs
distrusted seeds, each by its share of the host's pages. Trust flows along host edges as a
personalised PageRank, distrust flows against them: a host that links to blocked ones is distrusted.
Edges are links between hosts, counted once per pair, and a host's edge to and from the domain
above it, since a site answers for its subdomains. A host's pages without a rule are blocked where
its distrust is at least ``threshold`` of trust and distrust together; a host that neither reaches is
allowed.

Everything is DataFrame operations. Links and pages become one row per host or host pair before
any join, so a host with a third of all pages is a partial count per task. Only the final verdict
joins pages with hosts, two strings wide, where adaptive execution splits a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import Scratch, ascii_lower

#: (action, host and path): a rule holds for the host and its subdomains. Fixed values.
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as (rule, action); null without one. ``rules`` is a bounded list.

    Of two rules of one length, the one that stands first wins.
    """
    chosen = F.lit(None)
    for action, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last one put around is tried first
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        chosen = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(action).alias("action"))).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target): each pair of different hosts with a link between them, once.

    ``pages`` has host and html. Links are absolute or start with ``//``; others stay on the host.
    """
    links = pages.where(F.col("host") != "").select(
        F.col("host").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("link")
    )
    full = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return links.select("source", host_of(full).alias("target")).where("target <> '' AND target <> source").distinct()


def _with_domains(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """The edges, and those between each host and the domain one label above it, down to two labels."""
    nodes = hosts.select("host").unionByName(edges.select(F.col("target").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    chain = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    up = nodes.where(F.size(labels) > 2).select(F.explode(F.arrays_zip(
        F.slice(chain, F.lit(1), F.size(chain) - 1).alias("low"), F.slice(chain, F.lit(2), F.size(chain) - 1).alias("high")
    )).alias("e")).select(F.col("e.low").alias("source"), F.col("e.high").alias("target"))
    down = up.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return edges.unionByName(up).unionByName(down).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """(kind, node, score) after ``rounds`` of personalised PageRank, for each kind of ``seeds`` (kind, node, score).

    Trust flows from source to target, distrust from target to source. What a node without
    outgoing edges holds goes back to the seeds.
    """
    flows = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("node"), F.col("target").alias("to")).unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("node"), F.col("source").alias("to"))
    )
    degrees = flows.groupBy("kind", "node").agg(F.count("*").alias("degree"))
    flows = scratch.put(flows.join(degrees, ["kind", "node"]), "flows")
    total = seeds.groupBy("kind").agg(F.sum("score").alias("total"))
    start = scratch.put(
        seeds.join(total, "kind").where("total > 0").select("kind", "node", (F.col("score") / F.col("total")).alias("seed")), "seeds"
    )
    current = start.withColumnRenamed("seed", "score")
    for k in range(rounds):
        sent = current.join(flows, ["kind", "node"]).select("kind", F.col("to").alias("node"), (F.col("score") / F.col("degree") * damping).alias("part"))
        arrived = scratch.put(sent.groupBy("kind", "node").agg(F.sum("part").alias("score")), f"arrived-{k}")
        # Rank that did not arrive anywhere returns to the seeds, with the share that always does.
        back = start.select("kind").distinct().join(arrived.groupBy("kind").agg(F.sum("score").alias("held")), "kind", "left")
        back = back.select("kind", (1 - F.coalesce("held", F.lit(0.0))).alias("back"))
        returned = start.join(back, "kind").select("kind", "node", (F.col("seed") * F.col("back")).alias("score"))
        current = scratch.put(arrived.unionByName(returned).groupBy("kind", "node").agg(F.sum("score").alias("score")), f"rank-{k}")
        if k:
            scratch.drop(f"rank-{k - 1}")
        scratch.drop(f"arrived-{k}")
    return current


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5, damping: float = 0.85, rounds: int = 12
) -> DataFrame:
    """(page_id, host, path, rule, verdict, distrust) of every row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has an empty host and path, no rule, and is allowed. A null
    html has no links. Rows that repeat each count as a page and get the same verdict; a share that
    equals ``threshold`` blocks. An empty table gives an empty result; further columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "linkgraph")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    edges = scratch.put(host_edges(rows), "links")
    action = rows.select("host", ruled.alias("r")).select("host", F.col("r.action").alias("action")).where("host <> ''")
    hosts = scratch.put(
        action.groupBy("host").agg(
            F.count("*").alias("n"), F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked")
        ),
        "hosts",
    )
    graph = _with_domains(edges, hosts)
    share = lambda kind, column: hosts.select(F.lit(kind).alias("kind"), F.col("host").alias("node"), (F.col(column) / F.col("n")).alias("score")).where("score > 0")
    ranks = propagate(graph, share("trust", "allowed").unionByName(share("distrust", "blocked")), scratch, damping, rounds)
    trust = F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0))
    distrust = F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0))
    scores = ranks.groupBy(F.col("node").alias("host")).agg(F.round(distrust / (trust + distrust), 6).alias("distrust"))
    scores = scratch.put(hosts.select("host").join(scores, "host"), "scores")
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = named.join(scores, "host", "left").withColumn("r", ruled)
    method = F.when(F.col("distrust") >= threshold, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", method).alias("verdict"), "distrust"
    )


def sql(rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5, damping: float = 0.85, rounds: int = 12) -> str:
    """The same in DuckDB, a common table per round."""
    cases = []
    for action, text in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = text.partition("/")
        cases.append((f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash + rest}')", text, action))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in cases) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for c, _, a in cases) + " END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = lambda x: f"coalesce(translate(regexp_extract({x}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}'), '')"
    link = """(?is)<a\\s[^>]*?href\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]*)"""
    parts = [
        f"p AS (SELECT page_id, html, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)",
        f"r AS (SELECT page_id, host, path, {rule} AS rule, {action} AS action FROM p)",
        f"l AS (SELECT host AS source, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM p WHERE host <> '')",
        f"links AS (SELECT DISTINCT source, {host('''CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END''')} AS target FROM l)",
        "e0 AS (SELECT * FROM links WHERE target <> '' AND target <> source)",
        "hosts AS (SELECT host, count(*) AS n, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'block') AS blocked FROM r WHERE host <> '' GROUP BY host)",
        "up AS (SELECT host AS source, substr(host, instr(host, '.') + 1) AS target FROM (SELECT host FROM hosts UNION SELECT target FROM e0) n WHERE len(string_split(host, '.')) > 2"
        " UNION SELECT target, substr(target, instr(target, '.') + 1) FROM up WHERE len(string_split(target, '.')) > 2)",
        "e AS (SELECT * FROM e0 UNION SELECT * FROM up UNION SELECT target, source FROM up)",
        "f0 AS (SELECT 'trust' AS kind, source AS node, target AS dest FROM e UNION ALL SELECT 'distrust', target, source FROM e)",
        "flow AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY kind, node) AS degree FROM f0)",
        "s0 AS (SELECT 'trust' AS kind, host AS node, allowed / n AS score FROM hosts UNION ALL SELECT 'distrust', host, blocked / n FROM hosts)",
        "seed AS MATERIALIZED (SELECT kind, node, score / sum(score) OVER (PARTITION BY kind) AS score FROM s0 WHERE score > 0)",
        "k0 AS (SELECT * FROM seed)",
    ]
    for k in range(rounds):
        parts += [
            f"a{k} AS MATERIALIZED (SELECT kind, dest AS node, sum(score / degree * {damping}) AS score FROM k{k} JOIN flow USING (kind, node) GROUP BY ALL)",
            f"k{k + 1} AS MATERIALIZED (SELECT kind, node, sum(score) AS score FROM (SELECT * FROM a{k} UNION ALL SELECT s.kind, s.node, "
            f"s.score * (1 - coalesce((SELECT sum(score) FROM a{k} a WHERE a.kind = s.kind), 0)) FROM seed s) u GROUP BY ALL)",
        ]
    parts.append(
        f"d AS (SELECT node AS host, round(coalesce(sum(score) FILTER (kind = 'distrust'), 0) / sum(score), 6) AS distrust FROM k{rounds} GROUP BY node)"
    )
    return "WITH RECURSIVE " + ",\n".join(parts) + (
        f"\nSELECT page_id, r.host, path, rule, coalesce(action, CASE WHEN distrust >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict, distrust"
        " FROM r LEFT JOIN d ON r.host = d.host AND r.host <> ''"
    )
