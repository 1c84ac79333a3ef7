"""URL filter: rules by host and path, and trust and distrust spread over the graph of host links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.session import cut_lineage

LOWER = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`verdict` for urls of `host` and its subdomains whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query: fixed values.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def _rest(url: Column) -> Column:
    """What follows the first `://`, up to `?` or `#`."""
    return F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1)


def host_of(url: Column) -> Column:
    """Host of a url, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(F.translate(F.substring_index(_rest(url), "/", 1), LOWER.upper(), LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of a url, up to `?` or `#`; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/]*(/.*)$", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls; rules are few and become one expression."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Links between different hosts: rows (src, dst, n), n the number of links in all pages of src."""
    link = F.explode(F.regexp_extract_all(F.col(html_col).cast("string"), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'>]+)"), 1))
    found = pages.select(host_of(F.col(url_col)).alias("src"), link.alias("link"))
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    return found.select("src", host_of(whole).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(nodes: DataFrame, edges: DataFrame, damping: float, tolerance: float, most_rounds: int) -> DataFrame:
    """Personalised PageRank: rows (host, score) from nodes (host, seed) with seeds that add up to 1, over edges (src, dst, share).

    What reaches a host without edges out stays there for one round and is gone. A host with very many edges meets only sums by host and
    joins with one row a host. The rounds are cut every fourth, so plans stay short and a lost executor costs few rounds. At each cut the
    ranks are compared with those of the cut before: they are done once they differ by `tolerance` in sum at most and no
    further host has been reached. ValueError if that takes more than `most_rounds` rounds.
    """
    nodes = cut_lineage(nodes, "nodes")
    rank = nodes.select("host", F.col("seed").alias("score"))
    for _ in range(0, most_rounds, 4):
        last = rank.withColumnRenamed("score", "last")
        for _ in range(4):
            sent = rank.join(edges, rank["host"] == edges["src"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
            arrived = nodes.join(sent, nodes["host"] == sent["dst"], "left").select("host", "seed", F.coalesce("got", F.lit(0.0)).alias("got"))
            rank = arrived.select("host", (damping * F.col("got") + (1 - damping) * F.col("seed")).alias("score"))
        rank = cut_lineage(rank, "rank")
        change, more = rank.join(last, "host").agg(F.sum(F.abs(F.col("score") - F.col("last"))), F.count_if((F.col("score") > 0) & (F.col("last") == 0))).first()
        if (change or 0.0) <= tolerance and not more:
            return rank
    raise ValueError(f"ranks still change by {change} and reach {more} more hosts after {most_rounds} rounds; allow more")


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    damping: float = 0.85, ratio: float = 1.0, tolerance: float = 1e-9, most_rounds: int = 1000,
) -> DataFrame:
    """Judge every page's url: `id_col`, `host`, `path`, `rule`, `verdict`, `trust`, `distrust`.

    A url that a rule fits gets the verdict of the longest such rule. Any other url gets the verdict of its host: the hosts
    of pages that a rule allows are the trusted seeds, those of pages that a rule blocks the blocked seeds, weighted by such
    pages. Trust goes from trusted seeds along links, distrust from blocked seeds against them (who links to a blocked host
    is doubtful), both by personalised PageRank over all host links, repeated until
    the ranks settle (see `spread`; more than `most_rounds` rounds are an error). A host is blocked if its distrust is over `ratio` times its
    trust, else allowed; hosts without links or seeds are allowed. Both ranks are 0 where there is no seed at all.

    A null url, or one without `://`, has an empty host and path and is allowed unless a rule fits. Rows with null or
    repeated ids are judged one by one; other columns are ignored; an empty table gives no rows. The number of hosts may be
    anything; the few rules are part of the plan.
    """
    host, path = host_of(F.col(url_col).cast("string")), path_of(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = base.withColumns({"rule": text, "ruled": verdict})

    links = cut_lineage(host_links(pages, url_col, html_col), "links")
    seeds = ruled.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block"))
    linked = links.select(F.col("src").alias("host")).union(links.select(F.col("dst").alias("host"))).distinct()
    hosts = cut_lineage(seeds.where("host <> ''").join(linked, "host", "full").select("host", F.coalesce("allow", F.lit(0)).alias("allow"), F.coalesce("block", F.lit(0)).alias("block")), "hosts")
    allowed, blocked = hosts.agg(F.sum("allow"), F.sum("block")).first()

    def shares(edges: DataFrame) -> DataFrame:
        total = edges.groupBy("src").agg(F.sum("n").alias("total"))
        return cut_lineage(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")

    trust = spread(hosts.select("host", (F.col("allow") / F.lit(max(allowed or 0, 1))).alias("seed")), shares(links), damping, tolerance, most_rounds)
    against = shares(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    distrust = spread(hosts.select("host", (F.col("block") / F.lit(max(blocked or 0, 1))).alias("seed")), against, damping, tolerance, most_rounds)
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host")

    judged = ruled.join(scores, "host", "left").select(
        "id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("distrust") > ratio * F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return judged.withColumnRenamed("id", id_col)
