"""URL filters: base rules, then trust and distrust over the host graph.

Trust is a personalised PageRank from hosts whose pages the rules allow, along
links; distrust is one from hosts whose pages they block, against the links,
since linking to a bad host is what tells on a host.  A host is blocked if its
trust is under a set share of its trust and distrust together.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from poolwright.llm.graph import join_by_key
from poolwright.llm.stage import materialize


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


# The base rules.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null; of equal
    lengths the first by text."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: (-len(str(r)), str(r)), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """src, dst, weight: links between different hosts, counted; a host and the
    host one label above it are linked both ways where both have pages.

    ``pages`` has ``host``; a null html has no links.
    """
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", F.regexp_replace(F.translate("dst", UPPER, LOWER), r"^.*@|:\d*$", ""))
    own = pages.select("host").where("host <> ''").distinct()
    up = own.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]*\.(.+)$", 1).alias("dst")).join(own.withColumnRenamed("host", "dst"), "dst", "left_semi")
    both = up.select("src", "dst").union(up.select("dst", "src"))
    return links.select("src", "dst").union(both).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, at_once: int = 8, tolerance: float = 1e-4) -> DataFrame:
    """host, trust, distrust.  ``seeds``: host, good, bad (masses, each of sum
    1 or 0).  Mass at a host without links on the way leaves the walk.

    Rounds go on until ``at_once`` of them change no mass by more than
    ``tolerance`` of the least seed.  All change together shrinks by ``damping``
    a round, so that takes about log(tolerance * least) / log(damping) of them.
    """
    ways = edges.select(F.lit("trust").alias("way"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight").union(
        edges.select(F.lit("distrust"), "dst", "src", "weight"))
    out = ways.groupBy("way", "a").agg(F.sum("weight").alias("out"))
    ways = materialize(ways.join(out, ["way", "a"]).select("way", "a", "b", (F.col("weight") / F.col("out")).alias("p")))
    start = materialize(seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("good"), F.lit("distrust"), F.col("bad"))).alias("way", "seed")).where("seed > 0"))
    rank = start.select("way", "host", ((1 - damping) * F.col("seed")).alias("rank"))
    least = start.agg(F.min("seed")).first()[0] or 1.0
    while True:
        before = rank
        for _ in range(at_once):
            moved = ways.join(rank.withColumnRenamed("host", "a"), ["way", "a"]).groupBy("way", F.col("b").alias("host")).agg((damping * F.sum(F.col("p") * F.col("rank"))).alias("rank"))
            rank = moved.union(start.select("way", "host", ((1 - damping) * F.col("seed")).alias("rank"))).groupBy("way", "host").agg(F.sum("rank").alias("rank"))
        rank = materialize(rank)
        step = rank.join(before.withColumnRenamed("rank", "old"), ["way", "host"], "left").agg(F.max(F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))))).first()[0]
        if (step or 0.0) <= tolerance * least:
            break
    mass = lambda way: F.coalesce(F.sum(F.when(F.col("way") == way, F.col("rank"))), F.lit(0.0)).alias(way)
    return rank.groupBy("host").agg(mass("trust"), mass("distrust"))


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[UrlRule, ...] = RULES, least_trust: float = 0.3) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row.

    A rule's verdict stands; else the host's; a host without seeds, links or
    name is allowed.  Repeated rows stay and count as further pages, null ids
    and urls of any length too; other columns are dropped, whatever their names.
    """
    host, path = parts(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    own = materialize(own.withColumn("_r", ruled(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled")))
    per = own.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b"))
    total = per.agg(F.sum("a"), F.sum("b")).first()
    seeds = per.select("host", (F.col("a") / float(total[0] or 1)).alias("good"), (F.col("b") / float(total[1] or 1)).alias("bad"))
    edges = materialize(host_edges(pages.select(host.alias("host"), F.col(html_col).alias("html"))))
    scores = propagate(edges, seeds)
    out = join_by_key(own, materialize(scores), "host").na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > 0) & (F.col("trust") < least_trust * (F.col("trust") + F.col("distrust")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
