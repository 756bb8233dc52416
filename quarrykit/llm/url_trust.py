"""URL filter: explicit rules first, and link-graph propagation for all pages that no rule fits.

Rules are (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the
rule's; the longest rule string wins (ties: block). A host's seed of trust is the share of its pages that an allow
rule fits, its seed of distrust the share that a block rule fits. Edges between hosts are of two kinds: absolute links
in the pages' html to other hosts, with their number as weight; and the tie of a host to the domain that it is part of
(its last two labels), in both directions, with the host's number of pages as weight, as both are of one owner. Trust is a
personalised PageRank along the edges; distrust one against them, from blocked hosts back to the hosts that link to
them. Scores are in units of a full seed's own part, so they do not depend on the number of seeds; the rounds go on
until less than ``residual`` of any rank is left to move.

The threshold lies in the scores themselves: a host is blocked if its distrust is above its trust, and by ``spread``
standard deviations above the mean distrust of all hosts that have pages. Pages without a rule get their host's verdict.

Defined cases: a null url, or one without ``://``, has empty host and path; no rule fits an empty host, which takes
no part in the graph and is allowed; rank that reaches a host without edges ends there; null html has no links;
repeated rows weigh as often as they occur; very long html counts whole; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import ascii_lower, cut

# Public suffixes of two labels, as widely used. Names below one of them belong to different owners.
SUFFIXES = [
    "ac.at", "co.at", "or.at", "com.au", "edu.au", "gov.au", "net.au", "org.au", "com.ar", "com.br", "net.br", "org.br", "com.cn", "net.cn",
    "org.cn", "com.co", "com.es", "co.id", "co.il", "org.il", "co.in", "net.in", "org.in", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp",
    "ac.kr", "co.kr", "go.kr", "or.kr", "com.mx", "com.my", "ac.nz", "co.nz", "govt.nz", "org.nz", "com.pl", "com.pt", "com.sg", "co.th",
    "com.tr", "com.tw", "org.tw", "com.ua", "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "sch.uk", "co.za", "org.za",
    "blogspot.com", "github.io", "gitlab.io", "wordpress.com",
]
PORT = r"(?::[0-9]*)?$"
PARTS = 16
DAMPING, RESIDUAL = 0.85, 0.01
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_length(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1], r[2]))


def first_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The string and the verdict of the rule that decides, null where none fits."""
    fits = [(((host == h) | host.endswith(f".{h}")) & path.startswith(p), f"{h}{p}", v) for v, h, p in by_length(rules)]
    none = F.lit(None).cast("string")
    return tuple(reduce(lambda rest, f: F.when(f[0], F.lit(f[k])).otherwise(rest), reversed(fits), none) for k in (1, 2))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. Every task sums up before the shuffle."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    found = found.select("src", ascii_lower(F.col("to")).alias("dst")).filter("src != dst and src != ''")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def domain_pattern(suffixes: list[str]) -> str:
    """A regular expression whose first group is the domain that a host name is part of."""
    several = "|".join(s.replace(".", "[.]") for s in suffixes)
    return rf"([^.@:\[\]]+[.](?:{several + '|' * bool(several)}[^.@:\[\]]*[^.@:\[\]0-9][^.@:\[\]]*)){PORT}"


def ties(sizes: DataFrame, suffixes: list[str]) -> DataFrame:
    """(src, dst, n) from hosts (host, pages) to their domains and back."""
    own = sizes.select("host", F.regexp_extract("host", domain_pattern(suffixes), 1).alias("domain"), "pages").filter("domain != '' and domain != host")
    return own.select(F.col("host").alias("src"), F.col("domain").alias("dst"), F.col("pages").alias("n")).unionByName(own.select(F.col("domain").alias("src"), F.col("host").alias("dst"), F.col("pages").alias("n")))


def rounds_for(damping: float, residual: float) -> int:
    """After so many rounds, less than ``residual`` of what a seed sends out is still under way."""
    return math.ceil(math.log(residual) / math.log(damping))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, rounds: int) -> DataFrame:
    """(kind, host, score) from seeds (kind, host, seed) over edges (kind, a, b, share)."""
    base = cut(seeds.filter("seed > 0").select("kind", "host", F.col("seed").alias("score")))
    scores = base
    if not edges.limit(1).count():
        return base
    for turn in range(rounds):
        moved = scores.join(edges, (scores["host"] == edges["a"]) & (scores["kind"] == edges["kind"]))
        moved = moved.select(scores["kind"], F.col("b").alias("host"), (damping * F.col("share") * F.col("score")).alias("score"))
        scores = base.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if turn % 6 == 5 or turn == rounds - 1:
            scores = cut(scores)
    return scores


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], damping: float = DAMPING, residual: float = RESIDUAL, spread: float = 1.0, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, and what decided (``rule``, ``host``: propagation, ``none``), of every row."""
    url = F.col("url").cast("string")
    pages = pages.select("page_id", url.alias("url"), F.col("html").cast("string").alias("html"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = first_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "said": verdict})
    share = {k: F.avg((F.coalesce("said", F.lit("")) == v).cast("double")).alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))}
    shares = cut(rows.filter("host != ''").groupBy("host").agg(F.count("*").alias("pages"), *share.values()))
    seeds = shares.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, seed)"))
    found = cut(links(pages).unionByName(ties(shares, suffixes)).groupBy("src", "dst").agg(F.sum("n").alias("n")))
    forward = found.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n")
    back = found.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    edges = forward.unionByName(back)
    # a hub's many links are summed in part before its total is shuffled
    total = edges.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    edges = cut(edges.join(total, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("share")))
    scores = propagate(seeds, edges, damping, rounds_for(damping, residual))
    scores = scores.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    hosts = cut(shares.select("host").join(scores, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    limit = hosts.agg(F.coalesce(F.avg("distrust") + spread * F.stddev_pop("distrust"), F.lit(0.0))).first()[0]
    blocked = hosts.filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") > limit)).select(F.col("host").alias("_h"))
    # a large host's pages are dealt out, and its verdict with them
    blocked = blocked.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = F.pmod(F.xxhash64("page_id", "path"), F.lit(PARTS)).cast("int")
    judged = rows.join(blocked, (F.col("host") == F.col("_h")) & (part == F.col("_p")), "left")
    by_host = F.when(F.col("_h").isNotNull(), F.lit("block"))
    by = F.when(F.col("said").isNotNull(), "rule").when(F.col("host") != "", "host").otherwise("none")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", by_host, F.lit("allow")).alias("verdict"), by.alias("decided_by"))
