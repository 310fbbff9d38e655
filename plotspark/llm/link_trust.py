"""URL verdicts from rules and from trust that spreads over the link graph.

Pages that a rule allows seed trust, pages that a rule blocks seed distrust. Trust follows the links between hosts by personalised PageRank;
distrust goes against them, since a host that links to bad hosts is suspect. A host's verdict is a threshold on the share of trust in both,
and a page without a rule takes its host's verdict. Hosts are nodes and links are counted edges: both are aggregated before they are shuffled,
and a round is one equality join and one sum by host, however many links a host has.

Defined results
* The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path follows up to ``?``,
  ``#`` or the end. A null url, or one without ``://``, has an empty host and path, which no rule fits.
* Of the rules that fit, the longest wins, then a blocking one. Hosts that no trust or distrust reaches, at any distance, get ``default``.
* Rounds go on until no host is reached anew and no rank still grows by more than ``growth`` between two checks.
* Null html has no links. Links to hosts without pages pass trust on, but have no verdict. Links without a host lead to the page's own host.
* Repeated pages and links count as often as they occur. Empty tables give an empty table. Rank at hosts without links is not passed on.
* Only page_id, url and html are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotspark.llm.small import settled
from plotspark.session import checkpointed


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TrustSettings:
    damping: float = 0.85
    #: Least number of rounds: as many as leave under this share of a rank to come where everything is near a seed.
    rest: float = 0.01
    #: Beyond them rounds go on until no host is reached anew and no rank has grown by more than this share since the last check.
    growth: float = 0.01
    rounds_per_checkpoint: int = 6
    min_trust_share: float = 0.5
    default: str = "allow"

    @property
    def rounds(self) -> int:
        return math.ceil(math.log(self.rest) / math.log(self.damping))


def host_of(url: Column) -> Column:
    after = F.substring_index(url, "://", 1)
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(after) + 4)).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    after = F.substring_index(url, "://", 1)
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(after) + 4)).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the rule that decides, or nulls."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block")):  # the last one that fits is tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between hosts, from the href attributes of ``pages`` (host, html)."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\shref\s*=\s*["']?([^"'\s>]*)"""), 1)
    found = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(targets).alias("href"))
    absolute = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href"))
    other = host_of(F.when(absolute.rlike("^(?i)https?://"), absolute))
    dst = F.when(other != "", other).otherwise(F.col("src"))
    return found.select("src", dst.alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, settings: TrustSettings | None = None) -> DataFrame:
    """kind, host, rank: personalised PageRank from ``seeds`` (kind, host, share) over ``edges`` (kind, src, dst, share)."""
    settings = settings or TrustSettings()
    start = checkpointed(seeds.select("kind", "host", (F.col("share") * (1 - settings.damping)).alias("rank")))
    edges = checkpointed(edges.select("kind", F.col("src").alias("host"), "dst", (F.col("share") * settings.damping).alias("passed")))
    ranks = known = start
    for done in count(1):
        moved = ranks.join(edges, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("passed")).alias("rank"))
        ranks = start.unionAll(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if done % settings.rounds_per_checkpoint and done != settings.rounds:
            continue
        ranks = checkpointed(ranks)
        if done >= settings.rounds:
            grown = ranks.join(known.withColumnRenamed("rank", "before"), ["kind", "host"], "left")
            if grown.where(F.col("before").isNull() | (F.col("rank") > F.col("before") * (1 + settings.growth))).isEmpty():
                return ranks
        known = ranks


def host_verdicts(pages: DataFrame, settings: TrustSettings | None = None) -> DataFrame:
    """host, trust, distrust, trust_share and verdict of the hosts that trust or distrust reaches; ``pages`` has host, html and rule_verdict."""
    settings = settings or TrustSettings()
    kinds = F.when(F.col("rule_verdict") == "allow", "trust").when(F.col("rule_verdict") == "block", "distrust")
    seeds = settled(pages.withColumn("kind", kinds).where("kind is not null").groupBy("kind", "host").agg(F.count(F.lit(1)).alias("n")))
    seeds = seeds.join(F.broadcast(seeds.groupBy("kind").agg(F.sum("n").alias("all"))), "kind")  # two rows
    counted = checkpointed(links(pages))
    forward = counted.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    reverse = counted.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    edges = forward.unionAll(reverse)
    edges = edges.join(edges.groupBy("kind", "src").agg(F.sum("n").alias("all")), ["kind", "src"])
    share = (F.col("n") / F.col("all")).alias("share")
    ranks = spread(seeds.select("kind", "host", share), edges.select("kind", "src", "dst", share), settings)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    both = ranks.groupBy("host").agg(of("trust"), of("distrust")).where("trust + distrust > 0")
    trusted = (F.col("trust") / (F.col("trust") + F.col("distrust"))).alias("trust_share")
    return both.select("host", "trust", "distrust", trusted).withColumn("verdict", F.when(F.round("trust_share", 9) >= settings.min_trust_share, "allow").otherwise("block"))


def judge_pages(pages: DataFrame, rules: list[Rule], settings: TrustSettings | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust_share (null where neither trust nor distrust reaches it) of every page."""
    settings = settings or TrustSettings()
    rows = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "rule_verdict": verdict})
    hosts = settled(host_verdicts(rows, settings).select("host", "trust_share", F.col("verdict").alias("host_verdict")))
    judged = rows.drop("html").join(hosts, "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit(settings.default)).alias("verdict"), "trust_share")
