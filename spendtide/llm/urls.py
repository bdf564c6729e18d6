"""URL filters: host and path rules, and trust propagated over the hosts' link graph."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendtide.llm.common import lower_ascii, scratch, staged

#: One whole seed, in the units that propagation adds up. Whole numbers: no order of additions matters.
UNIT = 1_000_000_000

# Links that name a host: href, with or without quotes and scheme.
LINK = r"""[hH][rR][eE][fF]\s*=\s*["']?\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#"'<>\s]+)"""


@dataclass(frozen=True)
class Rule:
    """`text` is host and path prefix, such as `example.net/en/`."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(r.host, r.path, r.text, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, rule_verdict string"
    )


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end; A-Z in lower case."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """`pages` (with host and path) and the longest rule that fits: `rule`, `rule_verdict`.

    Rules meet hosts, not pages: each distinct host is spelled out as its suffixes, which
    are joined with the rules' hosts. A page then reads its host's short list of rules.
    Of equally long rules the first in text order wins.
    """
    hosts = pages.select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))
    )
    fitting = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    entry = F.struct((-F.length("rule")).alias("n"), "rule", "rule_path", "rule_verdict")
    lists = staged(fitting.groupBy("host").agg(F.sort_array(F.collect_set(entry)).alias("rules")), "rules")
    best = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    return pages.join(lists, "host", "left").withColumn("best", best).select(
        *pages.columns, F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict")
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links between different hosts, counted."""
    found = pages.select(
        F.col("host").alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"),
    ).withColumn("dst", lower_ascii(F.col("dst")))
    return found.filter("src != dst and src != ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int, damping: tuple[int, int] = (85, 100)) -> DataFrame:
    """Personalised PageRank (host, score) after `rounds` steps from seeds (host, seed).

    score = (1 - d) * seed + d * sum over edges into the host of score(src) * links / links out of src,
    in whole units, each term rounded down, so results do not depend on the order of work.
    Weight of a host without links out is lost, as usual for trust. A step is one join and
    one pre-aggregated sum, written to the shared folder.
    """
    d, of = damping
    out = edges.groupBy("src").agg(F.sum("links").alias("out_links"))
    shares = staged(edges.join(out, "src"), "shares")
    base = seeds.select("host", F.floor(F.col("seed") * (of - d) / of).cast("bigint").alias("score"))
    base = staged(base, "seeds")
    scores = base
    for _ in range(rounds):
        term = F.floor(F.col("score").cast("decimal(28,0)") * F.col("links") * d / (F.col("out_links") * of)).cast("bigint")
        moved = shares.join(scores, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), term.alias("score"))
        scores = staged(base.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score")), "scores")
    return scores


@scratch
def judge_urls(pages: DataFrame, rules: DataFrame, rounds: int = 8, threshold: int = UNIT // 20) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row per row of `pages`.

    A rule's verdict stands. A page without a rule gets its host's: `block` if the host's
    distrust exceeds its trust by more than `threshold`, else `allow`. Seeds: the share of a
    host's pages that rules allow (trusted) and block (blocked), in units. Trust flows along
    links (personalised PageRank), distrust flows back along them, from a host to those that link to it.

    A null url, or one without `://`, has empty host and path: no rule fits, no score, `allow`.
    A null html has no links. Rows repeat as often as they are given; ids are not looked at,
    so they may be null. Other columns are dropped. An empty table gives no rows.
    """
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = staged(match_rules(found, rules), "ruled", keep=True)
    edges = staged(host_edges(pages.select(host_of(F.col("url")).alias("host"), "html")), "edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")

    def seeds(verdict: str) -> DataFrame:
        share = F.floor(F.count_if(F.col("rule_verdict") == verdict) * UNIT / F.count("*"))
        named = ruled.filter("host != ''").groupBy("host").agg(share.cast("bigint").alias("seed"))
        return named.filter("seed > 0")

    trust = propagate(seeds("allow"), edges, rounds).withColumnRenamed("score", "trust")
    distrust = propagate(seeds("block"), back, rounds).withColumnRenamed("score", "distrust")
    scores = staged(trust.join(distrust, "host", "full"), "scores", keep=True)
    zero = F.lit(0).cast("bigint")
    known, bad = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    own = F.when(bad - known > threshold, "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", own).alias("verdict"), known.alias("trust"), bad.alias("distrust"),
    )
