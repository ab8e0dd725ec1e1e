"""URL filter: rules first, then trust and distrust propagated over the links between hosts.

Native DataFrame code only.  A page's verdict is that of the longest rule that fits its host (or a
domain above it) and the start of its path.  Pages without a rule get their host's: hosts whose pages
are mostly allowed by rules are trusted seeds, hosts mostly blocked are blocked seeds; personalised
PageRank runs from the trusted seeds along host links and from the blocked seeds against them (who
links to blocked hosts is distrusted).  A host is blocked when its distrust reaches THRESHOLD of an
average seed's restart and exceeds its trust, both counted in such restarts; otherwise allowed.

Links are counted per pair of hosts inside each task before they are shuffled, and ranks move as
(host, rank) rows, so a host with a third of all pages is one row.  Null urls and urls without '://'
have an empty host and path, fit no rule, and are allowed unless pages without a host are distrusted
(they have no links, so never).  Null html has no links; repeated pages count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, discard, stage
from .contamination import LOWERED, UPPER

DAMPING = 0.85
ROUNDS = 20
#: Written to the shared folder after so many rounds.
ROUNDS_A_STAGE = 5
THRESHOLD = 0.1
#: Share of a host's pages that rules must allow (or block) to make it a seed.
SEED_SHARE = 0.5
#: Fixed value: absolute links of a page; group 1 is the address without its scheme.
LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?(//[^\s"'<>]+)"""

Rules = list[tuple[str, str, str]]


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWERED)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """(suffix, path, verdict) from (host, path, verdict) triples."""
    return spark.createDataFrame([(h.lower(), p, v) for h, p, v in rules], "suffix string, path string, verdict string").distinct()


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host the rules on it and on the domains above it, longest first."""
    labels = F.split("host", "\\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = hosts.select("host", F.explode(tails).alias("suffix")).join(rules, "suffix")
    one = F.struct(
        (-(F.length("suffix") + F.length("path"))).alias("rank"), F.concat("suffix", "path").alias("rule"), F.col("path").alias("path"), F.col("verdict").alias("verdict")
    )
    return hosts.join(fit.groupBy("host").agg(F.array_sort(F.collect_list(one)).alias("rules")), "host", "left")


def links(pages: DataFrame, html: str) -> DataFrame:
    """(src, dst, n): links from host to other hosts."""
    address = F.explode(F.regexp_extract_all(F.col(html).cast("string"), F.lit(LINK), 1))
    found = pages.where("host <> ''").select(F.col("host").alias("src"), address.alias("to"))
    found = found.select("src", F.translate(F.regexp_extract("to", r"^//([^/?#]*)", 1), UPPER, LOWERED).alias("dst"))
    return found.where("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank): personalised PageRank from ``seeds`` (kind, host, restart) over ``edges`` (kind, src, dst, n).

    Restarts of a kind sum to 1.  Hosts without links send their rank back to the seeds.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    steps = stage(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "host-links")
    seeds = stage(seeds, "host-seeds")
    restart = seeds.select("kind", "host", (F.lit(1 - damping) * F.col("restart")).alias("rank"))
    rank = seeds.select("kind", "host", F.col("restart").alias("rank"))
    written = None
    for i in range(rounds):
        sent = rank.join(steps.withColumnRenamed("src", "host"), ["kind", "host"])
        sent = sent.groupBy("kind", F.col("dst").alias("host")).agg((F.lit(damping) * F.sum(F.col("rank") * F.col("share"))).alias("rank"))
        arrived = sent.groupBy("kind").agg(F.sum("rank").alias("sum"))  # two rows
        lost = seeds.select("kind").distinct().join(arrived, "kind", "left").select("kind", (F.lit(damping) - F.coalesce("sum", F.lit(0.0))).alias("lost"))
        back = seeds.join(F.broadcast(lost), "kind").select("kind", "host", (F.col("restart") * F.col("lost")).alias("rank"))
        rank = sent.unionByName(restart).unionByName(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if (i + 1) % ROUNDS_A_STAGE == 0:
            rank, before = stage(rank, "host-ranks"), written
            if before is not None:
                discard(before)
            written = rank
    return rank


def judge_urls(pages: DataFrame, rules: Rules, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None) with host, path, rule, verdict, trust and distrust."""
    spark = pages.sparkSession
    keep = carried(pages, keep, ("host", "path", "rule", "verdict", "trust", "distrust", "__html", "__best", "rules"))
    split = pages.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.col(html).alias("__html"))
    hosts = stage(host_rules(split.select("host").distinct(), rules_table(spark, rules)), "host-rules")
    best = F.expr("get(filter(rules, r -> startswith(path, r.path)), 0)")
    ruled = split.drop("__html").join(hosts, "host", "left").withColumn("__best", best).drop("rules")

    counts = ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("__best.verdict") == "allow").alias("allowed"), F.count_if(F.col("__best.verdict") == "block").alias("blocked")
    )
    kinds = {"trust": "allowed", "distrust": "blocked"}
    seeds = None
    for kind, column in kinds.items():
        one = counts.where((F.col(column) > 0) & (F.col(column) >= SEED_SHARE * F.col("n"))).select(F.lit(kind).alias("kind"), "host")
        seeds = one if seeds is None else seeds.unionByName(one)
    seeds = stage(seeds, "host-seed-list")
    sizes = seeds.groupBy("kind").agg(F.count("*").alias("seeds"))  # two rows
    weighted = seeds.join(F.broadcast(sizes), "kind").select("kind", "host", (1 / F.col("seeds")).alias("restart"))
    pairs = stage(links(split.select("host", "__html"), "__html"), "host-pairs")
    edges = pairs.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        pairs.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    rank = propagate(weighted, edges) if not pairs.isEmpty() else weighted.withColumnRenamed("restart", "rank")
    rank = rank.join(F.broadcast(sizes), "kind").select("kind", "host", (F.col("rank") * F.col("seeds")).alias("score"))
    scores = rank.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in kinds])
    scores = stage(scores, "host-scores")
    out = ruled.join(scores, "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in kinds})
    verdict = F.coalesce(F.col("__best.verdict"), F.when((F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow"))
    return out.select(*keep, "host", "path", F.col("__best.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
