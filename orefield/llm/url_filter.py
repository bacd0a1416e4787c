r"""Url filter: rules first, then trust and distrust that spread over the links between hosts.

Where no rule fits, a page has the verdict of its host. Personalised PageRank spreads trust from the hosts of pages
that rules allow along links, and distrust from the hosts of pages that rules block against them: who links to a
blocked host is distrusted. A host is allowed if its trust is at least its distrust. Only built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .urls import host_of, path_of

DAMPING, TOLERANCE = 0.85, 1e-6
HREF = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """rules: host, path, whether it allows."""
    rows = [F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(a).alias("allows")) for h, p, a in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and the array of rules whose host is the host or a parent domain of it."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return (
        hosts.select("host", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host")
        .groupBy("host")
        .agg(F.collect_list(F.struct("rule_path", F.concat("rule_host", "rule_path").alias("rule"), "allows")).alias("rules"))
    )


def best_rule() -> Column:
    """The longest rule that fits the path: struct n, rule, allows; null if none fits."""
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["allows"].alias("allows"))))


def spread(edges: DataFrame, seeds: DataFrame, scratch: Scratch, *, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of (kind, host, score), where edges (kind, a, b, share) pass on from a to b and seeds are kind, host, seed.

    Each round is one join and one aggregate, written to cut the lineage; it ends when no host's score moves by more than
    that share of itself, whatever the number of seeds (a host that is reached for the first time moves by all of it), or
    after so many rounds where these are given.
    """
    base = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    now = scratch.written(base, "rank")
    if not edges.limit(1).count():
        return now
    for _ in count() if rounds is None else range(rounds):
        passed = edges.join(now, (edges["kind"] == now["kind"]) & (edges["a"] == now["host"])).select(
            edges["kind"], F.col("b").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")
        )
        new = scratch.written(passed.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score")), "rank")
        old = now.select("kind", "host", F.col("score").alias("was"))
        moved = new.join(old, ["kind", "host"], "left").filter("score > 0").agg(F.max(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))) / F.col("score"))).first()[0] or 0.0
        scratch.drop(now)
        now = new
        if moved <= tolerance:
            break
    return now


def host_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, n: absolute links between different hosts."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))))
    links = pages.select(host_of(F.col(url)).alias("src"), found.alias("link"))
    full = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return links.select("src", host_of(full).alias("dst")).filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, bool]], *, url: str = "url", html: str = "html", key: str = "page_id", rounds: int | None = None) -> DataFrame:
    """One row per page: key, host, path, rule (null if none fits), verdict (allow or block), trust, distrust.

    A null url, or one without ://, has an empty host and path and so no rule; a host without trust or distrust is
    allowed. A rule without a fitting path doesn't count. Of equally long rules the larger string wins. Repeated
    rows stay; an empty table gives none.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = scratch.written(parts, "urls")
    hosts = parts.select("host").distinct()
    ruled = scratch.written(rules_of_hosts(hosts, rule_table(spark, rules)), "rules")
    judged = parts.join(ruled, "host", "left").withColumn("best", best_rule())
    counts = judged.filter("best is not null").groupBy("host").agg(F.count_if("best.allows").alias("trust"), F.count_if(~F.col("best.allows")).alias("distrust"))
    seeds = scratch.written(counts.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, seed)")).filter("seed > 0"), "seeds")
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("total"))
    seeds = seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("seed") / F.col("total")).alias("seed"))  # two rows
    links = scratch.written(host_links(pages, url=url, html=html), "links")
    ways = links.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    )
    out_n = ways.groupBy(F.col("kind").alias("k"), F.col("a").alias("from")).agg(F.sum("n").alias("out"))
    edges = scratch.written(ways.join(out_n, (F.col("kind") == F.col("k")) & (F.col("a") == F.col("from"))).select("kind", "a", "b", (F.col("n") / F.col("out")).alias("share")), "edges")
    ranks = spread(edges, seeds, scratch, rounds=rounds)
    by_host = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust")
    )
    zero = F.lit(0.0)
    known = scratch.written(ruled.join(by_host, "host", "full_outer"), "hosts")
    verdict = F.when(F.col("best").isNotNull(), F.col("best.allows")).otherwise(F.coalesce("trust", zero) >= F.coalesce("distrust", zero))
    return parts.join(known, "host", "left").withColumn("best", best_rule()).select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.when(verdict, "allow").otherwise("block").alias("verdict"),
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"),
    )
