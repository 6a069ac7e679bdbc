"""URL filters: rules of host and path, and trust propagated over the links between hosts.

Hosts whose pages the rules mostly allow are trusted seeds, hosts whose pages they mostly block are
blocked seeds. Trust is personalised PageRank from the trusted seeds along links; distrust is the same
from the blocked seeds against the direction of links (who links to them). A page that no rule fits is
blocked if distrust makes up `block_share` of its host's trust and distrust.

All of it is joins and sums over host pairs; links are aggregated to host pairs within each task first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvox.llm.textbytes import join_hot, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null and without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): what may fit each host, as an array of (length, path, verdict, rule)."""
    named = rules.select(F.col("host").alias("suffix"), F.struct(F.length(F.concat("host", "path")).alias("length"), "path", "verdict", F.concat("host", "path").alias("rule")).alias("r"))
    return hosts.select("host", F.explode(suffixes(F.col("host"))).alias("suffix")).join(named.hint("shuffle_hash"), "suffix").groupBy("host").agg(F.collect_set("r").alias("rules"))


def best_rule(rules: Column, path: Column) -> Column:
    """The longest rule whose path begins path; ties go to the smaller path, then verdict."""
    fits = F.filter(rules, lambda r: F.startswith(path, r["path"]))
    return F.try_element_at(F.array_sort(fits, lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"]).when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))), F.lit(1))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b, n): how many pages of host a link to host b; links within a host are left out."""
    own = host_of(F.col(url))
    target = lambda h: F.when(h.startswith("//"), host_of(F.concat(F.lit("x:"), h))).when(h.rlike("(?i)^https?://"), host_of(h)).otherwise(F.lit(""))
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1)), target))
    rows = pages.where(F.col(html).isNotNull()).select(own.alias("a"), F.explode(F.filter(found, lambda h: (h != "") & (h != own))).alias("b"))
    return rows.where("a <> ''").groupBy("a", "b").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = 1e-4, damping: float = 0.85) -> DataFrame:
    """(host, trust, distrust) of hosts that either reaches.

    edges (a, b, n); seeds (host, trust, distrust): weights that are scaled to sum to 1. Both kinds
    run in one table. Mass of hosts without links on goes back to the seeds. Rounds go on until the
    ranks move by tolerance or less in sum; each round leaves at most the damping's share of the
    distance, so the number of rounds is bounded by the two.
    """
    scale = seeds.agg(F.sum("trust"), F.sum("distrust")).first()
    jump = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("trust") / F.lit(float(scale[0] or 1))).alias("jump")), F.struct(F.lit("distrust").alias("kind"), (F.col("distrust") / F.lit(float(scale[1] or 1))).alias("jump")))).alias("s"))
    jump = table(jump.select("host", "s.kind", "s.jump").where("jump > 0"), "seeds")
    both = edges.select("a", "b", "n", F.lit("trust").alias("kind")).union(edges.select("b", "a", "n", F.lit("distrust")))
    out = both.groupBy("kind", "a").agg(F.sum("n").alias("total"))
    steps = table(both.join(out.hint("shuffle_hash"), ["kind", "a"]).select("kind", F.col("a").alias("host"), "b", (F.col("n") / F.col("total")).alias("w")), "steps")
    # without the mass of hosts that have no links on, ranks are the same but for their scale
    rank = jump.select("kind", "host", F.col("jump").alias("rank"))
    moves = 0.0 if steps.isEmpty() else 1.0
    while moves > tolerance:
        moved = rank.join(steps.hint("merge"), ["kind", "host"]).groupBy("kind", F.col("b").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("w"))).alias("moved"))
        parts = moved.select("kind", "host", F.col("moved").alias("rank"), F.lit(0.0).alias("before")).union(jump.select("kind", "host", (1 - damping) * F.col("jump"), F.lit(0.0))).union(rank.select("kind", "host", F.lit(0.0), "rank"))
        rank = table(parts.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before")), "rank")
        moves = rank.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
        rank = rank.drop("before")
    total = rank.groupBy("kind").agg(F.sum("rank").alias("total"))  # a row for each kind
    rank = rank.join(F.broadcast(total), "kind").withColumn("rank", F.col("rank") / F.col("total"))
    return rank.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html", tolerance: float = 1e-4, seed_share: float = 0.5, block_share: float = 0.6) -> DataFrame:
    """pages without html, with host, path, rule, verdict, trust and distrust.

    rules: (host, path, verdict allow or block); a rule fits its host and all subdomains if the path
    begins with the rule's; the longest wins. Without one the host's trust decides; hosts that neither
    reaches are allowed. Null urls have an empty host and path. Columns of pages by these names are
    replaced, all others stay, whatever their names; repeated pages count as often as they come.
    """
    made = ["host", "path", "rule", "verdict", "trust", "distrust"]
    rest = [c for c in pages.columns if c not in (*made, html)]
    # users' columns go along as one, so that no name clashes
    here = pages.select(F.struct(*([F.col(f"`{c}`") for c in rest] or [F.lit(0)])).alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    paths = table(here.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")), "paths")
    sizes = paths.groupBy("host").agg(F.sum("n").alias("pages"), F.count("*").alias("paths"))
    fits = table(sizes.select("host", "pages", "paths").join(rules_of_hosts(sizes, rules).hint("merge"), "host", "left"), "rules")
    total = fits.agg(F.sum("pages"), F.sum("paths")).first()
    many = lambda c, n: fits.where(F.col(c) >= max(1000, (n or 0) // 1000)).select("host")
    # pages of a host with equal paths are counted once before the join
    ruled = join_hot(paths, fits.select("host", "rules"), ["host"], many("paths", total[1]), total[1] or 0).withColumn("verdict", best_rule(F.col("rules"), F.col("path"))["verdict"])
    counted = ruled.groupBy("host").agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")], F.sum("n").alias("pages"))
    seeds = counted.select("host", F.when(F.col("allow") > seed_share * F.col("pages"), F.col("allow")).otherwise(0).alias("trust"), F.when(F.col("block") > seed_share * F.col("pages"), F.col("block")).otherwise(0).alias("distrust"))
    ranks = propagate(table(links(pages, url, html), "links"), table(seeds.where("trust + distrust > 0"), "seed-hosts"), tolerance)
    state = table(fits.select("host", "rules").join(ranks.hint("merge"), "host", "left"), "hosts")
    hot = many("pages", total[0]).union(pages.sparkSession.createDataFrame([("",)], "host string"))
    out = join_hot(here, state, ["host"], hot, pages.count()).withColumn("found", best_rule(F.col("rules"), F.col("path")))
    mass = F.col("trust") + F.col("distrust")
    blocked = F.coalesce((mass > 0) & (F.col("distrust") >= block_share * mass), F.lit(False))
    verdict = F.coalesce(F.col("found.verdict"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
