"""URL filter by link-graph propagation over hosts.

Rules decide the urls that they fit. They also seed the host graph: trust starts at
hosts with allowed pages and follows links (personalised PageRank); distrust starts
at hosts with blocked pages and follows links backwards, to the hosts that point
there. A host whose share of distrust reaches the threshold is blocked where no
rule fits.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.cluster import durable, forget, hot_keys, lookup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, ENOUGH = 0.85, 1e-6
#: A host is blocked at this share of distrust in trust and distrust together.
THRESHOLD = 0.75
LINK = r"(?is)href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z in lower case; '' if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? or #; '' if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's, and its verdict; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst and weight (links) between different hosts; links without // stay on their host and make no edge."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("to"))
    # a link may leave out its scheme, and may hold another :// behind its host
    dst = F.translate(F.regexp_extract("to", r"(?s)^[^/]*//([^/?#]*)", 1), UPPER, LOWER)
    return links.select("src", dst.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """host and score: (1 - damping) * seed, plus damping times what flows in along src to dst.

    seeds: host, mass; edges: src, dst, weight. What a host without links out holds
    flows nowhere. Rounds end when no host is newly reached and no score changes by a
    millionth of itself: damping bounds them at about 85 beyond the longest way from a
    seed to a host. ``rounds`` ends them sooner. A round joins on hosts and sums; each
    is kept in the shared folder until the next one is.
    """
    start = durable(seeds.groupBy("host").agg(F.sum("mass").alias("mass")))
    total = start.agg(F.sum("mass")).first()[0] or 0.0
    out = durable(edges.groupBy("src").agg(F.sum("weight").alias("all"), F.count("*").alias("count")))
    # a hub's edges are many rows of one key
    hubs = durable(hot_keys(out, "src"))
    flow = durable(lookup(edges, out.select("src", "all"), "src", hubs, F.xxhash64("dst")).select("src", "dst", (F.col("weight") / F.col("all")).alias("part")))
    base = start.select("host", (F.col("mass") * (1 - damping)).alias("score"))
    if not total or flow.isEmpty():
        return base
    now = base
    for _ in itertools.count() if rounds is None else range(rounds):
        here = lookup(flow, now.select(F.col("host").alias("src"), "score"), "src", hubs, F.xxhash64("dst")).where("score is not null")
        moved = here.select(F.col("dst").alias("host"), (F.col("score") * F.col("part") * damping).alias("score"))
        then = durable(base.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score")))
        # each score against itself: a verdict is a ratio, however far its host is from the seeds
        change = then.alias("b").join(now.alias("a"), "host", "left").agg(F.max(F.try_divide(F.abs(F.col("b.score") - F.coalesce("a.score", F.lit(0.0))), F.col("b.score")))).first()[0]
        forget(now)
        now = then
        if (change or 0.0) < ENOUGH:
            break
    return now


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    Seeds are counted in pages. Where no rule fits, a host with distrust of at least
    ``threshold`` of its trust and distrust together is blocked; others, also hosts
    that neither reaches, are allowed. A url that is null or has no :// has neither
    host nor path, fits no rule and is blocked: nothing can vouch for it. Null or
    empty html has no links. Repeated rows are judged each, and equal shares (a tie)
    alike; an empty table gives no rows and other columns are not read. A very long page
    is searched for links in place. A host with very many pages or links is no hot key:
    such hosts are looked up by broadcast.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parsed = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("rule", rule).withColumn("ruled", ruled)
    seen = durable(judged.groupBy("host", "ruled").count())
    masses = seen.where("host <> '' and ruled is not null").select("host", "ruled", F.col("count").cast("double").alias("mass"))
    edges = durable(host_edges(pages, url_col, html_col))
    trust = propagate(masses.where("ruled = 'allow'"), edges)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(masses.where("ruled = 'block'"), back)
    hosts = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    hosts = durable(hosts.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    large = durable(hot_keys(seen.groupBy("host").agg(F.sum("count").alias("count")), "host"))
    out = lookup(judged, hosts, "host", large, F.xxhash64("page_id")).withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    bad = (F.col("host") == "") | ((F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust"))))
    verdict = F.coalesce("ruled", F.when(bad, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
