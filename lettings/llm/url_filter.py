"""URL rules, and trust and distrust carried along links between hosts, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Cut

#: Verdict and place (host, then path) of each rule.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ABSOLUTE_LINK = r"""(?i)<[a-z][^<>]*?\s(?:href|src|action)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'>\s]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, of a url; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as a struct of length, rule and verdict; null if none does."""
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        fit = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p))
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def host_links(pages: DataFrame, text: str = "html") -> DataFrame:
    """``src``, ``dst`` and ``n``: the links between two different hosts."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(text, F.lit(ABSOLUTE_LINK), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", F.translate(F.regexp_replace("dst", r"^.*@", ""), UPPER, LOWER)).where("dst <> src and dst <> ''")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank: ``host`` and ``score``, from seeds (host, weight) along edges (src, dst, n).

    What a host without links holds stays lost, as usual with seeds of one kind. Rounds go on until
    the ranks change by less than the tolerance in sum and no host is new, unless ``rounds`` are
    given. Each round's change is at most ``damping`` of the one before, so about 90 rounds reach
    1e-6; hosts that are farther from all seeds are reached one link a round. Ranks are written each
    round, so no lineage grows and a lost executor costs one round; the round before is deleted.
    """
    total = seeds.agg(F.sum("weight").alias("_all"))
    start = Cut(seeds.crossJoin(F.broadcast(total)).select("host", (F.col("weight") / F.col("_all")).alias("score")), "rank").df
    out = Window.partitionBy("src")
    flow = Cut(edges.select("src", "dst", (F.col("n") / F.sum("n").over(out)).alias("share")), "flow").df
    ranks = start
    if flow.isEmpty():
        return ranks.withColumn("score", F.col("score") * (1 - damping))
    last, done = None, 0
    while rounds is None or done < rounds:
        moved = ranks.join(flow, ranks["host"] == flow["src"]).select(flow["dst"].alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        both = start.select("host", (F.col("score") * (1 - damping)).alias("score")).unionByName(moved)
        cut = Cut(both.groupBy("host").agg(F.sum("score").alias("score")), "rank")
        new = cut.df
        old = ranks.withColumnRenamed("score", "before").withColumnRenamed("host", "old")
        moves = new.join(old, new["host"] == old["old"], "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))), F.count_if(F.col("old").isNull())).first()
        if last:
            last.drop()
        ranks, last, done = new, cut, done + 1
        if moves[0] is None or moves[0] < tolerance and not moves[1]:
            break
    return ranks


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 1.0, seed_share: float = 0.5) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of each page (page_id, url, html).

    The longest rule that fits gives the verdict. Other pages get their host's: a host is a trusted
    seed, or a blocked one, if rules allow, or block, more than ``seed_share`` of its pages, with
    the number of those pages as weight. Trust goes along links and distrust against them (who
    links to a bad host is doubted) by personalised PageRank; a host is blocked if its distrust is
    above ``threshold`` times its trust. Hosts that neither reaches are allowed.

    A null url, or one without ``://``, has an empty host and path and is allowed by default. A null
    html has no links. Repeated rows are judged alike, one result each; ties of equally long rules
    go to the greater rule as text. An empty table gives an empty result; other columns are ignored.
    """
    host, path = host_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule = ruled(F.col("host"), F.col("path"), rules)
    paged = read.select("page_id", "host", "path", rule.alias("_rule"))
    seen = paged.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("_rule.verdict") == "allow").alias("good"), F.count_if(F.col("_rule.verdict") == "block").alias("bad"))
    seen = Cut(seen, "hosts").df
    edges = Cut(host_links(read), "links").df
    trust = rank(edges, seen.where(F.col("good") > F.col("pages") * seed_share).select("host", F.col("good").alias("weight")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = rank(back, seen.where(F.col("bad") > F.col("pages") * seed_share).select("host", F.col("bad").alias("weight")))
    scores = trust.select("host", F.col("score").alias("good"), F.lit(0.0).alias("bad")).unionByName(distrust.select("host", F.lit(0.0).alias("good"), F.col("score").alias("bad")))
    doubted = scores.groupBy("host").agg(F.sum("good").alias("trust"), F.sum("bad").alias("distrust")).where(F.col("distrust") > threshold * F.col("trust"))
    doubted = doubted.select(F.col("host").alias("_host"), F.lit("block").alias("_doubt"))
    # Ruled pages need no join; the others' hosts are joined as they are, AQE splitting a large one.
    rest = paged.where("_rule is null").join(doubted, F.col("host") == F.col("_host"), "left")
    rest = rest.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("_doubt", F.lit("allow")).alias("verdict"))
    return paged.where("_rule is not null").select("page_id", "host", "path", "_rule.rule", "_rule.verdict").unionByName(rest)
