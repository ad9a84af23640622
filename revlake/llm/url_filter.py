"""URL filters by link-graph propagation, in DataFrame operations only.

Pages are judged by host and path rules; what no rule fits is judged by its host. Hosts get a personalised PageRank
from the trusted seeds (hosts with allowed pages) along links, and a distrust rank from the blocked seeds against
the direction of links: a host that links to blocked hosts is suspect. A host is blocked if its distrust is over the
threshold's part of its distrust, its trust and the share of its pages that no rule fits, all in shares of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where html names a host: an attribute with an absolute address, or an address in the text; group 1 is its host part.
LINK = r"""(?i)(?:(?:href|src|action|cite|data)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?|\bhttps?:)//([^/?#"'\s<>]+)"""


def host(url: str | Column = "url") -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: str | Column = "url") -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rule_host, rule_path, verdict) rows of a short list of rules; long lists can be read from a table instead."""
    one = lambda r: F.struct(F.lit(r[0]).alias("rule_host"), F.lit(r[1]).alias("rule_path"), F.lit(r[2]).alias("verdict"))
    return spark.range(1).select(F.inline(F.array(*[one(r) for r in rules])))


def fits(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages: (host, path), distinct. The rule of each that any fits, as (host, path, rule, verdict).

    A host's parent domains times the lengths that rule paths have are its keys of one equi join, so neither a host's
    pages nor its rules are gathered. Of several rules the longest (host and path together) holds, then the one of the
    longer host, then block before allow.
    """
    sizes = sorted({r[0] for r in rules.select(F.length("rule_path")).distinct().collect()})  # as many as rule paths have lengths
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keyed = pages.filter("host <> ''").select("host", "path", F.explode(suffixes).alias("rule_host"), starts.alias("starts")).withColumn("rule_path", F.explode("starts")).drop("starts")
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict") == "block")
    best = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), order)
    return keyed.join(rules, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, settled: float = 1e-6) -> DataFrame:
    """Personalised PageRank of several kinds at once.

    edges: (kind, src, dst, share), the shares of a src adding up to 1; seeds: (kind, host, seed), adding up to 1 per
    kind. Gives (kind, host, rank). A round is one equi join and one sum; it is written out, so lineage stays short.
    Rounds go on until no rank moves by more than settled: what moves shrinks by the damping in every round, so that is
    about log(settled) / log(damping) rounds however long the paths are.
    """
    now = cut(seeds.select("kind", "host", F.col("seed").alias("rank")))
    base = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank"))
    moved = settled + 1
    while moved > settled:
        sent = now.join(edges, (now["kind"] == edges["kind"]) & (now["host"] == edges["src"])).select(now["kind"], F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        after = cut(base.unionByName(sent).groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
        moved = after.unionByName(now.select("kind", "host", (-F.col("rank")).alias("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("d")).agg(F.max(F.abs("d"))).first()[0] or 0.0
        now = after
    return now


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.5, damping: float = 0.85) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) of every page.

    rule is host/path of the longest rule that fits (host or parent domain, path prefix; see fits), else null; verdict is the
    rule's, else block where D / (D + T + U) of the host is over the threshold, else allow: U is the share of the host's
    pages that no rule fits, D and T are its ranks on the same scale (a host without links has its blocked and allowed
    share), so one blocked page of many blocks no other. trust and distrust are shares of all rank. Null urls,
    and those without ://, have an empty host and path, no rule, and are allowed. Null html has no links. Repeated
    rows are judged alike and count as pages of their host; an empty table gives no rows. Other columns are not read; a
    key called like one of the operator's own columns keeps its name, and the operator's gets an underscore at its end.
    """
    read = pages.select(F.col(key).alias("key"), host(url).alias("host"), path(url).alias("path"), F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), 1)).alias("links"))
    read = cut(read)
    hosts = read.groupBy("host").agg(F.count("*").alias("pages"))
    fit = fits(read.select("host", "path").distinct(), rules).select(F.col("host").alias("f_host"), F.col("path").alias("f_path"), "rule", F.col("verdict").alias("ruled"))
    ruled = cut(read.select("key", "host", "path").join(fit, (F.col("host") == F.col("f_host")) & (F.col("path") == F.col("f_path")), "left").select("key", "host", "path", "rule", "ruled"))

    shares = ruled.filter("ruled is not null").groupBy("host", "ruled").count().join(hosts.select("host", "pages"), "host")
    own = cut(shares.select(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host", (F.col("count") / F.col("pages")).alias("w")))
    total = {r["kind"]: r["all"] for r in own.groupBy("kind").agg(F.sum("w").alias("all")).collect()}  # two rows at most
    all_trust, all_distrust = total.get("trust", 1.0), total.get("distrust", 1.0)
    seeds = own.select("kind", "host", (F.col("w") / F.when(F.col("kind") == "trust", all_trust).otherwise(all_distrust)).alias("seed"))

    bare = F.translate(F.regexp_replace("link", r"^[^@]*@", ""), UPPER, LOWER)  # without a user part
    arcs = read.filter("host <> ''").select("host", F.explode("links").alias("link")).select(F.col("host").alias("src"), bare.alias("dst"))
    arcs = arcs.filter("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    both = arcs.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(arcs.select(F.lit("distrust"), "dst", "src", "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = cut(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")))

    # a host's part of all rank falls with the number of hosts, so ranks settle by the share of a host's pages
    ranked = ranks(edges, seeds, damping, 1e-6 / max([1.0, *total.values()]))
    known = own.select(F.lit("known").alias("kind"), "host", F.col("w").alias("rank"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    scored = ranked.unionByName(known).groupBy("host").agg(of("trust"), of("distrust"), of("known"))
    # both sides times 1 - damping, the part of its seed that a host keeps; the margin makes equal sides equal
    suspect, good, unruled = F.col("distrust") * all_distrust, F.col("trust") * all_trust, (1 - damping) * (1 - F.col("known"))
    bad = F.coalesce(suspect > threshold * (suspect + good + unruled) + 1e-9, F.lit(False))
    name = lambda c: free_name(c, [key])
    return ruled.join(scored, "host", "left").select(
        F.col("key").alias(key),
        F.col("host").alias(name("host")),
        F.col("path").alias(name("path")),
        F.col("rule").alias(name("rule")),
        F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias(name("verdict")),
        F.coalesce("trust", F.lit(0.0)).alias(name("trust")),
        F.coalesce("distrust", F.lit(0.0)).alias(name("distrust")),
    )
