"""URL filters as a sort-merge range join over reversed-host keys.

A host is written back to front (``m.example.net`` -> ``net.example.m.``), so that a rule's host and all its
subdomains are one interval of keys; in the same way a rule's path is an interval of paths under that host. Points and
interval ends are range-partitioned, sorted together and swept once: since prefixes nest, the rules that are active at a
point form a stack, which each start and end event replaces. Two sweeps are made, over hosts and then over
(rule host, path), both over *distinct* keys, so a host or url that holds a third of all rows is one row in them.

Defined cases: null urls and urls without ``://`` have an empty host and path and match no rule; an empty page or rule
table gives an empty result or the default verdict; of several verdicts for the same (host, path) ``block`` wins; among
fitting rules the longest host + path wins, then the longest host. Rules with a null or empty host fit nothing.
Repeated rows give repeated results. Only the id and url columns are read; others, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"  # sorts after whatever may follow a prefix
SEP = "\u0001"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def reversed_host(host: Column) -> Column:
    """``m.example.net`` -> ``net.example.m.``: a domain is a prefix of all its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, prefixes: DataFrame, ranges: int) -> DataFrame:
    """For each distinct ``key`` of points: the array of all prefixes of it, shortest first (``stack``).

    Points without any prefix are left out. ranges: how many key ranges the sweep is cut into; a prefix is copied only
    to the ranges that it spans. Bounds are taken from 2,048 keys, the least by hash; they shape tasks, not results.
    """
    points, prefixes = points.select("key").distinct(), prefixes.select("key").distinct()
    some = [r[0] for r in points.orderBy(F.xxhash64("key"), "key").limit(2048).collect()]
    bounds = sorted(sorted(some)[i * len(some) // ranges] for i in range(1, ranges)) if some else []
    edges = F.array(*[F.lit(b) for b in dict.fromkeys(bounds)]) if bounds else F.array().cast("array<string>")
    place = lambda key: F.size(F.filter(edges, lambda b: b <= key))
    stacks = (
        prefixes.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"))
        .select("key", F.expr("substring(key, 1, n)").alias("outer_key"))
        .join(prefixes.select(F.col("key").alias("outer_key")), "outer_key")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct(F.length("outer_key").alias("n"), "outer_key"))).alias("found"))
        .select("key", F.transform("found", lambda x: x["outer_key"]).alias("stack"))
    )
    end = F.concat("key", F.lit(LAST))
    events = stacks.select(
        F.explode(F.sequence(place(F.col("key")), place(end))).alias("part"),
        F.explode(
            F.array(
                F.struct(F.col("key"), F.col("stack")),
                F.struct(end.alias("key"), F.slice("stack", 1, F.size("stack") - 1).alias("stack")),
            )
        ).alias("e"),
    ).select("part", "e.key", F.lit(0).alias("kind"), "e.stack")
    both = events.unionByName(
        points.select(
            place(F.col("key")).alias("part"), "key", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("stack")
        )
    )
    # an end sorts after a start at another key, and before a point at the same one
    running = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("stack", F.last("stack", ignorenulls=True).over(running))
    return swept.where((F.col("kind") == 1) & (F.size("stack") > 0)).select("key", "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int = 0) -> DataFrame:
    """(id, host, path, rule, verdict) of every page; rules: (host, path, verdict)."""
    ranges = ranges or max(8, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = (
        rules.where(F.coalesce(F.col("host"), F.lit("")) != "")
        .groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("rule_key", reversed_host(F.col("rule_host")))
    )
    under = lambda key, path: F.concat(key, F.lit(SEP), path)
    hosts = urls.where("host <> ''").select("host").distinct().withColumn("key", reversed_host(F.col("host")))
    active = hosts.join(sweep(hosts, rules.select(F.col("rule_key").alias("key")), ranges), "key").select("host", F.explode("stack").alias("rule_key"))
    distinct = urls.where("host <> ''").select("host", "path").distinct()
    near = distinct.join(active, "host").withColumn("key", under(F.col("rule_key"), F.col("path")))
    keyed = rules.withColumn("key", under(F.col("rule_key"), F.col("rule_path")))
    hit = sweep(near, keyed, ranges).select("key", F.element_at("stack", -1).alias("rule_at"))
    best = (
        near.join(hit, "key")
        .join(keyed.select(F.col("key").alias("rule_at"), "rule_host", "rule_path", "rule_verdict"), "rule_at")
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    (F.length("rule_host") + F.length("rule_path")).alias("n"),
                    F.length("rule_host").alias("m"),
                    F.concat("rule_host", "rule_path").alias("rule"),
                    F.col("rule_verdict").alias("verdict"),
                )
            ).alias("best")
        )
        .select("host", "path", "best.rule", "best.verdict")
    )
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
