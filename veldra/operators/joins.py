"""Joins that are no plain equi-joins, written so that each still shuffles on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enclosing(points: DataFrame, ranges: DataFrame, scope: str, width: int = 64) -> DataFrame:
    """points (scope, point_id, at) with the smallest range (scope, range_id, start, end, pos) that holds each, or null.

    Ranges are laid on a hierarchy of grids, each on the one whose cells its length calls for, so a range is copied to
    two cells at most and a point looks once into each grid in use. Ties go to the first by pos.
    """
    size = F.greatest(F.col("end") - F.col("start") + 1, F.lit(1))
    level = F.greatest(F.ceil(F.log2(size.cast("double") / width)), F.lit(0)).cast("int")
    cell = lambda at, lv: F.floor(at / (F.lit(width) * F.pow(F.lit(2), lv)))
    laid = ranges.withColumn("level", level).withColumn("cell", F.explode(F.sequence(cell(F.col("start"), F.col("level")), cell(F.col("end"), F.col("level")))))
    levels = laid.select("level").distinct()  # few: one for each power of two of the lengths
    looks = points.crossJoin(F.broadcast(levels)).withColumn("cell", cell(F.col("at"), F.col("level")))
    held = looks.join(laid, [scope, "level", "cell"]).where("at BETWEEN start AND end")
    best = held.groupBy(scope, "point_id").agg(F.min_by("range_id", F.struct(F.col("end") - F.col("start"), "pos")).alias("range_id"))
    return points.join(best, [scope, "point_id"], "left")


def first_candidate(wanted: DataFrame, candidates: Column, known: DataFrame, key: str) -> DataFrame:
    """wanted with ``found``: the first of the candidate array that is a key of known, or null."""
    rows = wanted.withColumn("_tried", candidates)
    tried = rows.select("_tried").distinct().select("_tried", F.posexplode("_tried").alias("rank", "name"))
    best = tried.join(known.select(F.col(key).alias("name")).distinct(), "name").groupBy("_tried").agg(F.min(F.struct("rank", "name"))["name"].alias("found"))
    return rows.join(best, "_tried", "left").drop("_tried")


def prefix_lookup(rows: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """rows with the values of the first table row (ord, key, value) that is equal to name, or a prefix of it if it ends in ``/``.

    Instead of comparing each row with each key, a row names the keys that would fit it: itself, and each part up to a ``/``.
    """
    own = F.col(name)
    parts = F.filter(F.split(own, "/"), lambda p: F.lit(True))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    keys = F.array_distinct(F.concat(F.array(own), prefixes))
    names = rows.select(name).where(own.isNotNull()).distinct().withColumn("key", F.explode(keys))
    fits = names.join(table, "key").where(F.col("key").endswith("/") | (F.col("key") == own))
    return rows.join(fits.groupBy(name).agg(F.min_by("value", "ord").alias("value")), name, "left")


def segments(path: Column | str) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def matching_paths(uses: DataFrame, routes: DataFrame, scope: str) -> DataFrame:
    """(scope, use_path, route_path): the pairs of distinct paths of a scope for which ``scalars.segments_match`` holds.

    Which segments of two paths are parameters settles which of the others must be equal. So paths are joined on these, once for each
    shape (the places of parameters) that the other side's paths have, and never pair by pair.
    """
    is_param = lambda s: s.startswith(":")
    a = uses.select(scope, "use_path").where("use_path IS NOT NULL").distinct().withColumn("a", segments("use_path"))
    a = a.withColumn("shape", F.transform("a", is_param))
    b = routes.select(scope, "route_path").where("route_path IS NOT NULL").distinct().withColumn("b", segments("route_path"))
    met = b.join(a.select(scope, "shape").distinct(), scope).where(F.size("shape") <= F.size("b")).withColumn("b", F.slice("b", 1, F.size("shape")))
    met = met.withColumn("other", F.transform("b", is_param))
    free = F.zip_with("shape", "other", lambda x, y: x | y)
    key = lambda segs: F.array_join(F.zip_with(segs, free, lambda s, f: F.when(f, F.lit("")).otherwise(s)), "/").alias("key")
    left = a.join(met.select(scope, "shape", "other").distinct(), [scope, "shape"]).select(scope, "shape", "other", key("a"), "use_path")
    right = met.select(scope, "shape", "other", key("b"), "route_path")
    return left.join(right, [scope, "shape", "other", "key"]).select(scope, "use_path", "route_path")


def prefix_segments(uses: DataFrame, routes: DataFrame, scope: str) -> DataFrame:
    """(use_id, route_id, conditional): earlier uses whose path is a segment prefix of a later route of the same scope."""
    pairs = uses.join(matching_paths(uses, routes, scope), [scope, "use_path"])
    later = pairs.join(routes, [scope, "route_path"]).where(F.col("use_order") < F.col("route_order"))
    return later.select("use_id", "route_id", F.coalesce("dynamic", F.lit(False)).alias("conditional"))


def containment_match(rules: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, rule, score): rules (rule, signals, requires) of which a subject (subject, signal) has any signal and all requirements.

    Both tests are counts over exploded sets: the join is on the signal, not on each pair of rule and subject.
    """
    have = subjects.select("subject", "signal").distinct()
    wanted = rules.select("rule", F.explode(F.array_distinct("signals")).alias("signal"))
    score = wanted.join(have, "signal").groupBy("subject", "rule").agg(F.count("*").alias("score"))
    needs = rules.select("rule", F.explode(F.array_distinct("requires")).alias("signal"))
    met = needs.join(have, "signal").groupBy("subject", "rule").agg(F.count("*").alias("met"))
    sizes = rules.select("rule", F.size(F.array_distinct("requires")).alias("needed"))
    both = score.join(sizes, "rule").join(met, ["subject", "rule"], "left")
    return both.where(F.coalesce("met", F.lit(0)) >= F.col("needed")).select("subject", "rule", "score")


def same_set(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(set_key, size, groups): groups with equal sets of members, by the sorted set."""
    sets = rows.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("members"))
    keyed = sets.select(group, F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("set_key"), F.size("members").alias("size"))
    return keyed.groupBy("set_key", "size").agg(F.count("*").alias("groups"), F.min(group).alias("first_group"))


def zipped(rows: DataFrame, left: str, right: str, keep: list[str]) -> DataFrame:
    """Two arrays matched by position: (keep, pos, left, right); the longer one leaves nulls."""
    return rows.select(*keep, F.posexplode(F.arrays_zip(F.col(left).alias("a"), F.col(right).alias("b"))).alias("pos", "z")).select(*keep, "pos", F.col("z.a").alias(left), F.col("z.b").alias(right))


def numbered_repeats(rows: DataFrame, base: str, order: list[str | Column], out: str) -> DataFrame:
    """``base`` made unique: second and later occurrences get ``#2``, ``#3``, ..."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("#", base, n.cast("string"))))


def longest_ancestor(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """files (path) with the value of the nearest of dirs (dir, value) above it; the root is the empty dir."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    best = files.select("path", F.explode(above).alias("dir")).join(dirs, "dir").groupBy("path").agg(F.max_by("value", F.length("dir")).alias("value"))
    return files.join(best, "path", "left")
