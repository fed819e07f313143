"""Versions of file trees: content folded upwards by folder, and what differs between two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.sources.files import ancestors


def folded(files: DataFrame) -> DataFrame:
    """(dir, content, files): two sums over the names and hashes of all files below each folder, the root ('') included.

    files: (path, hash). The sums don't depend on an order, so they are partial aggregates, however large a folder is; the
    root's content names a whole version.
    """
    each = files.select("path", "hash", F.explode(ancestors("path")).alias("dir"))
    name = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    mark = lambda salt: F.bit_xor(F.xxhash64(name, F.coalesce("hash", F.lit("")), F.lit(salt)))
    return each.groupBy("dir").agg(F.concat_ws("-", F.hex(mark(1)), F.hex(mark(2)), F.count("*").cast("string")).alias("content"), F.count("*").alias("files"))


def equal_subtrees(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dir): the topmost folders with the same content in both versions."""
    same = folded(old).join(folded(new).select("dir", "content"), ["dir", "content"]).select("dir")
    inner = same.where("dir <> ''").select("dir", F.explode(F.concat(ancestors("dir"))).alias("above"))
    return same.join(inner.join(same.select(F.col("dir").alias("above")), "above", "left_semi").select("dir").distinct(), "dir", "left_anti")


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind, came_from): added, deleted and changed files; an added file with the content of a deleted one came from there.

    Equal subtrees are left out as a whole before files are compared. Of several equal contents the first by path are paired first.
    """
    same = equal_subtrees(old, new)

    def rest(files: DataFrame, out: str) -> DataFrame:
        held = files.select("path", F.explode(ancestors("path")).alias("dir")).join(same, "dir", "left_semi").select("path").distinct()
        return files.join(held, "path", "left_anti").select("path", F.coalesce("hash", F.lit("")).alias(out))

    both = rest(old, "old").join(rest(new, "new"), "path", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("changed")
    made = both.withColumn("kind", kind)

    def numbered(kind_: str, hash_: str, name: str) -> DataFrame:
        nth: Column = F.row_number().over(Window.partitionBy(hash_).orderBy("path"))
        return made.where(F.col("kind") == kind_).select(F.col(hash_).alias("hash"), nth.alias("nth"), F.col("path").alias(name))

    pairs = numbered("added", "new", "path").join(numbered("deleted", "old", "came_from"), ["hash", "nth"]).select("path", "came_from")
    return made.select("path", "kind").join(pairs, "path", "left")
