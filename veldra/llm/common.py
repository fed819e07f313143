"""What several operators need: reading a table, cutting lineage, stable hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.sources.landing import stored  # noqa: F401  (operators take it from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


MARK_BITS = 26


def marked(rows: DataFrame, id_col: str, ids: DataFrame, out: str) -> DataFrame:
    """rows with ``out``: false only if the row's id isn't among ids (one column); true for these and for a few others.

    A bitmap of 2 ** MARK_BITS bits over hashes of the ids is broadcast, in words: 2 ** 20 rows of two longs at most,
    however many ids there are. So a join with few of many wide rows needs to move only those that are marked.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << MARK_BITS))
    word, bits = unused(rows, "word"), unused(rows, "bits")
    at = ids.select(place(F.col(ids.columns[0])).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias(bits))
    found = rows.withColumn(word, F.shiftright(place(F.col(id_col)), 6)).join(F.broadcast(words), word, "left")
    seen = F.getbit(bits, place(F.col(id_col)).bitwiseAND(F.lit(63)).cast("int")) == 1
    return found.select(*rows.columns, F.coalesce(seen, F.lit(False)).alias(out))


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose id, the column that ids has, isn't among ids; rows with a null id stay. Only marked rows are joined."""
    id_col, mark = ids.columns[0], unused(rows, "mark")
    split = marked(rows, id_col, ids, mark)
    kept = split.where(~F.col(mark)).drop(mark)
    return kept.unionAll(split.where(mark).drop(mark).join(ids, id_col, "left_anti").select(rows.columns))
