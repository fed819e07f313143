"""Ordered merge aggregates: many rows of one id become one, and each field says how.

All are order-explicit (an ``ord`` column or struct), so results don't depend on the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(value: str, ord_: str | Column) -> Column:
    """First writer wins; nulls are no writers."""
    order = F.col(ord_) if isinstance(ord_, str) else ord_
    return F.min_by(value, F.when(F.col(value).isNotNull(), order))


def union_rows(rows: DataFrame, keys: list[str], value: str, ord_: list[str], out: str) -> DataFrame:
    """(keys, out): distinct values of each key in the order of their first occurrence.

    A value's first place is a partial aggregate, so what is collected for a key is its distinct values only.
    """
    once = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*ord_)).alias("at"))
    listed = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("at"), F.col(value).alias("v")))).alias("listed"))
    return listed.select(*keys, F.transform("listed", lambda r: r["v"]).alias(out))


def capped_rows(rows: DataFrame, keys: list[str], value: Column, ord_: list[str], cap: int, out: str) -> DataFrame:
    """(keys, out): the first ``cap`` values of each key; the limit is taken before the shuffle and after it."""
    ranked = rows.select(*keys, value.alias("v"), *ord_).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*ord_)))
    return ranked.where(F.col("rank") <= cap).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "v"))).alias("listed")).select(*keys, F.transform("listed", lambda r: r["v"]).alias(out))


def any_flag(flag: str) -> Column:
    """Absent counts as false."""
    return F.bool_or(F.coalesce(F.col(flag), F.lit(False)))


def every_flag(flag: str) -> Column:
    return F.bool_and(F.coalesce(F.col(flag), F.lit(False)))
