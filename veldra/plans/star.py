"""The star schema as a property graph, so that every generic operator also runs over large tables.

Region, Nation, Customer, Supplier, Order and Part nodes; CONTAINS (region - nation - customer, supplier), CALLS (customer -
order), ACCESSES (order - part, one edge per pair with its merged line items) and USES (order - supplier).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions.scalars import edge_id, node_id
from veldra.operators import merge
from veldra.operators.store import GraphStore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(rows: DataFrame, kind: str, key: str, **props: str) -> DataFrame:
    made = F.parse_json(F.to_json(F.struct(*[F.col(c).alias(n) for n, c in props.items()])))
    return rows.select(node_id(F.lit(kind), key).alias("id"), F.lit(kind).alias("type"), F.col(key).cast("string").alias("key"), made.alias("props"))


def _edges(rows: DataFrame, kind: str, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
    a, b = node_id(F.lit(src[0]), src[1]), node_id(F.lit(dst[0]), dst[1])
    return rows.select(edge_id(F.lit(kind), a, b).alias("id"), F.lit(kind).alias("type"), a.alias("src"), b.alias("dst"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return reduce(
        DataFrame.unionByName,
        [
            _nodes(t("region"), "Region", "r_regionkey", name="r_name"),
            _nodes(t("nation"), "Nation", "n_nationkey", name="n_name"),
            _nodes(t("customer"), "Customer", "c_custkey", name="c_name", segment="c_mktsegment", balance="c_acctbal"),
            _nodes(t("supplier"), "Supplier", "s_suppkey", name="s_name", balance="s_acctbal"),
            _nodes(t("orders"), "Order", "o_orderkey", status="o_orderstatus", priority="o_orderpriority"),
            _nodes(t("part"), "Part", "p_partkey", name="p_name", brand="p_brand", size="p_size"),
        ],
    )


def accesses(spark: SparkSession, sf_dir: str, cap: int = 3) -> DataFrame:
    """Merged order - part edges: first line, flags, the first ``cap`` quantities and all suppliers, in line order."""
    lines = table(spark, sf_dir, "lineitem")
    pair, order = ["l_orderkey", "l_partkey"], ["l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    grouped = lines.groupBy(*pair).agg(
        F.min("l_linenumber").alias("first_line"),  # plain values, so that the aggregate is a hash table
        F.min("l_quantity").cast("int").alias("quantity"),
        F.min("l_suppkey").alias("supplier"),
        F.count("*").alias("calls"),
        F.bool_or(F.col("l_returnflag") == "R").alias("returned"),
        F.bool_and(F.col("l_linestatus") == "F").alias("finished"),
    )
    # what one line says alone needs no ordered merge; the lines of the other pairs get one
    several = lines.join(grouped.where("calls > 1").select(*pair), pair, "left_semi")
    ops = merge.capped_rows(several, pair, F.col("l_quantity").cast("int"), order, cap, "ops")
    grouped = grouped.join(ops.join(merge.union_rows(several, pair, "l_suppkey", order, "via"), pair), pair, "left").withColumns(
        {"ops": F.coalesce("ops", F.array("quantity")), "via": F.coalesce("via", F.array("supplier"))}
    )
    a, b = node_id(F.lit("Order"), "l_orderkey"), node_id(F.lit("Part"), "l_partkey")
    return grouped.select(edge_id(F.lit("ACCESSES"), a, b).alias("id"), F.lit("ACCESSES").alias("type"), a.alias("src"), b.alias("dst"), "first_line", "calls", "ops", "via", "returned", "finished")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem")
    return reduce(
        DataFrame.unionByName,
        [
            _edges(t("nation"), "CONTAINS", ("Region", "n_regionkey"), ("Nation", "n_nationkey")),
            _edges(t("customer"), "CONTAINS", ("Nation", "c_nationkey"), ("Customer", "c_custkey")),
            _edges(t("supplier"), "CONTAINS", ("Nation", "s_nationkey"), ("Supplier", "s_suppkey")),
            _edges(t("orders"), "CALLS", ("Customer", "o_custkey"), ("Order", "o_orderkey")),
            _edges(lines.select("l_orderkey", "l_partkey").distinct(), "ACCESSES", ("Order", "l_orderkey"), ("Part", "l_partkey")),
            _edges(lines.select("l_orderkey", "l_suppkey").distinct(), "USES", ("Order", "l_orderkey"), ("Supplier", "l_suppkey")),
        ],
    )


def store(spark: SparkSession, sf_dir: str) -> GraphStore:
    return GraphStore(nodes(spark, sf_dir), edges(spark, sf_dir))
