"""Property graphs projected from relational tables, one label or type a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import deal, many

PROJECT = "tpch"

#: Ids of a label begin here, far above any key.
OFFSETS = {label: (i + 1) * 10**15 for i, label in enumerate(("Region", "Nation", "Customer", "Supplier", "Part", "Order", "Turn"))}

#: Turns of a conversation have consecutive ids from conversation times this on.
TURNS = 10**6


#: Labels at the ends of each type.
ENDS = {
    "PLACED": (frozenset({"Customer"}), frozenset({"Order"})),
    "CONTAINS": (frozenset({"Order"}), frozenset({"Part"})),
    "SUPPLIED_BY": (frozenset({"Part"}), frozenset({"Supplier"})),
    "LOCATED_IN": (frozenset({"Customer", "Supplier"}), frozenset({"Nation"})),
    "PART_OF": (frozenset({"Nation"}), frozenset({"Region"})),
    "NEXT": (frozenset({"Turn"}), frozenset({"Turn"})),
}


#: Ways that a key of one table to another has one target for.
SINGLE = {"PLACED": "in", "LOCATED_IN": "out", "PART_OF": "out"}


def _label(df: DataFrame, label: str, key: Column, name: Column, props: dict[str, str]) -> DataFrame:
    """props: graph property by column."""
    own = [F.col(c).alias(p) for c, p in props.items()]
    return df.select(
        (key.cast("bigint") + OFFSETS[label]).alias("id"),
        F.lit(PROJECT).alias("project"),
        F.lit(label).alias("label"),
        name.alias("name"),
        F.concat(F.lit(f"tpch.{label.lower()}."), key.cast("string")).alias("qualified_name"),
        F.concat(F.lit(f"{label.lower()}/"), key.cast("string")).alias("file_path"),
        F.lit(0).alias("start_line"),
        F.lit(0).alias("end_line"),
        F.to_json(F.struct(*own)).alias("properties"),
        *own,
    )


def _edges(df: DataFrame, kind: str, src: Column, dst: Column) -> DataFrame:
    return df.select(F.xxhash64(src, dst, F.lit(kind)).alias("id"), F.lit(PROJECT).alias("project"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit("{}").alias("properties"))


def _key(label: str, column: str) -> Column:
    return F.col(column).cast("bigint") + OFFSETS[label]


def tpch_graph(spark: SparkSession, sf_dir: str, turns: bool = False) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders with PLACED, CONTAINS,
    SUPPLIED_BY, LOCATED_IN and PART_OF; with turns also conversations and NEXT."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation, customer, supplier, part, orders, lineitem = map(t, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    c = F.col
    labels = {
        "Region": _label(region, "Region", c("r_regionkey"), c("r_name"), {"r_regionkey": "key"}),
        "Nation": _label(nation, "Nation", c("n_nationkey"), c("n_name"), {"n_nationkey": "key"}),
        "Customer": _label(customer, "Customer", c("c_custkey"), c("c_name"), {"c_custkey": "key", "c_acctbal": "acctbal", "c_mktsegment": "segment"}),
        "Supplier": _label(supplier, "Supplier", c("s_suppkey"), c("s_name"), {"s_suppkey": "key", "s_acctbal": "acctbal"}),
        "Part": _label(part, "Part", c("p_partkey"), c("p_name"), {"p_partkey": "key", "p_brand": "brand", "p_type": "kind", "p_size": "size", "p_retailprice": "price"}),
        "Order": _label(orders, "Order", c("o_orderkey"), F.concat(F.lit("Order#"), c("o_orderkey").cast("string")), {"o_orderkey": "key", "o_orderstatus": "status", "o_totalprice": "total", "o_orderpriority": "priority"}),
    }
    n = many(lineitem)
    contains = deal(lineitem.select("l_orderkey", "l_partkey"), n, "l_orderkey").distinct()
    supplied = deal(lineitem.select("l_partkey", "l_suppkey"), n, "l_partkey").distinct()
    located = _edges(customer, "LOCATED_IN", _key("Customer", "c_custkey"), _key("Nation", "c_nationkey")).union(_edges(supplier, "LOCATED_IN", _key("Supplier", "s_suppkey"), _key("Nation", "s_nationkey")))
    types = {
        "PLACED": _edges(orders, "PLACED", _key("Customer", "o_custkey"), _key("Order", "o_orderkey")),
        "CONTAINS": _edges(contains, "CONTAINS", _key("Order", "l_orderkey"), _key("Part", "l_partkey")),
        "SUPPLIED_BY": _edges(supplied, "SUPPLIED_BY", _key("Part", "l_partkey"), _key("Supplier", "l_suppkey")),
        "LOCATED_IN": located,
        "PART_OF": _edges(nation, "PART_OF", _key("Nation", "n_nationkey"), _key("Region", "n_regionkey")),
    }
    if turns:
        talk = t("conversations").select("conv_id", "turn", "role")
        at = F.col("conv_id") * TURNS + F.col("turn")
        labels["Turn"] = _label(talk.withColumn("k", at), "Turn", c("k"), F.concat_ws("#", c("conv_id").cast("string"), c("turn").cast("string")), {"k": "key", "role": "role"})
        after = talk.select(F.col("conv_id").alias("next_conv"), F.col("turn").alias("next_turn"))
        pairs = talk.join(after, (F.col("conv_id") == F.col("next_conv")) & (F.col("turn") + 1 == F.col("next_turn"))).select(at.alias("k"))
        types["NEXT"] = _edges(pairs, "NEXT", _key("Turn", "k"), _key("Turn", "k") + 1)
    return Graph(by_label=labels, by_type=types, ends=ENDS, single=SINGLE)
