"""The property graph: two tables and one view.

nodes(uuid, labels, name, description, properties, polarity, happened_at), edges(uuid, src, dst, name, description,
flow_key, deprecated, amount, properties, valid_at, invalid_at). `adjacency` holds each edge from both of its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normal_label
from .session import table

NODES = "uuid string, labels array<string>, name string, description string, properties map<string,string>, polarity string, happened_at timestamp"
EDGES = "uuid string, src string, dst string, name string, description string, flow_key string, deprecated boolean, amount double, properties map<string,string>, valid_at timestamp, invalid_at string"


def shaped(rows: DataFrame, ddl: str) -> DataFrame:
    """Adds the columns of the schema that rows lack, as nulls, and orders them."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(ddl)
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])


def nodes(rows: DataFrame) -> DataFrame:
    out = shaped(rows, NODES)
    return out.withColumn("labels", F.transform(F.coalesce("labels", F.array().cast("array<string>")), normal_label))


def edges(rows: DataFrame) -> DataFrame:
    return shaped(rows, EDGES).withColumn("deprecated", F.coalesce("deprecated", F.lit(False)))


def currently_valid() -> Column:
    return (F.coalesce("invalid_at", F.lit("")) == "") & ~F.coalesce("deprecated", F.lit(False))


def adjacency(edge_rows: DataFrame, loops_twice: bool = False) -> DataFrame:
    """origin, nbr, edge, name, direction, flow_key, amount, valid: each edge from either end, a self-loop once, or
    twice where both legs of a path may use it."""
    cols = ["name", "flow_key", "amount", currently_valid().alias("valid")]
    out = edge_rows.select(F.col("src").alias("origin"), F.col("dst").alias("nbr"), F.col("uuid").alias("edge"), F.lit("out").alias("direction"), *cols)
    into = edge_rows if loops_twice else edge_rows.filter("src <> dst")
    return out.unionByName(into.select(F.col("dst").alias("origin"), F.col("src").alias("nbr"), F.col("uuid").alias("edge"), F.lit("in").alias("direction"), *cols))


# -- the graph of the given tables: customers buy parts in orders, parts have brands, types and sizes


def tables_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """USER customer, EVENT order, PRODUCT part, BRAND / CATEGORY hubs. A purchase has two legs of one flow key: MADE
    from the user to the order, TARGETED from the order to each part; HAS edges lead from parts to their hubs."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    label = lambda *n: F.array(*[F.lit(x) for x in n])
    people = t("customer").select(key("user", "c_custkey").alias("uuid"), label("USER").alias("labels"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))
    goods = t("part").select(key("part", "p_partkey").alias("uuid"), label("PRODUCT").alias("labels"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    hubs = t("part").select(F.explode(F.array(F.struct(key("hub:brand", "p_brand").alias("uuid"), label("BRAND").alias("labels"), F.col("p_brand").alias("name")), F.struct(key("hub:type", "p_type").alias("uuid"), label("CATEGORY").alias("labels"), F.col("p_type").alias("name")))).alias("h")).select("h.*").distinct()
    orders = t("orders").select(key("order", "o_orderkey").alias("uuid"), label("EVENT").alias("labels"), F.lit("purchase").alias("name"), F.col("o_orderdate").cast("timestamp").alias("happened_at"))
    vertices = nodes(people).unionByName(nodes(goods)).unionByName(nodes(hubs)).unionByName(nodes(orders))
    made = t("orders").select(key("made", "o_orderkey").alias("uuid"), key("user", "o_custkey").alias("src"), key("order", "o_orderkey").alias("dst"), F.lit("MADE").alias("name"), F.col("o_orderkey").cast("string").alias("flow_key"), F.col("o_orderdate").cast("timestamp").alias("valid_at"), F.col("o_totalprice").alias("amount"))
    lines = t("lineitem")
    target = lines.select(F.concat(F.lit("line:"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("uuid"), key("order", "l_orderkey").alias("src"), key("part", "l_partkey").alias("dst"), F.lit("TARGETED").alias("name"), F.col("l_orderkey").cast("string").alias("flow_key"), F.col("l_extendedprice").alias("amount"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate").cast("string")).alias("invalid_at"))
    has = lambda kind, c: t("part").select(F.concat(F.lit(f"has:{kind}:"), F.col("p_partkey")).alias("uuid"), key("part", "p_partkey").alias("src"), key(f"hub:{kind}", c).alias("dst"), F.lit("HAS").alias("name"))
    links = edges(made).unionByName(edges(target)).unionByName(edges(has("brand", "p_brand"))).unionByName(edges(has("type", "p_type")))
    return vertices, links
