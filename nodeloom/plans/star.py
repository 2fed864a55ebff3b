"""The star schema read as an entity graph: tables are node types, foreign keys are relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators.graph import Graph
from nodeloom.sources.catalog import MISSING, Catalog, Field, Link, NodeType, Property

#: Child type, its key, its foreign key, parent type.
LINKS = (("nation", "n_nationkey", "n_regionkey", "region"), ("customer", "c_custkey", "c_nationkey", "nation"), ("supplier", "s_suppkey", "s_nationkey", "nation"), ("orders", "o_orderkey", "o_custkey", "customer"))
KEYS = {"region": "r_regionkey"} | {child: key for child, key, _, _ in LINKS}
TYPE_LINKS = {(parent, child) for child, _, _, parent in LINKS}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _field(name: str, *kinds, default=MISSING) -> Field:
    return Field(name, ("null", *kinds), default)


def catalog() -> Catalog:
    enum = lambda name, symbols: {"type": "enum", "name": name, "symbols": symbols}
    term = lambda name: Property(name, f"term of {name}", {"source": "star"})
    return Catalog(
        (
            NodeType("region", (_field("r_name", "string"),)),
            NodeType("nation", (_field("n_name", "string"), _field("submitter_id", "string")), (Link("regions", "region"),), properties=(term("n_name"),)),
            NodeType("customer", (_field("c_name", "string"), _field("c_acctbal", "double"), _field("c_mktsegment", "string")), (Link("nations", "nation"),), properties=(term("c_name"), term("c_mktsegment"))),
            NodeType("supplier", (_field("s_name", "string"), _field("s_acctbal", "double")), (Link("nations", "nation"),)),
            NodeType("orders", (_field("o_orderstatus", "string"), _field("o_totalprice", "double"), Field("o_orderpriority", (enum("orders_o_orderpriority", PRIORITIES), "null"), "5-LOW")), (Link("customers", "customer"),)),
        )
    )


def node_id(name: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{name}_"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight from the key columns; only those are read."""
    parts = []
    for child, key, foreign, parent in LINKS:
        rows = table(spark, sf_dir, child).filter(F.col(foreign).isNotNull())
        parts.append(rows.select(node_id(child, key).alias("src_id"), F.lit(child).alias("src_name"), node_id(parent, foreign).alias("dst_id"), F.lit(parent).alias("dst_name"), F.lit(0).alias("place")))
    return reduce(DataFrame.unionByName, parts)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name."""
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, n).select(node_id(n, k).alias("id"), F.lit(n).alias("name")) for n, k in KEYS.items()])


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """All as entities with typed payloads."""
    foreign, tables, about = {child: (fk, parent) for child, _, fk, parent in LINKS}, {}, catalog()
    for n, key in KEYS.items():
        rows = table(spark, sf_dir, n)
        if n == "nation":  # some nations have a submitter id
            rows = rows.withColumn("submitter_id", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
        columns = [node_id(n, key).alias("_id"), *[F.col(f.name).cast(f.dataType) for f in about[n].spark]]
        if n in foreign:
            columns.append(node_id(foreign[n][1], foreign[n][0]).alias("_parent"))
        tables[n] = rows.select(*columns)
    return Graph.of_tables(tables, about, {n: {"_parent": parent} for n, (_, parent) in foreign.items()}, dict.fromkeys(tables, "_id"))
