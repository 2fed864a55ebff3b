"""Exports: text tables of each node type, and CSV for graph bulk loaders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.operators.graph import Graph
from nodeloom.operators.storage import shared_dir
from nodeloom.sources.catalog import Catalog

#: Plural link names that stand for node types in relations read from text tables.
PLURALS = {"subjects": "subject", "timings": "timing", "persons": "person", "programs": "program", "projects": "project"}


def as_text(value: Column, kind: T.DataType) -> Column:
    """Python's way of writing values: True and False, 1e+16 and 0.0001; null is empty."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(kind, T.DoubleType):
        # Spark writes 1.0E16 and 1.0E-4; exponents from -4 to 15 are written out.
        raw = value.cast("string")
        sign = F.when(value < 0, "-").otherwise("")
        power = F.regexp_extract(raw, r"E(-?\d+)$", 1).try_cast("int")
        digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, r"^-?([\d.]+)E", 1), r"\.0$", ""), r"\.", "")
        small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        whole = F.concat(sign, F.rpad(digits, power + 1, "0"), F.lit(".0"))
        mixed = F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))
        middle = F.when(F.length(digits) > power + 1, mixed).otherwise(whole)
        size = F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0")
        far = F.concat(F.regexp_replace(F.regexp_extract(raw, r"^(-?[\d.]+)E", 1), r"\.0$", ""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), size)
        out = F.when(power.isNull(), raw).when((power < 0) & (power >= -4), small).when((power >= 0) & (power < 16), middle).otherwise(far)
        return F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(out)
    if isinstance(kind, T.ArrayType):
        return F.to_json(value)
    return value.cast("string")


def plural_parents(name: Column, catalog: Catalog | None = None) -> Column:
    """Link names as node types: the fixed plurals and all of the catalog's links."""
    known = {x.name: x.dst for n in (catalog.nodes if catalog else ()) for x in n.links} | PLURALS
    pairs = [F.lit(v) for kv in known.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def parent_links(edges: DataFrame, node: str, links: dict[str, str]) -> DataFrame:
    """src_id and for each link <link>.id: of several relations to one type the last; links: link name by node type, the first link to each."""
    named = edges.filter(F.col("src_name") == node)
    last = lambda dst: F.max_by(F.when(F.col("dst_name") == dst, F.col("dst_id")), F.when(F.col("dst_name") == dst, F.col("place")))
    return named.groupBy("src_id").agg(*[last(dst).alias(f"{link}.id") for dst, link in links.items()]) if links else named.select("src_id").distinct()


def first_links(catalog: Catalog, node: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for x in catalog[node].links:
        out.setdefault(x.dst, x.name)
    return out


def tsv_table(graph: Graph, node: str) -> DataFrame:
    """type, the fields, <link>.id and <link>.submitter_id of the first link to each type, id: all as text.

    Parents' submitter ids come from a join over the whole graph, so no order of records matters; unknown ones read ``null``.
    """
    links, kinds = first_links(graph.catalog, node), graph.catalog[node].spark
    rows = graph.node(node)
    edges = graph.edges.withColumn("dst_name", plural_parents(F.col("dst_name"), graph.catalog))
    wide = parent_links(edges, node, links)
    out = rows.join(wide, rows["id"] == wide["src_id"], "left").drop("src_id")
    for dst, link in links.items():
        parents = graph.entities.filter(F.col("name") == dst).groupBy(F.col("id").alias("_parent")).agg(F.max(F.try_variant_get("object", "$.submitter_id", "string")).alias(f"{link}.submitter_id"))
        out = out.join(parents, out[f"`{link}.id`"] == parents["_parent"], "left").drop("_parent")
    columns = [F.lit(node).alias("type"), *[as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in kinds if f.name not in ("id", "relations", "type")]]
    for link in links.values():
        columns += [F.col(f"`{link}.id`").alias(f"{link}.id"), F.when(F.col(f"`{link}.id`").isNotNull(), F.coalesce(F.col(f"`{link}.submitter_id`"), F.lit("null"))).alias(f"{link}.submitter_id")]
    return out.select(*columns, "id")


def vertex_id(name: Column, id_: Column) -> Column:
    """The same id in every run: a digest of type and id."""
    return F.sha2(F.concat_ws(":", name, id_), 256)


def gremlin_header(catalog: Catalog, node: str) -> list[str]:
    return ["~label", "~id", *[f"{f.name}:{f.bulk}" for f in catalog[node].fields]]


def gremlin_vertices(graph: Graph, node: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in graph.catalog[node].spark}
    named = [as_text(F.col(f"`{f.name}`"), kinds[f.name]).alias(f"{f.name}:{f.bulk}") for f in graph.catalog[node].fields]
    return graph.node(node).select(F.lit(node).alias("~label"), vertex_id(F.lit(node), F.col("id")).alias("~id"), *named)


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose parent (id, name) is no node."""
    parents = nodes.select(F.col("id").alias("dst_id"), F.col("name").alias("dst_name"))
    return edges.join(parents, ["dst_id", "dst_name"], "left_anti")


def gremlin_edges(edges: DataFrame, nodes: DataFrame, strict: bool = False) -> DataFrame:
    """~id, ~from (child), ~to (parent), ~label. Dangling ones are left out (see dangling_edges), or an error if strict."""
    if strict and not (bad := dangling_edges(edges, nodes)).isEmpty():
        raise ValueError(f"an edge leads nowhere: {bad.first()}")
    known = nodes.select(F.col("id").alias("dst_id"), F.col("name").alias("dst_name"))
    rows = edges.join(known, ["dst_id", "dst_name"], "left_semi")
    source, target = vertex_id(F.col("src_name"), F.col("src_id")), vertex_id(F.col("dst_name"), F.col("dst_id"))
    return rows.select(F.sha2(F.concat(source, target, F.col("place").cast("string")), 256).alias("~id"), source.alias("~from"), target.alias("~to"), F.col("dst_name").alias("~label"))


def _write_one(df: DataFrame, target: str, sep: str = ",", gzip: bool = False) -> None:
    """One named file: written in parts by Spark, then moved within the file system."""
    spark = df.sparkSession
    part = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    out = df.select([F.col(f"`{c}`").alias(c) for c in df.columns]).coalesce(1)
    out.write.csv(part, sep=sep, header=True, emptyValue="", nullValue="", quote='"', escape='"', compression="gzip" if gzip else "none", lineSep="\n")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, goal = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(target)
    fs = place.getFileSystem(conf)
    found = next(s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith("part-"))
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, found, goal.getFileSystem(conf), goal, False, True, conf)
    fs.delete(place, True)


def present(graph: Graph) -> list[str]:
    """Node types that have entities, in the catalog's order."""
    found = {r.name for r in graph.entities.select("name").distinct().collect()}
    return [n for n in graph.catalog.names if n in found]


def write_tsv(graph: Graph, folder: str) -> list[str]:
    for n in (names := present(graph)):
        _write_one(tsv_table(graph, n), f"{folder}/{n}.tsv", sep="\t")
    return names


def write_gremlin(graph: Graph, folder: str, gzip: bool = True, strict: bool = True) -> list[str]:
    end = ".csv.gz" if gzip else ".csv"
    for n in (names := present(graph)):
        _write_one(gremlin_vertices(graph, n), f"{folder}/{n}{end}", gzip=gzip)
    _write_one(gremlin_edges(graph.edges, graph.entities.select("id", "name"), strict), f"{folder}/gremlin_edges{end}", gzip=gzip)
    return names


