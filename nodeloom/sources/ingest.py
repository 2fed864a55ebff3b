"""Folders of JSON or text tables, one file for each node type, as entities under a catalog."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.casts import array_parse, typed
from nodeloom.operators.graph import RELATIONS, Graph, relation, relations
from nodeloom.sources.catalog import MISSING, Catalog, Field, NodeType


def _files(spark: SparkSession, folder: str, ending: str) -> dict[str, str]:
    """Paths by stem, in order of name; not of folders below."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [str(s.getPath()) for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if s.isFile()]
    return {p.rsplit("/", 1)[1][: -len(ending)]: p for p in sorted(found) if p.endswith(ending)}


def _field_value(payload: Column, f: Field) -> Column:
    """A field of a variant, as a variant: absent keys give the default, explicit nulls stay null."""
    kind = f.spark.simpleString()
    found = F.variant_get(payload, f"$['{f.name}']", "variant")
    value = F.try_variant_get(payload, f"$['{f.name}']", kind)
    if f.default is MISSING or f.default is None:
        return value
    default = F.parse_json(F.lit(json.dumps(f.default)))
    return F.when(found.isNull(), F.try_variant_get(default, "$", kind)).otherwise(value)


def json_entities(records: DataFrame, node: NodeType, program: str, project: str) -> DataFrame:
    """records: value, a variant for each record; ordinal.

    The id is submitter_id, else code; without either it is an error. Links are objects that hold a
    submitter_id, under the link's name; lists and links by code give none. project_id is set and
    created_datetime and updated_datetime become null.
    """
    get = lambda path: F.try_variant_get("value", path, "string")
    id_ = F.coalesce(get("$.submitter_id"), get("$.code"))
    id_ = F.when(id_.isNull(), F.raise_error(F.concat(F.lit(f"a {node.name} has neither submitter_id nor code: "), F.to_json("value")))).otherwise(id_)
    links = relations(*[relation(get(f"$['{x.name}'].submitter_id"), x.dst) for x in node.links])
    fields = []
    for f in node.fields:
        value = F.lit(f"{program}-{project}") if f.name == "project_id" else F.lit(None).cast("string") if f.name in ("created_datetime", "updated_datetime") else _field_value(F.col("value"), f)
        fields.append(value.alias(f.name))
    payload = F.to_variant_object(F.struct(*fields)) if fields else F.parse_json(F.lit("{}"))
    return records.select(id_.alias("id"), F.lit(node.name).alias("name"), payload.alias("object"), links.cast(RELATIONS).alias("relations"), "ordinal")


def from_json(spark: SparkSession, folder: str, catalog: Catalog, program: str, project: str) -> Graph:
    """Every ``<node type>.json`` of a folder: an object or a list of them. Of keys given twice the last counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parts = []
    for stem, path in _files(spark, folder, ".json").items():
        text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        many = F.try_variant_get("v", "$", "array<variant>")
        is_list = F.schema_of_variant("v").startswith("ARRAY")
        records = text.select(F.posexplode(F.when(is_list, many).otherwise(F.array("v"))).alias("place", "value"))
        parts.append(json_entities(records.select("value", F.struct(F.lit(stem).alias("file"), F.col("place").cast("long").alias("place")).alias("ordinal")), catalog[stem], program, project))
    return Graph(_union(spark, parts), catalog)


def tsv_entities(records: DataFrame, node: NodeType, program: str, project: str, strict: bool = False, resolve_links: bool = True) -> DataFrame:
    """records: text columns and ordinal.

    The id is submitter_id, else dbgap_accession_number of a program, else code. ``<link>.submitter_id``
    columns are relations, blank ones included; dst_name is the type that the catalog names, or the
    link's own name unless ``resolve_links``. Bracketed text of an enum or array field is an array.
    """
    columns = set(records.columns) - {"ordinal"}
    ids = [c for c in ("submitter_id", "dbgap_accession_number" if node.name == "program" else "code") if c in columns]
    targets = {x.name: x.dst for x in node.links} if resolve_links else {}
    links = []
    for c in records.columns:
        if ".submitter_id" in c:
            link = c.split(".")[0]
            links.append(relation(F.coalesce(F.col(f"`{c}`"), F.lit("")), targets.get(link, link)))
    fields = []
    for f in node.fields:
        if f.name == "project_id":
            value = F.lit(f"{program}-{project}")
        elif f.name not in columns:
            value = F.lit(None).cast(f.spark) if f.default is MISSING or f.default is None else F.try_variant_get(F.parse_json(F.lit(json.dumps(f.default))), "$", f.spark.simpleString())
        elif f.spark.typeName() == "array":
            value = F.coalesce(array_parse(F.col(f"`{f.name}`")), F.when(F.col(f"`{f.name}`") != "", F.array(F.col(f"`{f.name}`")))).cast(f.spark)
        else:
            value = typed(F.col(f"`{f.name}`"), f.kind, strict)
        fields.append(value.alias(f.name))
    payload = F.to_variant_object(F.struct(*fields)) if fields else F.parse_json(F.lit("{}"))
    id_ = F.coalesce(*[F.col(c) for c in ids]) if ids else F.raise_error(F.lit(f"{node.name}: no column for the id")).cast("string")
    return records.select(id_.alias("id"), F.lit(node.name).alias("name"), payload.alias("object"), relations(*links).cast(RELATIONS).alias("relations"), "ordinal")


def from_tsv(spark: SparkSession, folder: str, catalog: Catalog, program: str, project: str, strict: bool = False, resolve_links: bool = True) -> Graph:
    """Every ``<node type>.tsv`` of a folder, with a header; all columns are read as text, then typed by the catalog."""
    parts = []
    for stem, path in _files(spark, folder, ".tsv").items():
        rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, inferSchema=False)
        records = rows.withColumn("ordinal", F.struct(F.lit(stem).alias("file"), F.monotonically_increasing_id().alias("place")))
        parts.append(tsv_entities(records, catalog[stem], program, project, strict, resolve_links))
    return Graph(_union(spark, parts), catalog)


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    if parts:
        return reduce(DataFrame.unionByName, parts)
    return spark.createDataFrame([], f"id string, name string, object variant, relations {RELATIONS}, ordinal struct<file:string,place:long>")
