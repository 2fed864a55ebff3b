"""A dataset: entities (id, name, object VARIANT, relations, and maybe ordinal) with their catalog.

Everything is a lazy DataFrame; the catalog is driver-side data of the schema's size, so what asks
only for names, schemas or metadata runs no job.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.sources.catalog import Catalog

RELATIONS = "array<struct<dst_id:string,dst_name:string>>"


def entity(id_: Column, name: str, payload: list[str], relations: Column | None = None) -> list[Column]:
    """The envelope's columns around named payload columns."""
    none = F.array().cast(RELATIONS)
    return [id_.cast("string").alias("id"), F.lit(name).alias("name"), F.to_variant_object(F.struct(*payload)).alias("object"), (none if relations is None else relations).cast(RELATIONS).alias("relations")]


def relation(dst_id: Column, dst_name: Column | str) -> Column:
    return F.struct(dst_id.cast("string").alias("dst_id"), (F.lit(dst_name) if isinstance(dst_name, str) else dst_name).alias("dst_name"))


def relations(*links: Column) -> Column:
    """An array of those whose dst_id isn't null."""
    return F.filter(F.array(*links), lambda x: x["dst_id"].isNotNull()) if links else F.array().cast(RELATIONS)


class Graph:
    def __init__(self, entities: DataFrame, catalog: Catalog):
        self.entities, self.catalog = entities, catalog

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    @classmethod
    def of_tables(cls, tables: dict[str, DataFrame], catalog: Catalog, links: dict[str, dict[str, str]], ids: dict[str, str]) -> Graph:
        """From one table for each node type; links: for each type the node types by the columns that hold their ids."""
        parts = [t.select(*entity(F.col(ids[n]), n, [c for c in t.columns if c != ids[n] and c not in links.get(n, {})], relations(*[relation(F.col(c), dst) for c, dst in links.get(n, {}).items()]))) for n, t in tables.items()]
        return cls(reduce(DataFrame.unionByName, parts), catalog)

    # -- views --------------------------------------------------------------------------------

    @property
    def edges(self) -> DataFrame:
        """src_id, src_name, dst_id, dst_name, place: from child to parent."""
        rows = self.entities.select(F.col("id").alias("src_id"), F.col("name").alias("src_name"), F.posexplode("relations").alias("place", "r"))
        return rows.select("src_id", "src_name", F.col("r.dst_id").alias("dst_id"), F.col("r.dst_name").alias("dst_name"), "place")

    def node(self, name: str) -> DataFrame:
        """id, relations and the payload's fields, typed, of one node type."""
        rows = self.entities.filter(F.col("name") == name)
        fields = [F.try_variant_get("object", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name, metadata=f.metadata) for f in self.catalog[name].spark]
        return rows.select("id", "relations", *[c for c, f in zip(fields, self.catalog[name].spark, strict=True) if f.name not in ("id", "relations")])

    def ordered(self) -> DataFrame:
        return self.entities.orderBy("ordinal") if "ordinal" in self.entities.columns else self.entities

    # -- inspection ---------------------------------------------------------------------------

    def show(self, limit: int | None = None) -> DataFrame:
        """entity: JSON lines in file order (where the source tells it, else by name and id)."""
        rows = self.entities.orderBy("ordinal") if "ordinal" in self.entities.columns else self.entities.orderBy("name", "id")
        rows = rows if limit is None else rows.limit(limit)
        return rows.select(F.to_json(F.struct("id", "name", "object", "relations"), {"ignoreNullFields": "false"}).alias("entity"))

    def node_names(self) -> DataFrame:
        return self.spark.createDataFrame([(i, n) for i, n in enumerate(self.catalog.names)], "position int, name string")

    def schema_json(self, node: str | None = None, encoded: bool = False) -> str | None:
        """As JSON: all node types, or one (nothing for an unknown one)."""
        found = self.catalog.schemas(encoded)
        if node is None:
            return json.dumps(found)
        return next((json.dumps(s) for s in found if s["name"] == node), None)

    def metadata_json(self, node: str | None = None) -> str | None:
        found = self.catalog.metadata()
        if node is None:
            return json.dumps(found)
        return next((json.dumps(n) for n in found["nodes"] if n["name"] == node), None)

    def meta_nodes(self) -> DataFrame:
        rows = [(n.name, n.ontology_reference, n.values, len(n.links), len(n.properties)) for n in self.catalog.nodes]
        return self.spark.createDataFrame(rows, "name string, ontology_reference string, values map<string,string>, n_links int, n_properties int")

    def meta_links(self) -> DataFrame:
        return self.spark.createDataFrame([(n.name, x.name, x.dst, x.multiplicity) for n in self.catalog.nodes for x in n.links], "node string, link string, dst string, multiplicity string")

    def meta_properties(self) -> DataFrame:
        return self.spark.createDataFrame([(n.name, p.name, p.ontology_reference, p.values) for n in self.catalog.nodes for p in n.properties], "node string, property string, ontology_reference string, values map<string,string>")

    def stats(self) -> DataFrame:
        """name, n_nodes, n_edges of each type that is present."""
        return self.entities.groupBy("name").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.coalesce(F.size("relations"), F.lit(0))).cast("long").alias("n_edges"))

    def totals(self) -> DataFrame:
        return self.stats().agg(F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("n_nodes"), F.count(F.lit(1)).alias("n_types"), F.coalesce(F.sum("n_edges"), F.lit(0)).alias("n_edges"))

    # -- change -------------------------------------------------------------------------------

    def transform(self, *hooks: Callable[[DataFrame], DataFrame]) -> Graph:
        """Hooks over the entities, in order."""
        return Graph(reduce(lambda df, f: f(df), hooks, self.entities), self.catalog)

    def append(self, other: DataFrame) -> Graph:
        """Entities under the same catalog."""
        return Graph(self.entities.unionByName(other, allowMissingColumns=True), self.catalog)

    def append_json_lines(self, path: str) -> Graph:
        """One entity a line, as ``show`` and ``blank`` print them."""
        line = F.parse_json(F.col("value"))
        get = lambda k, kind: F.try_variant_get(line, f"$.{k}", kind)
        rows = self.spark.read.text(path).filter(F.trim("value") != "")
        return self.append(rows.select(get("id", "string").alias("id"), get("name", "string").alias("name"), get("object", "variant").alias("object"), F.coalesce(get("relations", RELATIONS), F.array().cast(RELATIONS)).alias("relations")))

    def blank(self, node: str) -> dict:
        return self.catalog.blank(node)

    def rename_node(self, old: str, new: str, cascade: bool = False) -> Graph:
        """Types get the new name; relations and links to the old one keep it unless ``cascade``."""
        changed = {"name": F.when(F.col("name") == old, new).otherwise(F.col("name"))}
        if cascade:
            changed["relations"] = F.transform("relations", lambda r: F.struct(r["dst_id"].alias("dst_id"), F.when(r["dst_name"] == old, new).otherwise(r["dst_name"]).alias("dst_name")))
        return Graph(self.entities.withColumns(changed), self.catalog.renamed_node(old, new, cascade))

    def rename_enum(self, field: str, old: str, new: str) -> Graph:
        """In all entities whose field equals the old value, and in the catalog."""
        at = f"$['{field}']"
        same = F.coalesce(F.try_variant_get("object", at, "string") == old, F.lit(False)) & F.schema_of_variant(F.variant_get("object", at, "variant")).eqNullSafe("STRING")
        as_map = F.try_variant_get("object", "$", "map<string,variant>")
        # A JSON round trip of the few entities concerned: the field's text is set by the parsed map.
        text = F.to_json(F.map_concat(F.map_filter(as_map, lambda k, _: k != field), F.create_map(F.lit(field), F.parse_json(F.lit(json.dumps(new))))))
        return Graph(self.entities.withColumn("object", F.when(same, F.parse_json(text)).otherwise(F.col("object"))), self.catalog.renamed_enum(field, old, new))

    # -- storage ------------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """Parquet by node type, and the catalog beside it."""
        self.entities.withColumn("object", F.to_json("object")).write.mode("overwrite").partitionBy("name").parquet(f"{path}/entities")
        self.spark.createDataFrame([(json.dumps(self.catalog.schemas()), json.dumps(self.catalog.metadata()))], "schemas string, metadata string").coalesce(1).write.mode("overwrite").parquet(f"{path}/catalog")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        about = spark.read.parquet(f"{path}/catalog").first()
        catalog = Catalog.from_avro(json.loads(about.schemas), json.loads(about.metadata), encoded=False)
        return cls(spark.read.parquet(f"{path}/entities").withColumn("object", F.parse_json("object")), catalog)
