"""Container files: the catalog in header and first record, then entities in blocks.

Reading goes through Spark's own file source, so any file system will do; blocks are dealt out and
decoded by the executors. Writing makes one file: executors encode blocks, the driver strings them
together, one block in memory at a time. (Tables of Parquet, one for each node type, are the layout
to work with; see Graph.save.)
"""

from __future__ import annotations

import io
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.codec import decode_name, encode_name
from nodeloom.operators.graph import Graph
from nodeloom.sources import avro
from nodeloom.sources.catalog import MULTIPLICITY, Catalog

BLOCK_RECORDS = 500


def _record(name: str, /, **fields) -> dict:
    return {"type": "record", "name": name, "fields": [{"name": k, "type": v} for k, v in fields.items()]}


def envelope(catalog: Catalog) -> dict:
    """The container's schema: what every entity has, and a union of all node types."""
    texts, many = {"type": "map", "values": "string"}, lambda x: {"type": "array", "items": x}
    link = _record("Link", multiplicity={"type": "enum", "name": "Multiplicity", "symbols": MULTIPLICITY}, dst="string", name="string")
    prop = _record("Property", name="string", ontology_reference="string", values=texts)
    node = _record("Node", name="string", ontology_reference="string", values=texts, links=many(link), properties=many(prop))
    out = _record("Entity", id=["null", "string"], name="string", object=[_record("Metadata", nodes=many(node), misc=texts), *catalog.schemas(encoded=True)], relations=many(_record("Relation", dst_id="string", dst_name="string")))
    out["fields"][0]["default"], out["fields"][3]["default"] = None, []
    return out


def parse_header(data: bytes | io.BufferedIOBase) -> Catalog:
    """Only the header and the first record are read."""
    f = io.BytesIO(data) if isinstance(data, bytes) else data
    schema, codec, sync = avro.read_header(f)
    names = avro.Names(schema)
    _, packed = next(avro.blocks(f, sync))
    first = avro.read_value(avro.unpack(packed, codec), schema, names)
    return Catalog.from_avro(schema["fields"][2]["type"][1:], first["object"])


def read_catalog(path: str) -> Catalog:
    """Without a Spark job."""
    with open(path, "rb") as f:
        return parse_header(f)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, block, n, codec, schema, packed."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                f = io.BytesIO(content)
                schema, codec, sync = avro.read_header(f)
                for k, (n, packed) in enumerate(avro.blocks(f, sync)):
                    columns = [file, k, n, codec, json.dumps(schema), packed]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds, strict=True)], ["file", "block", "n", "codec", "schema", "packed"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cut, "file string, block long, n long, codec string, schema string, packed binary")


def read_container(spark: SparkSession, path: str, catalog: Catalog | None = None) -> Graph:
    """The graph of a container; ``ordinal`` keeps the order of the file."""
    if catalog is None:
        first = spark.read.format("binaryFile").load(path).select("content").first()
        catalog = parse_header(bytes(first[0]))
    enums = {n.name: [f.name for f in n.fields if f.is_enum] for n in catalog.nodes}

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                schema = json.loads(r["schema"])
                names, f, out = avro.Names(schema), avro.unpack(r["packed"], r["codec"]), []
                for i in range(r["n"]):
                    e = avro.read_value(f, schema, names)
                    if not (r["block"] == 0 and i == 0):  # the metadata
                        out.append((e["id"], e["name"], json.dumps(decoded(e["name"], e["object"])), e["relations"], r["file"], (r["block"] << 32) + i))
                if out:
                    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("dst_id", pa.string()), ("dst_name", pa.string())])), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "name", "object", "relations", "file", "place"])

    def decoded(name, payload):
        for k in enums.get(name, ()):
            v = payload.get(k)
            if v:
                payload[k] = [decode_name(x) for x in v] if isinstance(v, list) else decode_name(v)
        return payload

    rows = _blocks(spark, path).repartition(F.col("file"), F.col("block")).mapInArrow(decode, "id string, name string, object string, relations array<struct<dst_id:string,dst_name:string>>, file string, place long")
    return Graph(rows.select("id", "name", F.parse_json("object").alias("object"), "relations", F.struct("file", "place").alias("ordinal")), catalog)


def write_container(graph: Graph, path: str, codec: str = "deflate") -> int:
    """Writes one file; returns the number of entities."""
    catalog, schema = graph.catalog, envelope(graph.catalog)
    enums = {n.name: {f.name for f in n.fields if f.is_enum} for n in catalog.nodes}

    def coded(name, payload):
        return {k: ([encode_name(x) for x in v] if isinstance(v, list) else encode_name(v)) if v is not None and k in enums.get(name, ()) else v for k, v in payload.items()}

    def encode(batches):
        import pyarrow as pa

        names = avro.Names(schema)
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), BLOCK_RECORDS):
                f, part = io.BytesIO(), rows[at : at + BLOCK_RECORDS]
                for r in part:
                    _entity(f, r["id"], r["name"], coded(r["name"], json.loads(r["object"])), r["relations"], schema, names)
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([avro.pack(f.getvalue(), codec)], pa.binary())], ["n", "packed"])

    rows = graph.ordered().select("id", "name", F.to_json("object").alias("object"), "relations")
    total = 0
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as out:
        sync = avro.write_header(out, schema, codec)
        f = io.BytesIO()
        _entity(f, None, "Metadata", catalog.metadata(), [], schema, avro.Names(schema))
        avro.write_block(out, 1, avro.pack(f.getvalue(), codec), sync)
        for r in rows.mapInArrow(encode, "n long, packed binary").toLocalIterator():
            avro.write_block(out, r.n, bytes(r.packed), sync)
            total += r.n
    return total


def _entity(f, id_, name, payload, relations, schema, names) -> None:
    kinds = [x["type"] for x in schema["fields"]]
    avro.write_value(f, id_, kinds[0], names)
    avro.write_value(f, name, kinds[1], names)
    avro.write_value(f, payload, kinds[2], names, branch=name)
    avro.write_value(f, relations or [], kinds[3], names)
