"""The catalog of a dataset: node types with their fields, links, ontology terms. As small as the schema, so plain Python on the driver."""

from __future__ import annotations

import copy
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any
from urllib.request import urlopen

from pyspark.sql import types as T

from nodeloom.functions.codec import decode_name, encode_name

MISSING = object()
#: Dictionary types and their Avro names, Avro names and those of the bulk-load header, multiplicities.
AVRO = {"integer": "long", "int": "long", "number": "double", "string": "string", "boolean": "boolean", "null": "null"}
BULK = {"boolean": "Boolean", "enum": "String", "integer": "Long", "long": "Long", "number": "Double", "double": "Double", "float": "Double", "string": "String", "array": "String", "md5sum": "String"}
MULTIPLICITY = ["ONE_TO_ONE", "ONE_TO_MANY", "MANY_TO_ONE", "MANY_TO_MANY"]
SPARK = {"long": T.LongType(), "int": T.LongType(), "double": T.DoubleType(), "float": T.DoubleType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class Link:
    name: str
    dst: str
    multiplicity: str = "MANY_TO_ONE"


@dataclass(frozen=True)
class Property:
    name: str
    ontology_reference: str = ""
    values: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Field:
    """branches: Avro types in the order of the union; a dict for enums and arrays."""

    name: str
    branches: tuple[Any, ...]
    default: Any = MISSING
    doc: str = ""
    union: bool = True

    @property
    def nullable(self) -> bool:
        return "null" in self.branches

    @property
    def enums(self) -> list[dict]:
        return [b for b in self.branches if isinstance(b, dict) and b["type"] == "enum"]

    @property
    def is_enum(self) -> bool:
        """Whether values are written as encoded names: a branch is an enum or an array of one."""
        return bool(self.enums) or any(isinstance(b, dict) and b["type"] == "array" and isinstance(b["items"], dict) and b["items"]["type"] == "enum" for b in self.branches)

    @property
    def kind(self) -> str | None:
        """The type that a text value is read as: the last branch but null; enums and arrays count as enum."""
        solid = [b for b in self.branches if b != "null"]
        return None if not solid else "enum" if isinstance(solid[-1], dict) else solid[-1]

    @property
    def spark(self) -> T.DataType:
        solid = [b for b in self.branches if b != "null"]
        arrays = [b for b in solid if isinstance(b, dict) and b["type"] == "array"]
        if arrays:
            items = arrays[0]["items"]
            return T.ArrayType(SPARK.get(items if isinstance(items, str) else "string", T.StringType()))
        plain = [SPARK.get(b) if isinstance(b, str) else None for b in solid]
        return plain[0] if plain and plain[0] and all(p == plain[0] for p in plain) else T.StringType()

    @property
    def bulk(self) -> str:
        """The type in a bulk-load header: that of the first branch but null; of a type that is no union, String."""
        if not self.union:
            return "String"
        first = next((b for b in self.branches if b != "null"), "string")
        return BULK[first] if isinstance(first, str) else "String"


@dataclass(frozen=True)
class NodeType:
    name: str
    fields: tuple[Field, ...] = ()
    links: tuple[Link, ...] = ()
    ontology_reference: str = ""
    values: dict[str, str] = field(default_factory=dict)
    properties: tuple[Property, ...] = ()
    aliases: tuple[str, ...] = ()

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def spark(self) -> T.StructType:
        out = T.StructType()
        for f in self.fields:
            about = {"symbols": [s for e in f.enums for s in e["symbols"]], "enum": f.is_enum} | ({} if f.default is MISSING else {"default": f.default})
            out = out.add(T.StructField(f.name, f.spark, True, about))
        return out


def _coded(kind: Any, code: Callable[[str], str]) -> Any:
    if not isinstance(kind, dict):
        return kind
    if kind["type"] == "enum":
        return kind | {"symbols": [code(s) for s in kind["symbols"] if s is not None]}
    if kind["type"] == "array" and isinstance(kind["items"], dict):
        items = _coded(kind["items"], code)
        return kind | {"items": items | {"name": code(items["name"])} if "name" in items else items}
    return kind


@dataclass(frozen=True)
class Catalog:
    nodes: tuple[NodeType, ...]
    misc: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> NodeType:
        return next(n for n in self.nodes if n.name == name)

    def __contains__(self, name: str) -> bool:
        return any(n.name == name for n in self.nodes)

    @property
    def names(self) -> list[str]:
        return [n.name for n in self.nodes]

    def is_enum(self, node: str, name: str) -> bool:
        """KeyError for an unknown node, False for an unknown field."""
        if node not in self:
            raise KeyError(node)
        found = self[node].field(name)
        return bool(found and found.is_enum)

    def link_targets(self, node: str) -> dict[str, str]:
        return {x.name: x.dst for x in self[node].links} if node in self else {}

    # -- as Avro ------------------------------------------------------------------------------

    def schemas(self, encoded: bool = False) -> list[dict]:
        """A record schema of each node type, in order."""
        code = encode_name if encoded else lambda x: x
        out = []
        for n in self.nodes:
            fields = []
            for f in n.fields:
                kinds = [_coded(b, code) for b in f.branches]
                entry = {"name": f.name, "type": kinds if f.union else kinds[0]} | ({"doc": f.doc} if f.doc else {})
                if f.default is not MISSING:
                    entry["default"] = self._default(f, code)
                fields.append(entry)
            out.append({"type": "record", "name": n.name, "fields": fields} | ({"aliases": list(n.aliases)} if n.aliases else {}))
        return out

    @staticmethod
    def _default(f: Field, code: Callable[[str], str]) -> Any:
        if not f.is_enum or f.default is None:
            return f.default
        return [code(x) for x in f.default] if isinstance(f.default, list) else code(f.default)

    def metadata(self) -> dict:
        """The dataset's first record."""
        nodes = [
            {
                "name": n.name,
                "ontology_reference": n.ontology_reference,
                "values": n.values,
                "links": [{"multiplicity": x.multiplicity, "dst": x.dst, "name": x.name} for x in n.links],
                "properties": [{"name": p.name, "ontology_reference": p.ontology_reference, "values": p.values} for p in n.properties],
            }
            for n in self.nodes
        ]
        return {"nodes": nodes, "misc": self.misc}

    @classmethod
    def from_avro(cls, schemas: list[dict], metadata: dict, encoded: bool = True) -> Catalog:
        code = decode_name if encoded else lambda x: x
        about = {m["name"]: m for m in metadata.get("nodes", [])}
        nodes = []
        for s in schemas:
            m = about.get(s["name"], {})
            fields = []
            for f in s["fields"]:
                union = isinstance(f["type"], list)
                found = Field(f["name"], tuple(_coded(b, code) for b in (f["type"] if union else [f["type"]])), f.get("default", MISSING), f.get("doc", ""), union)
                if found.default is not MISSING and found.is_enum and found.default is not None:
                    found = replace(found, default=[code(x) for x in found.default] if isinstance(found.default, list) else code(found.default))
                fields.append(found)
            links = tuple(Link(x["name"], x["dst"], x["multiplicity"]) for x in m.get("links", []))
            properties = tuple(Property(p["name"], p["ontology_reference"], p["values"]) for p in m.get("properties", []))
            nodes.append(NodeType(s["name"], tuple(fields), links, m.get("ontology_reference", ""), m.get("values", {}), properties, tuple(s.get("aliases", ()))))
        return cls(tuple(nodes), metadata.get("misc", {}))

    # -- evolution ----------------------------------------------------------------------------

    def renamed_node(self, old: str, new: str, cascade: bool = False) -> Catalog:
        """The type gets the new name, an alias, and enum names that follow. Links keep the old name unless ``cascade``."""
        nodes = []
        for n in self.nodes:
            if n.name == old:
                fields = tuple(replace(f, branches=tuple(b | {"name": b["name"].replace(old, new)} if isinstance(b, dict) and b["type"] == "enum" else b for b in f.branches)) for f in n.fields)
                n = replace(n, name=new, fields=fields, aliases=(*n.aliases, old))
            if cascade:
                n = replace(n, links=tuple(replace(x, dst=new if x.dst == old else x.dst) for x in n.links))
            nodes.append(n)
        return replace(self, nodes=tuple(nodes))

    def renamed_enum(self, name: str, old: str, new: str) -> Catalog:
        """In every node type with such a field the symbol, and the default if it is that."""
        swap = lambda b: b | {"symbols": [new if s == old else s for s in b["symbols"]]} if isinstance(b, dict) and b["type"] == "enum" else b
        change = lambda f: replace(f, branches=tuple(map(swap, f.branches)), default=new if f.default == old and f.enums else f.default) if f.name == name else f
        return replace(self, nodes=tuple(replace(n, fields=tuple(map(change, n.fields))) for n in self.nodes))

    def copy(self) -> Catalog:
        return copy.deepcopy(self)

    # -- records ------------------------------------------------------------------------------

    def blank(self, node: str) -> dict:
        """A record of defaults: the last branch decides, numbers are 0, strings empty, enums their first symbol; an unknown node has no fields."""
        payload: dict[str, Any] = {}
        for f in self[node].fields if node in self else ():
            value = "" if f.default is MISSING else f.default
            for b in reversed(f.branches):
                if b in ("long", "int", "double", "float"):
                    value = 0
                elif b == "string":
                    value = ""
                elif isinstance(b, dict) and b["type"] == "enum":
                    value = b["symbols"][0]
                else:
                    continue
                break
            payload[f.name] = value
        return {"id": str(uuid.uuid4()), "name": node, "object": payload, "relations": []}


# -- dictionaries ---------------------------------------------------------------------------------


def load_dictionary(where: str) -> dict[str, Any]:
    """Sections by file name: an address or file of JSON, or a folder of YAML."""
    if where.startswith("http"):
        with urlopen(where) as f:  # noqa: S310
            return json.load(f)
    if where.endswith(".json"):
        return json.loads(Path(where).read_text())
    import yaml

    return {p.name: yaml.safe_load(p.read_text()) for p in sorted(Path(where).glob("*.yaml"))}


def resolve(sections: dict[str, Any]) -> dict[str, Any]:
    """All sections with every ``$ref`` replaced by what it names; keys beside it override."""
    done: dict[tuple[str, str], Any] = {}

    def named(section: str, path: str, trail: tuple) -> Any:
        key = (section, path)
        if key in trail:
            raise ValueError(f"circular $ref: {section}#{path}")
        if key not in done:
            value: Any = sections.get(section, {})
            for part in filter(None, path.split("/")):
                value = value.get(part, {}) if isinstance(value, dict) else {}
            done[key] = walk(value, section, (*trail, key))
        return done[key]

    def walk(value: Any, section: str, trail: tuple) -> Any:
        if isinstance(value, list):
            return [walk(x, section, trail) for x in value]
        if not isinstance(value, dict):
            return value
        own = {k: walk(x, section, trail) for k, x in value.items() if k != "$ref"}
        refs = value.get("$ref", [])
        for ref in reversed([refs] if isinstance(refs, str) else refs):
            target, _, path = ref.partition("#")
            found = named(target or section, path, trail)
            own = {**found, **own} if isinstance(found, dict) else own
        return own

    return {name: walk(value, name, ()) for name, value in sections.items()}


def _items(kind: Any, owner: str, name: str) -> Any:
    """The element type of an array property."""
    if not isinstance(kind, dict):
        return "string"
    if "enum" in kind:
        return {"type": "enum", "name": f"{owner}_{name}_anon_enum", "symbols": list(kind["enum"])}
    if "oneOf" in kind:
        return "string"
    of = kind.get("type", "string")
    return AVRO.get(of, "string") if isinstance(of, str) else "string"


def _branches(prop: dict, owner: str, name: str, required: bool) -> list[Any] | None:
    """Avro types of a property, or None for what is no value (links)."""
    if "type" in prop:
        kind = prop["type"]
        if kind == "array" or (isinstance(kind, list) and "array" in kind):
            array = {"type": "array", "items": _items(prop.get("items"), owner, name)}
            return [array] if kind == "array" and required else ["null", array]
        if isinstance(kind, list):
            if "number" in kind:
                return ["null", "double"]
            return [AVRO.get(k, k) for k in reversed(kind)]
        return [AVRO.get(kind, kind)]
    if "enum" in prop:
        return [{"type": "enum", "name": f"{owner}_{name}", "symbols": list(prop["enum"])}]
    if "oneOf" in prop:
        out: list[Any] = []
        for i, part in enumerate(prop["oneOf"]):
            out += _branches(part, owner, f"{name}_{i}" if "enum" in part else name, required) or []
        return out
    return None


def _field(owner: str, name: str, prop: dict, required: bool) -> Field | None:
    prop = dict(prop)
    default = prop.get("default", MISSING)
    if default is not MISSING and "oneOf" in prop:  # the enum that has the default comes first
        prop["oneOf"] = sorted(prop["oneOf"], key=lambda x: default not in x.get("enum", ()))
    kinds = _branches(prop, owner, name, required)
    if kinds is None or not kinds:
        return None
    if isinstance(default, bool) and "boolean" in kinds:
        kinds = ["boolean", *[k for k in kinds if k != "boolean"]]
    distinct: list[Any] = []
    for k in kinds:
        if k not in distinct:
            distinct.append(k)
    solid = [k for k in distinct if k != "null"]
    # Every field may be null, required ones as well; the default is of the first branch.
    branches = [*solid, "null"] if default is not MISSING else ["null", *solid]
    return Field(name, tuple(branches), default, prop.get("description", "") or "")


def _links(entries: list[dict]) -> list[Link]:
    out = []
    for x in entries:
        if "subgroup" in x:
            out += _links(x["subgroup"])
        elif "name" in x and "target_type" in x:
            out.append(Link(x["name"], x["target_type"], x["multiplicity"].upper()))
    return out


def _term(prop: dict) -> tuple[str, dict[str, str]] | None:
    term = prop.get("term") if isinstance(prop, dict) else None
    about = term.get("termDef") if isinstance(term, dict) else None
    if not isinstance(about, dict):
        return None
    return about.get("term") or "", {k: str(v) for k, v in about.items() if k != "term" and v is not None}


def from_dictionary(where: str | dict[str, Any]) -> Catalog:
    """The catalog that a data dictionary (a place, or its sections) describes."""
    sections = resolve(load_dictionary(where) if isinstance(where, str) else where)
    nodes = []
    for file, d in sections.items():
        if file.startswith("_") or not isinstance(d, dict) or "properties" not in d:
            continue
        name = d.get("id", re.sub(r"\.\w+$", "", file))
        required = set(d.get("required", []))
        fields, properties = [], []
        for key, prop in d["properties"].items():
            if key in ("id", "type") or not isinstance(prop, dict):
                continue
            found = _field(name, key, prop, key in required)
            if found is None:
                continue
            fields.append(found)
            if term := _term(prop):
                properties.append(Property(key, *term))
        about = _term(d)
        nodes.append(NodeType(name, tuple(fields), tuple(_links(d.get("links") or [])), "", about[1] if about else {}, tuple(properties)))
    return Catalog(tuple(nodes))
