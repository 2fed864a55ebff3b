import json

import pytest

from nodeloom.sources import catalog as C

DICTIONARY = {
    "_definitions.yaml": {
        "id": "_definitions",
        "state": {"default": "validated", "oneOf": [{"enum": ["uploading", "live"]}, {"enum": ["validated", "released"]}], "term": {"$ref": "_terms.yaml#/state"}},
        "datetime": {"oneOf": [{"format": "date-time", "type": "string"}, {"type": "null"}]},
        "ubiquitous": {"state": {"$ref": "#/state"}, "created_datetime": {"$ref": "#/datetime"}, "id": {"type": "string"}, "type": {"type": "string"}},
    },
    "_terms.yaml": {"state": {"description": "s", "termDef": {"term": "State", "source": "terms", "cde_id": 7, "cde_version": None}}},
    "sample.yaml": {
        "id": "sample",
        "links": [{"subgroup": [{"name": "cases", "target_type": "case", "multiplicity": "many_to_one"}, {"subgroup": [{"name": "kits", "target_type": "kit", "multiplicity": "one_to_one"}]}]}, {"multiplicity": "many_to_many"}],
        "required": ["tags", "size"],
        "properties": {
            "$ref": "_definitions.yaml#/ubiquitous",
            "tags": {"type": "array", "items": {"type": "integer"}},
            "kinds": {"type": "array", "items": {"enum": ["x y", "z"]}},
            "size": {"type": "integer"},
            "weight": {"type": ["number", "null"]},
            "flag": {"type": "boolean", "default": False},
            "color": {"enum": ["1 red", "blue"]},
            "cases": {"anyOf": [{"type": "array"}]},
        },
    },
    "case.yaml": {"id": "case", "properties": {"submitter_id": {"type": ["string"]}}},
}


def test_dictionary():
    cat = C.from_dictionary(DICTIONARY)
    assert cat.names == ["sample", "case"]
    s = cat["sample"]
    assert [(x.name, x.dst, x.multiplicity) for x in s.links] == [("cases", "case", "MANY_TO_ONE"), ("kits", "kit", "ONE_TO_ONE")]
    assert [f.name for f in s.fields] == ["state", "created_datetime", "tags", "kinds", "size", "weight", "flag", "color"]
    state = s.field("state")
    assert [b["symbols"] for b in state.enums] == [["validated", "released"], ["uploading", "live"]] and state.branches[-1] == "null" and state.default == "validated"
    assert s.field("created_datetime").branches == ("null", "string")
    assert s.field("size").branches == ("null", "long") and s.field("weight").branches == ("null", "double")
    assert s.field("tags").branches == ("null", {"type": "array", "items": "long"})
    assert s.field("kinds").is_enum and cat.is_enum("sample", "color") and not cat.is_enum("sample", "nope")
    with pytest.raises(KeyError):
        cat.is_enum("nope", "color")
    assert s.properties == (C.Property("state", "State", {"source": "terms", "cde_id": "7"}),)
    assert s.spark["weight"].dataType.simpleString() == "double" and s.spark["state"].metadata["symbols"] == ["validated", "released", "uploading", "live"]


def test_encoded_schema_and_back():
    cat = C.from_dictionary(DICTIONARY)
    raw = cat.schemas(encoded=True)
    color = next(f for f in raw[0]["fields"] if f["name"] == "color")
    assert color["type"][1]["symbols"] == ["_31__20_red", "blue"]
    back = C.Catalog.from_avro(json.loads(json.dumps(raw)), json.loads(json.dumps(cat.metadata())))
    assert back.schemas() == cat.schemas() and back.metadata() == cat.metadata()


def test_blank_takes_the_last_branch():
    blank = C.from_dictionary(DICTIONARY).blank("sample")
    assert blank["object"] == {"state": "uploading", "created_datetime": "", "tags": "", "kinds": "", "size": 0, "weight": 0, "flag": False, "color": "1 red"}
    assert C.from_dictionary(DICTIONARY).blank("unknown")["object"] == {}


def test_evolution():
    cat = C.from_dictionary(DICTIONARY)
    new = cat.renamed_node("sample", "specimen")
    assert "specimen" in new and "sample" not in new and new["specimen"].aliases == ("sample",)
    assert new["specimen"].field("color").enums[0]["name"] == "specimen_color"
    assert cat.renamed_node("case", "person", cascade=True)["sample"].links[0].dst == "person" and cat.renamed_node("case", "person")["sample"].links[0].dst == "case"
    enum = cat.renamed_enum("state", "validated", "ok")["sample"].field("state")
    assert enum.default == "ok" and enum.enums[0]["symbols"] == ["ok", "released"]


def test_circular_reference():
    with pytest.raises(ValueError, match="circular"):
        C.resolve({"a": {"x": {"$ref": "#/y"}, "y": {"$ref": "#/x"}}})
