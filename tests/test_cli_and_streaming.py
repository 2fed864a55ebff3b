import json

import pytest

from nodeloom import cli
from nodeloom.sources.container import read_catalog
from nodeloom.streaming import append
from tests.test_catalog import DICTIONARY


@pytest.fixture
def made(spark, tmp_path, capsys):
    (tmp_path / "dictionary.json").write_text(json.dumps(DICTIONARY))
    schema, data, out = str(tmp_path / "schema.avro"), tmp_path / "data", str(tmp_path / "out.avro")
    cli.main(["from", "-o", schema, "dict", str(tmp_path / "dictionary.json")])
    data.mkdir()
    (data / "case.json").write_text('[{"submitter_id": "c1"}]')
    (data / "sample.json").write_text('[{"submitter_id": "s1", "size": 1, "tags": [1, 2], "color": "1 red", "cases": {"submitter_id": "c1"}}]')
    cli.main(["from", "-o", out, "json", str(data), "-s", schema, "--program", "p", "--project", "q"])
    capsys.readouterr()
    return out


def said(capsys, *arguments):
    cli.main(list(arguments))
    return capsys.readouterr().out.splitlines()


def test_commands(made, capsys, tmp_path):
    assert said(capsys, "show", "-i", made, "nodes") == ["sample", "case"]
    lines = [json.loads(x) for x in said(capsys, "show", "-i", made)]
    assert [x["id"] for x in lines] == ["c1", "s1"] and lines[1]["object"]["state"] == "validated" and lines[1]["object"]["color"] == "1 red" and lines[1]["relations"] == [{"dst_id": "c1", "dst_name": "case"}]
    assert len(said(capsys, "show", "-i", made, "-n", "1")) == 1
    assert json.loads(said(capsys, "show", "-i", made, "schema", "case")[0])["name"] == "case" and said(capsys, "show", "-i", made, "schema", "nope") == []
    assert json.loads(said(capsys, "show", "-i", made, "metadata", "sample")[0])["name"] == "sample"
    assert "_31__20_red" in said(capsys, "show", "-i", made, "encoded-schema")[0]
    assert said(capsys, "show", "-i", made, "stats")[-1] == "2 nodes of 2 types, 1 edges"
    new = str(tmp_path / "renamed.avro")
    cli.main(["rename", "-i", made, "-o", new, "node", "case", "person"])
    assert read_catalog(new)["person"].aliases == ("case",)
    cli.main(["rename", "-i", made, "-o", new, "enum", "state", "validated", "fine"])
    capsys.readouterr()
    assert json.loads(said(capsys, "show", "-i", new)[1])["object"]["state"] == "fine"
    cli.main(["to", "-i", made, "tsv", str(tmp_path / "t")])
    cli.main(["to", "-i", made, "gremlin", str(tmp_path / "g"), "--no-gzip"])
    assert (tmp_path / "t/sample.tsv").exists() and (tmp_path / "g/gremlin_edges.csv").exists()


def test_make_and_add(made, capsys, tmp_path):
    (tmp_path / "blank.json").write_text("\n".join(said(capsys, "make", "-i", made, "case")))
    cli.main(["add", made, "-i", str(tmp_path / "blank.json")])
    capsys.readouterr()
    assert len(said(capsys, "show", "-i", made)) == 3


def test_failure_is_told(capsys, tmp_path):
    with pytest.raises(FileNotFoundError):
        cli.main(["show", "-i", str(tmp_path / "none"), "nodes"])
    assert "Failed!" in capsys.readouterr().err


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id": "1", "name": "case", "object": {"x": 1}, "relations": [{"dst_id": "2", "dst_name": "case"}]}\n\n')
    for more in ("b", None):
        append.append_to(append.entity_stream(spark, str(folder)), str(tmp_path / "saved"), str(tmp_path / "state")).awaitTermination(120)
        if more:
            (folder / "b.jsonl").write_text('{"id": "3", "name": "sample", "object": {}}\n')
    got = sorted((r.id, r.name, len(r.relations)) for r in append.arrived(spark, str(tmp_path / "saved")).collect())
    assert got == [("1", "case", 1), ("3", "sample", 0)]
