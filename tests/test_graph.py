import csv
import gzip
import itertools
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nodeloom.operators import export, http_sink, spanning
from nodeloom.operators.graph import Graph
from nodeloom.sources import container, ingest
from nodeloom.sources.catalog import Catalog, Field, Link, NodeType, Property


def catalog():
    state = {"type": "enum", "name": "case_state", "symbols": ["ok", "1 bad"]}
    return Catalog(
        (
            NodeType("case", (Field("submitter_id", ("null", "string")), Field("state", (state, "null"), "ok"), Field("age", ("null", "long"))), properties=(Property("state", "State", {"a": "b"}),)),
            NodeType("sample", (Field("submitter_id", ("null", "string")), Field("project_id", ("null", "string")), Field("created_datetime", ("null", "string")), Field("weight", ("null", "double")), Field("frozen", ("null", "boolean")), Field("tags", ("null", {"type": "array", "items": "string"})), Field("state", ("null", "string"))), (Link("cases", "case"),)),
            NodeType("unused", (Field("x", ("null", "string")),)),
        ),
        {"made": "here"},
    )


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "json"
    d.mkdir()
    (d / "case.json").write_text(json.dumps([{"submitter_id": "c1", "age": 3, "extra": 1}, {"code": "c2", "state": None, "age": None}]))
    (d / "sample.json").write_text('{"submitter_id": "s0", "submitter_id": "s1", "weight": 83.9, "frozen": true, "cases": {"submitter_id": "c1"}, "tags": ["a", "b c"], "created_datetime": "now", "state": "ok"}')
    return str(d)


@pytest.fixture
def graph(spark, folder):
    return ingest.from_json(spark, folder, catalog(), "DEV", "test")


def rows(graph):
    return {r.id: (r.name, json.loads(r.o), [tuple(x) for x in r.relations]) for r in graph.entities.select("id", "name", F.to_json("object", {"ignoreNullFields": "false"}).alias("o"), "relations").collect()}


def test_from_json(graph):
    got = rows(graph)
    assert got["c1"] == ("case", {"submitter_id": "c1", "state": "ok", "age": 3}, [])
    assert got["c2"][1] == {"submitter_id": None, "state": None, "age": None}
    assert got["s1"] == ("sample", {"submitter_id": "s1", "project_id": "DEV-test", "created_datetime": None, "weight": 83.9, "frozen": True, "tags": ["a", "b c"], "state": "ok"}, [("c1", "case")])


def test_record_without_id(spark, tmp_path):
    (tmp_path / "case.json").write_text('{"age": 1}')
    with pytest.raises(Exception, match="neither submitter_id nor code"):
        ingest.from_json(spark, str(tmp_path), catalog(), "a", "b").entities.collect()


def test_from_tsv(spark, tmp_path):
    (tmp_path / "case.tsv").write_text("submitter_id\tstate\tage\nc1\t\t4\nc2\t1 bad\t\n")
    (tmp_path / "sample.tsv").write_text("submitter_id\tweight\tfrozen\ttags\tcases.submitter_id\ns1\tnull\tTrue\t[x,y]\tc1\ns2\t1e2\tno\t\t\n")
    got = rows(ingest.from_tsv(spark, str(tmp_path), catalog(), "P", "q"))
    assert got["c1"][1] == {"submitter_id": "c1", "state": None, "age": 4} and got["c2"][1]["age"] is None
    assert got["s1"][1]["tags"] == ["x", "y"] and got["s1"][1]["frozen"] is True and got["s1"][1]["weight"] is None and got["s1"][1]["project_id"] == "P-q" and got["s1"][2] == [("c1", "case")]
    assert got["s2"][1]["weight"] == 100.0 and got["s2"][1]["frozen"] is None and got["s2"][2] == [("", "case")]
    raw = rows(ingest.from_tsv(spark, str(tmp_path), catalog(), "P", "q", resolve_links=False))
    assert raw["s1"][2] == [("c1", "cases")]


def test_container_round_trip(spark, graph, tmp_path):
    for codec in ("null", "deflate"):
        path = str(tmp_path / f"{codec}.avro")
        assert container.write_container(graph, path, codec) == 3
        back = container.read_container(spark, path)
        assert rows(back) == rows(graph)
        assert back.catalog.schemas() == graph.catalog.schemas() and back.catalog.metadata() == graph.catalog.metadata()
        assert container.read_catalog(path).names == ["case", "sample", "unused"]
        # The JVM's own reader agrees.
        jvm = spark._jvm
        reader = jvm.org.apache.avro.file.DataFileReader(jvm.java.io.File(path), jvm.org.apache.avro.generic.GenericDatumReader())
        seen = []
        while reader.hasNext():
            r = reader.next()
            seen.append((str(r.get("name")), str(r.get("object"))))
        assert [n for n, _ in seen][0] == "Metadata" and len(seen) == 4
        assert any('"state": "ok"' in o for n, o in seen if n == "case")
    assert [json.loads(r.entity)["id"] for r in back.show().collect()] == ["c1", "c2", "s1"]
    assert len(back.show(1).collect()) == 1


def test_inspection(graph):
    assert {tuple(r) for r in graph.stats().collect()} == {("case", 2, 0), ("sample", 1, 1)}
    assert tuple(graph.totals().first()) == (3, 2, 1)
    assert [r.name for r in graph.node_names().collect()] == ["case", "sample", "unused"]
    assert json.loads(graph.schema_json("case"))["name"] == "case" and graph.schema_json("nope") is None
    assert "_31__20_bad" in graph.schema_json(encoded=True) and json.loads(graph.metadata_json("sample"))["links"][0]["dst"] == "case"
    assert graph.meta_properties().count() == 1


def test_evolution_and_append(spark, graph, tmp_path):
    renamed = graph.rename_node("case", "person")
    assert {n for n, _, _ in rows(renamed).values()} == {"person", "sample"} and rows(renamed)["s1"][2] == [("c1", "case")]
    assert rows(graph.rename_node("case", "person", cascade=True))["s1"][2] == [("c1", "person")]
    enum = rows(graph.rename_enum("state", "ok", 'fi"ne'))
    assert enum["c1"][1]["state"] == enum["s1"][1]["state"] == 'fi"ne' and enum["c2"][1]["state"] is None and enum["s1"][1]["weight"] == 83.9 and enum["s1"][1]["tags"] == ["a", "b c"]
    lines = tmp_path / "more.jsonl"
    lines.write_text(json.dumps(graph.blank("sample")) + "\n" + json.dumps({"id": "z", "name": "case", "object": {"age": 1}, "relations": [{"dst_id": "a", "dst_name": "b"}]}) + "\n")
    more = rows(graph.append_json_lines(str(lines)))
    assert len(more) == 5 and more["z"] == ("case", {"age": 1}, [("a", "b")])
    graph.save(str(tmp_path / "saved"))
    assert rows(Graph.load(spark, str(tmp_path / "saved"))) == rows(graph)


def test_exports(spark, graph, tmp_path):
    assert export.write_tsv(graph, str(tmp_path / "tsv")) == ["case", "sample"]
    with open(tmp_path / "tsv/sample.tsv", newline="") as f:
        table = list(csv.DictReader(f, delimiter="\t"))
    assert table == [{"type": "sample", "submitter_id": "s1", "project_id": "DEV-test", "created_datetime": "", "weight": "83.9", "frozen": "True", "tags": '["a","b c"]', "state": "ok", "cases.id": "c1", "cases.submitter_id": "c1", "id": "s1"}]
    export.write_gremlin(graph, str(tmp_path / "g"))
    with gzip.open(tmp_path / "g/sample.csv.gz", "rt") as f:
        vertex = next(csv.DictReader(f))
    assert list(vertex) == ["~label", "~id", "submitter_id:String", "project_id:String", "created_datetime:String", "weight:Double", "frozen:Boolean", "tags:String", "state:String"] and vertex["created_datetime:String"] == ""
    with gzip.open(tmp_path / "g/gremlin_edges.csv.gz", "rt") as f:
        edges = list(csv.DictReader(f))
    assert len(edges) == 1 and edges[0]["~from"] == vertex["~id"] and edges[0]["~label"] == "case"
    lost = graph.append(graph.entities.filter("name = 'sample'").withColumns({"id": F.lit("s9"), "relations": F.expr("array(struct('gone' as dst_id, 'case' as dst_name))")}))
    assert [r.dst_id for r in export.dangling_edges(lost.edges, lost.entities).collect()] == ["gone"]
    with pytest.raises(ValueError, match="leads nowhere"):
        export.gremlin_edges(lost.edges, lost.entities, strict=True)


@pytest.mark.parametrize("x", [0.0001, 0.00012345, 1e16, 1.5e15, 123456789.25, 1e-5, 2.5e-7, 1e22, -0.001, -3e8, 5.0, 1e100, 0.1, float("inf")])
def test_doubles_as_python_writes_them(spark, x):
    from pyspark.sql.types import DoubleType

    assert spark.createDataFrame([(x,)], "x double").select(export.as_text(F.col("x"), DoubleType())).first()[0] == str(x)


def test_http(spark, graph, tmp_path):
    place = str(tmp_path)

    def send(url, body, token):
        with open(f"{place}/sent", "a") as f:
            f.write(json.dumps([url, json.loads(body), token]) + "\n")

    table = http_sink.etl(graph, "case", "http://x", "tok", send)
    assert [tuple(r) for r in table.collect()] == [("c1", "s1")]
    sent = {u: b for u, b, t in map(json.loads, Path(f"{place}/sent").read_text().splitlines()) if t == "tok"}
    assert sent["http://x/spanning_tree_index/_doc/0"] == {"case": "c1", "sample": "s1"} and sent["http://x/case/_doc/c1"]["age"] == 3


# -- spanning tables ------------------------------------------------------------------------------


def brute(root, children):
    """All choices of one id a type among what the root reaches, their parts that hang on the root, the maximal ones."""
    reach, todo = {root}, [root]
    while todo:
        for c in children.get(todo.pop(), ()):
            if c not in reach:
                reach.add(c)
                todo.append(c)
    by = {}
    for x in reach:
        by.setdefault(x[1], []).append(x)
    found = set()
    for choice in itertools.product(*by.values()):
        part, todo = {root}, [root]
        while todo:
            for c in children.get(todo.pop(), ()):
                if c in choice and c not in part:
                    part.add(c)
                    todo.append(c)
        found.add(frozenset(part))
    return {x for x in found if not any(x < y for y in found)}


def edges_of(spark, children):
    return spark.createDataFrame([(c[0], c[1], p[0], p[1]) for p, cs in children.items() for c in cs], "src_id string, src_name string, dst_id string, dst_name string")


def as_sets(table, root):
    return sorted(sorted((r[c], c if c != f"{root}_2" else root) for c in table.columns if r[c] is not None) for r in table.collect())


def test_cyclic_types(spark):
    children = {("A_1", "A"): [("B_1", "B"), ("C_1", "C"), ("C_2", "C"), ("B_2", "B")], ("B_1", "B"): [("D_1", "D")], ("D_1", "D"): [("C_1", "C")], ("C_1", "C"): [("D_2", "D"), ("B_3", "B")]}
    want = [{"C_2", "B_2", "A_1"}, {"C_2", "B_1", "D_1", "A_1"}, {"C_1", "B_2", "D_2", "A_1"}, {"C_1", "B_1", "D_2", "A_1"}, {"C_1", "B_1", "D_1", "A_1"}, {"C_1", "B_3", "D_2", "A_1"}]
    got = as_sets(spanning.spanning_table(edges_of(spark, children), "A"), "A")
    assert got == sorted(sorted((x, x[0]) for x in s) for s in want)


def random_graph(rng, n_types, acyclic):
    ids = [(f"{t}{i}", t) for t in "ABCDE"[:n_types] for i in range(rng.randint(1, 3))]
    children = {}
    for p in ids:
        for c in ids:
            if p != c and p[1] != c[1] and (p[1] < c[1] or not acyclic) and c[1] != "A" and rng.random() < 0.35:
                children.setdefault(p, []).append(c)
    return children


def test_growing_equals_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        children = random_graph(rng, rng.randint(2, 4), rng.random() < 0.5)
        if ("A0", "A") in children:
            assert spanning.grow(("A0", "A"), children) == brute(("A0", "A"), children)
    with pytest.raises(ValueError, match="partial choices"):
        spanning.grow(("A0", "A"), {("A0", "A"): [(f"{t}{i}", t) for t in "BCDEFG" for i in range(9)]}, most=100)


@pytest.mark.parametrize("seed", range(4))
def test_joins_equal_brute_force(spark, seed):
    children = random_graph(random.Random(seed), 5, True)
    edges = edges_of(spark, children)
    table = spanning.spanning_table(edges, "A")
    assert "Python" not in table._jdf.queryExecution().executedPlan().toString()
    want = sorted(sorted(s) for root in sorted(p for p in children if p[1] == "A") for s in brute(root, children))
    assert as_sets(table, "A") == want


def test_root_on_a_cycle(spark):
    children = {("A1", "A"): [("A2", "A"), ("B1", "B")], ("A2", "A"): [("B1", "B")], ("B1", "B"): []}
    got = as_sets(spanning.spanning_table(edges_of(spark, children), "A"), "A")
    assert got == [[("A1", "A"), ("A2", "A"), ("B1", "B")]]


def test_reachable(spark):
    children = {("a", "A"): [("b", "B")], ("b", "B"): [("c", "C"), ("a", "A")], ("c", "C"): [("b", "B")], ("x", "A"): [("y", "B")]}
    edges = edges_of(spark, children)
    got = {(r.root_id, r.id) for r in spanning.reachable(edges, spanning.roots(edges, "A").withColumn("name", F.lit("A"))).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")}


def test_antichain_and_documents(spark):
    sets = spark.createDataFrame([(["a", "b"],), (["a"],), (["b", "c", "a"],), (["d"],), (["d"],)], "s array<string>")
    assert sorted(r.s for r in spanning.antichain(sets, "s").collect()) == [["b", "c", "a"], ["d"], ["d"]]
    docs = spanning.documents(spark.range(500).select(F.col("id").alias("A")))
    assert sorted(r.doc_no for r in docs.collect()) == list(range(500))


def test_reachable_is_whole_or_an_error(spark):
    edges = spark.createDataFrame([(str(i + 1), "A", str(i), "A") for i in range(3)], "src_id string, src_name string, dst_id string, dst_name string")
    start = spark.createDataFrame([("0", "A")], "id string, name string")
    assert spanning.reachable(edges, start, max_rounds=3).count() == 4
    with pytest.raises(ValueError, match="2 rounds"):
        spanning.reachable(edges, start, max_rounds=2)


def test_null_in_a_required_field_is_written_and_read(spark, tmp_path):
    from nodeloom.operators.graph import Graph, entity
    from nodeloom.sources.catalog import from_dictionary
    from nodeloom.sources.container import read_container, write_container

    node = {"id": "visit", "required": ["size", "tags", "state"], "properties": {"size": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string"}}, "state": {"enum": ["a b", "c"]}, "weight": {"type": ["number", "null"]}}}
    catalog = from_dictionary({"visit.yaml": node})
    rows = spark.createDataFrame([("1", 2.0, ["x"], "a b", 1.5), ("2", None, None, None, None)], "k string, size double, tags array<string>, state string, weight double")
    graph = Graph(rows.select(*entity(rows["k"], "visit", ["size", "tags", "state", "weight"])), catalog)
    path = str(tmp_path / "v.avro")
    assert write_container(graph, path) == 2
    got = {r.id: (r.size, r.tags, r.state, r.weight) for r in read_container(spark, path).node("visit").collect()}
    assert got == {"1": (2.0, ["x"], "a b", 1.5), "2": (None, None, None, None)}


def test_antichain_meets_by_the_rarest_member(spark):
    import itertools
    import random

    from nodeloom.operators import spanning

    rng = random.Random(2)
    sets = [["root", *rng.sample("abcdefgh", rng.randint(0, 5))] for _ in range(120)] + [["root"], ["z"]]
    got = sorted(sorted(set(r.s)) for r in spanning.antichain(spark.createDataFrame([(s,) for s in sets], "s array<string>"), "s").collect())
    assert got == sorted(sorted(set(s)) for s in sets if not any(set(s) < set(t) for t in sets))
    assert len(list(itertools.chain(*got))) > 0


TREE = {"A": "BC", "B": "DE", "C": "F", "F": "GH"}


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("seed", range(2))
def test_branches_equal_brute_force_in_any_form(spark, monkeypatch, seed, small):
    """Nested branches, broadcast or dealt in parts, in arrays of a few ids, with edges given twice."""
    rng = random.Random(seed)
    children = {}
    for p, cs in TREE.items():
        for i in range(3):
            for c in cs:
                for j in rng.sample(range(4), rng.randint(0, 3)):
                    children.setdefault((f"{p}{i}", p), []).append((f"{c}{j}", c))
    monkeypatch.setattr(spanning, "PACK", 1)
    monkeypatch.setattr(spanning, "ROWS_A_TASK", 2)
    monkeypatch.setattr(spanning, "BROADCAST_ROWS", 1000 if small else 0)
    edges = edges_of(spark, children)
    want = sorted(sorted(s) for root in sorted(p for p in children if p[1] == "A") for s in brute(root, children))
    assert as_sets(spanning.spanning_table(edges.union(edges), "A"), "A") == want


def test_products_are_made_last_and_not_shuffled(spark):
    """Rows times 2,000 siblings: what is shuffled or sorted grows with the edges, not with their product."""
    def links(child, parent, at):
        return spark.range(2000).select(F.concat(F.lit(child), "id").alias("src_id"), F.lit(child).alias("src_name"), at.alias("dst_id"), F.lit(parent).alias("dst_name"))

    edges = links("B", "A", F.lit("a")).union(links("D", "A", F.lit("a"))).union(links("E", "B", F.concat(F.lit("B"), "id")))
    table = spanning.spanning_table(edges, "A", {("A", "B"), ("A", "D"), ("B", "E")}, unique=True)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" in plan and not any(x in plan[: plan.index("Generate inline")] for x in ("Exchange", "Sort", "Join"))
    assert table.rdd.getNumPartitions() >= 4 and table.columns == ["A", "B", "D", "E"]
    assert table.agg(F.count("*"), F.countDistinct("D", "E")).first()[:] == (4_000_000, 4_000_000)


def test_a_child_without_an_id_is_a_row_of_nulls(spark):
    edges = spark.createDataFrame([("b", "B", "a", "A"), ("d", "D", "a", "A"), (None, "D", "a", "A")], "src_id string, src_name string, dst_id string, dst_name string")
    got = {tuple(r) for r in spanning.spanning_table(edges, "A", {("A", "B"), ("A", "D")}).collect()}
    assert got == {("a", "b", "d"), ("a", "b", None)}


@pytest.mark.parametrize("cyclic", [False, True])
def test_document_texts_are_those_of_documents(spark, cyclic):
    ids = ['"', "\\", "{x}", "}", "{", ",", "é😀", "\n\t\x01", "", "</a>", "null"]
    edges = [(b, "B", a, 'A "1"') for a in ids for b in (a, "b")] + [(None, "B", "}", 'A "1"')] + [(d, "D}", a, 'A "1"') for a in ids[:4] for d in ids] + [(e, "E", b, "B") for b in ids[3:] for e in ids[:3]]
    edges = spark.createDataFrame(edges + [("x", "B", "E", "E")] * cyclic, "src_id string, src_name string, dst_id string, dst_name string")
    want = sorted(r.document for r in spanning.documents(spanning.spanning_table(edges, 'A "1"')).collect())
    assert sorted(r.document for r in spanning.document_texts(edges, 'A "1"').collect()) == want and len(want) > 40


def test_documents_query_writes_json_before_rows_multiply(spark):
    """Members of the texts are made from the edges, and rows are made once: nothing is numbered, as no number is asked for."""
    from nodeloom.plans import catalog_queries

    if not (data := Path("/root/testdata/sf0.001")).exists():
        pytest.skip("no test data")
    plan = catalog_queries.QUERIES["spanning_documents"](spark, str(data))._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Generate inline")]
    assert "Json" in plan and not any(x in top for x in ("Json", "Exchange", "Sort", "Join", "Window")) and plan.count("Generate inline") == 1
