"""The command line: ``python -m nodeloom <command>``; what it prints goes to stdout, progress to stderr."""

from __future__ import annotations

import argparse
import json
import logging
import shutil
import sys
import tempfile
from collections.abc import Callable
from pathlib import Path

#: Further commands by name: functions of (spark, arguments after the name).
PLUGINS: dict[str, Callable] = {}
log = logging.getLogger("nodeloom")


def spark_session():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("nodeloom").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    return builder.getOrCreate()


def spooled(path: str) -> str:
    """A path that can be read again; ``-`` is what stdin holds."""
    if path != "-":
        return path
    with tempfile.NamedTemporaryFile("wb", suffix=".avro", delete=False) as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
    return f.name


def emit(graph, output: str) -> None:
    """A container to a path, or to stdout unless that is a terminal."""
    from nodeloom.sources.container import write_container

    if output != "-":
        write_container(graph, output)
        return
    if sys.stdout.isatty():
        raise SystemExit("binary output: name a file with -o, or redirect")
    with tempfile.TemporaryDirectory() as d:
        write_container(graph, f"{d}/out")
        sys.stdout.buffer.write(Path(f"{d}/out").read_bytes())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("nodeloom")
    top = p.add_subparsers(dest="command", required=True)

    def command(parent, name: str, *arguments, **flags):
        c = parent.add_parser(name)
        for a in arguments:
            c.add_argument(a[0], **(a[1] if len(a) > 1 else {}))
        for k, v in flags.items():
            c.add_argument(*([f"-{k[0]}", f"--{k}"]), **v)
        return c

    from_ = top.add_parser("from")
    from_.add_argument("-o", "--output", default="-")
    kinds = from_.add_subparsers(dest="kind", required=True)
    command(kinds, "dict", ("dictionary",))
    for kind in ("json", "tsv"):
        c = command(kinds, kind, ("path", {"nargs": "?", "default": "."}), schema={"required": True})
        c.add_argument("--program", required=True)
        c.add_argument("--project", required=True)
    to = top.add_parser("to")
    to.add_argument("-i", "--input", default="-")
    kinds = to.add_subparsers(dest="kind", required=True)
    command(kinds, "gremlin", ("output", {"nargs": "?", "default": "./gremlin/"})).add_argument("--gzip", action=argparse.BooleanOptionalAction, default=True)
    command(kinds, "tsv", ("output", {"nargs": "?", "default": "./tsvs/"}))
    show = top.add_parser("show")
    show.add_argument("-i", "--input", default="-")
    show.add_argument("-n", "--limit", type=int)
    kinds = show.add_subparsers(dest="kind")
    for kind in ("nodes", "schema", "encoded-schema", "metadata", "stats"):
        command(kinds, kind, *([] if kind == "nodes" else [("node", {"nargs": "?"})]))
    command(top, "make", ("name",), input={"default": "-"})
    command(top, "add", ("container",), input={"default": "-"})
    rename = top.add_parser("rename")
    rename.add_argument("-i", "--input", default="-")
    rename.add_argument("-o", "--output", default="-")
    kinds = rename.add_subparsers(dest="kind", required=True)
    command(kinds, "node", ("old",), ("new",))
    command(kinds, "enum", ("field",), ("old",), ("new",))
    command(top, "etl", ("container",), url={"required": True}, token={"default": ""}, node={"required": True})
    for name in PLUGINS:
        top.add_parser(name).add_argument("rest", nargs=argparse.REMAINDER)
    return p


def run(a: argparse.Namespace) -> None:
    from nodeloom.operators import export, http_sink
    from nodeloom.operators.graph import Graph
    from nodeloom.sources import catalog, container, ingest

    if a.command == "show" and a.kind in ("nodes", "schema", "encoded-schema", "metadata"):  # no job is needed
        found = container.read_catalog(spooled(a.input))
        graph = Graph(None, found)
        if a.kind == "nodes":
            print("\n".join(found.names))
        else:
            text = graph.schema_json(encoded=True) if a.kind == "encoded-schema" else (graph.schema_json if a.kind == "schema" else graph.metadata_json)(a.node)
            if text is not None:
                print(text)
        return
    if a.command == "make":
        print(json.dumps(container.read_catalog(spooled(a.input)).blank(a.name)))
        return
    spark = spark_session()
    if a.command in PLUGINS:
        PLUGINS[a.command](spark, a.rest)
    elif a.command == "from" and a.kind == "dict":
        about = catalog.from_dictionary(a.dictionary)
        emit(Graph(ingest._union(spark, []), about), a.output)
    elif a.command == "from":
        read = ingest.from_json if a.kind == "json" else ingest.from_tsv
        emit(read(spark, a.path, container.read_catalog(a.schema), a.program, a.project), a.output)
    elif a.command == "add":
        # The file is read before it is written anew, so the result is made beside it first.
        graph = container.read_container(spark, a.container).append_json_lines(spooled(a.input))
        container.write_container(graph, a.container + ".new")
        Path(a.container + ".new").replace(a.container)
    elif a.command == "etl":
        http_sink.etl(container.read_container(spark, a.container), a.node, a.url, a.token)
    else:
        graph = container.read_container(spark, spooled(a.input))
        if a.command == "show" and a.kind == "stats":
            for r in graph.stats().collect():
                print(f"{r.name}\t{r.n_nodes}")
            t = graph.totals().first()
            print(f"{t.n_nodes} nodes of {t.n_types} types, {t.n_edges} edges")
        elif a.command == "show":
            for r in graph.show(a.limit).toLocalIterator():
                print(r.entity)
        elif a.command == "to":
            names = export.write_gremlin(graph, a.output, a.gzip) if a.kind == "gremlin" else export.write_tsv(graph, a.output)
            log.info("%d node types", len(names))
        elif a.kind == "node":
            emit(graph.rename_node(a.old, a.new), a.output)
        else:
            emit(graph.rename_enum(a.field, a.old, a.new), a.output)


def main(arguments: list[str] | None = None) -> None:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(levelname)s %(name)s: %(message)s")
    a = parser().parse_args(arguments)
    try:
        run(a)
    except Exception:
        print("Failed!", file=sys.stderr)
        raise
    log.info("done")
