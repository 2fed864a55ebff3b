"""Tool-call linking: calls meet their results by identifier, in topological order, validated and as canonical JSON.

Calls and results are hash-joined on (conversation, identifier); of an identifier's results the least
text is joined to its calls and each other one is a row of its own (``repeated``), so none is lost and no pairs multiply. A call's level is the longest chain of dependencies below it,
found in rounds: each places the calls that wait for none unplaced, by anti joins over all
conversations at once, and writes what is left to the shared folder. No conversation is gathered in a task.

Defined cases: calls of one identifier are rows of their own, a dependency waits for all of them; of
several results the least text (null last) is taken and their number told; a result without a call is an
``orphan``, a call without a result ``unanswered``; unknown dependencies are told and don't count;
calls on a cycle have level -1; null identifiers link with nothing, each such result is an orphan of its own; arguments
that are null or no JSON (broken, NaN and infinite numbers, lone surrogates, nested deeper than Python
parses) are a problem of validation and stay as they came; turns of unknown or null roles have a status of their own;
texts of any length are parsed whole; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import Scratch, stored

_TYPES = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "integer": lambda x: (isinstance(x, int) and not isinstance(x, bool)) or (isinstance(x, float) and x.is_integer()),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
}


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What of the value breaks a JSON Schema of the keywords below, in order."""
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    if "enum" in schema and not any(value == x and isinstance(value, bool) == isinstance(x, bool) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += problems(value[k], schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            out.append(f"{at}: number of items")
        for i, x in enumerate(value if "items" in schema else []):
            out += problems(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        out.append(f"{at}: length")
    if _TYPES["number"](value) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        out.append(f"{at}: out of range")
    return out


def canonical(value: object) -> str:
    """Sorted keys, no spaces, whole floats as integers, characters as they are. ValueError for what JSON or UTF-8 can't say."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() else x

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    text.encode()
    return text


def _refused(name: str):
    raise ValueError(name)


def _finite(text: str) -> float:
    x = float(text)
    return x if math.isfinite(x) else _refused(text)


def parsed(arguments: str | None, schema: dict | None) -> tuple[object, list[str]]:
    """The arguments and what is wrong with them; no text makes this fail."""
    try:
        value = json.loads(arguments or "", parse_constant=_refused, parse_float=_finite)
        canonical(value)
        return value, ["$: no schema for this name"] if schema is None else problems(value, schema)
    except (ValueError, RecursionError):
        return arguments, ["$: not JSON"]


def levels(calls: DataFrame) -> DataFrame:
    """conv, id, level, unknown (dependencies that no call has) of every identifier; calls: conv, id, needs array<string>."""
    with Scratch(calls.sparkSession) as scratch:
        known = stored(calls.filter("conv is not null and id is not null").select("conv", "id", "needs"), "calls")
        left = stored(known.select("conv", "id").distinct(), "left")
        names = left.withColumnRenamed("id", "need")
        needs = known.select("conv", "id", F.explode("needs").alias("need")).distinct()
        open_needs = stored(needs.join(names, ["conv", "need"], "left_semi").select("conv", "id", "need"), "needs")
        unknown = needs.join(names, ["conv", "need"], "left_anti").groupBy("conv", "id").agg(F.sort_array(F.collect_set("need")).alias("unknown"))
        placed, level = [], 0
        while True:
            ready = stored(left.join(open_needs, ["conv", "id"], "left_anti").withColumn("level", F.lit(level)), "ready")
            if ready.isEmpty():  # nothing is left, or only cycles
                break
            placed.append(ready)
            left = stored(left.join(ready, ["conv", "id"], "left_anti"), "left")
            open_needs = stored(open_needs.join(ready.select("conv", F.col("id").alias("need")), ["conv", "need"], "left_anti").select("conv", "id", "need"), "needs")
            level += 1
        out = left.withColumn("level", F.lit(-1))
        for x in placed:
            out = out.union(x)
        out = stored(out.join(unknown, ["conv", "id"], "left").select("conv", "id", "level", "unknown"), "levels")
        scratch.keep(out)
        return out


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """From calls (conv, id, name, arguments, needs) and results (conv, id, content): conv, id, status, level,
    n_results, valid, problems, json of each call, of each orphan result, and of each further result of an identifier."""
    named = F.col("conv").isNotNull() & F.col("id").isNotNull()
    texts = results.filter(named).groupBy("conv", "id", "content").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("content").isNull().alias("is_null"), F.col("content").alias("content"))
    one = texts.groupBy("conv", "id").agg(F.min(order).alias("least"), F.sum("n").alias("n_results")).select("conv", "id", F.col("least.content").alias("content"), "n_results")
    placed = calls.join(levels(calls), ["conv", "id"], "left").withColumn("what", F.lit("call"))
    # Null identifiers meet nothing in this join, and stay as they are on either side.
    columns = ["conv", "id", "name", "arguments", "needs", "level", "unknown", F.coalesce("what", F.lit("orphan")).alias("what"), "content", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results")]
    both = placed.join(one, ["conv", "id"], "full_outer").select(*columns)
    least = one.select("conv", "id", F.col("content").alias("least"), F.lit(True).alias("known"))
    again = texts.join(least, ["conv", "id"]).withColumn("more", F.col("n") - F.col("content").eqNullSafe(F.col("least")).cast("long")).filter("more > 0")
    further = again.select("conv", "id", "content", F.explode(F.sequence(F.lit(1).cast("long"), F.col("more"))), F.lit("repeated").alias("what")).drop("col")
    alone = results.filter(~named).select("conv", "id", "content", F.lit("orphan").alias("what"))
    both = both.unionByName(further.union(alone.select("conv", "id", "content", "what")).withColumn("n_results", F.lit(1).cast("long")), allowMissingColumns=True)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["what"] != "call":
                    out.append((r["what"], None, [], canonical({"id": r["id"], "result": r["content"]})))
                    continue
                arguments, found = parsed(r["arguments"], schemas.get(r["name"]))
                found += [f"unknown dependency {x}" for x in r["unknown"] or []]
                value = {"id": r["id"], "name": r["name"], "arguments": arguments, "depends_on": sorted(x for x in r["needs"] or [] if x is not None), "result": r["content"]}
                out.append(("linked" if r["n_results"] else "unanswered", not found, found, canonical(value)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            status, valid, found, text = (pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("id"), status, batch.column("level"), batch.column("n_results"), valid, found, text], ["conv", "id", "status", "level", "n_results", "valid", "problems", "json"])

    kind = calls.schema["conv"].dataType.simpleString()
    return both.mapInArrow(run, f"conv {kind}, id string, status string, level int, n_results long, valid boolean, problems array<string>, json string")


#: How plain conversations are read as calls: what users and systems say is a call, what assistants say its result.
TURN_SCHEMAS = {
    "respond": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
    "configure": {"type": "object", "required": ["prompt", "turn"], "properties": {"prompt": {"type": "string"}, "turn": {"type": "integer", "maximum": 0}}},
}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results: a user's turn t is the call ``t`` with the result of turn t + 1 if an assistant's; all calls need the one of turn 0."""
    turn = F.col("turn").cast("string")
    asked = conversations.filter(F.col("role").isin("user", "system")).select(
        F.col("conv_id").alias("conv"),
        turn.alias("id"),
        F.when(F.col("role") == "system", "configure").otherwise("respond").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"),
        F.when(F.col("turn") > 0, F.array(F.lit("0"))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    answered = conversations.filter(F.col("role") == "assistant").select(F.col("conv_id").alias("conv"), (F.col("turn") - 1).cast("string").alias("id"), F.col("text").alias("content"))
    return asked, answered


def linked_turns(conversations: DataFrame) -> DataFrame:
    """Every turn's row: calls with their results, orphans, and turns of roles that are neither (``unknown role``)."""
    known = F.coalesce(F.col("role").isin("user", "system", "assistant"), F.lit(False))
    out = linked(*turns_as_calls(conversations), TURN_SCHEMAS)
    others = conversations.filter(~known).select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("string").alias("id"), F.lit("unknown role").alias("status"), F.lit(None).cast("int").alias("level"), F.lit(0).cast("long").alias("n_results"),
        F.lit(None).cast("boolean").alias("valid"), F.array().cast("array<string>").alias("problems"), F.to_json(F.struct(F.col("turn").cast("string").alias("id"), F.col("text").alias("result")), {"ignoreNullFields": "false"}).alias("json"),
    )
    return out.union(others)
