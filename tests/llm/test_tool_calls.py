import json
import random

from pyspark.sql import functions as F

from nodeloom.llm import tool_calls as T

CALLS = "conv long, id string, name string, arguments string, needs array<string>"


def test_levels_equal_brute_force(spark):
    rng, rows, want = random.Random(3), [], {}
    for conv in range(30):
        n = rng.randint(1, 9)
        for i in range(n):
            needs = [str(j) for j in range(n) if rng.random() < (0.25 if j < i else 0.02)] + ["gone"] * (rng.random() < 0.1)
            rows.append((conv, str(i), "f", "{}", needs))
        deps = {str(i): [x for x in rows[-n + i][4] if x != "gone"] for i in range(n)}
        level, left = {}, dict(deps)
        while ready := [i for i, d in left.items() if all(x in level for x in d)]:
            r = 1 + max(level.values(), default=-1)
            for i in ready:
                del left[i]
            level |= dict.fromkeys(ready, r)
        want |= {(conv, i): level.get(i, -1) for i in deps}
    got = {(r.conv, r.id): r.level for r in T.levels(spark.createDataFrame(rows, CALLS)).collect()}
    assert got == want


def test_linked(spark):
    schemas = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 9}, "s": {"type": ["string", "null"], "enum": ["x", None]}, "l": {"type": "array", "items": {"type": "number"}, "maxItems": 2}}, "additionalProperties": False}}
    calls = spark.createDataFrame(
        [
            (1, "a", "add", '{"s":"x", "a":2.0}', ["b"]),
            (1, "b", "add", '{"a":10,"l":[1,"q",3],"zz":1}', []),
            (1, "c", "nope", "{}", ["missing"]),
            (1, "d", "add", "{broken", None),
            (2, "a", "add", None, []),
            (2, None, "add", '{"a":1}', []),
            (None, "a", "add", '{"a":true}', []),
            (3, "x", "add", '{"a":1}', ["y"]),
            (3, "y", "add", '{"a":1}', ["x"]),
            (4, "r", "add", '{"a":1,"s":"é"}', []),
            (4, "r", "add", '{"a":1,"s":"é"}', []),
        ],
        CALLS,
    ).withColumn("level", F.lit("clash")).drop("level")
    results = spark.createDataFrame([(1, "a", "A2"), (1, "a", "A1"), (2, "q", "lost"), (4, "r", None), (None, None, "n")], "conv long, id string, content string")
    got = sorted(T.linked(calls, results, schemas).collect(), key=lambda r: (str(r.conv), str(r.id), str(r.json)))
    short = [(r.conv, r.id, r.status, r.level, r.n_results, r.valid) for r in got]
    assert short == [
        (1, "a", "linked", 1, 2, True),
        (1, "a", "repeated", None, 1, None),
        (1, "b", "unanswered", 0, 0, False),
        (1, "c", "unanswered", 0, 0, False),
        (1, "d", "unanswered", 0, 0, False),
        (2, None, "unanswered", None, 0, True),
        (2, "a", "unanswered", 0, 0, False),
        (2, "q", "orphan", None, 1, None),
        (3, "x", "unanswered", -1, 0, True),
        (3, "y", "unanswered", -1, 0, True),
        (4, "r", "linked", 0, 1, False),
        (4, "r", "linked", 0, 1, False),
        (None, None, "orphan", None, 1, None),
        (None, "a", "unanswered", None, 0, False),
    ]
    assert got[0].json == '{"arguments":{"a":2,"s":"x"},"depends_on":["b"],"id":"a","name":"add","result":"A1"}'
    assert got[1].json == '{"id":"a","result":"A2"}'
    got = got[1:]
    assert got[1].problems == ["$.a: out of range", "$.l: number of items", "$.l[1]: not of type number", "$.zz: not allowed"]
    assert got[2].problems == ["$: no schema for this name", "unknown dependency missing"] and got[3].problems == ["$: not JSON"]


def test_turns(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi ü"), (1, 2, "assistant", "hello"), (2, 0, "user", None), (2, 1, "assistant", "?"), (3, 4, "assistant", "late"), (3, 5, "user", "x " * 100000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"id": F.lit(1), "level": F.lit(2), "name": F.lit("n")})
    got = {(r.conv, r.id): r for r in T.linked(*T.turns_as_calls(frame), T.TURN_SCHEMAS).collect()}
    assert {k: (r.status, r.level, r.valid) for k, r in got.items()} == {(1, "0"): ("unanswered", 0, True), (1, "1"): ("linked", 1, True), (2, "0"): ("linked", 0, False), (3, "3"): ("orphan", None, None), (3, "5"): ("unanswered", 0, False)}
    assert json.loads(got[1, "1"].json) == {"arguments": {"prompt": "hi ü", "turn": 1}, "depends_on": ["0"], "id": "1", "name": "respond", "result": "hello"}
    assert T.linked(*T.turns_as_calls(frame.limit(0)), T.TURN_SCHEMAS).count() == 0


def test_no_argument_text_fails(spark):
    texts = ['{"a":"\\ud800"}', "[" * 100_000, '{"a":' * 900 + "1" + "}" * 900, '{"a":NaN}', '{"a":-Infinity}', '{"a":1e999}', "", None, '{"a":1e300}', '"\\ud83d\\ude00"', "1" * 5000, '{"k":"' + "x" * 10**6 + '"}', '{"\\udfff":1}']
    calls = spark.createDataFrame([(1, str(i), "f", x, []) for i, x in enumerate(texts)], CALLS)
    got = {int(r.id): r for r in T.linked(calls, spark.createDataFrame([], "conv long, id string, content string"), {"f": {}}).collect()}
    assert len(got) == len(texts)
    broken = [i for i in got if got[i].problems == ["$: not JSON"]]
    assert {0, 1, 3, 4, 5, 6, 7, 10, 12} <= set(broken) and not {8, 9, 11} & set(broken)
    for r in got.values():
        json.loads(r.json, parse_constant=lambda x: 1 / 0)
        if r.id in map(str, broken):
            assert json.loads(r.json)["arguments"] == texts[int(r.id)]


def test_no_result_is_lost(spark):
    calls = spark.createDataFrame([(1, "a", "f", "{}", []), (1, "a", "f", "{}", [])], CALLS)
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (1, "a", None), (1, None, "n1"), (1, None, "n1"), (None, "a", "n2"), (2, "o", None), (2, "o", "z"), (2, "o", "z")]
    got = [(r.conv, r.id, r.status, r.n_results, json.loads(r.json)["result"]) for r in T.linked(calls, spark.createDataFrame(rows, "conv long, id string, content string"), {"f": {}}).collect()]
    want = [(1, "a", "linked", 4, "x")] * 2 + [(1, "a", "repeated", 1, x) for x in ("x", "y", None)] + [(1, None, "orphan", 1, "n1")] * 2 + [(None, "a", "orphan", 1, "n2"), (2, "o", "orphan", 3, "z"), (2, "o", "repeated", 1, "z"), (2, "o", "repeated", 1, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_turns_of_unknown_roles(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "tool", "t"), (1, 2, None, None), (1, 3, "assistant", "late")]
    got = sorted((r.id, r.status, r.json) for r in T.linked_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert [x[:2] for x in got] == [("0", "unanswered"), ("1", "unknown role"), ("2", "orphan"), ("2", "unknown role")] and got[3][2] == '{"id":"2","result":null}'
