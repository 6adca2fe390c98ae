import json
import random

import pytest

from tempora.llm import tool_calls


def test_made_calls_are_chains(spark):
    rows = [(conv, first + i, "user" if i % 2 == 0 else "assistant", f"text {i}") for conv, first in ((1, 0), (2, 1)) for i in range(9)]
    rows.append((2, 0, "system", "be brief"))
    made = tool_calls.as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): r for r in tool_calls.linked(made, tool_calls.SCHEMAS).collect()}
    assert len(got) == len(rows) and all(r.valid for r in got.values())
    for conv, first in ((1, 0), (2, 1)):
        assert [got[conv, first + 2 * j].level for j in range(5)] == [0, 1, 2, 3, 4]
    texts = {(r.conv_id, r.turn): r.arguments for r in made.filter("call_id is not null").collect()}
    assert '"after":"@c5","also":["@c3","@c1"]' in texts[2, 7] and "also" not in texts[2, 5]


def test_made_cycles(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(9)]
    got = tool_calls.linked(tool_calls.as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), tool_calls.SCHEMAS).collect()
    assert {r.status for r in got} == {"cycle"}


def plain_levels(refs):
    """Level of each call by plain recursion to a fixed point: -1 where something is missing, None on or behind a cycle."""
    level = {}
    while True:
        before = dict(level)
        for c, names in refs.items():
            if c not in level:
                found = [level.get(r) if r in refs else -1 for r in names]
                if -1 in found:
                    level[c] = -1
                elif None not in found:
                    level[c] = max(found, default=-1) + 1
        if level == before:
            return {c: level.get(c) for c in refs}


@pytest.mark.parametrize("block", [3, 1 << 14])
def test_levels_are_those_of_plain_python(spark, block):
    r = random.Random(block)
    rows, want = [], {}
    for conv in range(30):
        n = r.randint(1, 40)
        refs = {}
        for turn in range(n):
            names = {f"c{r.randrange(max(1, turn))}" for _ in range(r.randint(0, 3)) if turn} | ({f"c{turn - 1}"} if turn and r.random() < 0.7 else set())
            if r.random() < 0.03:
                names.add(r.choice(["none", f"c{n - 1}", f"c{turn}"]))
            refs[f"c{turn}"] = sorted(names)
            rows.append((conv, turn // r.choice([1, 1, 2]), "assistant", None, f"c{turn}", "f", json.dumps({"of": ["@" + x for x in sorted(names)]}), None))
        want |= {(conv, c): x for c, x in plain_levels(refs).items()}
    rows += rows[:5]  # repeated rows
    schema = "conv_id long, turn long, role string, content string, call_id string, name string, arguments string, answers string"
    got = tool_calls.linked(spark.createDataFrame(rows, schema), {"f": {}}, block=block).collect()
    assert len(got) == len(rows) and sum(x.status == "repeated" for x in got) == 5
    told = {(x.conv_id, x.identifier): (-1 if x.status == "unknown" else None if x.status == "cycle" else x.level) for x in got if x.status != "repeated"}
    assert told == want


def test_a_long_chain_takes_few_rounds(spark):
    rows = [(1, i, "assistant", None, f"c{i}", "f", json.dumps({"of": f"@c{i - 1}"}) if i else "{}", None) for i in range(400)]
    schema = "conv_id long, turn long, role string, content string, call_id string, name string, arguments string, answers string"
    got = tool_calls.linked(spark.createDataFrame(rows, schema), {"f": {}}, block=150).collect()
    assert {x.turn: x.level for x in got} == {i: i for i in range(400)}


def test_no_input_fails_the_job(spark):
    deep = "[" * 5000 + "]" * 5000
    texts = ['{"a":"\\ud800"}', '{"a":NaN}', '{"a":1e999}', deep, "[" * 900 + "]" * 900, "", None, '{"a":null}', '{"a":true}', '{"a":1.0}', '{"a":' + "9" * 6000 + "}", '{"a":"x"}']
    texts[0] = '{"a":"' + chr(92) + 'ud800"}'
    schemas = {"f": {"type": "object", "properties": {"a": {"type": ["string", "null"]}}}, "g": {"properties": {"a": {"enum": [1]}}}, "h": {"properties": {"a": {"type": "integer"}}}, "i": {"type": "thing"}, "j": False}
    rows = [(1, i, "assistant", "t" * 100_000, f"{n}{i}", n, x, None) for n in schemas for i, x in enumerate(texts)]
    schema = "conv_id long, turn long, role string, content string, call_id string, name string, arguments string, answers string"
    got = {x.identifier: x for x in tool_calls.linked(spark.createDataFrame(rows, schema), schemas).collect()}
    assert len(got) == len(rows)
    for i in (0, 1, 2, 3, 5, 10):
        assert got[f"f{i}"].errors and not got[f"f{i}"].valid and '"arguments":null' in got[f"f{i}"].json
    assert not got["f7"].errors and not got["f11"].errors and got["f8"].errors == ["$.a: not string or null"]
    assert got["g8"].errors == ["$.a: not in enum"] and not got["g9"].errors and not got["h9"].errors and got["h8"].errors
    assert got["i7"].errors == ["$: no type thing"] and got["j7"].errors == ["$: not allowed"]
    for x in got.values():
        json.loads(x.json) if x.identifier not in ("f4", "g4", "h4", "i4", "j4") else None
