"""Chat formatting: tool calls linked with their results.

Messages are rows (conv_id, turn, role, content, call_id, name, arguments, answers): a row with a
``call_id`` is a call with JSON arguments, a row with ``answers`` is the result of that call.
Calls and results are hash-joined by (conv_id, identifier).  Calls are ordered topologically:
an argument ``"@<identifier>"`` refers to another call of the conversation, and a call's level is
one more than the highest level it refers to (0 without references).  References, which are two
numbers each, are dealt to blocks of ``block`` turns of a conversation, and a task orders a block of
them in one pass; a conversation of several blocks takes a round for each time that a chain goes
from one block to another.  What gets no level lies on or behind a cycle.  Arguments are validated
against the schema of the call's name, and every row is serialised as canonical JSON: sorted keys,
no blanks, numbers as short as they can be.

One row comes back for each message, never one for a conversation, so a conversation of any length
is spread over tasks.  Its place is the key (level, turn): a result takes its call's level.

Null conv_ids are one conversation of their own.  Status is ``linked``, ``pending`` (a call without
result), ``orphan`` (a result without call), ``repeated`` (a further call or result of one
identifier: the one of the least turn is linked), ``cycle``, ``unknown`` (refers to a call that
isn't there, or to one that does) or ``message``.  Invalid JSON (with NaN, infinite numbers and
halves of surrogate pairs), null arguments, unknown names and unknown types of a schema are errors
of the row, not of the job.  As in JSON, 1.0 is an integer and equals 1, and true doesn't.  Null contents are JSON null; repeated rows are each returned; an empty table gives
an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.session import cut, discard, prepare

COLUMNS = ("conv_id", "turn", "role", "content", "call_id", "name", "arguments", "answers")
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """One text for equal JSON values; ValueError for numbers that JSON can't write."""

    def plain(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed_json(text: str):
    """A JSON value; ValueError for anything that standard JSON or UTF-8 can't write."""

    def refuse(name: str):
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def is_kind(value, kind: str) -> bool:
    if isinstance(value, bool) and kind in ("integer", "number"):
        return False
    return isinstance(value, KINDS[kind]) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def violations(value, schema: dict | bool, path: str = "$") -> list[str]:
    """Where a value breaks a schema (true, false, or type, one or several, enum, required, properties,
    additionalProperties, items, minimum, maximum, minLength, maxLength)."""
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: not allowed"]
    out = []
    kinds = schema.get("type")
    if kinds:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if unknown := [k for k in kinds if k not in KINDS]:
            return [f"{path}: no type {unknown[0]}"]
        if not any(is_kind(value, k) for k in kinds):
            return [f"{path}: not {' or '.join(kinds)}"]
    if "enum" in schema and canonical(value) not in {canonical(x) for x in schema["enum"]}:
        out.append(f"{path}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{path}: below minimum"] if value < schema.get("minimum", value) else []
        out += [f"{path}: above maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        out += [f"{path}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{path}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
    return out


def referred(value) -> set[str]:
    """Identifiers that a JSON value refers to."""
    if isinstance(value, str):
        return {value[1:]} if len(value) > 1 and value[0] == "@" else set()
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(referred, parts))


def _parsed(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Rows with errors, refs and the canonical arguments of calls."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                errors, refs, texts = [], [], []
                for call_id, name, arguments in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    found, named, text = [], set(), None
                    if call_id is not None:
                        try:
                            value = parsed_json(arguments) if arguments is not None else None
                            canonical(value).encode()
                            found = violations(value, schemas[name]) if name in schemas else [f"$: no schema for {name}"]
                            named, text = referred(value), canonical(value)
                        except (ValueError, RecursionError) as e:
                            found = [f"$: no JSON ({type(e).__name__})"]
                    errors.append(found)
                    refs.append(sorted(named))
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(errors, pa.list_(pa.string())), pa.array(refs, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["__row", "errors", "refs", "canonical_arguments"])

    return rows.select("__row", "call_id", "name", "arguments").mapInArrow(parse, "__row long, errors array<string>, refs array<string>, canonical_arguments string")


def ordered(rows: list[int], refs: list[int | None], known: list[int | None]) -> dict[int, int]:
    """Levels of the calls of a block, from its references (a call, the call referred to or None, and
    the level of that if it was found already): -1 where a reference, or one that it needs, isn't
    there.  Calls that can't be told yet aren't listed."""
    level: dict[int, int] = {}
    needs: dict[int, int] = {}
    behind: dict[int, list[int]] = {}
    top: dict[int, int] = {}
    own, lost = set(rows), []
    for x, ref, at in zip(rows, refs, known, strict=True):
        needs.setdefault(x, 0)
        if ref is None or at == -1:
            lost.append(x)
        elif at is not None:
            top[x] = max(top.get(x, -1), at)
        else:
            needs[x] += 1
            if ref in own:
                behind.setdefault(ref, []).append(x)
    while lost:
        x = lost.pop()
        if x not in level:
            level[x] = -1
            lost += behind.get(x, ())
    ready = [x for x, n in needs.items() if not n and x not in level]
    while ready:
        x = ready.pop()
        level[x] = top.get(x, -1) + 1
        for y in behind.get(x, ()):
            top[y], needs[y] = max(top.get(y, -1), level[x]), needs[y] - 1
            if not needs[y] and y not in level:
                ready.append(y)
    return level


def levels(calls: DataFrame, block: int) -> DataFrame:
    """(conv, call_id, turn, row, refs) as (row, level) of the calls that have one, without those that
    refer to none: -1 where a reference, or one that it needs, isn't there."""
    there = calls.select("conv", F.col("call_id").alias("name"), F.col("row").alias("ref"), F.when(F.size("refs") == 0, 0).alias("known"))
    edges = calls.select("conv", "turn", "row", F.explode("refs").alias("name")).join(there, ["conv", "name"], "left")
    part = F.floor(F.coalesce("turn", F.lit(0)) / F.lit(block))
    edges = edges.select("row", "ref", F.xxhash64("conv", part).alias("block"), "known")
    big = cut(edges.groupBy("block").agg(F.ceil(F.count("*") / F.lit(4 * block)).cast("int").alias("parts")).filter("parts > 1"), "big")
    if not big.isEmpty():  # many calls of a turn
        edges = edges.join(F.broadcast(big), "block", "left").withColumn("block", F.xxhash64("block", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))))).drop("parts")
    edges = cut(edges, "edges")
    discard(big)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple[list, list, list] = ([], [], [])
        last = None
        for batch in batches:
            for b, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != last and own[0]:
                    yield found(own)
                    own = ([], [], [])
                last = b
                for column, value in zip(own, x, strict=True):
                    column.append(value)
        if own[0]:
            yield found(own)

    def found(own: tuple[list, list, list]) -> pa.RecordBatch:
        level = ordered(*own)
        return pa.RecordBatch.from_arrays([pa.array(list(level), pa.int64()), pa.array(list(level.values()), pa.int32())], names=["row", "level"])

    every: DataFrame | None = None
    while True:
        new = cut(edges.select("block", "row", "ref", "known").repartition("block").sortWithinPartitions("block").mapInArrow(order, "row long, level int"), "levels")
        every = new if every is None else every.union(new)
        left = edges.join(new.select("row"), "row", "left_anti")
        told = left.join(new.select(F.col("row").alias("ref"), F.col("level").alias("now")), "ref", "left")
        told = cut(told.select("block", "row", "ref", F.coalesce("known", "now").alias("known"), F.col("now").isNotNull().alias("moved")), "edges")
        discard(edges)
        edges = told
        if edges.filter("moved").isEmpty():
            return every


def linked(messages: DataFrame, schemas: dict[str, dict], *, block: int = 1 << 14) -> DataFrame:
    """Every message with its status, level, the turn it is linked with, its errors and its JSON."""
    prepare(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.col(c).cast("string").alias(c) for c in COLUMNS[2:]))
    rows = cut(rows.withColumns({"__row": F.monotonically_increasing_id(), "conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))}), "messages")
    parsed = cut(_parsed(rows, schemas), "parsed")
    # of an identifier, the row of the least turn is the call and the result
    order = F.struct(F.col("turn").isNull(), "turn", "__row")
    calls = rows.filter("call_id is not null").groupBy("conv", "call_id").agg(F.min(order).alias("at"))
    calls = cut(calls.select("conv", "call_id", F.col("at.turn").alias("call_turn"), F.col("at.__row").alias("__row")), "calls")
    results = rows.filter("answers is not null").groupBy("conv", F.col("answers").alias("call_id")).agg(F.min(order).alias("at"))
    results = results.select("conv", "call_id", F.col("at.turn").alias("result_turn"), F.col("at.__row").alias("result_row"))
    known = calls.join(parsed.select("__row", "refs"), "__row")
    known = cut(known.select("conv", "call_id", F.col("call_turn").alias("turn"), F.col("__row").alias("row"), "refs"), "known")
    level = known.select("row", F.size("refs").alias("n")).join(levels(known, block), "row", "left")
    level = level.select(F.col("row").alias("call_row"), F.when(F.col("n") == 0, 0).otherwise(F.col("level")).alias("level"))
    pairs = calls.withColumnRenamed("__row", "call_row").join(results, ["conv", "call_id"], "full_outer").join(level, "call_row", "left")
    pairs = cut(pairs, "pairs")

    key = F.coalesce("call_id", "answers")
    out = rows.withColumn("identifier", key).join(pairs.withColumnRenamed("call_id", "identifier"), ["conv", "identifier"], "left").join(parsed, "__row")
    is_call, is_result = F.col("call_id").isNotNull(), F.col("call_id").isNull() & F.col("answers").isNotNull()
    repeated = (is_call & (F.col("call_row") != F.col("__row"))) | (is_result & (F.col("result_row") != F.col("__row")))
    status = (
        F.when(~is_call & ~is_result, "message").when(repeated, "repeated").when(is_result & F.col("call_row").isNull(), "orphan")
        .when(F.col("level").isNull(), "cycle").when(F.col("level") == -1, "unknown")
        .when(is_call & F.col("result_row").isNull(), "pending").otherwise("linked")
    )
    out = out.select(
        "conv_id", "turn", "role", "identifier", "name", status.alias("status"), F.when(F.col("level") >= 0, F.col("level")).alias("level"),
        F.when(is_call, F.col("result_turn")).when(is_result, F.col("call_turn")).alias("linked_turn"), "errors", "content", "canonical_arguments", is_call.alias("is_call"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = []
                for x in part.to_pylist():
                    head = f'{{"content":{canonical(x["content"])},"role":{canonical(x["role"])}'
                    if x["is_call"]:
                        head += f',"tool_call":{{"arguments":{x["canonical_arguments"] or "null"},"id":{canonical(x["identifier"])},"name":{canonical(x["name"])}}}'
                    elif x["identifier"] is not None:
                        head += f',"tool_call_id":{canonical(x["identifier"])}'
                    texts.append(head + "}")
                yield pa.RecordBatch.from_arrays([*part.columns[:9], pa.array([not x for x in part.column(8).to_pylist()], pa.bool_()), pa.array(texts, pa.string())], names=[*part.schema.names[:9], "valid", "json"])

    return out.mapInArrow(write, "conv_id long, turn long, role string, identifier string, name string, status string, level int, linked_turn long, errors array<string>, valid boolean, json string")


SCHEMAS = {
    "ask": {
        "type": "object", "required": ["text", "chars"], "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1}, "chars": {"type": "integer", "minimum": 1}, "after": {"type": "string"}, "also": {"type": "array", "items": {"type": "string"}}},
    }
}


def as_calls(conversations: DataFrame) -> DataFrame:
    """Conversations as calls and results: what a user says calls ``ask``, an assistant's turn
    answers the turn before.  A call refers to the one two turns before it (``after``), every third
    call to the two before that, too (``also``); in every 50th conversation the first call refers to
    the second, so that these lie on a cycle and the rest behind it."""
    user, assistant, turn = F.col("role") == "user", F.col("role") == "assistant", F.col("turn")
    at = lambda back: F.format_string("c%d", turn - back)
    ref = lambda back: F.concat(F.lit("@"), at(back))
    after = F.when(turn >= 2, ref(2)).when(F.pmod("conv_id", F.lit(50)) == 7, ref(-2))
    also = F.when((turn >= 6) & (F.floor(turn / 2) % 3 == 0), F.array(ref(4), ref(6)))
    arguments = F.to_json(F.struct("text", F.length("text").alias("chars"), after.alias("after"), also.alias("also")))
    return conversations.select("conv_id", "turn", "role", F.col("text").alias("content"), F.when(user, at(0)).alias("call_id"), F.when(user, F.lit("ask")).alias("name"), F.when(user, arguments).alias("arguments"), F.when(assistant, at(1)).alias("answers"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), SCHEMAS)
