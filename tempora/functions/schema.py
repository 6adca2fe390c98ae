"""Checking JSON values against a schema: every failing path is told.

Known keywords: type (one or several), enum, pattern, minLength, maxLength, minimum, maximum,
exclusiveMinimum, exclusiveMaximum, minItems, maxItems, items, required, properties,
additionalProperties (false or a schema), oneOf (at least one form must fit), $ref to #/definitions.
"""

from __future__ import annotations

import json
import re
from typing import Any

NAMES = ((bool, "boolean"), (type(None), "null"), (str, "string"), (dict, "object"), (list, "array"), ((int, float), "number"))


def kind_of(value: Any) -> str:
    return next(name for kind, name in NAMES if isinstance(value, kind))


def same(a: Any, b: Any) -> bool:
    """Equality of JSON values: true isn't 1."""
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) or (kind_of(a) == kind_of(b) == "number" and a == b)


class Checker:
    def __init__(self, schema: dict):
        self.root = schema
        self.found: list[str] = []

    def say(self, path: str, text: str) -> None:
        self.found.append(f"{path}: {text}")

    def check(self, value: Any, schema: dict | bool, path: str = "$", depth: int = 0) -> None:
        if isinstance(schema, bool):
            return None if schema else self.say(path, "nothing is allowed here")
        if "$ref" in schema:
            name = str(schema["$ref"])
            target = self.root.get("definitions", {}).get(name.removeprefix("#/definitions/")) if name.startswith("#/definitions/") else None
            if target is None or depth > 200:
                raise ValueError(f"schema: {name} leads nowhere")
            return self.check(value, target, path, depth + 1)
        if "oneOf" in schema:
            return self.one_of(value, schema["oneOf"], path)
        wanted = schema.get("type", [])
        wanted = [wanted] if isinstance(wanted, str) else wanted
        kind = kind_of(value)
        whole = kind == "number" and float(value).is_integer()
        if wanted and kind not in wanted and not (whole and "integer" in wanted):
            return self.say(path, f"is {kind}, not {' or '.join(wanted)}")
        if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
            self.say(path, f"{json.dumps(value)} is none of {json.dumps(schema['enum'])}")
        getattr(self, f"check_{kind}", lambda *_: None)(value, schema, path)
        return None

    def one_of(self, value: Any, forms: list, path: str) -> None:
        reasons = []
        for form in forms:
            inner = Checker(self.root)
            inner.check(value, form, path)
            if not inner.found:
                return
            reasons.append(inner.found[0])
        self.say(path, "fits no form (" + " | ".join(reasons) + ")")

    def check_string(self, value: str, schema: dict, path: str) -> None:
        if "pattern" in schema and not re.search(schema["pattern"], value):
            self.say(path, f"doesn't match {schema['pattern']}")
        self.bounds(len(value), schema, path, ("minLength", "maxLength"), "characters")

    def check_array(self, value: list, schema: dict, path: str) -> None:
        self.bounds(len(value), schema, path, ("minItems", "maxItems"), "items")
        for i, x in enumerate(value if "items" in schema else ()):
            self.check(x, schema["items"], f"{path}[{i}]")

    def check_number(self, value: float, schema: dict, path: str) -> None:
        self.bounds(value, schema, path, ("minimum", "maximum"), "")
        if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            self.say(path, f"{value} is not over {schema['exclusiveMinimum']}")
        if "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            self.say(path, f"{value} is not under {schema['exclusiveMaximum']}")

    def check_object(self, value: dict, schema: dict, path: str) -> None:
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        for name in schema.get("required", ()):
            if name not in value:
                self.say(path, f"{name} is missing")
        for name, x in value.items():
            if name in known:
                self.check(x, known[name], f"{path}.{name}")
            elif others is False:
                self.say(path, f"{name} is unknown")
            elif isinstance(others, dict):
                self.check(x, others, f"{path}.{name}")

    def bounds(self, n: float, schema: dict, path: str, names: tuple[str, str], unit: str) -> None:
        low, high = (schema.get(x) for x in names)
        if low is not None and n < low:
            self.say(path, f"{n} {unit}".rstrip() + f" is under {low}")
        if high is not None and n > high:
            self.say(path, f"{n} {unit}".rstrip() + f" is over {high}")


def problems(text: str | None, schema: dict) -> list[str]:
    """What is wrong with a JSON text; text that isn't JSON is one problem."""
    try:
        value = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return ["$: no JSON"]
    checker = Checker(schema)
    try:
        checker.check(value, schema)
    except RecursionError:
        return ["$: too deep"]
    return checker.found
