"""Compiled JSON Schemas against a plain validator, on random values and schemas."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from tracelode.functions import shapes

KINDS = {"object": dict, "array": list, "string": str, "null": type(None)}


def _kind(value, kind):
    if kind == "boolean":
        return isinstance(value, bool)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return number if kind == "number" else number and value == int(value) if kind == "integer" else isinstance(value, KINDS[kind])


def _same(a, b):
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) or (_kind(a, "number") and _kind(b, "number") and a == b)


def plainly(schema, value, root, path=""):
    """Paths at which a value breaks a schema, each as often as it does."""
    if schema is True:
        return []
    if schema is False:
        return [path]
    out, number = [], _kind(value, "number")
    fits = lambda s: not plainly(s, value, root)
    for key, want in schema.items():
        bad = False
        if key == "type":
            bad = not any(_kind(value, k) for k in ([want] if isinstance(want, str) else want))
        elif key == "enum":
            bad = not any(_same(value, x) for x in want)
        elif key == "const":
            bad = not _same(value, want)
        elif key in ("minLength", "maxLength", "pattern") and isinstance(value, str):
            bad = len(value) < want if key == "minLength" else len(value) > want if key == "maxLength" else not re.search(want, value)
        elif key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf") and number:
            bad = {"minimum": value < want, "maximum": value > want, "exclusiveMinimum": value <= want, "exclusiveMaximum": value >= want, "multipleOf": key == "multipleOf" and value / want != int(value // want)}[key]
        elif key == "required" and isinstance(value, dict):
            out += [f"{path}/{k}" for k in want if k not in value]
        elif key == "properties" and isinstance(value, dict):
            out += [e for k, s in want.items() if k in value for e in plainly(s, value[k], root, f"{path}/{k}")]
        elif key == "additionalProperties" and isinstance(value, dict):
            out += [e for k in value if k not in schema.get("properties", {}) for e in plainly(want, value[k], root, f"{path}/{k}")]
        elif key == "items" and isinstance(value, list):
            out += [e for i, x in enumerate(value) if i >= len(schema.get("prefixItems", ())) for e in plainly(want, x, root, f"{path}/{i}")]
        elif key == "prefixItems" and isinstance(value, list):
            out += [e for i, (s, x) in enumerate(zip(want, value)) for e in plainly(s, x, root, f"{path}/{i}")]
        elif key in ("minItems", "maxItems", "uniqueItems") and isinstance(value, list):
            bad = len(value) < want if key == "minItems" else len(value) > want if key == "maxItems" else want and any(_same(a, b) for i, a in enumerate(value) for b in value[:i])
        elif key == "allOf":
            out += [e for s in want for e in plainly(s, value, root, path)]
        elif key in ("anyOf", "oneOf"):
            many = sum(fits(s) for s in want)
            bad = many == 0 if key == "anyOf" else many != 1
        elif key == "not":
            bad = fits(want)
        elif key == "if":
            side = "then" if fits(want) else "else"
            out += plainly(schema[side], value, root, path) if side in schema else []
        elif key == "$ref":
            out += plainly(root["$defs"][want.rsplit("/", 1)[1]], value, root, path)
        out += [path] * bool(bad)
    return out


def _value(draw, depth=3):
    way = draw.randrange(8 if depth else 6)
    if way < 6:
        return draw.choice([None, True, False, 0, 1, 2.0, -3, 2.5, 7, "", "a", "abc", "xyz1", "é"])
    if way == 6:
        return [_value(draw, depth - 1) for _ in range(draw.randint(0, 4))]
    return {draw.choice(["a", "b", "c", "d e"]): _value(draw, depth - 1) for _ in range(draw.randint(0, 4))}


def _schema(draw, depth=2):
    if not depth or draw.random() < 0.15:
        return draw.choice([True, False, {}, {"type": "string"}, {"type": ["integer", "null"]}, {"enum": ["a", 1, None, [1], {"a": 1}]}, {"const": 2}, {"$ref": "#/$defs/name"}])
    inner = lambda: _schema(draw, depth - 1)
    every = {
        "type": draw.choice(["object", "array", "number", "boolean", ["string", "object", "array"]]), "properties": {k: inner() for k in draw.sample(["a", "b", "c"], 2)}, "required": draw.sample(["a", "b", "z"], 2), "additionalProperties": inner(), "items": inner(), "prefixItems": [inner()],
        "minItems": draw.randint(0, 2), "maxItems": 2, "uniqueItems": True, "minLength": 1, "maxLength": 2, "pattern": "^[a-c]+$", "minimum": 1, "maximum": 3, "exclusiveMinimum": 0, "exclusiveMaximum": 7, "multipleOf": 0.5, "allOf": [inner(), inner()], "anyOf": [inner(), inner()], "oneOf": [inner(), inner()], "not": inner(), "if": inner(), "then": inner(), "else": inner(),
    }
    return {k: every[k] for k in draw.sample(sorted(every), draw.randint(1, 3))}


def test_random_schemas(spark):
    draw = random.Random(21)
    values = [_value(draw) for _ in range(150)]
    table = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, text string").repartition(2).cache()
    for batch in range(4):
        schemas = [dict(s, **{"$defs": {"name": {"type": "string", "minLength": 2}}}) if isinstance(s, dict) else s for s in (_schema(draw) for _ in range(6))]
        rows = table.select("i", *[shapes.shape_errors(F.col("text"), s).alias(f"s{k}") for k, s in enumerate(schemas)]).collect()
        for r in rows:
            for k, schema in enumerate(schemas):
                assert sorted(e.rsplit(": ", 1)[0] for e in r[f"s{k}"]) == sorted(plainly(schema, values[r["i"]], schema)), (schema, values[r["i"]])


def test_recursion_and_unreadable_values(spark):
    tree = {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "required": ["v"], "additionalProperties": False, "properties": {"v": {"type": "integer"}, "next": {"$ref": "#/$defs/node"}}}}}
    nest = lambda n: {"v": n, **({"next": nest(n - 1)} if n else {})}
    cases = [json.dumps(nest(3)), json.dumps({"v": 1, "next": {"v": "x", "w": 1}}), json.dumps(nest(shapes.DEPTH + 2)), "{broken", None, "[]"]
    table = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, text string")
    found = [sorted(r["e"]) for r in table.orderBy("i").select(shapes.shape_errors(F.col("text"), tree).alias("e")).collect()]
    assert found == [[], ["/next/v: not of type integer", "/next/w: not allowed"], ["/next" * shapes.DEPTH + ": too deep"], [": not JSON"], [": not JSON"], [": not of type object"]]
    for wrong in ({"format": "date"}, {"$ref": "elsewhere.json"}):
        with pytest.raises(ValueError):
            shapes.shape_errors(F.lit("1"), wrong)
