"""JSON Schema as column expressions: what is wrong with a JSON value, and where.

A schema is compiled once to one expression over a variant; validation then is
column work without any Python on executors. Keywords: type (also a list), enum,
const, properties, required, additionalProperties, propertyNames' pattern,
items, prefixItems, minItems, maxItems, uniqueItems, minLength, maxLength,
pattern, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf,
allOf, anyOf, oneOf, not, if/then/else, $ref into $defs. A keyword that is not
here is an error when the schema is compiled, never ignored. References that
lead back to themselves are followed DEPTH levels; values nested deeper are
refused as too deep.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

#: Levels of references that lead back to themselves.
DEPTH = 6
#: Keywords that say nothing about a value.
_SILENT = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "definitions"}
_KNOWN = {"type", "enum", "const", "properties", "required", "additionalProperties", "items", "prefixItems", "minItems", "maxItems", "uniqueItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref"}
#: What each type's values are called by schema_of_variant.
_SHAPES = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "integer": ("BIGINT",)}
_NONE = "array<string>"


def _shape(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _is(value: Column, kind: str) -> Column:
    good = _shape(value).isin(*_SHAPES[kind])
    if kind == "integer":  # 2.0 is a whole number too
        number = F.try_variant_get(value, "$", "double")
        good = good | (_shape(value).isin(*_SHAPES["number"]) & (number == F.floor(number)))
    return F.coalesce(good, F.lit(False))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _canonical(value: Column) -> Column:
    """A value as text in which equal values are equal: whole numbers alike, keys in the variant's own order."""
    number = F.try_variant_get(value, "$", "double")
    return F.when(_is(value, "number"), F.concat(F.lit("#"), number.cast("string"))).otherwise(F.to_json(value))


def _plain(value: Any) -> Column:
    """A constant in the same form."""
    return _canonical(F.parse_json(F.lit(json.dumps(value, ensure_ascii=False))))


class _Compiler:
    def __init__(self, root: dict):
        self.root = root

    def _target(self, ref: str) -> Any:
        if not ref.startswith("#"):
            raise ValueError(f"a reference outside the schema: {ref}")
        found: Any = self.root
        for part in ref[1:].split("/")[1:]:
            found = found[part.replace("~1", "/").replace("~0", "~")]
        return found

    def errors(self, schema: Any, value: Column, path: Column, open_refs: tuple[str, ...] = ()) -> Column:
        """An array of texts ``path: what is wrong``; ``value`` is a variant that is there."""
        if schema is True or schema == {}:
            return F.array().cast(_NONE)
        if schema is False:
            return F.array(F.concat(path, F.lit(": not allowed")))
        if unknown := set(schema) - _KNOWN - _SILENT:
            raise ValueError(f"keywords that are not known: {sorted(unknown)}")
        parts = [part for key in schema if key in _KNOWN and (part := self._keyword(key, schema, value, path, open_refs)) is not None]
        return F.flatten(F.array(*parts)) if parts else F.array().cast(_NONE)

    def _fails(self, schema: Any, value: Column, open_refs: tuple[str, ...]) -> Column:
        return F.size(self.errors(schema, value, F.lit(""), open_refs)) > 0

    def _inside(self, schema: Any, value: Column, path: Column, refs: tuple[str, ...]) -> Column:
        """``errors`` of a part of a value, which is taken out once."""
        return let(value, lambda part: self.errors(schema, part, path, refs))

    @staticmethod
    def _when(bad: Column, path: Column, words: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(path, F.lit(f": {words}")))).otherwise(F.array().cast(_NONE))

    def _keyword(self, key: str, schema: dict, value: Column, path: Column, refs: tuple[str, ...]) -> Column | None:
        wanted, when = schema[key], self._when
        if key == "type":
            kinds = [wanted] if isinstance(wanted, str) else wanted
            good = F.lit(False)
            for kind in kinds:
                good = good | _is(value, kind)
            return when(~good, path, f"not of type {' or '.join(kinds)}")
        if key in ("enum", "const"):
            return when(~_canonical(value).isin(*[_plain(x) for x in (wanted if key == "enum" else [wanted])]), path, f"not {'one of the values' if key == 'enum' else 'the value'}")
        if key in ("minLength", "maxLength", "pattern"):
            text = _text(value)
            bad = F.char_length(text) < wanted if key == "minLength" else F.char_length(text) > wanted if key == "maxLength" else ~text.rlike(wanted)
            return when(_is(value, "string") & bad, path, {"minLength": "too short", "maxLength": "too long", "pattern": "does not match"}[key])
        if key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
            number = F.try_variant_get(value, "$", "double")
            bad = number < wanted if key == "minimum" else number > wanted if key == "maximum" else number <= wanted if key == "exclusiveMinimum" else number >= wanted if key == "exclusiveMaximum" else number / wanted != F.floor(number / wanted)
            return when(_is(value, "number") & bad, path, {"multipleOf": "not a multiple"}.get(key, "too small" if "Minimum" in key or key == "minimum" else "too large"))
        if key in ("properties", "required", "additionalProperties"):
            return self._object(key, schema, value, path, refs)
        if key in ("items", "prefixItems", "minItems", "maxItems", "uniqueItems"):
            return self._array(key, schema, value, path, refs)
        if key == "allOf":
            return F.flatten(F.array(*[self.errors(s, value, path, refs) for s in wanted]))
        if key in ("anyOf", "oneOf"):
            good = [(~self._fails(s, value, refs)).cast("int") for s in wanted]
            many = sum(good[1:], good[0])
            return when(many == 0 if key == "anyOf" else many != 1, path, "fits none" if key == "anyOf" else "fits none or several")
        if key == "not":
            return when(~self._fails(wanted, value, refs), path, "fits what it must not")
        if key == "if":
            none = F.array().cast(_NONE)
            side = lambda name: self.errors(schema[name], value, path, refs) if name in schema else none
            return F.when(self._fails(wanted, value, refs), side("else")).otherwise(side("then"))
        if key == "$ref":
            if refs.count(wanted) >= DEPTH:
                return F.array(F.concat(path, F.lit(": too deep")))
            return self.errors(self._target(wanted), value, path, (*refs, wanted))
        return None  # then and else are read with if

    def _object(self, key: str, schema: dict, value: Column, path: Column, refs: tuple[str, ...]) -> Column | None:
        fields = F.when(_is(value, "object"), F.try_variant_get(value, "$", "map<string,variant>"))
        none = F.array().cast(_NONE)
        if key == "required":
            lost = F.array_except(F.array(*[F.lit(x) for x in schema[key]]).cast(_NONE), F.map_keys(fields))
            return F.coalesce(F.transform(lost, lambda k: F.concat(path, F.lit("/"), k, F.lit(": required"))), none)
        if key == "properties":
            parts = []
            for name, inner in schema[key].items():
                there = F.array_contains(F.map_keys(fields), name)
                parts.append(F.when(F.coalesce(there, F.lit(False)), self._inside(inner, F.try_element_at(fields, F.lit(name)), F.concat(path, F.lit(f"/{name}")), refs)).otherwise(none))
            return F.flatten(F.array(*parts)) if parts else none
        if schema[key] is True:
            return None
        known = F.array(*[F.lit(x) for x in schema.get("properties", {})]).cast(_NONE)
        others = F.map_filter(fields, lambda k, _: ~F.array_contains(known, k))
        each = F.transform(F.map_entries(others), lambda e: self.errors(schema[key], e["value"], F.concat(path, F.lit("/"), e["key"]), refs))
        return F.coalesce(F.flatten(each), none)

    def _array(self, key: str, schema: dict, value: Column, path: Column, refs: tuple[str, ...]) -> Column | None:
        items = F.when(_is(value, "array"), F.try_variant_get(value, "$", "array<variant>"))
        none, wanted = F.array().cast(_NONE), schema[key]
        if key == "minItems":
            return self._when(F.size(items) < F.lit(wanted) if wanted else F.lit(False), path, "too few items") if wanted else none
        if key == "maxItems":
            return self._when(F.size(items) > wanted, path, "too many items")
        if key == "uniqueItems":
            return self._when(F.size(F.array_distinct(F.transform(items, _canonical))) < F.size(items), path, "items are not unique") if wanted else none
        place = lambda i: F.concat(path, F.lit("/"), i.cast("string"))
        if key == "prefixItems":
            parts = [F.when(F.coalesce(F.size(items) > k, F.lit(False)), self.errors(s, F.get(items, F.lit(k)), place(F.lit(k)), refs)).otherwise(none) for k, s in enumerate(wanted)]
            return F.flatten(F.array(*parts)) if parts else none
        first = len(schema.get("prefixItems", ()))
        each = F.transform(items, lambda x, i: F.when(i >= first, self.errors(wanted, x, place(i), refs)).otherwise(none))
        return F.coalesce(F.flatten(each), none)


def shape_errors(text: Column, schema: dict | bool) -> Column:
    """What is wrong with a JSON text under ``schema``: an array of ``path: reason``, empty where it fits; ``: not JSON`` for null and unreadable texts."""
    compiler = _Compiler(schema if isinstance(schema, dict) else {})
    return let(F.try_parse_json(text), lambda value: F.when(value.isNull(), F.array(F.lit(": not JSON"))).otherwise(compiler.errors(schema, value, F.lit(""))))
