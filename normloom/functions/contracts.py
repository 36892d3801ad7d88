"""JSON Schema contracts compiled to column expressions that give every violation with its path.

A record is a ``variant`` (parsed JSON, whose types are seen row by row) or a typed column, whose
types are settled when the expression is built; a null of a typed column counts as absent. The
compiler knows the keywords in ``KNOWN``, follows ``$ref`` into the same or another file, and refuses
keywords it does not know and schemas that contain themselves.
"""

from __future__ import annotations

import json
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from normloom.functions.text import let

FOLDER = Path(__file__).resolve().parent.parent / "contracts"
#: Keywords that check something; those of ``NOTES`` do not.
KNOWN = {
    "$ref", "type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
    "minItems", "maxItems", "required", "properties", "additionalProperties", "items", "allOf", "anyOf", "not",
}
NOTES = {"$id", "$schema", "$comment", "$defs", "title", "description", "default", "examples", "format"}
FAULTS = "array<struct<place:string,path:string,message:string>>"


def _said(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class _Variant:
    """A value of parsed JSON with its type's name."""

    def __init__(self, value: Column, kind: Column):
        self.value, self.kind = value, kind

    @staticmethod
    def bound(value: Column, body):
        return let(F.struct(value.alias("v"), F.schema_of_variant(value).alias("k")), lambda b: body(_Variant(b["v"], b["k"])))

    def present(self) -> Column:
        return self.value.isNotNull()

    def number(self) -> Column:
        return F.try_variant_get(self.value, "$", "double")

    def text(self) -> Column:
        return F.try_variant_get(self.value, "$", "string")

    def has_type(self, name: str) -> Column:
        numeric = self.kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        if name in ("number", "integer"):
            return numeric if name == "number" else numeric & (self.number() == F.floor(self.number()))
        if name in ("object", "array"):
            return F.startswith(self.kind, F.lit(name.upper()))
        return self.kind == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name]

    def json(self) -> Column:
        return F.to_json(self.value)

    def member(self, name: str) -> _Variant:
        escaped = name.replace("\\", "\\\\").replace("'", "\\'")
        value = F.try_variant_get(self.value, f"$['{escaped}']", "variant")
        return _Variant(value, F.schema_of_variant(value))

    def items(self, body) -> Column:
        return F.transform(F.try_variant_get(self.value, "$", "array<variant>"), lambda x, i: body(_Variant(x, F.schema_of_variant(x)), i))

    def size(self) -> Column:
        return F.size(F.try_variant_get(self.value, "$", "array<variant>"))

    def entries(self) -> Column:
        return F.map_entries(F.try_variant_get(self.value, "$", "map<string,variant>"))

    def of_entry(self, value: Column) -> _Variant:
        return _Variant(value, F.schema_of_variant(value))


class _Typed:
    """A value of a typed column; its kind is known before any row is read."""

    def __init__(self, value: Column, kind: Y.DataType):
        self.value, self.kind = value, kind

    def present(self) -> Column:
        return self.value.isNotNull()

    def number(self) -> Column:
        return self.value.cast("double")

    def text(self) -> Column:
        return self.value.cast("string")

    def has_type(self, name: str) -> Column:
        kinds = {"string": (Y.StringType,), "boolean": (Y.BooleanType,), "object": (Y.StructType, Y.MapType), "array": (Y.ArrayType,), "number": (Y.NumericType,), "integer": (Y.IntegralType,), "null": (Y.NullType,)}
        if name == "integer" and isinstance(self.kind, Y.FractionalType):
            return self.number() == F.floor(self.number())
        return F.lit(isinstance(self.kind, kinds[name]))

    def json(self) -> Column:
        if isinstance(self.kind, (Y.StructType, Y.MapType, Y.ArrayType)):
            return F.to_json(self.value)
        return F.regexp_replace(F.to_json(F.struct(self.value.alias("v"))), r'^\{"v":|\}$', "")

    def member(self, name: str) -> _Typed:
        if isinstance(self.kind, Y.StructType) and name in self.kind.names:
            return _Typed(self.value[name], self.kind[name].dataType)
        if isinstance(self.kind, Y.MapType):
            return _Typed(F.element_at(self.value, name), self.kind.valueType)
        return _Typed(F.lit(None).cast("string"), Y.NullType())

    def items(self, body) -> Column:
        return F.transform(self.value, lambda x, i: body(_Typed(x, self.kind.elementType), i))

    def size(self) -> Column:
        return F.size(self.value)

    def entries(self) -> Column:
        if isinstance(self.kind, Y.MapType):
            return F.map_entries(self.value)
        return F.array(*[F.struct(F.lit(n).alias("key"), F.lit(None).cast("string").alias("value")) for n in self.kind.names])

    def of_entry(self, value: Column) -> _Typed:
        return _Typed(value, self.kind.valueType if isinstance(self.kind, Y.MapType) else Y.NullType())


class Contract:
    """A schema of ``files`` (name to content) by its file's name.

    ``brief`` only tells whether a value breaks it, as one condition without places and messages.
    """

    def __init__(self, files: dict[str, dict], name: str, brief: bool = False):
        self.files, self.name, self.brief = files, name, brief

    def _target(self, ref: str, file: str) -> tuple[dict, str]:
        place, _, pointer = ref.partition("#")
        file = place or file
        if file not in self.files:
            raise LookupError(f"unknown schema {file}")
        schema = self.files[file]
        for part in filter(None, pointer.split("/")):
            part = part.replace("~1", "/").replace("~0", "~")
            if part not in schema:
                raise LookupError(f"unknown schema {ref}")
            schema = schema[part]
        return schema, file

    def _faults(self, schema: dict | bool, v, file: str, at: Column, path: Column, within: tuple) -> list[Column]:
        """Arrays of the violations of one value, which is there."""
        fault = lambda broken, message: F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(at.alias("place"), path.alias("path"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))))
        every, fine = F.flatten, lambda found: F.size(found) == 0
        if self.brief:
            fault, every, fine = (lambda broken, message: F.coalesce(broken, F.lit(False))), (lambda found: F.exists(found, lambda x: x)), (lambda found: ~found)
        if isinstance(schema, bool):
            return [] if schema else [fault(F.lit(True), "not allowed")]
        if unknown := schema.keys() - KNOWN - NOTES:
            raise ValueError(f"unknown keywords {sorted(unknown)}")
        out: list[Column] = []
        if "$ref" in schema:
            target, other = self._target(schema["$ref"], file)
            if (key := (other, id(target))) in within:
                raise ValueError(f"{schema['$ref']} contains itself")
            out += self._faults(target, v, other, at, path, (*within, key))
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            wrong = ~v.has_type(names[0])
            for name in names[1:]:
                wrong = wrong & ~v.has_type(name)
            out.append(fault(wrong, f"type: {' or '.join(names)}"))
        for name in ("enum", "const"):
            if name in schema:
                allowed = schema[name] if name == "enum" else [schema[name]]
                if all(isinstance(x, str) for x in allowed):
                    known = v.has_type("string") & v.text().isin(*allowed) if allowed else F.lit(False)
                else:
                    known = v.json().isin(*map(_said, allowed))
                out.append(fault(~F.coalesce(known, F.lit(False)), f"{name}: {_said(schema[name])}"))
        string, number, array, thing = (v.has_type(t) for t in ("string", "number", "array", "object"))
        if "pattern" in schema:
            out.append(fault(string & ~v.text().rlike(schema["pattern"]), f"pattern: {schema['pattern']}"))
        limits = {"minLength": lambda n: string & (F.length(v.text()) < n), "maxLength": lambda n: string & (F.length(v.text()) > n), "minimum": lambda n: number & (v.number() < n), "maximum": lambda n: number & (v.number() > n), "exclusiveMinimum": lambda n: number & (v.number() <= n), "exclusiveMaximum": lambda n: number & (v.number() >= n)}
        for name, broken in limits.items():
            if name in schema:
                out.append(fault(broken(schema[name]), f"{name}: {_said(schema[name])}"))
        listed = not isinstance(v, _Typed) or isinstance(v.kind, Y.ArrayType)
        if listed:
            for name, broken in {"minItems": lambda n: v.size() < n, "maxItems": lambda n: v.size() > n}.items():
                if name in schema:
                    out.append(fault(array & broken(schema[name]), f"{name}: {schema[name]}"))
            if "items" in schema:
                inner = lambda x, i: self._all(schema["items"], x, file, F.concat_ws("\x00", at, F.lpad(i.cast("string"), 12, "0")), F.concat_ws("/", F.nullif(path, F.lit("")), i.cast("string")), within)
                out.append(F.when(array, every(v.items(inner))))
        if not isinstance(v, _Typed) or isinstance(v.kind, (Y.StructType, Y.MapType)):
            for name in schema.get("required", []):
                out.append(fault(thing & ~v.member(name).present(), f"required: {name}"))
            under = lambda name: (F.concat_ws("\x00", at, name), F.concat_ws("/", F.nullif(path, F.lit("")), name))
            for name, part in schema.get("properties", {}).items():
                own = v.member(name)
                out.append(F.when(thing & own.present(), self._all(part, own, file, *under(F.lit(name)), within)))
            rest, named = schema.get("additionalProperties", True), F.array(*map(F.lit, sorted(schema.get("properties", {}) or [""])))
            if rest is not True:
                more = F.filter(v.entries(), lambda e: ~F.array_contains(named, e["key"]))
                if rest is False:
                    names = F.array_sort(F.transform(more, lambda e: e["key"]))
                    out.append(fault(thing & (F.size(more) > 0), F.concat(F.lit("additionalProperties: "), F.array_join(names, ","))))
                else:
                    out.append(F.when(thing, every(F.transform(more, lambda e: self._all(rest, v.of_entry(e["value"]), file, *under(e["key"]), within)))))
        for part in schema.get("allOf", []):
            out += self._faults(part, v, file, at, path, within)
        if "anyOf" in schema:
            fits = F.lit(False)
            for part in schema["anyOf"]:
                fits = fits | fine(self._all(part, v, file, at, path, within))
            out.append(fault(~fits, "anyOf"))
        if "not" in schema:
            out.append(fault(fine(self._all(schema["not"], v, file, at, path, within)), "not"))
        return out

    def _all(self, schema: dict | bool, v, file: str, at: Column, path: Column, within: tuple) -> Column:
        whole = lambda v: self._joined(self._faults(schema, v, file, at, path, within))
        return _Variant.bound(v.value, whole) if isinstance(v, _Variant) else whole(v)

    def _joined(self, faults: list[Column]) -> Column:
        if self.brief:
            return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in faults], F.lit(False))
        none = F.array().cast(FAULTS)
        return F.concat(*[F.coalesce(f, none) for f in faults]) if faults else none

    def _found(self, record: Column, kind: Y.DataType | None) -> Column:
        schema = self.files[self.name]
        v = _Variant(record, F.schema_of_variant(record)) if kind is None else _Typed(record, kind)
        return self._all(schema, v, self.name, F.lit(""), F.lit(""), ((self.name, id(schema)),))

    def holds(self, record: Column, kind: Y.DataType | None = None) -> Column:
        """Whether a record has no ``violations``."""
        return record.isNotNull() & ~Contract(self.files, self.name, brief=True)._found(record, kind)

    def violations(self, record: Column, kind: Y.DataType | None = None) -> Column:
        """All violations of a record as an array of ``path, message`` in order of path, list places by number.

        ``record`` is a variant, or a typed column if its type is given; the path of the whole is ``<root>``.
        A null record (text that is no JSON, for one) has the one violation ``no record``.
        """
        found = F.array_sort(self._found(record, kind))
        shown = F.transform(found, lambda x: F.struct(F.when(x["path"] == "", "<root>").otherwise(x["path"]).alias("path"), x["message"].alias("message")))
        absent = F.array(F.struct(F.lit("<root>").alias("path"), F.lit("no record").alias("message")))
        return F.when(record.isNull(), absent).otherwise(shown)


@cache
def _files(folder: str) -> dict[str, dict]:
    return {p.name: json.loads(p.read_text()) for p in sorted(Path(folder).glob("*.json"))}


def contract(name: str, folder: str | Path = FOLDER) -> Contract:
    """The contract ``name`` (without ``.json``) among the schema files of a folder."""
    files = _files(str(folder))
    if f"{name}.json" not in files:
        raise LookupError(f"unknown schema {name}")
    return Contract(files, f"{name}.json")


def violations(records: DataFrame, json_text: str, name: str, folder: str | Path = FOLDER) -> DataFrame:
    """``records`` (without the JSON column) with one row for each violation: ``path, message``."""
    found = contract(name, folder).violations(F.try_parse_json(F.col(json_text)))
    rest = [c for c in records.columns if c != json_text]
    return records.select(*rest, F.explode(found).alias("x")).select(*rest, "x.path", "x.message")
