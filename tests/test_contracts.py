import json
import random
import re

import pytest
from pyspark.sql import functions as F

from normloom.functions import contracts

FILES = {
    "a.json": {
        "type": "object",
        "required": ["id", "parts"],
        "properties": {
            "id": {"type": "string", "pattern": "^[a-c]+$", "minLength": 2, "maxLength": 4},
            "n": {"type": "integer", "minimum": 0, "exclusiveMaximum": 5},
            "share": {"$ref": "b.json#/$defs/share"},
            "kind": {"enum": ["x", 1, None]},
            "fixed": {"const": "EU"},
            "flag": {"type": ["boolean", "null"]},
            "parts": {"type": "array", "minItems": 1, "maxItems": 12, "items": {"$ref": "#/$defs/part"}},
            "odd/name": {"anyOf": [{"type": "string"}, {"type": "number", "maximum": 3}]},
            "closed": {"type": "object", "properties": {"k": {"type": "string"}}, "additionalProperties": False},
            "open": {"type": "object", "additionalProperties": {"$ref": "b.json#/$defs/share"}},
            "never": {"not": {"type": "string"}},
        },
        "$defs": {"part": {"type": "object", "required": ["p"], "properties": {"p": {"allOf": [{"type": "number"}, {"minimum": 1}, {"exclusiveMinimum": 0.5}]}}}},
    },
    "b.json": {"$defs": {"share": {"type": "number", "minimum": 0, "maximum": 1, "description": "noted only"}}},
}


def is_a(v, name):
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {"string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "object": isinstance(v, dict), "array": isinstance(v, list), "number": number, "integer": number and v == int(v)}[name]


def by_hand(schema, v, file, path=()):
    """A plain recursive check: (path, message) of each violation."""
    if schema is False:
        return [(path, "not allowed")]
    out, said = [], lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    if "$ref" in schema:
        other, _, pointer = schema["$ref"].partition("#")
        target = FILES[other or file]
        for p in filter(None, pointer.split("/")):
            target = target[p]
        out += by_hand(target, v, other or file, path)
    names = schema.get("type", [])
    names = [names] if isinstance(names, str) else names
    if names and not any(is_a(v, n) for n in names):
        out.append((path, "type: " + " or ".join(names)))
    same = lambda a, b: type(a) is type(b) and a == b
    if "enum" in schema and not any(same(v, x) for x in schema["enum"]):
        out.append((path, "enum: " + said(schema["enum"])))
    if "const" in schema and not same(v, schema["const"]):
        out.append((path, "const: " + said(schema["const"])))
    if isinstance(v, str):
        if "pattern" in schema and not re.search(schema["pattern"], v):
            out.append((path, "pattern: " + schema["pattern"]))
        out += [(path, f"{k}: {schema[k]}") for k, bad in (("minLength", lambda n: len(v) < n), ("maxLength", lambda n: len(v) > n)) if k in schema and bad(schema[k])]
    if is_a(v, "number"):
        tests = {"minimum": lambda n: v < n, "maximum": lambda n: v > n, "exclusiveMinimum": lambda n: v <= n, "exclusiveMaximum": lambda n: v >= n}
        out += [(path, f"{k}: {schema[k]}") for k, bad in tests.items() if k in schema and bad(schema[k])]
    if isinstance(v, list):
        out += [(path, f"{k}: {schema[k]}") for k, bad in (("minItems", lambda n: len(v) < n), ("maxItems", lambda n: len(v) > n)) if k in schema and bad(schema[k])]
        for i, x in enumerate(v if "items" in schema else []):
            out += by_hand(schema["items"], x, file, (*path, i))
    if isinstance(v, dict):
        out += [(path, f"required: {n}") for n in schema.get("required", []) if n not in v]
        known = schema.get("properties", {})
        for n, part in known.items():
            if n in v:
                out += by_hand(part, v[n], file, (*path, n))
        more, extra = schema.get("additionalProperties", True), sorted(v.keys() - known.keys())
        if more is False and extra:
            out.append((path, "additionalProperties: " + ",".join(extra)))
        elif isinstance(more, dict):
            for n in extra:
                out += by_hand(more, v[n], file, (*path, n))
    for part in schema.get("allOf", []):
        out += by_hand(part, v, file, path)
    if "anyOf" in schema and all(by_hand(part, v, file, path) for part in schema["anyOf"]):
        out.append((path, "anyOf"))
    if "not" in schema and not by_hand(schema["not"], v, file, path):
        out.append((path, "not"))
    return out


def shown(found):
    order = lambda f: ["\x00" + (f"{p:012d}" if isinstance(p, int) else p) for p in f[0]]
    return [("/".join(map(str, p)) or "<root>", m) for p, m in sorted(found, key=lambda f: ("".join(order(f)), f[1]))]


def test_every_keyword_against_a_plain_check(spark):
    random.seed(11)
    values = ["ab", "a", "abcab", "zz", "", "EU", "x", 0, 1, 4, 5, -1, 0.5, 2.0, 7.25, True, False, None, [], {}]

    def part():
        return random.choice([{"p": random.choice(values)}, {}, 3, {"p": 2, "q": 1}])

    records = []
    for _ in range(400):
        r = {k: random.choice(values) for k in FILES["a.json"]["properties"] if random.random() < 0.7}
        if random.random() < 0.8:
            r["parts"] = [part() for _ in range(random.randrange(14))]
        for k in ("closed", "open"):
            if random.random() < 0.6:
                r[k] = {n: random.choice(values) for n in random.sample(["k", "l", "m n", "é"], random.randrange(4))}
        records.append(r)
    records += [[], "text", None, 3, {}]
    made = contracts.Contract(FILES, "a.json").violations(F.try_parse_json("j"))
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, j string").repartition(4).select("i", made.alias("found")).collect()
    for row in rows:
        assert [tuple(f) for f in row.found] == shown(by_hand(FILES["a.json"], records[row.i], "a.json")), records[row.i]
    odd = spark.createDataFrame([(0, "{"), (1, None)], "i int, j string").select(made.alias("found")).collect()
    assert all([tuple(f) for f in r.found] == [("<root>", "no record")] for r in odd)


def test_typed_columns_are_checked_as_their_json(spark):
    kind = "id string, n int, share double, parts array<struct<p: double>>, open map<string, double>, closed struct<k: string, l: int>, flag boolean, fixed string"
    rows = [("ab", 3, 0.5, [(1.0,)], {"a": 0.5}, None, None, "EU"), ("z", 7, 1.5, [], {"a": 2.0, "b": -1.0}, ("x", 1), True, "US"), (None, None, None, [(None,), (0.2,)], None, ("x", None), None, None)]
    frame = spark.createDataFrame(rows, kind)
    whole = F.struct(*frame.columns)
    typed = contracts.Contract(FILES, "a.json").violations(whole, frame.schema)
    parsed = contracts.Contract(FILES, "a.json").violations(F.parse_json(F.to_json(whole)))
    got = frame.select(typed.alias("t"), parsed.alias("p")).collect()
    texts = lambda found: [tuple(f) for f in found]
    # A field that the type has and the schema does not allow is a violation even where it is null.
    assert texts(got[0].t) == texts(got[0].p) == [] and texts(got[1].t) == texts(got[1].p)
    assert texts(got[2].p) == [("<root>", "required: id"), ("parts/0", "required: p"), ("parts/1/p", "exclusiveMinimum: 0.5"), ("parts/1/p", "minimum: 1")]
    assert [f for f in texts(got[2].t) if f[0] != "closed"] == texts(got[2].p)


def test_schemas_that_cannot_be_compiled(spark):
    value = F.parse_json(F.lit("{}"))
    for files, error in (({"a.json": {"$ref": "#"}}, ValueError), ({"a.json": {"$ref": "c.json"}}, LookupError), ({"a.json": {"$ref": "#/$defs/x"}}, LookupError), ({"a.json": {"dependentRequired": {}}}, ValueError)):
        with pytest.raises(error):
            contracts.Contract(files, "a.json").violations(value)
    with pytest.raises(LookupError):
        contracts.contract("nothing")


def test_the_contracts_of_the_library(spark):
    report = {"changeset_id": "c", "rules": [{"rule_name": "no_dangling_node_reference", "status": "fail", "message": "m"}], "overall_status": "fail"}
    whole = {"changeset_id": "c", "base_snapshot_id": None, "source_clause_ids": ["k"], "ontology_version": "1.0.0", "proposed_nodes": [], "proposed_relationships": [], "constraint_report": report, "status": "draft"}
    broken = json.loads(json.dumps(whole))
    broken["constraint_report"]["rules"][0]["status"] = "warn"
    del broken["status"]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate((whole, broken, {"changeset_id": "c"}))], "i int, j string")
    got = contracts.violations(rows, "j", "change_set").collect()
    assert [r.path for r in got if r.i == 1] == ["<root>", "constraint_report/rules/0/status"] and sum(r.i == 2 for r in got) == 7 and not [r for r in got if r.i == 0]
    names = [p.stem for p in contracts.FOLDER.glob("*.json") if p.stem != "common"]
    assert len(names) == 6
    for name in names:
        assert spark.range(1).select(contracts.contract(name).violations(F.parse_json(F.lit("{}"))).alias("v")).first().v
