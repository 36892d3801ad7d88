from pyspark.sql import functions as F

from normloom.functions.contracts import Contract

SCHEMA = {
    "type": "object", "required": ["a"], "additionalProperties": False,
    "properties": {"a": {"type": "string", "minLength": 2}, "b": {"type": "array", "items": {"anyOf": [{"type": "integer"}, {"const": "x"}]}}, "c": {"type": ["object", "null"], "additionalProperties": {"type": "boolean"}}, "d": {"not": {"type": "string"}}},
}
TEXTS = ['{"a":"xy"}', '{"a":"x"}', "{}", "[]", "none", '{"a":"xy","b":[1,"x"]}', '{"a":"xy","b":[1,"y"]}', '{"a":"xy","c":{"p":true}}', '{"a":"xy","c":{"p":1}}', '{"a":"xy","c":null}', '{"a":"xy","d":"s"}', '{"a":"xy","d":1}', '{"a":"xy","e":1}', '{"a":null}']


def test_a_record_holds_where_it_has_no_violation(spark):
    made = Contract({"s.json": SCHEMA}, "s.json")
    record = F.try_parse_json(F.col("t"))
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", made.holds(record).alias("holds"), F.size(made.violations(record)).alias("n")).collect()
    assert {r.t: r.holds for r in got} == {r.t: r.n == 0 for r in got}
    assert {r.holds for r in got} == {True, False}
