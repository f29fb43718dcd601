import itertools
import json

import pytest
from pyspark.sql import functions as F

from quillvec.model import InvalidPredicate
from quillvec.operators import predicate as P
from quillvec.operators.predicate import And, Comparison, Not, Or, where

METADATA = [
    "{}", '{"x":null}', '{"x":7}', '{"x":7.0}', '{"x":"7"}', '{"x":true}', '{"x":{"y":1}}', '{"x":[1]}', '{"x":9007199254740992}', '{"x":9007199254740993}', '{"x":"ä"}', '{"x":-3.5}',
    '{"x":18446744073709551615}', '"text"', "[1]", "null", '{"a.b":1}', '{"x":7e0}',
]
VALUES = [None, 7, 7.0, "7", True, False, 9007199254740993, "z", -3.5, 18446744073709551615]


def expected(text, p):
    """The same semantics over parsed JSON."""
    value = json.loads(text)
    present = isinstance(value, dict) and p.field in value
    own = value[p.field] if present else None
    if p.operator == "exists":
        return present
    if p.operator == "is_null":
        return present and own is None
    kind = P.kind_of(own) if present else None
    if not present or kind is None:
        return False
    other = P.kind_of(p.value)
    if p.operator in ("eq", "ne"):
        same = kind == other and own == p.value
        return same if p.operator == "eq" else not same
    if not ({kind, other} == {"string"} or {kind, other} <= {"int", "float"}):
        return False
    a, b = (own.encode(), p.value.encode()) if kind == "string" else (own, p.value) if kind == other == "int" else (float(own), float(p.value))
    return {"lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[p.operator]


def run(spark, predicates):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(METADATA)], "i int, metadata string")
    return df.select("i", *[P.compile_predicate(p, F.col("metadata")).alias(f"p{k}") for k, p in enumerate(predicates)]).orderBy("i").collect()


def test_all_operators_on_all_shapes(spark):
    cases = [where("x", o, v) for o, v in itertools.product(("eq", "ne"), VALUES)]
    cases += [where("x", o, v) for o, v in itertools.product(P.ORDERED, [v for v in VALUES if P.kind_of(v) in ("int", "float", "string")])]
    cases += [where("x", "exists"), where("x", "is_null"), where("a.b", "eq", 1), where("missing", "exists")]
    for row, text in zip(run(spark, cases), METADATA):
        for k, p in enumerate(cases):
            assert row[f"p{k}"] is expected(text, p), (text, p)


def test_two_valued_logic(spark):
    leaf, other = where("x", "eq", 7), where("x", "gt", 3)
    cases = [leaf, Not(leaf), other, And((leaf, other)), Or((leaf, other)), Not(And((leaf, other)))]
    for row in run(spark, cases):
        a, not_a, b, both, either, neither = (row[f"p{k}"] for k in range(6))
        assert None not in (a, b) and not_a is (not a) and both is (a and b) and either is (a or b) and neither is (not both)


@pytest.mark.parametrize("bad", [And(()), Or(()), Comparison("x", "exists", 1), Comparison("x", "eq"), Comparison("x", "lt", None), Comparison("x", "gt", True), Comparison("", "exists"), Comparison("x", "like", "y"), Comparison("x", "eq", [1])])
def test_validation(bad):
    with pytest.raises(InvalidPredicate):
        P.validate(bad)


def test_json_and_text_forms():
    tree = {"kind": "and", "children": [{"kind": "comparison", "field": "x", "operator": "gte", "value": 3}, {"kind": "not", "child": {"kind": "comparison", "field": "y", "operator": "exists"}}]}
    assert P.to_json(P.from_json(json.dumps(tree))) == tree
    with pytest.raises(InvalidPredicate):
        P.from_json({"kind": "comparison", "field": "x", "operator": "eq", "value": None})
    assert P.parse_filter("a=json:7") == ("a", 7) and P.parse_filter("a=7") == ("a", "7") and P.parse_filter("a=json:null") == ("a", None)
    assert P.parse_where("x:gte:json:2.5") == where("x", "gte", 2.5) and P.parse_where("x:exists") == where("x", "exists") and P.parse_where("t:eq:a:b") == where("t", "eq", "a:b")
    for bad in ("x:eq", "x:exists:1", "x:near:1", "x:lt:json:true"):
        with pytest.raises(InvalidPredicate):
            P.parse_where(bad)
    assert P.combine({"a": 1}, None) == where("a", "eq", 1) and P.combine(None, None) is None
    assert P.combine([("a", None)], where("b", "exists")) == And((where("a", "eq", None), where("b", "exists")))
