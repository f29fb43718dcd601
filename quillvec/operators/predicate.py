"""Predicates over top-level metadata fields.

The tree compiles to a Column that is true or false and never null: a missing
field and an explicit null differ, negation is plain, and values of different
types are never equal.  Whole numbers and floats are different under equality and
comparable under order.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillvec.model import InvalidPredicate, Scalar

UNARY, EQUALITY, ORDERED = ("exists", "is_null"), ("eq", "ne"), ("lt", "lte", "gt", "gte")
MISSING = object()


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class And(Predicate):
    children: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    children: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    child: Predicate


@dataclass(frozen=True)
class Comparison(Predicate):
    field: str
    operator: str
    value: Scalar | object = MISSING


def where(field: str, operator: str, value: Scalar | object = MISSING) -> Comparison:
    return Comparison(field, operator, value)


def kind_of(value: object) -> str | None:
    """null, bool, int, float or string; None for what isn't a scalar. Whole numbers beyond 64 bits are floats."""
    if value is None:
        return "null"
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**64:
        return "float"
    for kind, name in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string")):
        if isinstance(value, kind):
            return name
    return None


def validate(p: Predicate) -> None:
    if isinstance(p, (And, Or)):
        if not p.children:
            raise InvalidPredicate("logical predicates require at least one child")
        for child in p.children:
            validate(child)
    elif isinstance(p, Not):
        validate(p.child)
    elif isinstance(p, Comparison):
        if not p.field:
            raise InvalidPredicate("a field name is required")
        if p.operator in UNARY:
            if p.value is not MISSING:
                raise InvalidPredicate(f"{p.operator} does not accept a value")
        elif p.operator in EQUALITY + ORDERED:
            if p.value is MISSING:
                raise InvalidPredicate(f"{p.operator} requires a value")
            kind = kind_of(p.value)
            if kind is None:
                raise InvalidPredicate(f"{p.operator} requires a scalar")
            if p.operator in ORDERED and kind in ("null", "bool"):
                raise InvalidPredicate(f"{p.operator} requires a string or a number")
        else:
            raise InvalidPredicate(f"unknown operator {p.operator!r}")
    else:
        raise InvalidPredicate(f"not a predicate: {p!r}")


def combine(filters: dict[str, Scalar] | Iterable[tuple[str, Scalar]] | None, predicate: Predicate | None) -> Predicate | None:
    """Equality filters and a predicate, all of which must hold."""
    pairs = list(filters.items() if isinstance(filters, dict) else filters or ())
    parts: list[Predicate] = [Comparison(f, "eq", v) for f, v in pairs]
    if predicate is not None:
        parts.append(predicate)
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def from_json(source: str | dict) -> Predicate:
    """The JSON form: `kind` is and, or, not or comparison; a null value counts as none."""
    tree = json.loads(source) if isinstance(source, str) else source

    def build(node: dict) -> Predicate:
        kind = node.get("kind") if isinstance(node, dict) else None
        if kind in ("and", "or"):
            return (And if kind == "and" else Or)(tuple(build(c) for c in node["children"]))
        if kind == "not":
            return Not(build(node["child"]))
        if kind == "comparison":
            value = node.get("value")
            return Comparison(node["field"], node["operator"], MISSING if value is None else value)
        raise InvalidPredicate(f"unknown predicate kind {kind!r}")

    try:
        built = build(tree)
    except KeyError as e:
        raise InvalidPredicate(f"missing {e.args[0]!r}") from e
    validate(built)
    return built


def to_json(p: Predicate) -> dict:
    if isinstance(p, (And, Or)):
        return {"kind": "and" if isinstance(p, And) else "or", "children": [to_json(c) for c in p.children]}
    if isinstance(p, Not):
        return {"kind": "not", "child": to_json(p.child)}
    out = {"kind": "comparison", "field": p.field, "operator": p.operator}
    return out if p.value is MISSING else out | {"value": p.value}


def parse_value(text: str) -> Scalar:
    """A command-line value: a string, or JSON after `json:`."""
    if not text.startswith("json:"):
        return text
    try:
        value = json.loads(text[5:])
    except ValueError as e:
        raise InvalidPredicate(f"invalid JSON value {text!r}") from e
    if kind_of(value) is None:
        raise InvalidPredicate("values must be scalars")
    return value


def parse_filter(text: str) -> tuple[str, Scalar]:
    """`field=value`."""
    name, equals, value = text.partition("=")
    if not equals or not name:
        raise InvalidPredicate(f"expected field=value, got {text!r}")
    return name, parse_value(value)


def parse_where(text: str) -> Comparison:
    """`field:operator` or `field:operator:value`."""
    name, _, rest = text.partition(":")
    operator, colon, value = rest.partition(":")
    parsed = Comparison(name, operator, parse_value(value) if colon else MISSING)
    validate(parsed)
    return parsed


def parse_clauses(wheres: Iterable[str] = (), predicate_json: str | None = None) -> Predicate | None:
    """All clauses of a command line, ANDed."""
    parts: list[Predicate] = [parse_where(w) for w in wheres]
    if predicate_json:
        parts.append(from_json(predicate_json))
    return None if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))


# --- typed leaves -------------------------------------------------------------------------


def field_path(name: str) -> str:
    """The variant path of a literal top-level key."""
    if '"' not in name and "\\" not in name:
        return f'$["{name}"]'
    if "'" not in name and "\\" not in name:
        return f"$['{name}']"
    raise InvalidPredicate(f"field names with both quotes or a backslash are not supported: {name!r}")


def leaf(metadata: Column, name: str) -> Column:
    """The variant at a top-level key of the JSON text: null if absent or if the text is no object."""
    return F.try_variant_get(F.try_parse_json(metadata), field_path(name), "variant")


def leaf_kind(v: Column) -> Column:
    """null, bool, int, float, string, array or object; null for an absent leaf.

    Numbers written without fraction or exponent are whole up to 64 unsigned bits.
    """
    schema = F.schema_of_variant(v)
    wide = F.try_variant_get(v, "$", "decimal(38,0)")
    unsigned = schema.rlike(r"^DECIMAL\((19|20),0\)$") & wide.between(Decimal(2**63), Decimal(2**64 - 1))
    return (
        F.when(v.isNull(), F.lit(None).cast("string")).when(F.is_variant_null(v), "null").when(schema == "BOOLEAN", "bool").when(schema == "STRING", "string")
        .when((schema == "BIGINT") | unsigned, "int").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").otherwise("float")
    )


def as_whole(v: Column) -> Column:
    return F.try_variant_get(v, "$", "decimal(20,0)")


def as_double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def equals(v: Column, kind: Column, value: Scalar) -> Column:
    own = kind_of(value)
    same = {
        "null": lambda: F.lit(True), "bool": lambda: F.try_variant_get(v, "$", "boolean") == F.lit(value), "string": lambda: as_string(v) == F.lit(value),
        "int": lambda: as_whole(v) == F.lit(Decimal(value)).cast("decimal(20,0)"), "float": lambda: as_double(v) == F.lit(float(value)),
    }[own]()
    return F.coalesce((kind == own) & same, F.lit(False))


def compares(v: Column, kind: Column, operator: str, value: Scalar) -> Column:
    def test(a: Column, b: Column) -> Column:
        return {"lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[operator]

    own = kind_of(value)
    if own == "string":
        return F.coalesce((kind == "string") & test(as_string(v), F.lit(value)), F.lit(False))
    by_double = test(as_double(v), F.lit(float(value)))
    if own == "float":
        return F.coalesce(kind.isin("int", "float") & by_double, F.lit(False))
    exact = test(as_whole(v), F.lit(Decimal(value)).cast("decimal(20,0)"))
    return F.coalesce(F.when(kind == "int", exact).when(kind == "float", by_double), F.lit(False))


def compile_predicate(p: Predicate, metadata: Column) -> Column:
    """A Column that is true or false for every row."""
    if isinstance(p, And):
        return reduce(lambda a, b: a & b, (compile_predicate(c, metadata) for c in p.children))
    if isinstance(p, Or):
        return reduce(lambda a, b: a | b, (compile_predicate(c, metadata) for c in p.children))
    if isinstance(p, Not):
        return ~compile_predicate(p.child, metadata)
    v = leaf(metadata, p.field)
    if p.operator == "exists":
        return v.isNotNull()
    if p.operator == "is_null":
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    kind = leaf_kind(v)
    if p.operator == "eq":
        return equals(v, kind, p.value)
    if p.operator == "ne":
        return F.coalesce(kind.isin("null", "bool", "int", "float", "string"), F.lit(False)) & ~equals(v, kind, p.value)
    return compares(v, kind, p.operator, p.value)
