"""Document-store filters as conditions on a variant column."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole numbers are compared as decimals so that 5 does not equal 5.5.
WHOLE_NUMBER = "decimal(38,10)"


def _path(field: str) -> str:
    return "$" + "".join(f"['{part}']" if not part.isdigit() else f"[{part}]" for part in field.split("."))


def _typed(document: Column, field: str, value: object) -> Column:
    """The field as the type of ``value``, NULL where it has another type."""
    path = _path(field)
    if isinstance(value, bool):
        kind, allowed = "boolean", r"^BOOLEAN"
    elif isinstance(value, int):
        kind, allowed = WHOLE_NUMBER, r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
    elif isinstance(value, float):
        kind, allowed = "double", r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
    elif isinstance(value, str):
        kind, allowed = "string", r"^STRING"
    else:
        raise TypeError(f"cannot compare with {value!r}")
    found = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    return F.when(found.rlike(allowed), F.try_variant_get(document, path, kind))


def _equals(document: Column, field: str, value: object) -> Column:
    if value is None:  # absent or null
        got = F.try_variant_get(document, _path(field), "variant")
        return got.isNull() | F.is_variant_null(got)
    return F.coalesce(_typed(document, field, value) == F.lit(value), F.lit(False))


def _compare(test: Callable[[Column, Column], Column]) -> Callable[[Column, str, object], Column]:
    return lambda document, field, value: F.coalesce(
        test(_typed(document, field, value), F.lit(value)), F.lit(False)
    )


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


_OPERATORS: dict[str, Callable[[Column, str, object], Column]] = {
    "$eq": _equals,
    "$ne": lambda d, f, v: ~_equals(d, f, v),
    "$gt": _compare(lambda a, b: a > b),
    "$gte": _compare(lambda a, b: a >= b),
    "$lt": _compare(lambda a, b: a < b),
    "$lte": _compare(lambda a, b: a <= b),
    "$in": lambda d, f, v: _any([_equals(d, f, x) for x in v]),
    "$nin": lambda d, f, v: ~_any([_equals(d, f, x) for x in v]),
    "$exists": lambda d, f, v: F.try_variant_get(d, _path(f), "variant").isNotNull() == F.lit(bool(v)),
}


def compile_filter(spec: Mapping[str, object], document: Column) -> Column:
    """The condition that ``spec`` puts on a document.

    Fields take a value or operators ($eq $ne $gt $gte $lt $lte $in $nin
    $exists $not); $and, $or and $nor take lists of filters. A comparison with
    an absent field or another type is false.
    """
    conditions: list[Column] = []
    for field, value in spec.items():
        if field == "$and":
            conditions.append(_all([compile_filter(s, document) for s in value]))
        elif field == "$or":
            conditions.append(_any([compile_filter(s, document) for s in value]))
        elif field == "$nor":
            conditions.append(~_any([compile_filter(s, document) for s in value]))
        elif field.startswith("$"):
            raise ValueError(f"unknown operator {field!r}")
        elif isinstance(value, Mapping):
            conditions.append(_all([_operator(document, field, op, x) for op, x in value.items()]))
        else:
            conditions.append(_equals(document, field, value))
    return _all(conditions)


def _operator(document: Column, field: str, op: str, value: object) -> Column:
    if op == "$not":
        return ~_all([_operator(document, field, o, x) for o, x in value.items()])
    if op not in _OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    return _OPERATORS[op](document, field, value)
