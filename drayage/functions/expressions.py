"""The scalar expression library: one registry, ``expr(name, **params)``.

Columns may be given as names or as ``Column`` objects. Casts of untrusted data
never raise; a value that does not fit becomes NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ADF, PYSPARK, POWER_QUERY = "adf", "pyspark", "powerquery"


@dataclass(frozen=True)
class Expression:
    name: str
    category: str
    platforms: tuple[str, ...]
    build: Callable[..., Column]
    description: str


REGISTRY: dict[str, Expression] = {}


def _col(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _value(value: object) -> Column:
    """A literal unless it already is a column."""
    return value if isinstance(value, Column) else F.lit(value)


def _cond(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.expr(value)


def _define(names: str, category: str, platforms: str, build: Callable[..., Column], description: str) -> None:
    for name in names.split():
        REGISTRY[name] = Expression(name, category, tuple(platforms.split()), build, description)


def expr(name: str, **params: object) -> Column:
    """The expression ``name`` applied to ``params``."""
    try:
        entry = REGISTRY[name]
    except KeyError:
        raise KeyError(f"unknown expression {name!r}") from None
    return entry.build(**params)


def custom(text: str) -> Column:
    """A free-form Spark SQL expression."""
    return F.expr(text)


def catalogue(platform: str = "", category: str = "") -> list[Expression]:
    """Entries of a platform and category; empty text means all."""
    return [
        e
        for e in REGISTRY.values()
        if (not platform or platform.lower() in e.platforms) and (not category or category.lower() == e.category)
    ]


def _case_when(column: Column | str, cases: dict, default: object) -> Column:
    chain = None
    for match, result in cases.items():
        test = _col(column) == _value(match)
        chain = F.when(test, _value(result)) if chain is None else chain.when(test, _value(result))
    return _value(default) if chain is None else chain.otherwise(_value(default))


def _concat(column1: Column | str, column2: Column | str, separator: str = "") -> Column:
    return F.concat(_col(column1).cast("string"), F.lit(separator), _col(column2).cast("string"))


def _to_timestamp(column: Column | str, format: str | None = None) -> Column:
    # Results carry no zone: what the text says is what the clock showed.
    source = _col(column).cast("string")
    parsed = F.try_to_timestamp(source, F.lit(format)) if format else F.try_to_timestamp(source)
    return parsed.cast("timestamp_ntz")


def _to_date(column: Column | str, format: str | None = None) -> Column:
    source = _col(column).cast("string")
    return F.try_to_date(source, format) if format else source.try_cast("date")


def _cast(type_name: str) -> Callable[..., Column]:
    return lambda column: _col(column).try_cast(type_name)


_ALL = f"{ADF} {PYSPARK} {POWER_QUERY}"

_define("upper", "string", _ALL, lambda column: F.upper(_col(column)), "upper case")
_define("lower", "string", _ALL, lambda column: F.lower(_col(column)), "lower case")
_define("trim", "string", _ALL, lambda column: F.trim(_col(column)), "strip spaces on both sides")
_define("ltrim", "string", ADF, lambda column: F.ltrim(_col(column)), "strip leading spaces")
_define("rtrim", "string", ADF, lambda column: F.rtrim(_col(column)), "strip trailing spaces")
_define("concat", "string", _ALL, _concat, "join two columns with a separator; NULL if either is NULL")
_define(
    "substring",
    "string",
    _ALL,
    lambda column, start, length: F.substring(_col(column), start, length),
    "part of a text, first character is 1",
)
_define(
    "replace",
    "string",
    _ALL,
    lambda column, old_value, new_value: F.replace(_col(column), F.lit(old_value), F.lit(new_value)),
    "replace literal text",
)
_define(
    "regex_replace",
    "string",
    ADF,
    lambda column, pattern, replacement: F.regexp_replace(_col(column), pattern, replacement),
    "replace every match of a pattern",
)
_define(
    "left_pad",
    "string",
    f"{ADF} {POWER_QUERY}",
    lambda column, length, pad_char: F.lpad(_col(column).cast("string"), length, pad_char),
    "pad or cut on the left",
)
_define(
    "right_pad",
    "string",
    ADF,
    lambda column, length, pad_char: F.rpad(_col(column).cast("string"), length, pad_char),
    "pad or cut on the right",
)
_define("soundex", "string", ADF, lambda column: F.soundex(_col(column)), "phonetic code")
_define(
    "sanitize_name",
    "string",
    "",
    lambda column: F.regexp_replace(F.lower(F.trim(_col(column))), "[^a-zA-Z0-9_-]", "_"),
    "a text usable as an identifier",
)
_define(
    "truncate",
    "string",
    "",
    lambda column, length=500: F.when(
        F.length(_col(column)) > length, F.concat(F.substring(_col(column), 1, length - 3), F.lit("..."))
    ).otherwise(_col(column)),
    "cut to a length, ending in an ellipsis",
)

_define("to_string", "type", ADF, lambda column: _col(column).cast("string"), "text form")
_define("to_text", "type", POWER_QUERY, lambda column: _col(column).cast("string"), "text form")
_define("cast_string", "type", PYSPARK, lambda column: _col(column).cast("string"), "text form")
_define("to_integer", "type", ADF, _cast("int"), "32-bit integer or NULL")
_define("cast_int", "type", PYSPARK, _cast("int"), "32-bit integer or NULL")
_define("to_long", "type", ADF, _cast("bigint"), "64-bit integer or NULL")
_define("to_float", "type", ADF, _cast("float"), "single-precision number or NULL")
_define("to_double", "type", ADF, _cast("double"), "double-precision number or NULL")
_define("cast_double", "type", PYSPARK, _cast("double"), "double-precision number or NULL")
_define("to_number", "type", POWER_QUERY, _cast("double"), "double-precision number or NULL")
_define(
    "to_decimal",
    "type",
    ADF,
    lambda column, precision, scale: _col(column).try_cast(f"decimal({precision},{scale})"),
    "decimal or NULL when it overflows",
)
_define("to_date", "type", _ALL, _to_date, "date or NULL")
_define("to_timestamp", "type", f"{ADF} {PYSPARK}", _to_timestamp, "timestamp or NULL")
_define("to_datetime", "type", POWER_QUERY, _to_timestamp, "timestamp or NULL")
_define("to_boolean", "type", ADF, _cast("boolean"), "boolean or NULL")

_define("current_date", "date", ADF, lambda: F.current_date(), "date of the run")
_define("current_timestamp", "date", ADF, lambda: F.current_timestamp(), "time of the run")
_define("year", "date", _ALL, lambda column: F.year(_col(column)), "year number")
_define("month", "date", _ALL, lambda column: F.month(_col(column)), "month number")
_define("day_of_month", "date", ADF, lambda column: F.dayofmonth(_col(column)), "day in the month")
_define("day", "date", POWER_QUERY, lambda column: F.dayofmonth(_col(column)), "day in the month")
_define(
    "date_diff",
    "date",
    ADF,
    lambda start_column, end_column: F.datediff(_col(end_column), _col(start_column)),
    "days from start to end",
)
_define("add_days", "date", ADF, lambda column, days: F.date_add(_col(column), days), "date moved by days")
_define(
    "format_date", "date", ADF, lambda column, format: F.date_format(_col(column), format), "text form of a date"
)

_define(
    "coalesce",
    "null",
    _ALL,
    lambda column, default_value: F.coalesce(_col(column), _value(default_value)),
    "value or default",
)
_define(
    "iif_null",
    "null",
    ADF,
    lambda column, replacement: F.coalesce(_col(column), _value(replacement)),
    "value or replacement",
)
_define("is_null", "null", ADF, lambda column: _col(column).isNull(), "true for NULL")

_define(
    "iif",
    "conditional",
    _ALL,
    lambda condition, true_value, false_value: F.when(_cond(condition), _value(true_value)).otherwise(
        _value(false_value)
    ),
    "one of two values",
)
_define("case_when", "conditional", ADF, _case_when, "value by match, in the order given")

_define("md5", "hash", f"{ADF} {PYSPARK}", lambda column: F.md5(_col(column).cast("string")), "MD5 as hex")
_define("hash_md5", "hash", POWER_QUERY, lambda column: F.md5(_col(column).cast("string")), "MD5 as hex")
_define(
    "sha2_256", "hash", f"{ADF} {PYSPARK}", lambda column: F.sha2(_col(column).cast("string"), 256), "SHA-256 as hex"
)

_define("round", "math", POWER_QUERY, lambda column, decimals=0: F.round(_col(column), decimals), "half-up rounding")

_define("sum", "aggregate", ADF, lambda column: F.sum(_col(column)), "sum of non-NULL values")
_define("avg", "aggregate", ADF, lambda column: F.avg(_col(column)), "mean of non-NULL values")
_define("min", "aggregate", ADF, lambda column: F.min(_col(column)), "smallest value")
_define("max", "aggregate", ADF, lambda column: F.max(_col(column)), "largest value")
_define("count", "aggregate", ADF, lambda column: F.count(_col(column)), "number of non-NULL values")
_define(
    "count_distinct",
    "aggregate",
    ADF,
    lambda column, approximate=False: F.approx_count_distinct(_col(column))
    if approximate
    else F.count_distinct(_col(column)),
    "number of different values",
)


def _surrogate_key() -> Column:
    raise TypeError("a key needs all rows: use drayage.operators.keys.surrogate_key")


_define("surrogate_key", "key", ADF, _surrogate_key, "a dense number per row, as a dataflow step")
