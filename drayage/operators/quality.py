"""Profiles and data quality checks.

Every check is one pass of partial aggregates per table, however many columns
or rules it covers. Row-level checks aggregate by key before any join, so that
a hot key reaches the join as one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.functions.canonical import canonical_text
from drayage.operators.sketches import column_sketches, distinct_keys, sketched_profile


@dataclass(frozen=True)
class Edge:
    """A declared reference ``child.fk -> parent.pk``."""

    name: str
    child: str
    fk: str
    parent: str
    pk: str


@dataclass(frozen=True)
class Rule:
    """A range and / or format rule for a column."""

    column: str
    minimum: object = None
    maximum: object = None
    pattern: str | None = None


def unpivot_aggregates(aggregated: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One row of aggregates turned into one row per struct."""
    return aggregated.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, 0 for an empty whole."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, row_count, null_count, null_percent`` for each column."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(columns)]
    )
    nulls = [F.col("_rows") - F.col(f"_c{i}") for i in range(len(columns))]
    return unpivot_aggregates(
        counted,
        [
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("_rows").alias("row_count"),
                n.alias("null_count"),
                percent(n, F.col("_rows")).alias("null_percent"),
            )
            for c, n in zip(columns, nulls)
        ],
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with ``row_count``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def key_uniqueness(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[Sequence[str]]]) -> DataFrame:
    """Whether each declared key is unique: rows, distinct keys, verdict."""
    out = None
    for table, candidates in keys.items():
        for key in candidates:
            part = distinct_keys(tables[table], key).select(
                F.lit(table).alias("table_name"),
                F.lit(", ".join(key)).alias("key_columns"),
                "row_count",
                "distinct_count",
                (F.col("row_count") == F.col("distinct_count")).alias("is_unique"),
            )
            out = part if out is None else out.unionAll(part)
    return out


def orphan_keys(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child keys without a parent, with the child rows behind each.

    A NULL key refers to nothing and is no orphan.
    """
    used = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("orphan_key"))
    used = used.agg(F.count(F.lit(1)).alias("row_count"))
    return used.join(parent.select(F.col(pk).alias("orphan_key")).distinct(), "orphan_key", "left_anti")


def fk_coverage(tables: Mapping[str, DataFrame], edges: Sequence[Edge]) -> DataFrame:
    """Per declared edge: child rows, NULL keys, orphan rows and coverage."""
    out = None
    for edge in edges:
        per_key = tables[edge.child].groupBy(F.col(edge.fk).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
        # An outer join by distinct keys, not by rows.
        parents = tables[edge.parent].select(F.col(edge.pk).alias("_key")).distinct().withColumn("_hit", F.lit(True))
        joined = per_key.join(parents, "_key", "left")
        total = F.coalesce(F.sum("n"), F.lit(0))
        nulls = F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("n"))), F.lit(0))
        orphan = F.col("_key").isNotNull() & F.col("_hit").isNull()
        orphans = F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0))
        part = joined.agg(
            total.alias("child_rows"), nulls.alias("null_keys"), orphans.alias("orphan_rows")
        ).select(
            F.lit(edge.name).alias("fk_name"),
            F.lit(edge.child).alias("table_name"),
            F.lit(edge.fk).alias("column_name"),
            F.lit(edge.parent).alias("ref_table"),
            F.lit(edge.pk).alias("ref_column"),
            "child_rows",
            "null_keys",
            "orphan_rows",
            percent(
                F.col("child_rows") - F.col("null_keys") - F.col("orphan_rows"),
                F.col("child_rows") - F.col("null_keys"),
            ).alias("coverage_percent"),
        )
        out = part if out is None else out.unionAll(part)
    return out


def range_format_checks(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per rule: smallest and largest value as text, and values that break it."""
    aggregates: list[Column] = []
    structs: list[Column] = []
    for i, rule in enumerate(rules):
        column = F.col(f"`{rule.column}`")
        kind = df.schema[rule.column].dataType
        never = F.lit(False)
        below = column < F.lit(rule.minimum) if rule.minimum is not None else never
        above = column > F.lit(rule.maximum) if rule.maximum is not None else never
        misfit = ~column.cast("string").rlike(rule.pattern) if rule.pattern is not None else never
        aggregates += [
            F.min(column).alias(f"_lo{i}"),
            F.max(column).alias(f"_hi{i}"),
            F.count(column).alias(f"_n{i}"),
            F.count_if(below).alias(f"_b{i}"),
            F.count_if(above).alias(f"_a{i}"),
            F.count_if(misfit).alias(f"_m{i}"),
        ]
        structs.append(
            F.struct(
                F.lit(rule.column).alias("column_name"),
                F.col(f"_n{i}").alias("value_count"),
                canonical_text(F.col(f"_lo{i}"), kind).alias("min_value"),
                canonical_text(F.col(f"_hi{i}"), kind).alias("max_value"),
                F.col(f"_b{i}").alias("below_minimum"),
                F.col(f"_a{i}").alias("above_maximum"),
                F.col(f"_m{i}").alias("bad_format"),
            )
        )
    return unpivot_aggregates(df.agg(*aggregates), structs)


def value_pattern(text: Column) -> Column:
    """The shape of a text: capitals A, small letters a, digits 9, rest kept."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """Cardinality, extremes, text lengths and most frequent value per column.

    The default is one pass with sketches, which also tell quantiles and more
    of the frequent values (:mod:`drayage.operators.sketches`). ``exact``
    counts values instead: rows become (column, value) pairs, combined on the
    map side, then one row per column. Ties for the top value go to the value
    that sorts first.
    """
    columns = list(columns or df.columns)
    if not exact:
        return sketched_profile(column_sketches(df, columns))
    cells = {c: canonical_text(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns}
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), cells[c].alias("value")) for c in columns])
        ).alias("p")
    ).select("p.*")
    counted = pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    value = F.col("value")
    has = value.isNotNull()
    frequency = F.when(has, F.struct((-F.col("n")).alias("n"), value))
    profile = counted.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("value_count"),
        F.count(value).alias("distinct_count"),
        F.min(value).alias("min_text"),
        F.max(value).alias("max_text"),
        F.max(F.length(value)).alias("max_length"),
        (F.sum(F.length(value) * F.col("n")).cast("double") / F.sum(F.when(has, F.col("n")))).alias("avg_length"),
        F.min(frequency).alias("_top"),
    )
    return profile.select(
        "column_name",
        "value_count",
        "distinct_count",
        "min_text",
        "max_text",
        "max_length",
        "avg_length",
        F.col("_top.value").alias("top_value"),
        (-F.col("_top.n")).alias("top_count"),
    )


def pattern_profile(df: DataFrame, column: str) -> DataFrame:
    """``pattern, row_count`` of a text column; see :func:`value_pattern`."""
    return df.groupBy(value_pattern(F.col(f"`{column}`")).alias("pattern")).agg(F.count(F.lit(1)).alias("row_count"))


def quality_scorecard(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], edges: Sequence[Edge]
) -> DataFrame:
    """Per table: bad cells, score and whether the migration is blocked.

    Bad cells are NULLs, surplus rows of the key and orphan rows, one cell
    each. The score is ``100 * (1 - bad cells / all cells)``; a duplicate key
    or an orphan blocks. Formula and blocking rule are this library's own.
    """
    parts = None
    for name, df in tables.items():
        counted = df.agg(
            F.count(F.lit(1)).alias("row_count"),
            sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0)).alias("null_cells"),
        ).select(
            F.lit(name).alias("table_name"),
            "row_count",
            (F.col("row_count") * len(df.columns)).alias("cell_count"),
            "null_cells",
        )
        parts = counted if parts is None else parts.unionAll(counted)
    surplus = None
    for name, key in keys.items():
        part = duplicate_keys(tables[name], key).agg(
            F.coalesce(F.sum(F.col("row_count") - 1), F.lit(0)).alias("duplicate_rows")
        )
        part = part.select(F.lit(name).alias("table_name"), "duplicate_rows")
        surplus = part if surplus is None else surplus.unionAll(part)
    orphans = fk_coverage(tables, edges) if edges else None
    out = parts
    if surplus is not None:
        out = out.join(surplus, "table_name", "left")
    else:
        out = out.withColumn("duplicate_rows", F.lit(0).cast("long"))
    if orphans is not None:
        out = out.join(orphans.groupBy("table_name").agg(F.sum("orphan_rows").alias("orphan_rows")), "table_name", "left")
    else:
        out = out.withColumn("orphan_rows", F.lit(0).cast("long"))
    out = out.fillna(0, ["duplicate_rows", "orphan_rows"])
    bad = F.col("null_cells") + F.col("duplicate_rows") + F.col("orphan_rows")
    score = F.when(F.col("cell_count") > 0, F.lit(100.0) * (F.lit(1.0) - bad / F.col("cell_count"))).otherwise(100.0)
    return out.withColumns(
        {
            "quality_score": F.round(score, 4),
            "is_blocking": (F.col("duplicate_rows") > 0) | (F.col("orphan_rows") > 0),
        }
    )


@dataclass(frozen=True)
class ComplexityLimits:
    """From these values on a table counts as moderate / complex."""

    columns: tuple[int, int] = (8, 15)
    references: tuple[int, int] = (2, 4)
    text_columns: tuple[int, int] = (4, 8)
    rows: tuple[int, int] = (10_000, 1_000_000_000)


def complexity_class(
    inventory: DataFrame, counts: DataFrame, edges: DataFrame, limits: ComplexityLimits = ComplexityLimits()
) -> DataFrame:
    """Simple, moderate or complex per table: the worst of its measures.

    ``inventory`` holds ``table_name, column_name, data_type``, ``counts``
    ``table_name, row_count`` and ``edges`` ``table_name, ref_table``. The
    thresholds are this library's own.
    """
    columns = inventory.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("column_count"), F.count_if(F.col("data_type") == "string").alias("text_columns")
    )
    both_ends = edges.select("table_name").unionAll(edges.select(F.col("ref_table").alias("table_name")))
    degree = both_ends.groupBy("table_name").agg(F.count(F.lit(1)).alias("reference_count"))
    out = columns.join(counts, "table_name", "left").join(degree, "table_name", "left")
    out = out.fillna(0, ["row_count", "reference_count"])
    measures = [
        ("column_count", limits.columns),
        ("reference_count", limits.references),
        ("text_columns", limits.text_columns),
        ("row_count", limits.rows),
    ]

    def any_from(level: int) -> Column:
        test = F.lit(False)
        for name, bounds in measures:
            test = test | (F.col(name) >= bounds[level])
        return test

    label = F.when(any_from(1), "complex").when(any_from(0), "moderate").otherwise("simple")
    return out.withColumn("complexity", label)


