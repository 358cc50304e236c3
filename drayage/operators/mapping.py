"""Type mapping, column mapping and casts of the data itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.functions.type_rules import DEFAULT_TYPE, SCALED_TYPES, SIZED_TYPES, TYPE_RULES, system
from drayage.operators.dataflow import first_per_key

# An unquoted name in an expression.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def map_types(columns: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target_type`` to a column inventory.

    Reads ``data_type`` and, where present, ``character_maximum_length``,
    ``numeric_precision`` and ``numeric_scale``. The rules are chosen by the
    pair of systems; without a rule the target's own text type is used.
    """
    pair = (system(source), system(target))
    if pair not in TYPE_RULES:
        raise ValueError(f"no type rules for {pair}")
    spark = columns.sparkSession
    # At most 30 rows, whatever the data.
    rules = F.broadcast(spark.createDataFrame(list(TYPE_RULES[pair].items()), "_type string, _mapped string"))
    mapped = F.coalesce("_mapped", F.lit(DEFAULT_TYPE[pair[1]]))
    have = set(columns.columns)
    chain = F.when(F.lit(False), mapped)
    if "character_maximum_length" in have:
        length = F.col("character_maximum_length")
        sized = F.format_string("%s(%d)", mapped, length.cast("int"))
        chain = chain.when(mapped.isin(*SIZED_TYPES) & (length > 0), sized)
    if "numeric_precision" in have:
        precision = F.col("numeric_precision").cast("int")
        scale = F.coalesce("numeric_scale", F.lit(0)).cast("int") if "numeric_scale" in have else F.lit(0)
        scaled = F.format_string("%s(%d,%d)", mapped, precision, scale)
        chain = chain.when(mapped.isin(*SCALED_TYPES) & (precision > 0), scaled)
    joined = columns.withColumn("_lower", F.lower("data_type")).join(rules, F.col("_lower") == F.col("_type"), "left")
    return joined.withColumn("target_type", chain.otherwise(mapped)).drop("_lower", "_type", "_mapped")


def map_columns(
    source: DataFrame, target: DataFrame, transforms: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Pair source and target columns by name, ignoring case.

    ``source`` and ``target`` hold ``name, type, ordinal``; ``transforms`` holds
    ``target_column, expression``. With ``by`` (such as a table name) many
    tables are mapped in one job. ``kind`` of a result row is ``direct``,
    ``type_cast``, ``transform``, ``unmapped_source`` or ``unmapped_target``.
    Every source column that an expression names counts as mapped.
    """
    by = list(by)
    if transforms is None:
        fields = [f for f in source.schema.fields if f.name in by]
        empty = source.select(*[f.name for f in fields]).limit(0)
        transforms = empty.withColumns(
            {"target_column": F.lit(None).cast("string"), "expression": F.lit(None).cast("string")}
        )
    s = source.select(*by, F.col("name").alias("source_column"), F.col("type").alias("source_type"))
    s = s.withColumn("_name", F.lower("source_column"))
    t = target.withColumn("_name", F.lower("name"))
    first = first_per_key(t, [*by, "_name"], ["ordinal"])
    first = first.select(*by, "_name", F.col("name").alias("target_column"), F.col("type").alias("target_type"))
    made = transforms.select(*by, F.lower("target_column").alias("_name")).distinct().withColumn("_made", F.lit(True))
    names = F.explode(F.regexp_extract_all("expression", F.lit(IDENTIFIER), F.lit(0)))
    used = transforms.select(*by, names.alias("_name")).select(*by, F.lower("_name").alias("_name"))
    used = used.distinct().withColumn("_used", F.lit(True))

    keys = [*by, "_name"]
    paired = s.join(first, keys, "left").join(made, keys, "left").join(used, keys, "left")
    is_direct = F.col("target_column").isNotNull() & F.col("_made").isNull()
    same_type = F.lower("source_type") == F.lower("target_type")
    kind = (
        F.when(is_direct & same_type, "direct")
        .when(is_direct, "type_cast")
        .when(F.col("_used").isNull(), "unmapped_source")
    )
    nothing = F.lit(None).cast("string")
    from_source = paired.withColumn("kind", kind).filter("kind IS NOT NULL")
    from_source = from_source.select(
        *by,
        "kind",
        "source_column",
        "source_type",
        F.when(is_direct, F.col("target_column")).alias("target_column"),
        F.when(is_direct, F.col("target_type")).alias("target_type"),
        nothing.alias("expression"),
    )
    from_transforms = transforms.select(
        *by,
        F.lit("transform").alias("kind"),
        nothing.alias("source_column"),
        nothing.alias("source_type"),
        "target_column",
        nothing.alias("target_type"),
        "expression",
    )
    left_over = t.join(s.select(*keys).distinct(), keys, "left_anti").join(made, keys, "left_anti")
    from_target = left_over.select(
        *by,
        F.lit("unmapped_target").alias("kind"),
        nothing.alias("source_column"),
        nothing.alias("source_type"),
        F.col("name").alias("target_column"),
        F.col("type").alias("target_type"),
        nothing.alias("expression"),
    )
    return from_source.unionAll(from_transforms).unionAll(from_target)


def mapping_summary(mapped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many columns of a mapping are direct, cast, transformed and unmapped on either side, per ``by``."""
    kinds = ("direct", "type_cast", "transform", "unmapped_source", "unmapped_target")
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    return mapped.groupBy(*by).agg(*counts)


Mapping = Sequence[tuple[str, str, str]]


def conform(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Cast ``(source, target, spark_type)`` columns; what does not fit is NULL."""
    return df.select(*[F.col(f"`{s}`").try_cast(kind).alias(t) for s, t, kind in mapping])


def cast_failures(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Per column, the values that :func:`conform` would lose; one pass for all."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.count_if(F.col(f"`{s}`").isNotNull() & F.col(f"`{s}`").try_cast(kind).isNull()).alias(f"_f{i}")
            for i, (s, _, kind) in enumerate(mapping)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("source_column"),
                F.lit(t).alias("target_column"),
                F.lit(kind).alias("target_type"),
                F.col("_rows").alias("row_count"),
                F.col(f"_f{i}").alias("failed_count"),
            )
            for i, (s, t, kind) in enumerate(mapping)
        ]
    )
    return counted.select(F.explode(rows).alias("r")).select("r.*")
