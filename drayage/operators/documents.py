"""Schemas of JSON documents: inference, drift, common fields, flattening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.operators.quality import percent

# The name reported for each kind of JSON value.
TYPE_NAMES = {
    "ARRAY": "list",
    "BIGINT": "int",
    "BOOLEAN": "bool",
    "DECIMAL": "float",
    "DOUBLE": "float",
    "FLOAT": "float",
    "OBJECT": "dict",
    "STRING": "str",
    "VOID": "NoneType",
}
COMPLEX_TYPES = ("dict", "list")
SAMPLE_LENGTH = 200


def document_fields(df: DataFrame, json_column: str, id_column: str) -> DataFrame:
    """One row per document and top-level field: ``id, field, value, type``.

    Text that holds no JSON object has no fields.
    """
    parsed = F.from_json(json_column, "map<string,variant>")
    fields = df.select(F.col(id_column).alias("id"), F.explode(parsed).alias("field", "value"))
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    return fields.withColumn("type", F.coalesce(names[kind], F.lower(kind)))


def _types() -> Column:
    # At most one entry per kind of JSON value.
    return F.array_join(F.sort_array(F.collect_set("type")), ",")


def infer_document_schema(
    df: DataFrame,
    json_column: str,
    id_column: str,
    sample_docs: int | None = None,
    skip_prefix: str = "",
    with_sample: bool = True,
) -> DataFrame:
    """Per field: sorted type set, nullability, first value by document id.

    Reads all documents, or the first ``sample_docs`` by id. Fields starting
    with ``skip_prefix`` are left out.
    """
    docs = df.select(id_column, json_column)
    if sample_docs:
        docs = docs.orderBy(id_column).limit(sample_docs)
    fields = document_fields(docs, json_column, id_column)
    if skip_prefix:
        fields = fields.filter(~F.startswith("field", F.lit(skip_prefix)))
    is_null = F.col("type") == "NoneType"
    text = F.substring(F.col("value").cast("string"), 1, SAMPLE_LENGTH)
    columns = [_types().alias("types"), F.bool_or(is_null).alias("nullable")]
    if with_sample:
        columns.append(F.min_by(text, F.when(~is_null, F.col("id"))).alias("sample"))
    return fields.groupBy("field").agg(*columns)


def schema_drift(df: DataFrame, json_column: str, id_column: str) -> DataFrame:
    """Per field: documents that hold it, presence, types, drift flag.

    A field drifts if some document lacks it or its non-null types differ.
    """
    fields = document_fields(df, json_column, id_column)
    stats = fields.groupBy("field").agg(
        F.count(F.lit(1)).alias("document_count"),
        _types().alias("types"),
        F.count_distinct(F.when(F.col("type") != "NoneType", F.col("type"))).alias("type_count"),
    )
    counted = stats.withColumn("total_documents", df.agg(F.count(F.lit(1))).scalar())
    drifts = (F.col("document_count") < F.col("total_documents")) | (F.col("type_count") > 1)
    return counted.withColumns(
        {"presence_percent": percent(F.col("document_count"), F.col("total_documents")), "drifts": drifts}
    )


def common_fields(
    df: DataFrame, json_column: str, id_column: str, share: float = 0.5, min_fields: int = 2, max_complex: int = 2
) -> DataFrame:
    """The fields to show documents as a table, or none if they do not fit.

    Kept are fields in at least ``share`` of the documents. There must be two
    documents and ``min_fields`` such fields, of which at most ``max_complex``
    hold objects or arrays.
    """
    fields = document_fields(df, json_column, id_column)
    stats = fields.groupBy("field").agg(
        F.count(F.lit(1)).alias("document_count"),
        F.bool_or(F.col("type").isin(*COMPLEX_TYPES)).alias("is_complex"),
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    kept = stats.filter((F.col("document_count") >= F.ceil(total * F.lit(share))) & (total >= 2))
    fits = kept.agg((F.count(F.lit(1)) >= min_fields) & (F.count_if("is_complex") <= max_complex))
    return kept.filter(fits.scalar())


# Different fields from which an object of documents without a schema counts as a map.
MAP_FIELDS = 200


def inferred_schema(df: DataFrame, json_column: str, maps: Sequence[str] = (), map_fields: int = MAP_FIELDS) -> T.StructType:
    """The schema that holds all documents, found in one pass over them.

    Values of several types, and fields that are always null, become text.
    Objects at the dotted paths in ``maps``, and those with more than
    ``map_fields`` different fields, become maps. Texts that are no JSON object
    do not count; no documents give no fields.
    """
    value = F.try_parse_json(json_column)
    objects = df.select(F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value).alias("v"))
    found = objects.filter("v IS NOT NULL").agg(F.schema_of_variant_agg("v")).first()[0]
    if not found.startswith("OBJECT"):
        return T.StructType([])
    kind = df.sparkSession.createDataFrame([], f"doc {found.replace('OBJECT<', 'STRUCT<')}").schema["doc"].dataType

    def settled(t: T.DataType, path: str) -> T.DataType:
        if isinstance(t, (T.VariantType, T.NullType)):
            return T.StringType()
        if isinstance(t, T.ArrayType):
            return T.ArrayType(settled(t.elementType, path))
        if isinstance(t, T.StructType):
            fields = [T.StructField(f.name, settled(f.dataType, f"{path}.{f.name}".lstrip("."))) for f in t.fields]
            if path in maps or (path and len(fields) > map_fields):
                kinds = {f.dataType.json(): f.dataType for f in fields}
                return T.MapType(T.StringType(), next(iter(kinds.values())) if len(kinds) == 1 else T.StringType())
            return T.StructType(fields)
        return t

    return settled(kind, "")


def flatten_documents(
    df: DataFrame,
    keys: Sequence[str],
    json_column: str,
    schema: T.StructType | str | None = None,
    name: str = "root",
    maps: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Documents as flat tables: one for the objects, one per array or map.

    Nested objects become columns ``a_b``. An array becomes a table named after
    its path, with the parent's keys, ``<array>_pos`` counted from 0 and the
    flattened items (``value`` for plain items). A map becomes such a table with
    ``<map>_key``. Items that are arrays or maps themselves become a table below
    that, named ``..._item``. Parents with an empty array or map have no row there.

    Without ``schema`` it is found by :func:`inferred_schema`, to which ``maps``
    is handed on.
    """
    schema = inferred_schema(df, json_column, maps) if schema is None else schema
    parsed = df.select(*keys, F.from_json(json_column, schema).alias("_doc"))
    return _flatten(parsed, list(keys), F.col("_doc"), parsed.schema["_doc"].dataType, name)


def _flatten(df: DataFrame, keys: list[str], value: Column, kind: T.DataType, name: str) -> dict[str, DataFrame]:
    leaves: list[Column] = []
    nested: list[tuple[str, Column, T.DataType]] = []

    def walk(t: T.DataType, inner: Column, path: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(f.dataType, inner.getField(f.name), f"{path}_{f.name}" if path else f.name)
        elif isinstance(t, (T.ArrayType, T.MapType)):
            nested.append((path or "item", inner, t))
        else:
            leaves.append(inner.alias(path or "value"))

    walk(kind, value, "")
    out = {name: df.select(*keys, *leaves)}
    for path, inner, t in nested:
        if isinstance(t, T.MapType):
            place, item = f"{path}_key", t.valueType
            child = df.select(*keys, F.explode(inner).alias(place, "_item"))
        else:
            place, item = f"{path}_pos", t.elementType
            child = df.select(*keys, F.posexplode(inner).alias(place, "_item"))
        out.update(_flatten(child, [*keys, place], F.col("_item"), item, f"{name}_{path}"))
    return out
