"""Schema inference and flattening over JSON documents made from rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from drayage.operators import documents as d
from drayage.plans.registry import Tables, query

# The same text in both engines: fields and types vary with the event id.
DOCUMENT = """
    CASE event_id % 5
        WHEN 0 THEN '{"k": ' || (event_id % 100) || ', "value": 1.5}'
        WHEN 1 THEN '{"k": "' || event_type || '", "tags": [1, 2]}'
        WHEN 2 THEN '{"k": null, "nested": {"a": ' || event_id || '}}'
        WHEN 3 THEN '{"k": 7, "_ts": ' || user_id || ', "flag": true}'
        ELSE props END
"""


def documents(t: Tables) -> DataFrame:
    return t.spread("events").selectExpr("event_id", f"{DOCUMENT} AS doc")


FIELDS = f"""
    WITH docs AS (SELECT event_id AS id, {DOCUMENT} AS doc FROM events),
    keyed AS (SELECT id, doc, unnest(json_keys(doc)) AS field FROM docs),
    fields AS (
        SELECT id, field, doc ->> ('$.' || field) AS text,
               CASE json_type(doc, '$.' || field) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list'
                    WHEN 'VARCHAR' THEN 'str' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool'
                    WHEN 'NULL' THEN 'NoneType' ELSE 'int' END AS type
        FROM keyed
    )
"""


@query(
    "infer_document_schema",
    FIELDS
    + """
    SELECT field, array_to_string(list_sort(list_distinct(list(type))), ',') AS types, bool_or(type = 'NoneType')
               AS nullable, left(min_by(text, id) FILTER (type <> 'NoneType'), 200) AS sample
    FROM fields GROUP BY field
    """,
)
def infer_document_schema(t: Tables) -> DataFrame:
    return d.infer_document_schema(documents(t), "doc", "event_id")


@query(
    "infer_document_schema_public",
    FIELDS
    + """
    SELECT field, array_to_string(list_sort(list_distinct(list(type))), ',') AS types,
           bool_or(type = 'NoneType') AS nullable
    FROM fields WHERE field NOT LIKE '\\_%' ESCAPE '\\' GROUP BY field
    """,
)
def infer_document_schema_public(t: Tables) -> DataFrame:
    return d.infer_document_schema(documents(t), "doc", "event_id", skip_prefix="_", with_sample=False)


@query(
    "schema_drift",
    FIELDS
    + """
    SELECT field, count(*) AS document_count, array_to_string(list_sort(list_distinct(list(type))), ',') AS types,
           count(DISTINCT CASE WHEN type <> 'NoneType' THEN type END) AS type_count,
           (SELECT count(*) FROM docs) AS total_documents,
           100.0::DOUBLE * count(*) / (SELECT count(*) FROM docs) AS presence_percent,
           count(*) < (SELECT count(*) FROM docs)
               OR count(DISTINCT CASE WHEN type <> 'NoneType' THEN type END) > 1 AS drifts
    FROM fields GROUP BY field
    """,
)
def schema_drift(t: Tables) -> DataFrame:
    return d.schema_drift(documents(t), "doc", "event_id")


@query(
    "common_fields",
    FIELDS
    + """
    , stats AS (
        SELECT field, count(*) AS document_count, bool_or(type IN ('dict', 'list')) AS is_complex
        FROM fields GROUP BY field
    ), kept AS (SELECT * FROM stats WHERE document_count >= ceil((SELECT count(*) FROM docs) * 0.2))
    SELECT * FROM kept
    WHERE (SELECT count(*) FROM kept) >= 2 AND (SELECT count(*) FILTER (is_complex) FROM kept) <= 2
    """,
)
def common_fields(t: Tables) -> DataFrame:
    return d.common_fields(documents(t), "doc", "event_id", share=0.2)


LINE_SCHEMA = (
    "head struct<order: bigint, flag: struct<ret: string, status: string>>, tags array<string>, "
    "parts array<struct<part: bigint, prices: array<double>>>"
)


def line_documents(t: Tables) -> DataFrame:
    """A nested document per line item, numbered by all its key columns."""
    return t.spread("lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "to_json(named_struct('head', named_struct('order', l_orderkey, 'flag', "
        "named_struct('ret', l_returnflag, 'status', l_linestatus)), "
        "'tags', array(l_returnflag, l_linestatus), "
        "'parts', array(named_struct('part', l_partkey, 'prices', array(l_extendedprice, l_tax)), "
        "named_struct('part', l_suppkey, 'prices', array(l_discount))))) AS doc",
    )


KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query(
    "flatten_documents",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey AS head_order, l_returnflag AS head_flag_ret,
           l_linestatus AS head_flag_status FROM lineitem
    """,
)
def flatten_documents(t: Tables) -> DataFrame:
    return d.flatten_documents(line_documents(t), KEYS, "doc", LINE_SCHEMA)["root"]


@query(
    "flatten_children",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, 0::INTEGER AS parts_pos, l_partkey AS part FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 1, l_suppkey FROM lineitem
    """,
)
def flatten_children(t: Tables) -> DataFrame:
    return d.flatten_documents(line_documents(t), KEYS, "doc", LINE_SCHEMA)["root_parts"]


@query(
    "flatten_grandchildren",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, 0::INTEGER AS parts_pos, 0::INTEGER AS prices_pos,
           l_extendedprice AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 0, 1, l_tax FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 1, 0, l_discount FROM lineitem
    """,
)
def flatten_grandchildren(t: Tables) -> DataFrame:
    return d.flatten_documents(line_documents(t), KEYS, "doc", LINE_SCHEMA)["root_parts_prices"]


# Documents without a schema: a map whose keys vary, arrays in arrays, a field of two types, one that is always null.
LOOSE = """
    '{"id": ' || event_id || ', "who": ' || CASE WHEN event_id % 7 = 0 THEN '"none"' ELSE '' || user_id END
    || ', "gone": null, "hits": {"' || event_type || '": ' || (event_id % 10) || ', "all": ' || (event_id % 4) || '}'
    || ', "grid": [[' || (event_id % 3) || ', ' || (event_id % 5) || '], [], [' || (event_id % 2) || ']]}'
"""


def loose(t: Tables) -> dict[str, DataFrame]:
    docs = t.spread("events").selectExpr("event_id", f"{LOOSE} AS doc")
    return d.flatten_documents(docs, ["event_id"], "doc", maps=["hits"])


@query(
    "flatten_loose",
    """
    SELECT event_id, NULL::VARCHAR AS gone, event_id AS id,
           CASE WHEN event_id % 7 = 0 THEN 'none' ELSE user_id::VARCHAR END AS who FROM events
    """,
)
def flatten_loose(t: Tables) -> DataFrame:
    return loose(t)["root"]


@query(
    "flatten_map",
    """
    SELECT event_id, event_type AS hits_key, event_id % 10 AS value FROM events
    UNION ALL SELECT event_id, 'all', event_id % 4 FROM events
    """,
)
def flatten_map(t: Tables) -> DataFrame:
    return loose(t)["root_hits"]


@query(
    "flatten_arrays_in_arrays",
    """
    SELECT event_id, 0::INTEGER AS grid_pos, 0::INTEGER AS item_pos, event_id % 3 AS value FROM events
    UNION ALL SELECT event_id, 0, 1, event_id % 5 FROM events
    UNION ALL SELECT event_id, 2, 0, event_id % 2 FROM events
    """,
)
def flatten_arrays_in_arrays(t: Tables) -> DataFrame:
    return loose(t)["root_grid_item"]
