"""Sources, catalog and sinks: each writes and reads the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.operators.load import load_table
from drayage.plans.registry import ALL_TABLES, Tables, query
from drayage.session import scratch_path
from drayage.sources import files, inventory, sinks
from drayage.sources.bounded_sql import bounded_query
from drayage.sources.documents import find


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    t.customer.write.option("header", True).csv(path)
    return files.read_csv(t.spark, path, t.customer.schema)


@query(
    "scan_parquet",
    """
    SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 500 AS truncated,
           (SELECT count(*) FROM orders) AS total_rows
    FROM orders ORDER BY o_orderkey LIMIT 500
    """,
)
def scan_parquet(t: Tables) -> DataFrame:
    orders = files.read_parquet(t.spark, t.path("orders")).select("o_orderkey", "o_totalprice")
    return files.preview(orders, 500, ["o_orderkey"], count=True).annotated()


EVENT_LINES = "event_id bigint, event_type string, value double"


def event_lines(t: Tables) -> DataFrame:
    """Events as JSON lines, every 40th cut short."""
    path = scratch_path(t.spark, "json")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    cut = F.when(F.col("event_id") % 40 == 0, F.expr("substring(line, 1, length(line) - 5)")).otherwise(F.col("line"))
    sinks.write_text(t.events.withColumn("line", line).select(cut.alias("line")), path, "line")
    return files.read_json_lines(t.spark, path, EVENT_LINES)


@query("scan_json_lenient", "SELECT event_id, event_type, value FROM events WHERE event_id % 40 <> 0")
def scan_json_lenient(t: Tables) -> DataFrame:
    return files.good_lines(event_lines(t))


@query("scan_json_bad_lines", "SELECT count(*) AS bad_lines FROM events WHERE event_id % 40 = 0")
def scan_json_bad_lines(t: Tables) -> DataFrame:
    return files.bad_lines(event_lines(t)).agg(F.count(F.lit(1)).alias("bad_lines"))


def text_folder(t: Tables) -> str:
    path = scratch_path(t.spark, "text")
    sinks.write_text(t.documents, path, "text")
    return path


@query("scan_text_prefix")
def scan_text_prefix(t: Tables) -> DataFrame:
    return files.read_text_prefix(t.spark, text_folder(t), 10_000, glob="*.txt")


@query("file_inventory")
def file_inventory(t: Tables) -> DataFrame:
    return files.file_inventory(t.spark, text_folder(t), glob="*.txt")


FILES = """
    WITH files AS (
        SELECT doc_id // 50 AS file, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents GROUP BY 1
    )
"""


def document_files(t: Tables) -> str:
    """Fifty documents to a file, in order."""
    path = scratch_path(t.spark, "document-files")
    rows = t.documents.selectExpr("text", "doc_id", "doc_id DIV 50 AS file").repartition("file").sortWithinPartitions("file", "doc_id")
    rows.select("text", "file").write.partitionBy("file").text(path)
    return path


def file_number(column: str) -> Column:
    return F.regexp_extract(column, "file=([0-9]+)", 1).cast("bigint")


@query("scan_text_heads", FILES + "SELECT file, left(body, 2000) AS head, strlen(body) > 10000 AS truncated FROM files")
def scan_text_heads(t: Tables) -> DataFrame:
    heads = files.read_text_prefix(t.spark, document_files(t), 10_000)
    return heads.select(file_number("path").alias("file"), F.left("text", F.lit(2000)).alias("head"), "truncated")


@query("file_inventory_sizes", FILES + "SELECT file, strlen(body)::BIGINT AS size, 1::BIGINT AS file_count FROM files")
def file_inventory_sizes(t: Tables) -> DataFrame:
    listed = files.file_inventory(t.spark, document_files(t), glob="*.txt").withColumn("file", file_number("path"))
    return listed.groupBy("file").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("file_count"))


@query("scan_json_arrays", "SELECT event_id, event_type, value FROM events")
def scan_json_arrays(t: Tables) -> DataFrame:
    """Files that hold one array of 500 objects each."""
    path = scratch_path(t.spark, "json-arrays")
    rows = t.events.selectExpr("event_id DIV 500 AS file", "to_json(struct(event_id, event_type, value)) AS item")
    arrays = rows.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ", "), F.lit("]")).alias("text"))
    arrays.repartition("file").write.partitionBy("file").text(path)
    return files.read_json_documents(t.spark, path, "event_id bigint, event_type string, value double").drop("file")


@query(
    "file_inventory_total",
    "SELECT sum(strlen(text) + 1)::BIGINT AS total_size, bool_and(text IS NOT NULL) AS all_text FROM documents",
)
def file_inventory_total(t: Tables) -> DataFrame:
    listed = files.file_inventory(t.spark, text_folder(t), glob="*.txt")
    return listed.agg(F.sum("size").alias("total_size"), F.bool_and(F.endswith("name", F.lit(".txt"))).alias("all_text"))


@query(
    "infer_file_schema",
    """
    SELECT column_name, data_type, TRUE AS is_nullable, (SELECT count(*) FROM customer) AS row_count,
           0::BIGINT AS null_count, sample
    FROM (
        SELECT 'c_custkey' AS column_name, 'int' AS data_type, min(c_custkey::VARCHAR) AS sample FROM customer
        UNION ALL SELECT 'c_name', 'string', min(c_name) FROM customer
        UNION ALL SELECT 'c_nationkey', 'int', min(c_nationkey::VARCHAR) FROM customer
        UNION ALL SELECT 'c_acctbal', 'double', min(c_acctbal::DECIMAL(38,6)::VARCHAR) FROM customer
        UNION ALL SELECT 'c_mktsegment', 'string', min(c_mktsegment) FROM customer
    )
    """,
)
def infer_file_schema(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    t.customer.write.option("header", True).csv(path)
    return files.file_schema(files.read_csv(t.spark, path))


@query(
    "document_find",
    """
    SELECT event_id, props FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events)
    WHERE (k >= 50 AND k < 60) OR k IN (1, 2, 3)
    """,
)
def document_find(t: Tables) -> DataFrame:
    wanted = {"$or": [{"k": {"$gte": 50, "$lt": 60}}, {"k": {"$in": [1, 2, 3]}}], "missing": {"$exists": False}}
    return find(t.spread("events").select("event_id", "props"), "props", wanted)


@query(
    "table_inventory",
    " UNION ALL ".join(
        f"SELECT 'default' AS schema_name, '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in ALL_TABLES
    ),
)
def table_inventory(t: Tables) -> DataFrame:
    return inventory.table_inventory({n: getattr(t, n) for n in ALL_TABLES})


def inventory_sql(table: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, {i}::INTEGER AS ordinal, '{kind}' AS data_type, "
        f"NULL::INTEGER AS numeric_precision, NULL::INTEGER AS numeric_scale, TRUE AS is_nullable, "
        f"count(*) AS row_count, count(*) - count({c}) AS null_count FROM {table}"
        for i, (c, kind) in enumerate(columns, start=1)
    )


@query(
    "column_inventory",
    inventory_sql(
        "orders",
        [
            ("o_orderkey", "bigint"),
            ("o_custkey", "bigint"),
            ("o_orderstatus", "string"),
            ("o_totalprice", "double"),
            ("o_orderdate", "timestamp_ntz"),
            ("o_orderpriority", "string"),
        ],
    )
    + " UNION ALL "
    + inventory_sql(
        "supplier", [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")]
    ),
)
def column_inventory(t: Tables) -> DataFrame:
    return inventory.measured_inventory({"orders": t.orders, "supplier": t.supplier})


@query(
    "schema_table_counts",
    """
    SELECT schema_name, count(c_name) AS table_count
    FROM (SELECT CASE WHEN p_partkey % 200 = 0 THEN 'SYS' ELSE 'schema_' || p_partkey END AS schema_name FROM part)
    LEFT JOIN (SELECT 'schema_' || c_custkey % 700 AS s, c_name FROM customer) ON s = schema_name
    WHERE schema_name <> 'SYS' GROUP BY schema_name
    """,
)
def schema_table_counts(t: Tables) -> DataFrame:
    schemas = t.part.selectExpr("if(p_partkey % 200 = 0, 'SYS', concat('schema_', p_partkey)) AS schema_name")
    tables = t.customer.selectExpr("concat('schema_', c_custkey % 700) AS schema_name", "c_name AS table_name")
    return inventory.schema_table_counts(schemas, tables)


@query(
    "bounded_query",
    """
    SELECT o_custkey, count(*) AS order_count, TRUE AS truncated FROM orders
    GROUP BY o_custkey ORDER BY order_count DESC, o_custkey LIMIT 100
    """,
)
def bounded_query_plan(t: Tables) -> DataFrame:
    view = f"orders_{uuid.uuid4().hex}"
    t.orders.createTempView(view)
    text = f"""
        WITH per_customer AS (SELECT o_custkey, count(*) AS order_count FROM {view} GROUP BY o_custkey)
        SELECT * FROM per_customer ORDER BY order_count DESC, o_custkey;
    """
    try:
        return bounded_query(t.spark, text).annotated()
    finally:
        t.spark.catalog.dropTempView(view)


@query(
    "sink_append",
    """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'
    """,
)
def sink_append(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "append")
    source = t.orders
    for condition in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'", "o_orderstatus = 'P'"):
        sinks.append(source.filter(condition).select("o_orderkey", "o_totalprice"), path)
    return t.spark.read.parquet(path)


@query("sink_replace", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def sink_replace(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "replace")
    source = t.orders
    for condition in ("o_orderstatus = 'F'", "o_orderstatus = 'O'"):
        sinks.replace(source.filter(condition).select("o_orderkey", "o_totalprice"), path)
    return t.spark.read.parquet(path)


@query("sink_text", "SELECT o_orderkey::VARCHAR || ';' || o_orderstatus AS value FROM orders")
def sink_text(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "report")
    sinks.write_text(t.orders.selectExpr("concat(o_orderkey, ';', o_orderstatus) AS value"), path)
    return t.spark.read.text(path)


@query("create_target", "SELECT s_suppkey AS supplier_id, s_name AS supplier_name FROM supplier")
def create_target(t: Tables) -> DataFrame:
    schema = T.StructType.fromDDL("supplier_id bigint, supplier_name string")
    path = scratch_path(t.spark, "target")
    name = "target_" + path.rsplit("-", 1)[1]
    sinks.create_target(t.spark, name, schema, path)
    try:
        rows = t.supplier.selectExpr("s_suppkey AS supplier_id", "s_name AS supplier_name")
        sinks.require_schema(rows, schema).write.insertInto(name)
    finally:
        t.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return t.spark.read.schema(schema).parquet(path)


@query(
    "schema_gate",
    """
    SELECT 'o_totalprice' AS column_name, 'retyped' AS issue, 'double' AS actual_type, 'decimal(18,2)' AS target_type,
           FALSE AS passes, count(*) AS row_count FROM orders
    UNION ALL SELECT 'o_clerk', 'missing', NULL, 'string', FALSE, count(*) FROM orders
    UNION ALL SELECT 'o_custkey', 'extra', 'bigint', NULL, TRUE, count(*) FROM orders
    UNION ALL SELECT 'o_orderstatus', 'extra', 'string', NULL, TRUE, count(*) FROM orders
    UNION ALL SELECT 'o_orderpriority', 'extra', 'string', NULL, TRUE, count(*) FROM orders
    """,
)
def schema_gate(t: Tables) -> DataFrame:
    target = T.StructType.fromDDL(
        "o_orderkey bigint, o_totalprice decimal(18,2), o_orderdate timestamp_ntz, o_clerk string"
    )
    gate = sinks.schema_gate(t.orders, target, allow_drift=True)
    return gate.withColumn("row_count", t.orders.agg(F.count(F.lit(1))).scalar())


@query(
    "layout",
    """
    SELECT n_name, count(*) AS order_count FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
    """,
)
def layout(t: Tables) -> DataFrame:
    orders = sinks.layout(t.orders.select(F.col("o_custkey").alias("c_custkey")), "HASH", ["c_custkey"])
    customers = sinks.layout(t.customer.select("c_custkey", "c_nationkey"), "HASH", ["c_custkey"])
    nations = sinks.layout(t.nation.withColumnRenamed("n_nationkey", "c_nationkey"), "REPLICATE")
    joined = orders.join(customers, "c_custkey").join(nations, "c_nationkey")
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("order_count"))


@query(
    "load_fixture",
    """
    SELECT 'supplier' AS table_name, 'loaded' AS status, count(*) AS row_count, FALSE AS has_message FROM supplier
    UNION ALL SELECT 'customer', 'loaded', count(*), FALSE FROM customer
    UNION ALL SELECT 'supplier', 'exists', NULL, TRUE
    """,
)
def load_fixture(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "fixture")
    loads = [(n, getattr(t, n)) for n in ("supplier", "customer", "supplier")]  # the second time it is there
    parts = [load_table(df, f"{base}/{name}", name) for name, df in loads]
    statuses = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return statuses.withColumn("has_message", F.col("message").isNotNull()).drop("message")
