"""Report texts built around whole documents, plan texts and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.operators import text as x
from drayage.plans.registry import Tables, query

# A report around each document; the same expression in both engines.
REPORT = """
    CASE doc_id % 4
    WHEN 0 THEN '# Report ' || doc_id || '

Total: ' || n_chars || ' chars, count 12,345 found 7, Score: 45.5% risk ' || n_chars || '

## Overview

### Text
| skipped |
' || text || '

## Figures
Counted over all sources
| Name | Value | Note |
|:---|---:|---|
| chars | ' || n_chars || ' | ' || lang || ' |
| source | ' || source || ' |  |
| share | 1,234.5 | - |
| key | -' || doc_id || ' | end |
'
    WHEN 1 THEN text
    WHEN 2 THEN '## Small
| A |
|---|
| ' || lang || ' |
- one
- two
' || text || '
## Empty
{"status":"uploaded","container":"c","blob":"b"}

## Last
   ' || source || ' processed 5 analyzed 5 identified 6 found 8 count 9 total 10'
    ELSE '* a
* b
* c
- d
- e
# Head
' || text END
"""
AGENT = "CASE WHEN doc_id % 7 = 0 THEN 'DataQualityAgent' ELSE source END"


def reports(t: Tables) -> DataFrame:
    return t.spread("documents").selectExpr("doc_id", f"{AGENT} AS agent", f"{REPORT} AS report")


REPORTS = f"WITH reports AS (SELECT doc_id, {AGENT} AS agent, {REPORT} AS report FROM documents)"

STRIP = "trim(line, ' ' || chr(9) || chr(13))"
LINES = (
    REPORTS
    + f"""
    , split AS (SELECT doc_id, string_split(report, chr(10)) AS parts FROM reports),
    raw AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
    lines AS (SELECT doc_id, pos, {STRIP} AS line FROM raw)
"""
)


@query(
    "report_classify",
    REPORTS
    + r"""
    , counted AS (
        SELECT doc_id, agent, report, len(regexp_extract_all(report, '(?m)^#{1,4}\s'))::INTEGER AS heading_count,
               len(regexp_extract_all(report, '(?m)^\|'))::INTEGER AS table_line_count,
               len(regexp_extract_all(report, '(?m)^[-*]\s'))::INTEGER AS list_line_count
        FROM reports
    )
    SELECT doc_id, heading_count, table_line_count, list_line_count,
           length(report) >= 300 AND (
               regexp_matches(lower(agent),
                              'report|discovery|analysis|quality|mapping|assessment|audit|summary|migration')
               OR heading_count >= 2 OR table_line_count >= 4
               OR (heading_count >= 1 AND (table_line_count >= 2 OR list_line_count >= 5))) AS is_report
    FROM counted
    """,
)
def report_classify(t: Tables) -> DataFrame:
    return x.report_classify(reports(t), "report", "agent").drop("agent", "report")


TABLES_SQL = (
    LINES
    + r"""
    , bars AS (
        SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run
        FROM lines WHERE line LIKE '|%'
    ), numbered AS (
        SELECT *, row_number() OVER w AS n, regexp_full_match(line, '\|[\s:|-]*-[\s:|-]*\|') AS is_sep
        FROM bars WINDOW w AS (PARTITION BY doc_id, run ORDER BY pos)
    ), placed AS (
        SELECT *, min(n) FILTER (is_sep) OVER (PARTITION BY doc_id, run) AS sep FROM numbered
    ), data AS (
        SELECT doc_id, run, line, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS row_no
        FROM placed WHERE sep > 1 AND n > sep AND NOT is_sep
    ), heads AS (SELECT doc_id, run, line AS header FROM placed WHERE sep > 1 AND n = sep - 1),
    tables AS (
        SELECT doc_id, run, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS table_no
        FROM (SELECT DISTINCT doc_id, run FROM data)
    )
"""
)


@query(
    "report_tables_flag",
    TABLES_SQL
    + """
    SELECT doc_id, doc_id IN (SELECT doc_id FROM data GROUP BY doc_id, run HAVING count(*) >= 3) AS has_tables
    FROM reports
    """,
)
def report_tables_flag(t: Tables) -> DataFrame:
    return x.significant_tables(reports(t), "report").select("doc_id", "has_tables")


@query(
    "markdown_table_rows",
    TABLES_SQL
    + f"""
    , cells AS (
        SELECT doc_id, run, row_no, list_filter(list_transform(string_split(line, '|'), lambda line: {STRIP}),
                                                lambda c: c <> '') AS cells,
               list_filter(list_transform(string_split(header, '|'), lambda line: {STRIP}), lambda c: c <> '') AS names
        FROM data JOIN heads USING (doc_id, run)
    ), flat AS (
        SELECT doc_id, run, row_no, unnest(cells) AS value, generate_subscripts(cells, 1) AS column_no, names FROM cells
    )
    SELECT doc_id, table_no::INTEGER AS table_no, row_no::INTEGER AS row_no, column_no::INTEGER AS column_no,
           names[column_no] AS column_name, value,
           CASE WHEN contains(value, '.') THEN TRY_CAST(replace(value, ',', '') AS DOUBLE)
                WHEN regexp_full_match(value, '-?[0-9]+') THEN value::DOUBLE END AS number
    FROM flat JOIN tables USING (doc_id, run) WHERE column_no <= len(names)
    """,
)
def markdown_table_rows(t: Tables) -> DataFrame:
    return x.markdown_table_rows(reports(t), "doc_id", "report")


@query(
    "report_table_totals",
    TABLES_SQL
    + """
    SELECT r.doc_id, count(DISTINCT t.table_no) AS table_count, count(d.row_no) AS table_rows
    FROM reports r LEFT JOIN tables t ON t.doc_id = r.doc_id LEFT JOIN data d ON d.doc_id = t.doc_id AND d.run = t.run
    GROUP BY r.doc_id
    """,
)
def report_table_totals(t: Tables) -> DataFrame:
    return x.table_totals(reports(t), "doc_id", "report")


@query(
    "section_heads",
    LINES
    + """
    , grouped AS (
        SELECT *, count(*) FILTER (line LIKE '## %') OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM lines
    ), heads AS (SELECT doc_id, section_no, trim(substring(line, 4)) AS section FROM grouped WHERE line LIKE '## %'),
    firsts AS (
        SELECT doc_id, section_no, min_by(line, pos) AS first_line FROM grouped
        WHERE section_no > 0 AND line <> '' AND line NOT LIKE '#%' AND line NOT LIKE '|%'
          AND NOT (line LIKE '{%' AND contains(line, '"status":"uploaded"'))
        GROUP BY doc_id, section_no
    )
    SELECT doc_id, section_no::INTEGER AS section_no, section,
           CASE WHEN length(first_line) > 150 THEN left(first_line, 147) || '...' ELSE first_line END AS first_line
    FROM heads JOIN firsts USING (doc_id, section_no)
    """,
)
def section_heads(t: Tables) -> DataFrame:
    return x.section_heads(reports(t), "doc_id", "report")


METRIC = r"(?i)(?:total|count|found|identified|analyzed|processed|risk|score)[:\s]+(\d+(?:,\d+)*(?:\.\d+)?%?)"


@query(
    "metric_extract",
    REPORTS
    + f"""
    , found AS (SELECT doc_id, regexp_extract_all(report, '{METRIC}', 1)[1:5] AS metrics FROM reports),
    flat AS (SELECT doc_id, unnest(metrics) AS metric, generate_subscripts(metrics, 1) AS pos FROM found),
    firsts AS (SELECT doc_id, metric, min(pos) AS pos FROM flat GROUP BY doc_id, metric)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS metric_no, metric FROM firsts
    """,
)
def metric_extract(t: Tables) -> DataFrame:
    return x.metric_extract(reports(t), "doc_id", "report")


INFRASTRUCTURE = """
    CASE doc_id % 5
    WHEN 0 THEN '{"resource_group": "rg-' || doc_id || '", "name": "adf' || lang || '", "location": "' || source || '"}'
    WHEN 1 THEN 'Created Resource Group: rg_' || doc_id || ' and Data Factory named `adf-' || doc_id || '` for you'
    WHEN 2 THEN 'id /subscriptions/s/resourceGroups/group' || doc_id
        || '/providers/Microsoft.DataFactory/factories/factory' || doc_id || ' "storage_account": "st' || doc_id || '"'
    WHEN 3 THEN '"resource_group": "first" resource group second "name" : "st' || lang || '"'
    ELSE '' END || ' ' || text
"""


def attribute(patterns: list[tuple[str, int]]) -> str:
    found = [f"nullif(regexp_extract(report, '{p.replace(chr(39), chr(39) * 2)}', {g}), '')" for p, g in patterns]
    return f"coalesce({', '.join([*found, 'NULL'])})"


@query(
    "attribute_extract",
    f"""
    WITH reports AS (SELECT doc_id, {INFRASTRUCTURE} AS report FROM documents)
    SELECT doc_id, {', '.join(f'{attribute(p)} AS {n}' for n, p in x.DEPLOYMENT_ATTRIBUTES.items())} FROM reports
    """,
)
def attribute_extract(t: Tables) -> DataFrame:
    texts = t.spread("documents").selectExpr("doc_id", f"{INFRASTRUCTURE} AS report")
    return x.attribute_extract(texts, "report").drop("report")


PLAN_TEXT = """
    CASE o_orderkey % 4
    WHEN 0 THEN '{"task": "t", "steps": [{"step_number": 3, "agent": "discovery agent", "task": "Find ' || o_custkey
        || '", "dependencies": []}, {"agent": "Mapping", "task": "Map", "dependencies": [3, 1]}]}'
    WHEN 1 THEN 'Plan follows:
1. [Discovery_Agent] Find ' || o_custkey || '
2. [QualityAgent] Check (all) rows (depends on: 1)
  3. [Nobody] Report ' || o_orderpriority || ' (depend on 1, 2)
Done.'
    WHEN 2 THEN 'Here:
```json
{"steps": [{"step_number": 1, "agent": "QualityAgent", "task": "Only ' || o_orderkey || '"}]}
```
ok'
    ELSE 'Move order ' || o_orderkey || ' somehow' END
"""
AGENTS = ["DiscoveryAgent", "MappingAgent", "QualityAgent"]


@query(
    "plan_steps_extract",
    """
    SELECT o_orderkey, 'json' AS form, 3::INTEGER AS step_number, 'DiscoveryAgent' AS agent, 'Find ' || o_custkey AS task,
           '' AS dependencies FROM orders WHERE o_orderkey % 4 = 0
    UNION ALL SELECT o_orderkey, 'json', 2, 'MappingAgent', 'Map', '3,1' FROM orders WHERE o_orderkey % 4 = 0
    UNION ALL SELECT o_orderkey, 'numbered', 1, 'DiscoveryAgent', 'Find ' || o_custkey, ''
              FROM orders WHERE o_orderkey % 4 = 1
    UNION ALL SELECT o_orderkey, 'numbered', 2, 'QualityAgent', 'Check (all) rows', '1' FROM orders WHERE o_orderkey % 4 = 1
    UNION ALL SELECT o_orderkey, 'numbered', 3, 'Nobody', 'Report ' || o_orderpriority, '1,2'
              FROM orders WHERE o_orderkey % 4 = 1
    UNION ALL SELECT o_orderkey, 'json', 1, 'QualityAgent', 'Only ' || o_orderkey, '' FROM orders WHERE o_orderkey % 4 = 2
    UNION ALL SELECT o_orderkey, 'text', 1, 'DiscoveryAgent', 'Move order ' || o_orderkey || ' somehow', ''
              FROM orders WHERE o_orderkey % 4 = 3
    """,
)
def plan_steps_extract(t: Tables) -> DataFrame:
    texts = t.spread("orders").selectExpr("o_orderkey", f"{PLAN_TEXT} AS plan_text")
    steps = x.plan_steps_extract(texts, "o_orderkey", "plan_text", AGENTS)
    return steps.withColumn("dependencies", F.array_join("dependencies", ","))


NAME = """
    CASE p_partkey % 5 WHEN 0 THEN upper(p_brand) WHEN 1 THEN replace(p_brand, '#', ' _#')
        WHEN 2 THEN 'x ' || p_brand || '_y' WHEN 3 THEN p_name ELSE substring(p_brand, 3, 9) END
"""


@query(
    "fuzzy_name_match",
    f"""
    WITH names AS (SELECT p_partkey, {NAME} AS name FROM part),
    candidates AS (SELECT p_brand AS candidate, min(p_partkey) AS ord FROM part GROUP BY p_brand),
    folded AS (SELECT DISTINCT name, regexp_replace(lower(name), '[ _]', '', 'g') AS f FROM names),
    hits AS (
        SELECT name, candidate, ord,
               CASE WHEN candidate = name THEN 0
                    WHEN regexp_replace(lower(candidate), '[ _]', '', 'g') = f THEN 1
                    WHEN f <> '' AND (contains(lower(candidate), f) OR contains(f, lower(candidate))) THEN 2 END AS rank
        FROM folded CROSS JOIN candidates
    ), best AS (
        SELECT name, candidate FROM hits WHERE rank IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, ord) = 1
    )
    SELECT p_partkey, n.name, coalesce(candidate, n.name) AS match FROM names n LEFT JOIN best b ON b.name = n.name
    """,
)
def fuzzy_name_match(t: Tables) -> DataFrame:
    names = t.part.selectExpr("p_partkey", f"{NAME} AS name")
    candidates = t.part.selectExpr("p_brand AS candidate", "p_partkey AS ord")
    return x.fuzzy_match(names, "name", candidates, "candidate", "ord")


UPLOADS = """
    text || ' {"status":"uploaded","container":"c' || (doc_id % 3) || '","blob":"b' || (doc_id % 5) || '.csv"} and '
    || '{"blob":"other.csv", "container":"c' || (doc_id % 2) || '","status": "success"} twice '
    || '{"status":"uploaded","container":"c' || (doc_id % 3) || '","blob":"b' || (doc_id % 5) || '.csv"} not '
    || '{"status":"failed","container":"c","blob":"d"} {"status":"uploaded","blob":"e"}'
"""


@query(
    "upload_refs",
    """
    SELECT doc_id, 'c' || doc_id % 3 AS container, 'b' || doc_id % 5 || '.csv' AS blob FROM documents
    UNION ALL SELECT doc_id, 'c' || doc_id % 2, 'other.csv' FROM documents
    """,
)
def upload_refs(t: Tables) -> DataFrame:
    return x.upload_refs(t.spread("documents").selectExpr("doc_id", f"{UPLOADS} AS report"), "doc_id", "report")


def upload_record(key: str) -> str:
    return f"""'{{"status":"uploaded","container":"c","blob":"' || {key} || '"}}'"""


@query(
    "missing_uploads",
    f"""
    SELECT doc_id, {upload_record("doc_id % 4")} AS raw, 1::INTEGER AS seq, 'c' AS container,
           (doc_id % 4)::VARCHAR AS blob FROM documents WHERE doc_id % 2 = 1
    UNION ALL SELECT doc_id, {upload_record("doc_id")}, 3, 'c', doc_id::VARCHAR FROM documents WHERE doc_id > 3
    """,
)
def missing_uploads(t: Tables) -> DataFrame:
    """Two records per document, the first one twice; even texts show it."""
    texts = t.spread("documents").selectExpr(
        "doc_id", f"text || if(doc_id % 2 = 0, {upload_record('(doc_id % 4)')}, '') AS report"
    )
    records = [(upload_record("(doc_id % 4)"), 1), (upload_record("(doc_id % 4)"), 2), (upload_record("doc_id"), 3)]
    uploads = None
    for raw, seq in records:
        part = t.spread("documents").selectExpr("doc_id", f"{raw} AS raw", f"{seq} AS seq")
        uploads = part if uploads is None else uploads.unionAll(part)
    return x.missing_uploads(texts, uploads, "doc_id", "report", "raw", "seq")


LISTS = """
    'intro - not - a list
### Tables (' || o_orderkey || ' items)

- orders - ' || o_custkey || ' rows
* line items – 12 rows
customers (all) — 7 rows

- notes - none
closing line
**Details**
a - b
c d - e-f

  g - ' || o_orderpriority || '
#### Short
x - y
z - w
# Prose
Only words here
- i - 1
- j - 2
- k - 3
'
"""


@query(
    "list_to_table",
    """
    WITH items AS (
        SELECT * FROM (VALUES (1, 'Table', 'Row Count', 1, 'orders', 'ROWS'), (1, 'Table', 'Row Count', 2, 'line items', '12 rows'),
            (1, 'Table', 'Row Count', 3, 'customers (all)', '7 rows'), (1, 'Table', 'Row Count', 4, 'notes', 'none'),
            (2, 'Name', 'Details', 1, 'a', 'b'), (2, 'Name', 'Details', 2, 'c d', 'e-f'),
            (2, 'Name', 'Details', 3, 'g', 'PRIORITY')) v(section_no, name_title, value_title, item_no, name, value)
    )
    SELECT o_orderkey, section_no::INTEGER AS section_no,
           CASE section_no WHEN 1 THEN 'Tables (' || o_orderkey || ' items)' ELSE 'Details' END AS heading, name_title,
           value_title, item_no::INTEGER AS item_no, name,
           CASE value WHEN 'ROWS' THEN o_custkey || ' rows' WHEN 'PRIORITY' THEN o_orderpriority ELSE value END AS value
    FROM orders CROSS JOIN items
    """,
)
def list_to_table(t: Tables) -> DataFrame:
    return x.list_to_table(t.spread("orders").selectExpr("o_orderkey", f"{LISTS} AS report"), "o_orderkey", "report")


KEY = """
    CASE event_id % 6 WHEN 0 THEN 'Status' WHEN 1 THEN 'provisioning_state' WHEN 2 THEN 'accessible'
        WHEN 3 THEN 'fallback_used' WHEN 4 THEN 'state' ELSE 'other' END
"""
VALUE = """
    CASE WHEN event_id % 6 IN (2, 3) THEN CASE WHEN event_type = 'click' THEN 'true' ELSE 'false' END
        ELSE CASE event_type WHEN 'click' THEN 'Succeeded' WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'partial_ok'
             WHEN 'signup' THEN 'ready' ELSE event_type END END
"""


@query(
    "status_normalize",
    f"""
    WITH pairs AS (SELECT event_id, lower({KEY}) AS k, lower({VALUE}) AS v FROM events)
    SELECT event_id,
           CASE WHEN k IN ('status', 'provisioning_state', 'state', 'discovery_status')
                THEN CASE WHEN v IN ('succeeded', 'ready') THEN 'success' WHEN v = 'error' THEN 'failed'
                          WHEN contains(v, 'partial') THEN 'warning' ELSE 'info' END
                WHEN k = 'accessible' THEN CASE v WHEN 'true' THEN 'success' ELSE 'failed' END
                WHEN k = 'fallback_used' AND v = 'true' THEN 'warning' END AS status_type
    FROM pairs
    """,
)
def status_normalize(t: Tables) -> DataFrame:
    pairs = t.spread("events").selectExpr("event_id", f"{KEY} AS key", f"{VALUE} AS value")
    return pairs.select("event_id", x.status_normalize(F.col("key"), F.col("value")).alias("status_type"))


@query(
    "humanise_keys",
    """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Total Size Mb ' || upper(left(event_type, 1)) || substring(event_type, 2)
                          WHEN 1 THEN 'Resource ID SQL' ELSE 'SKU Name URL' END AS label
    FROM events
    """,
)
def humanise_keys(t: Tables) -> DataFrame:
    key = "CASE event_id % 3 WHEN 0 THEN 'total_size_mb_' || event_type WHEN 1 THEN 'resourceId-sql' ELSE 'skuNameUrl' END"
    keys = t.spread("events").selectExpr("event_id", f"{key} AS key")
    return keys.select("event_id", x.humanise_key(F.col("key")).alias("label"))
