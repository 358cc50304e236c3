"""The expression library by category, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.functions.expressions import custom, expr
from drayage.plans.registry import Tables, query


@query(
    "expr_string",
    """
    SELECT p_partkey, upper(p_name) AS upper_name, lower(p_brand) AS lower_brand, trim('  ' || p_name || ' ') AS trimmed,
           ltrim('  ' || p_name) AS left_trimmed, rtrim(p_name || '  ') AS right_trimmed,
           p_brand || ' - ' || p_type AS joined, substring(p_name, 2, 4) AS part_name,
           replace(p_brand, '#', '.') AS replaced, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS regex_replaced,
           lpad(p_partkey::VARCHAR, 8, '0') AS left_padded, rpad(p_partkey::VARCHAR, 8, '*') AS right_padded,
           regexp_replace(lower(trim(' ' || p_brand || ' ')), '[^a-zA-Z0-9_-]', '_', 'g') AS sanitized,
           CASE WHEN length(p_name) > 8 THEN left(p_name, 5) || '...' ELSE p_name END AS shortened
    FROM part
    """,
)
def expr_string(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        expr("upper", column="p_name").alias("upper_name"),
        expr("lower", column="p_brand").alias("lower_brand"),
        expr("trim", column=F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).alias("trimmed"),
        expr("ltrim", column=F.concat(F.lit("  "), F.col("p_name"))).alias("left_trimmed"),
        expr("rtrim", column=F.concat(F.col("p_name"), F.lit("  "))).alias("right_trimmed"),
        expr("concat", column1="p_brand", separator=" - ", column2="p_type").alias("joined"),
        expr("substring", column="p_name", start=2, length=4).alias("part_name"),
        expr("replace", column="p_brand", old_value="#", new_value=".").alias("replaced"),
        expr("regex_replace", column="p_name", pattern="[aeiou]+", replacement="_").alias("regex_replaced"),
        expr("left_pad", column="p_partkey", length=8, pad_char="0").alias("left_padded"),
        expr("right_pad", column="p_partkey", length=8, pad_char="*").alias("right_padded"),
        expr("sanitize_name", column=F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))).alias("sanitized"),
        expr("truncate", column="p_name", length=8).alias("shortened"),
    )


def soundex_sql(name: str) -> str:
    """First letter, then the codes of the rest: runs of one code count once,
    vowels part them, H and W do not."""
    codes = "'BFPVCGJKQSXZDTLMNRAEIOUY HW', '1111222222223345560000000'"
    coded = (
        f"CASE WHEN upper(left({name}, 1)) IN ('H', 'W') THEN '7' ELSE translate(upper(left({name}, 1)), {codes}) END "
        f"|| translate(upper(substring({name}, 2)), {codes})"
    )
    for digit in range(7):
        coded = f"regexp_replace({coded}, '{digit}+', '{digit}', 'g')"
    return f"upper(left({name}, 1)) || left(replace(substring({coded}, 2), '0', '') || '000', 3)"


@query("expr_soundex", f"SELECT p_partkey, {soundex_sql('p_name')} AS code FROM part")
def expr_soundex(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", expr("soundex", column="p_name").alias("code"))


@query(
    "expr_cast",
    """
    SELECT o_orderkey, o_orderkey::VARCHAR AS as_string, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey::INTEGER END AS as_int,
           CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS as_long,
           CASE WHEN o_orderkey % 3 > 0 THEN o_custkey::FLOAT END AS as_float, o_totalprice AS as_double,
           CASE WHEN o_totalprice < 100000 THEN o_totalprice::DECIMAL(7,2) END AS as_decimal,
           CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate::DATE END AS as_date,
           CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + INTERVAL 90 MINUTE END AS as_timestamp,
           CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS as_boolean
    FROM orders
    """,
)
def expr_cast(t: Tables) -> DataFrame:
    number = F.expr("if(o_orderkey % 3 > 0, cast(o_custkey AS string), concat('x', o_custkey))")
    day = F.expr("if(o_orderkey % 4 > 0, date_format(o_orderdate, 'dd/MM/yyyy'), 'soon')")
    time = F.expr("if(o_orderkey % 4 > 0, date_format(o_orderdate + INTERVAL 90 MINUTES, 'yyyyMMdd HHmmss'), '')")
    flag = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'maybe' WHEN 1 THEN 'true' ELSE 'no' END")
    return t.spread("orders").select(
        "o_orderkey",
        expr("to_string", column="o_orderkey").alias("as_string"),
        expr("to_integer", column=number).alias("as_int"),
        expr("to_long", column=number).alias("as_long"),
        expr("to_float", column=number).alias("as_float"),
        expr("to_double", column=F.col("o_totalprice").cast("string")).alias("as_double"),
        expr("to_decimal", column="o_totalprice", precision=7, scale=2).alias("as_decimal"),
        expr("to_date", column=day, format="dd/MM/yyyy").alias("as_date"),
        expr("to_timestamp", column=time, format="yyyyMMdd HHmmss").alias("as_timestamp"),
        expr("to_boolean", column=flag).alias("as_boolean"),
    )


@query(
    "expr_date",
    """
    SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month,
           day(o_orderdate)::INTEGER AS day, date_diff('day', o_orderdate::DATE, DATE '2002-01-01')::INTEGER AS days_left,
           (o_orderdate::DATE + 30) AS due_date, strftime(o_orderdate, '%d.%m.%Y') AS day_text
    FROM orders
    """,
)
def expr_date(t: Tables) -> DataFrame:
    as_of = F.lit("2002-01-01").cast("date")
    return t.spread("orders").select(
        "o_orderkey",
        expr("year", column="o_orderdate").alias("year"),
        expr("month", column="o_orderdate").alias("month"),
        expr("day_of_month", column="o_orderdate").alias("day"),
        expr("date_diff", start_column="o_orderdate", end_column=as_of).alias("days_left"),
        expr("add_days", column="o_orderdate", days=30).alias("due_date"),
        expr("format_date", column="o_orderdate", format="dd.MM.yyyy").alias("day_text"),
    )


@query(
    "expr_null_cond",
    """
    SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS filled,
           coalesce(nullif(o_orderstatus, 'P'), o_orderpriority) AS replaced,
           nullif(o_orderpriority, '5-LOW') IS NULL AS is_missing,
           CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size_class,
           CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS status_name,
           CASE WHEN o_totalprice >= 1000 AND o_orderstatus = 'F' THEN 'bill' END AS free_form
    FROM orders
    """,
)
def expr_null_cond(t: Tables) -> DataFrame:
    priority = F.expr("nullif(o_orderpriority, '5-LOW')")
    status = F.expr("nullif(o_orderstatus, 'P')")
    return t.spread("orders").select(
        "o_orderkey",
        expr("coalesce", column=priority, default_value="none").alias("filled"),
        expr("iif_null", column=status, replacement=F.col("o_orderpriority")).alias("replaced"),
        expr("is_null", column=priority).alias("is_missing"),
        expr("iif", condition="o_totalprice > 200000", true_value="large", false_value="small").alias("size_class"),
        expr("case_when", column="o_orderstatus", cases={"F": "final", "O": "open"}, default="other").alias("status_name"),
        custom("CASE WHEN o_totalprice >= 1000 AND o_orderstatus = 'F' THEN 'bill' END").alias("free_form"),
    )


@query(
    "expr_hash",
    """
    SELECT c_custkey, md5(c_name) AS name_md5, md5(c_custkey::VARCHAR) AS key_md5, sha256(c_name) AS name_sha,
           md5(c_mktsegment) AS segment_md5
    FROM customer
    """,
)
def expr_hash(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey",
        expr("md5", column="c_name").alias("name_md5"),
        expr("md5", column="c_custkey").alias("key_md5"),
        expr("sha2_256", column="c_name").alias("name_sha"),
        expr("hash_md5", column="c_mktsegment").alias("segment_md5"),
    )


@query(
    "expr_math",
    """
    SELECT o_orderkey, round(o_totalprice::DECIMAL(18,2), 1)::DOUBLE AS rounded,
           round(o_custkey::DECIMAL(18,2), -2)::BIGINT AS hundreds FROM orders
    """,
)
def expr_math(t: Tables) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return t.spread("orders").select(
        "o_orderkey",
        expr("round", column=price, decimals=1).cast("double").alias("rounded"),
        expr("round", column="o_custkey", decimals=-2).alias("hundreds"),
    )
