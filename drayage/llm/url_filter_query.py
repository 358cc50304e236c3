"""Captures and list events come from ``pages``: times and entries from hashes of URL and host."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.llm.registry import query
from drayage.llm.url_filter import host_of, judge, validity
from drayage.plans.registry import Tables

SQL = """
WITH p AS (
    SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
           TIMESTAMP '2024-01-01' + to_days((('0x' || substr(md5('t' || url), 1, 6))::INTEGER % 400)) AS fetched_at
    FROM pages),
h AS (
    SELECT host, list_aggregate(list_slice(string_split(host, '.'), -3, -1), 'string_agg', '.') AS domain
    FROM p WHERE host <> '' GROUP BY host),
n AS (
    SELECT *, ('0x' || substr(md5('a' || host), 1, 6))::INTEGER AS a, ('0x' || substr(md5('b' || host), 1, 6))::INTEGER AS b,
           ('0x' || substr(md5('c' || host), 1, 6))::INTEGER AS c, ('0x' || substr(md5('d' || domain), 1, 6))::INTEGER AS d FROM h),
e AS (
    SELECT 'hosts' AS list, 'block' AS effect, 'host' AS kind, host AS pattern, 'add' AS action, b % 200 AS day FROM n WHERE a % 2 = 0
    UNION ALL SELECT 'hosts', 'block', 'host', host, 'remove', 200 + c % 100 FROM n WHERE a % 2 = 0 AND b % 2 = 0
    UNION ALL SELECT 'hosts', 'block', 'host', host, 'add', 300 + a % 60 FROM n WHERE a % 2 = 0 AND c % 3 = 0
    UNION ALL SELECT 'domains', 'block', 'domain', domain, 'add', d % 365 FROM n WHERE d % 4 = 0
    UNION ALL SELECT 'paths', 'block', 'prefix', host || '/en', 'add', c % 365 FROM n WHERE a % 3 = 0
    UNION ALL SELECT 'trusted', 'allow', 'host', host, 'add', a % 365 FROM n WHERE c % 5 = 0
    UNION ALL SELECT 'trusted', 'allow', 'host', host, 'remove', a % 365 + 30 FROM n WHERE c % 10 = 0),
m AS (
    SELECT p.page_id, p.url, p.fetched_at, e.list, e.effect, e.kind, e.pattern,
           arg_max(e.action, (TIMESTAMP '2024-01-01' + to_days(e.day), e.action)) AS last
    FROM p JOIN e ON TIMESTAMP '2024-01-01' + to_days(e.day) <= p.fetched_at AND CASE e.kind
        WHEN 'host' THEN p.host = e.pattern
        WHEN 'domain' THEN p.host = e.pattern OR ends_with(p.host, '.' || e.pattern)
        ELSE p.host || p.path = e.pattern OR starts_with(p.host || p.path, e.pattern || '/') END
    GROUP BY ALL),
s AS (
    SELECT page_id, url, fetched_at, count(*) FILTER (WHERE effect = 'block') AS n_block, count(*) FILTER (WHERE effect = 'allow') AS n_allow,
           min(list || ' ' || kind || ' ' || pattern) FILTER (WHERE effect = 'block') AS first_block
    FROM m WHERE last = 'add' GROUP BY ALL)
SELECT p.page_id, p.url, p.fetched_at, p.host, coalesce(s.n_block, 0)::BIGINT AS n_block, coalesce(s.n_allow, 0)::BIGINT AS n_allow,
       s.first_block, coalesce(s.n_block, 0) > 0 AND coalesce(s.n_allow, 0) = 0 AS blocked
FROM p LEFT JOIN s ON p.page_id = s.page_id AND p.url = s.url AND p.fetched_at = s.fetched_at
"""


def number(salt: str, text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text)), 1, 6), 16, 10).cast("int")


def day(count: Column) -> Column:
    return F.dateadd(F.lit("2024-01-01").cast("date"), count).cast("timestamp_ntz")


def captures(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", day(number("t", F.col("url")) % 400).alias("fetched_at"))


def list_events(t: Tables) -> DataFrame:
    hosts = t.pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    domain = F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.lit(1), F.size(F.split("host", r"\.")) - 2), 3), ".")
    n = hosts.withColumn("domain", domain)
    n = n.select("host", "domain", *[number(s, F.col("host")).alias(s) for s in "abc"], number("d", F.col("domain")).alias("d"))
    a, b, c, d, host = (F.col(x) for x in ("a", "b", "c", "d", "host"))

    def entry(where, list_, effect, kind, pattern, action, when):
        return n.where(where).select(
            F.lit(list_).alias("list"), F.lit(effect).alias("effect"), F.lit(kind).alias("kind"), pattern.alias("pattern"),
            F.lit(action).alias("action"), day(when).alias("at"),
        )

    return reduce(DataFrame.unionByName, [
        entry(a % 2 == 0, "hosts", "block", "host", host, "add", b % 200),
        entry((a % 2 == 0) & (b % 2 == 0), "hosts", "block", "host", host, "remove", 200 + c % 100),
        entry((a % 2 == 0) & (c % 3 == 0), "hosts", "block", "host", host, "add", 300 + a % 60),
        entry(d % 4 == 0, "domains", "block", "domain", F.col("domain"), "add", d % 365),
        entry(a % 3 == 0, "paths", "block", "prefix", F.concat(host, F.lit("/en")), "add", c % 365),
        entry(c % 5 == 0, "trusted", "allow", "host", host, "add", a % 365),
        entry(c % 10 == 0, "trusted", "allow", "host", host, "remove", a % 365 + 30),
    ])


@query("op6_url_filters", SQL)
def op6_url_filters(t: Tables) -> DataFrame:
    return judge(captures(t), validity(list_events(t)))
