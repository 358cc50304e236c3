"""URL filters by dated lists.

The dated entries of block and allow lists become validity intervals. A capture
has a key for its host, for each domain above it and for each path prefix; a
join by key and time finds the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY = ("list", "effect", "kind", "pattern")
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; empty if there is none."""
    place = F.regexp_extract(F.coalesce(url, F.lit("")), SCHEME + r"([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", ""))


def segments_of(url: Column) -> Column:
    """The segments of the path, empty ones left out."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), SCHEME + r"[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def keys_of(url: Column, depth: int) -> Column:
    """(kind, pattern) of every entry that can match a URL: its host, the domains, prefixes of up to ``depth`` segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    count = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count - i + 1), "."))
    segments = F.slice(segments_of(url), 1, max(depth, 1))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(segments)), lambda i: F.concat_ws("/", host, F.when(i > 0, F.array_join(F.slice(segments, 1, i), "/")))
    )
    named = lambda kind, patterns: F.transform(patterns, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern")))
    found = F.concat(named("host", F.array(host)), named("domain", domains), named("prefix", prefixes))
    return F.when(host == "", F.array().cast("array<struct<kind:string,pattern:string>>")).otherwise(F.array_distinct(found))


def validity(events: DataFrame) -> DataFrame:
    """Intervals ``valid_from`` (in) to ``valid_to`` (out, null if open) of each entry.

    ``events`` has list, effect ('block' or 'allow'), kind ('host', 'domain' or
    'prefix'), pattern, action ('add' or 'remove') and at. An entry is active
    from an 'add' to the next 'remove'. Of events of an entry at one time, repeated
    ones count once and a 'remove' beats an 'add'; adding what is active changes
    nothing. Rows with a null in the entry or the time are no events.
    """
    known = events.dropna(subset=[*ENTRY, "action", "at"])
    at_once = known.groupBy(*ENTRY, "at").agg(F.min(F.col("action") == "add").alias("on"))
    order = Window.partitionBy(*ENTRY).orderBy("at")
    changes = at_once.withColumn("before", F.lag("on", 1, False).over(order)).where(F.col("on") != F.col("before"))
    closed = changes.withColumn("valid_to", F.lead("at").over(order)).where("on")
    return closed.select(*ENTRY, F.col("at").alias("valid_from"), "valid_to")


def prefix_depth(intervals: DataFrame) -> int:
    """Segments of the longest prefix in the lists."""
    found = intervals.where(F.col("kind") == "prefix").agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0]
    return found or 0


def judge(captures: DataFrame, intervals: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``key``, ``url``, ``at``, ``host``, ``n_block``, ``n_allow``, ``first_block`` and ``blocked`` of every capture.

    ``n_block`` and ``n_allow`` count the entries active at fetch time;
    ``first_block`` names one, by list, kind and pattern. A capture is blocked
    if a block entry is active and no allow entry. Captures with a null URL, URL
    without a host, or null time match nothing. Rows that repeat are judged
    each. A key that many captures have is a join that Spark splits: the other
    side holds one entry's intervals. Other columns are not read.
    """
    read = captures.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(at).alias("at"))
    read = read.withColumn("row", F.monotonically_increasing_id())
    asked = read.select("row", "at", F.explode(keys_of(F.col("url"), prefix_depth(intervals))).alias("k")).select("row", "at", "k.*")
    active = asked.join(intervals, ["kind", "pattern"]).where(
        (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    )
    block = F.col("effect") == "block"
    name = F.concat_ws(" ", "list", "kind", "pattern")
    found = active.groupBy("row").agg(
        F.count_if(block).alias("n_block"), F.count_if(~block).alias("n_allow"), F.min(F.when(block, name)).alias("first_block")
    )
    none = F.lit(0).cast("long")
    out = read.join(found, "row", "left")
    counts = {c: F.coalesce(F.col(c), none) for c in ("n_block", "n_allow")}
    return out.select(
        F.col("key").alias(key), F.col("url").alias(url), F.col("at").alias(at), host_of(F.col("url")).alias("host"),
        *[v.alias(c) for c, v in counts.items()], "first_block", ((counts["n_block"] > 0) & (counts["n_allow"] == 0)).alias("blocked"),
    )
