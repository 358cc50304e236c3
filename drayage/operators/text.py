"""Report texts as tables: structure, markdown tables, metrics, plan steps.

Everything works inside a row, on the whole text, in the JVM: texts are cut
into lines, blocks or matches and exploded, with no shuffle. Patterns avoid
nested backtracking, so time grows with the length of the text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Lines end at \n only (?d), and ^ and $ match at them (?m).
LINES = "(?md)"

# What makes a text a report.
MIN_REPORT_LENGTH = 300
REPORT_KEYWORDS = (
    "report",
    "discovery",
    "analysis",
    "quality",
    "mapping",
    "assessment",
    "audit",
    "summary",
    "migration",
)
HEADING = r"^#{1,4}\s"
TABLE_LINE = r"^\|"
LIST_LINE = r"^[-*]\s"
METRIC = (
    r"(?i)(?:total|count|found|identified|analyzed|processed|risk|score)[:\s]+(\d+(?:,\d+)*(?:\.\d+)?%?)"
)
MAX_METRICS = 5
FIRST_LINE_LENGTH = 150

# Attributes of a deployment report, patterns in order of trust.
RESOURCE_PATH = (
    r'/subscriptions/[^/]+/resourceGroups/([^/]+)/providers/Microsoft\.DataFactory/factories/([^/"\s]+)'
)
DEPLOYMENT_ATTRIBUTES: dict[str, list[tuple[str, int]]] = {
    "resource_group": [
        (r'"resource_group"\s*:\s*"([^"]+)"', 1),
        (r"(?i)resource[_ ]?group[:\s]+[`\"']?([a-zA-Z0-9_-]+)", 1),
        (RESOURCE_PATH, 1),
    ],
    "factory_name": [
        (r'"(?:factory_name|name)"\s*:\s*"(adf[a-zA-Z0-9_-]*)"', 1),
        (r"[Dd]ata\s+[Ff]actory\s+(?:named?\s+)?[`\"']?([a-zA-Z0-9_-]+)", 1),
        (RESOURCE_PATH, 2),
    ],
    "location": [(r'"location"\s*:\s*"([^"]+)"', 1)],
    "storage_account": [(r'"(?:storage_account|name)"\s*:\s*"(st[a-z0-9]+)"', 1)],
}

# A numbered plan step and a fenced JSON block.
PLAN_STEP = (
    r"(?<!\d)(\d++)\.\s*\[([^\]\n]+)\]\s*(\S(?:[^\n]*?\S)?)[ \t\r]*+(?:\(depends?\s*on:?\s*([\d,\s]+)\))?[ \t\r]*+$"
)
FENCE, FENCE_LABEL = "```", r"^json(?=\s*+\{)"
BLANKS = " \t\n\x0b\f\r"
PLAN_JSON = (
    "task string, steps array<struct<step_number: int, agent: string, task: string, description: string, "
    "dependencies: array<int>>>"
)

# An upload record inside a text.
UPLOAD = r'\{(?=[^{}]*+\})[^{}]*"(?:status|container|blob)"[^{}]*+\}'
UPLOAD_STATUSES = ("uploaded", "success")

# Keys and values that mean a status.
STATUS_KEYS = ("status", "provisioning_state", "state", "discovery_status")
FLAG_KEYS = ("accessible", "schema_discovered", "relationships_discovered", "tables_discovered")
SUCCESS_VALUES = (
    "success",
    "succeeded",
    "created",
    "created_or_updated",
    "running",
    "ready",
    "active",
    "fully accessible",
    "completed",
)
FAILED_VALUES = ("failed", "error", "deleted", "inaccessible")
WARNING_VALUES = ("warning", "degraded", "partial")
ACRONYMS = ("ID", "URL", "FQDN", "SKU", "HNS", "TLS", "SQL", "ADF")


def strip(line: Column) -> Column:
    """A line without blanks, tabs and carriage returns at its ends."""
    return F.btrim(line, F.lit(" \t\r"))


def _matches(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _count(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(LINES + pattern))


def report_classify(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``is_report`` and the counts of headings, table and list lines."""
    counts = df.withColumns(
        {
            "heading_count": _count(text, HEADING),
            "table_line_count": _count(text, TABLE_LINE),
            "list_line_count": _count(text, LIST_LINE),
        }
    )
    named = F.lower(name).rlike("|".join(REPORT_KEYWORDS))
    headings, tables, lists = F.col("heading_count"), F.col("table_line_count"), F.col("list_line_count")
    shaped = (headings >= 2) | (tables >= 4) | ((headings >= 1) & ((tables >= 2) | (lists >= 5)))
    return counts.withColumn("is_report", (F.length(text) >= MIN_REPORT_LENGTH) & (named | shaped))


# Consecutive lines that start with a bar. Possessive, so each line is read once.
TABLE_BLOCK = LINES + r"(?:^[ \t]*+\|[^\n]*+(?:\n|\z))++"


def _is_separator(line: Column) -> Column:
    return line.rlike(r"^\|[\s:|-]*\|$") & F.contains(line, F.lit("-"))


def _table_blocks(text: Column | str) -> Column:
    """Arrays of trimmed lines, one per run of table lines."""
    blocks = _matches(text, TABLE_BLOCK)
    return F.transform(blocks, lambda b: F.transform(F.split(F.rtrim(b, F.lit("\n")), "\n"), strip))


def _parsed_block(lines: Column) -> Column:
    """Header line and data lines around the first separator line.

    The line before the separator is the header; a block without one, or with
    nothing before it, has none.
    """
    at = F.array_position(F.transform(lines, _is_separator), True)
    data = F.filter(F.slice(lines, at.cast("int") + 1, F.size(lines)), lambda x: ~_is_separator(x))
    return F.when(
        at > 1, F.struct(F.get(lines, at.cast("int") - 2).alias("header"), data.alias("data"))
    )


def markdown_tables(text: Column | str) -> Column:
    """``array<struct<header, data array>>`` of the tables with data rows."""
    parsed = F.transform(_table_blocks(text), _parsed_block)
    return F.filter(parsed, lambda p: p.isNotNull() & (F.size(p["data"]) > 0))


def _cells(line: Column) -> Column:
    trimmed = F.transform(F.split(line, r"\|"), strip)
    return F.filter(trimmed, lambda c: c != "")


def significant_tables(df: DataFrame, text: str, min_rows: int = 3) -> DataFrame:
    """Add ``has_tables``: some table has a header and ``min_rows`` rows."""
    return df.withColumn("has_tables", F.exists(markdown_tables(text), lambda p: F.size(p["data"]) >= min_rows))


def table_totals(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """How many tables with rows a text has, and the rows: ``table_count, table_rows``."""
    tables = F.filter(markdown_tables(text), lambda t: F.size(t["data"]) > 0)
    rows = F.aggregate(tables, F.lit(0), lambda n, t: n + F.size(t["data"]))
    return df.select(id_column, F.size(tables).cast("long").alias("table_count"), rows.cast("long").alias("table_rows"))


def typed_number(value: Column) -> Column:
    """The number a cell holds: digits, or a decimal with thousands commas."""
    plain = F.when(F.contains(value, F.lit(".")), F.replace(value, F.lit(","), F.lit("")).try_cast("double"))
    whole = F.when(value.rlike("^-?[0-9]+$"), value.try_cast("double"))
    return F.coalesce(plain, whole)


def markdown_table_rows(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """The cells of all tables: ``table_no, row_no, column_name, value, number``.

    Tables and rows count from 1. Empty cells are left out, as in the header;
    cells past the last header have no column and are dropped.
    """
    tables = df.select(id_column, F.posexplode(markdown_tables(text)).alias("_t", "_table"))
    # Cut the table up before the lines are exploded: a line must carry the
    # header, not the whole table.
    cut = tables.select(
        id_column,
        (F.col("_t") + 1).alias("table_no"),
        _cells(F.col("_table.header")).alias("_header"),
        F.col("_table.data").alias("_lines"),
    )
    rows = cut.select(id_column, "table_no", "_header", F.posexplode("_lines").alias("_r", "_line"))
    cells = rows.select(
        id_column,
        "table_no",
        (F.col("_r") + 1).alias("row_no"),
        "_header",
        F.posexplode(_cells(F.col("_line"))).alias("_c", "value"),
    ).filter(F.col("_c") < F.size("_header"))
    return cells.select(
        id_column,
        "table_no",
        "row_no",
        (F.col("_c") + 1).alias("column_no"),
        F.get("_header", F.col("_c")).alias("column_name"),
        "value",
        typed_number(F.col("value")).alias("number"),
    )


def section_heads(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Level-2 sections with their first plain line: ``section_no, section``.

    Headings, table lines, blank lines and upload records are passed over; a
    line beyond 150 characters ends in an ellipsis. Sections without a plain
    line are left out.
    """
    parts = F.filter(F.split(text, LINES + r"^(?=[ \t]*## )"), lambda p: strip(p).startswith("## "))
    sections = df.select(id_column, F.posexplode(parts).alias("_n", "_part"))
    lines = F.transform(F.split("_part", "\n"), strip)
    is_upload = lambda x: x.startswith("{") & F.contains(x, F.lit('"status":"uploaded"'))
    plain = F.filter(
        F.slice(F.col("_lines"), 2, F.size("_lines")),
        lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("|") & ~is_upload(x),
    )
    first = F.get(plain, 0)
    cut = F.when(
        F.length(first) > FIRST_LINE_LENGTH, F.concat(F.substring(first, 1, FIRST_LINE_LENGTH - 3), F.lit("..."))
    ).otherwise(first)
    return (
        sections.withColumn("_lines", lines)
        .select(
            id_column,
            (F.col("_n") + 1).alias("section_no"),
            strip(F.substr(F.get("_lines", 0), F.lit(4))).alias("section"),
            cut.alias("first_line"),
        )
        .filter("first_line IS NOT NULL")
    )


def metric_extract(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """The different ones among the first five numbers after a metric word."""
    metrics = F.array_distinct(F.slice(_matches(text, METRIC, 1), 1, MAX_METRICS))
    found = df.select(id_column, F.posexplode(metrics).alias("_n", "metric"))
    return found.select(id_column, (F.col("_n") + 1).alias("metric_no"), "metric")


def attribute_extract(
    df: DataFrame, text: str, attributes: Mapping[str, Sequence[tuple[str, int]]] = DEPLOYMENT_ATTRIBUTES
) -> DataFrame:
    """Add one column per attribute: the first pattern that matches, else NULL."""
    return df.withColumns(
        {
            name: F.coalesce(*[F.nullif(F.regexp_extract(text, p, g), F.lit("")) for p, g in patterns])
            for name, patterns in attributes.items()
        }
    )


def folded_name(name: Column) -> Column:
    """Small letters without spaces and underscores."""
    return F.regexp_replace(F.lower(name), "[ _]", "")


def listed_match(name: Column, listed: Sequence[str]) -> Column:
    """The name among a list that fits best, else ``name`` itself.

    A listed name with the same letters wins, then the first that contains the
    name or is contained in it.
    """
    folded = folded_name(name)
    if not listed:
        return name
    known = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.lit("".join(ch for ch in c.lower() if ch not in " _")).alias("same"),
                F.lit(c.lower()).alias("lower"),
            )
            for c in listed
        ]
    )
    exact = F.get(F.filter(known, lambda c: c["same"] == folded), F.lit(0))["name"]
    touching = F.filter(known, lambda c: F.contains(c["lower"], folded) | F.contains(folded, c["lower"]))
    return F.coalesce(F.when(name.isin(*listed), name), exact, F.get(touching, F.lit(0))["name"], name)


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The different substrings of one length, in time linear in the text."""
    chars = F.split(text, "")

    def cut(c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(c) - size)
        return F.transform(starts, lambda i: F.concat(*[c[i + k] for k in range(size)]))

    named = F.transform(F.array(chars), lambda c: F.when(F.size(c) >= size, cut(c)))  # named once, so that it is computed once
    return F.array_distinct(F.when(F.length(text) >= size, named[0]))


def substring_join(inner: DataFrame, outer: DataFrame, gram: int = GRAM) -> DataFrame:
    """``inner``, ``outer``: each text of a table that a text of another one contains.

    Both tables have distinct texts in a column ``text``; empty and NULL ones
    meet nothing. An inner text is filed under the one of its grams that the
    fewest outer texts have, if all of them occur there. An outer text looks
    under its own grams, and what it finds is verified. Texts shorter than a gram
    meet as whole pieces. So a text of n characters gives at most ``gram * n`` rows
    before the join, and a pair comes up once.
    """
    outer_grams = outer.select(F.col("text").alias("outer"), F.explode(_grams(F.col("text"), gram)).alias("_gram"))
    counts = outer_grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    inner_grams = inner.select(F.col("text").alias("inner"), F.explode(_grams(F.col("text"), gram)).alias("_gram"))
    counted = inner_grams.join(counts, "_gram", "left")
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram")))
    filed = counted.groupBy("inner").agg(rarest.alias("_r")).filter("_r.n > 0").select("inner", F.col("_r.gram").alias("_gram"))
    pairs = filed.join(outer_grams, "_gram").filter(F.contains("outer", "inner")).select("inner", "outer")
    short = inner.filter(F.length("text").between(1, gram - 1)).select(F.col("text").alias("inner"))
    pieces = F.flatten(F.array(*[F.coalesce(_grams(F.col("text"), n), F.array().cast("array<string>")) for n in range(1, gram)]))
    cut = outer.select(F.col("text").alias("outer"), F.explode(pieces).alias("inner"))
    return pairs.unionAll(cut.join(short, "inner").select("inner", "outer"))


def fuzzy_match(names: DataFrame, name: str, candidates: DataFrame, candidate: str, order: str) -> DataFrame:
    """Add ``match`` to ``names``: the best candidate of a table, else the name.

    Ranked as :func:`listed_match`, first in ``order``. "Contains" goes through
    :func:`substring_join`, so no name meets every candidate. Names are matched
    once each, however many rows share them.
    """
    wanted = names.select(F.col(name).alias("_name")).distinct().withColumn("_folded", folded_name(F.col("_name")))
    listed = candidates.groupBy(F.col(candidate).alias("match")).agg(F.min(order).alias("_order"))
    listed = listed.withColumns({"_lower": F.lower("match"), "_same": folded_name(F.col("match"))})

    def first(key: str) -> DataFrame:
        """The first candidate per key: one row each to join."""
        return listed.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(F.col("_order").alias("o"), F.col("match").alias("m"))).alias("_c"))

    def hit(rank: int) -> Column:
        return F.struct(F.lit(rank).alias("rank"), F.col("_c.o").alias("o"), F.col("_c.m").alias("m")).alias("_hit")

    exact = wanted.join(first("match"), wanted["_name"] == F.col("_key")).select("_name", hit(0))
    alike = wanted.join(first("_same"), wanted["_folded"] == F.col("_key")).select("_name", hit(1))
    folded = wanted.select(F.col("_folded").alias("text")).distinct()
    lower = listed.select(F.col("_lower").alias("text")).distinct()
    found = substring_join(lower, folded).selectExpr("inner AS _key", "outer AS _text")
    found = found.unionAll(substring_join(folded, lower).selectExpr("outer AS _key", "inner AS _text"))
    touching = found.join(first("_lower"), "_key").groupBy("_text").agg(F.min("_c").alias("_c"))
    within = wanted.join(touching, wanted["_folded"] == touching["_text"]).select("_name", hit(2))
    chosen = exact.unionAll(alike).unionAll(within).groupBy("_name").agg(F.min("_hit").alias("_hit"))
    chosen = chosen.select("_name", F.col("_hit.m").alias("_match"))
    joined = names.join(chosen, names[name] == chosen["_name"], "left")
    return joined.withColumn("match", F.coalesce("_match", F.col(name))).drop("_name", "_match")


def fenced_object(text: Column) -> Column:
    """The first fenced block that holds a JSON object; NULL if there is none.

    The text is cut once at the fence marks, so time grows with its length.
    """
    pieces = F.split(text, FENCE)
    blocks = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))),  # the last piece is not closed
        lambda p: F.btrim(F.regexp_replace(F.btrim(p, F.lit(BLANKS)), FENCE_LABEL, ""), F.lit(BLANKS)),
    )
    return F.get(F.filter(blocks, lambda p: F.startswith(p, F.lit("{")) & F.endswith(p, F.lit("}"))), F.lit(0))


def plan_steps_extract(df: DataFrame, id_column: str, text: str, agents: Sequence[str] = ()) -> DataFrame:
    """The steps a plan text names: ``form, step_number, agent, task, dependencies``.

    JSON with ``steps`` (bare or fenced) comes first, then lines like
    ``2. [Agent] task (depends on: 1)``, else the whole text is one step of the
    first agent. Agents are matched to the list of known ones.
    """
    raw = F.col(text)
    fenced = fenced_object(raw)
    parsed = F.from_json(F.coalesce(fenced, F.trim(raw)), PLAN_JSON)["steps"]
    pattern = LINES + PLAN_STEP
    numbered = F.transform(  # one scan of the text; the groups come from each short match
        _matches(raw, pattern),
        lambda m: F.struct(*[F.regexp_extract(m, pattern, g).alias(f"g{g}") for g in (1, 2, 3, 4)]),
    )
    listed = F.transform(
        numbered,
        lambda m: F.struct(
            m["g1"].try_cast("int").alias("step_number"),
            F.trim(m["g2"]).alias("agent"),
            F.trim(m["g3"]).alias("task"),
            F.transform(
                F.filter(F.split(m["g4"], ","), lambda d: F.trim(d) != ""), lambda d: F.trim(d).try_cast("int")
            ).alias("dependencies"),
        ),
    )
    from_json = F.transform(
        parsed,
        lambda s, i: F.struct(
            F.coalesce(s["step_number"], i + 1).alias("step_number"),
            F.coalesce(s["agent"], F.lit("")).alias("agent"),
            F.coalesce(s["task"], F.lit("")).alias("task"),
            F.coalesce(s["dependencies"], F.array().cast("array<int>")).alias("dependencies"),
        ),
    )
    whole = F.array(
        F.struct(
            F.lit(1).alias("step_number"),
            F.lit(agents[0] if agents else "Unknown").alias("agent"),
            raw.alias("task"),
            F.array().cast("array<int>").alias("dependencies"),
        )
    )
    forms = df.select(id_column, from_json.alias("_json"), listed.alias("_listed"), whole.alias("_whole"))
    form = F.when(F.col("_json").isNotNull(), "json").when(F.size("_listed") > 0, "numbered").otherwise("text")
    steps = F.when(F.col("_json").isNotNull(), F.col("_json")).when(F.size("_listed") > 0, F.col("_listed"))
    exploded = forms.select(
        id_column, form.alias("form"), F.explode(steps.otherwise(F.col("_whole"))).alias("_s")
    )
    agent = F.col("_s.agent")
    return exploded.select(
        id_column,
        "form",
        F.col("_s.step_number").alias("step_number"),
        (listed_match(agent, agents) if agents else agent).alias("agent"),
        F.col("_s.task").alias("task"),
        F.col("_s.dependencies").alias("dependencies"),
    )


def upload_refs(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Upload records inside texts, once per container and blob of a text."""
    records = F.transform(
        _matches(text, UPLOAD), lambda m: F.from_json(m, "status string, container string, blob string")
    )
    good = F.filter(
        records,
        lambda r: r["status"].isin(*UPLOAD_STATUSES) & r["container"].isNotNull() & r["blob"].isNotNull(),
    )
    refs = F.array_distinct(F.transform(good, lambda r: F.struct(r["container"].alias("container"), r["blob"].alias("blob"))))
    return df.select(id_column, F.explode(refs).alias("_r")).select(id_column, "_r.*")


def missing_uploads(texts: DataFrame, uploads: DataFrame, id_column: str, text: str, raw: str, order: str) -> DataFrame:
    """Upload records that their text does not show yet, first per blob.

    ``uploads`` holds the id, the record as JSON text and its order. Records
    that are no JSON objects are left out.
    """
    is_object = F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT")
    parsed = uploads.filter(is_object).withColumn("_r", F.from_json(raw, "container string, blob string"))
    keyed = parsed.withColumns(
        {
            "container": F.coalesce("_r.container", F.lit("")),
            "blob": F.coalesce("_r.blob", F.lit("")),
        }
    ).drop("_r")
    window = W.partitionBy(id_column, "container", "blob").orderBy(order, raw)
    first = keyed.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
    joined = first.join(texts.select(id_column, F.col(text).alias("_text")), id_column, "left")
    return joined.filter(~F.contains(F.coalesce("_text", F.lit("")), F.col(raw))).drop("_text")


# One "name - value" line, optionally a bullet.
_ITEM = r"[ \t]*+(?:[-•*][ \t]+)?[^\n]*?\S[ \t]+[-–—][ \t]+\S[^\n]*"
_SECTION_START = LINES + r"^(?=#{1,4}[ \t]+\S|\*\*[^*\n]+\*\*[ \t]*$)"
_LIST_RUN = r"(?d)\A[^\n]*\n(?:[ \t]*\n)*+((?:(?!#{1,4}[ \t])" + _ITEM + r"(?:\n|\z)(?:[ \t]*\n(?=" + _ITEM + r"))?)++)"
_HEADING_LINE = r"(?d)\A(?:#{1,4}\s+[^\n]+|\*\*[^*\n]+\*\*)"
_ITEM_PARTS = r"^(?:[-•*]\s+)?(.*?\S)\s++[-–—]\s+(.+)$"
_COUNT_PARTS = r"(?i)^(?:[-•*]\s+)?(.*?[^\s–—-])\s*+[-–—]++\s++(\d[\d,]*\s*rows?.*)$"


def list_to_table(df: DataFrame, id_column: str, text: str, min_items: int = 3) -> DataFrame:
    """Lists of ``name - value`` lines under a heading, as rows.

    ``heading, item_no, name, value`` and the column titles. A list needs
    ``min_items`` lines; one blank line may separate two of them.
    """
    sections = df.select(id_column, F.posexplode(F.split(text, _SECTION_START)).alias("section_no", "_part"))
    run = F.regexp_extract("_part", _LIST_RUN, 1)
    lines = F.filter(F.transform(F.split(run, "\n"), strip), lambda x: x != "")

    def item(line: Column) -> Column:
        counted = F.regexp_extract(line, _COUNT_PARTS, 1)
        return F.when(
            counted != "", F.struct(counted.alias("name"), F.regexp_extract(line, _COUNT_PARTS, 2).alias("value"))
        ).otherwise(
            F.struct(
                F.regexp_extract(line, _ITEM_PARTS, 1).alias("name"), F.regexp_extract(line, _ITEM_PARTS, 2).alias("value")
            )
        )

    heading = F.regexp_extract("_part", _HEADING_LINE, 0)
    # Exploding an array of one keeps the parsed items from being worked out
    # again by each later use.
    parsed = F.array(
        F.struct(F.when(heading != "", F.transform(lines, item)).alias("items"), heading.alias("heading"))
    )
    found = sections.select(id_column, "section_no", F.explode(parsed).alias("_s")).filter(
        F.size("_s.items") >= min_items
    )
    counts = F.exists("_s.items", lambda i: i["value"].rlike(r"(?i)\d+\s*rows?"))
    titled = found.select(
        id_column,
        "section_no",
        F.trim(F.regexp_replace("_s.heading", r"^#{1,4}\s+|\*\*", "")).alias("heading"),
        F.when(counts, "Table").otherwise("Name").alias("name_title"),
        F.when(counts, "Row Count").otherwise("Details").alias("value_title"),
        F.col("_s.items").alias("_items"),
    )
    items = titled.select(
        id_column, "section_no", "heading", "name_title", "value_title", F.posexplode("_items").alias("_i", "_item")
    )
    return items.select(
        id_column,
        "section_no",
        "heading",
        "name_title",
        "value_title",
        (F.col("_i") + 1).alias("item_no"),
        F.trim("_item.name").alias("name"),
        F.trim("_item.value").alias("value"),
    )


def status_normalize(key: Column, value: Column) -> Column:
    """success, failed, warning or info for a status key, else NULL."""
    k, v = F.lower(key), F.lower(value.cast("string"))
    of_status = (
        F.when(v.isin(*SUCCESS_VALUES), "success")
        .when(v.isin(*FAILED_VALUES), "failed")
        .when(v.isin(*WARNING_VALUES) | F.contains(v, F.lit("partial")), "warning")
        .otherwise("info")
    )
    return (
        F.when(k.isin(*STATUS_KEYS), of_status)
        .when(k.isin(*FLAG_KEYS) & (v == "true"), "success")
        .when(k.isin(*FLAG_KEYS) & (v == "false"), "failed")
        .when((k == "fallback_used") & (v == "true"), "warning")
    )


def humanise_key(key: Column) -> Column:
    """A snake_case or camelCase key as title words, acronyms in capitals."""
    spaced = F.regexp_replace(F.regexp_replace(key, "([a-z])([A-Z])", "$1 $2"), "[_-]", " ")
    words = F.transform(
        F.split(spaced, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    )
    out = F.array_join(words, " ")
    for acronym in ACRONYMS:
        out = F.regexp_replace(out, rf"\b{acronym.capitalize()}\b", acronym)
    return out
