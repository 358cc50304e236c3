"""Lines that many documents share.

Every normalised line is hashed, documents are counted per hash, and lines
whose hash is found in enough documents go; what is left is joined by position.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
KEY = "__line_key"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def text_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(lines: Column, min_length: int) -> Column:
    """A 128-bit hash per line, null for lines whose key is too short to count."""

    def hashed(line: Column) -> Column:
        key = F.transform(F.array(line_key(line)), lambda k: F.when(  # named once, so that it is computed once
            F.length(k) >= min_length, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))
        ))
        return key[0]

    return F.transform(lines, hashed)


# Parts that the documents, and the places, of one line are dealt to.
SALTS = 64


def salt(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")


def frequent_lines(docs: DataFrame, text: str, min_docs: int, min_length: int, key: str | None) -> DataFrame:
    """Hashes ``a``, ``b`` of the lines found in ``min_docs`` different documents of ``docs``.

    The documents of a line are counted in parts and the parts added up, so a
    line that every document holds is no hot key.
    """
    hashes = F.array_distinct(line_hashes(text_lines(F.col(text)), min_length))
    document = F.struct(F.col(key) if key else F.monotonically_increasing_id())
    parts = (
        docs.select(document.alias("doc"), F.explode(hashes).alias("h"))
        .where(F.col("h").isNotNull())
        .select("h.a", "h.b", "doc", salt(F.col("doc")).alias("part"))
        .groupBy("a", "b", "part")
        .agg(F.count_distinct("doc").alias("n"))
    )
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("a", "b")


def kept_lines(lines: Column, dropped: Column) -> Column:
    """``lines`` without those at the positions in the sorted array ``dropped``; linear in the lines."""
    borders = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))

    def between(b: Column, ls: Column) -> Column:
        return F.flatten(
            F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda k: F.slice(ls, b[k] + 2, b[k + 1] - b[k] - 1))
        )

    named = F.array(F.struct(borders.alias("b"), lines.alias("l")))
    return F.transform(named, lambda x: between(x["b"], x["l"]))[0]


def dedup_lines(
    docs: DataFrame, text: str = "text", min_docs: int = 10, min_length: int = 1, key: str | None = "doc_id"
) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` documents hold.

    Adds ``n_lines`` (before dropping) and ``n_dropped``, both long; ``text``
    holds the other lines, joined by a newline. Rows of one ``key`` are one
    document and count once, those without a key too; with ``key`` None every
    row is a document of its own. All rows are returned. A null or empty text is one empty line, and
    null becomes the empty text. All other columns stay; a column of ``docs``
    named ``n_lines`` or ``n_dropped`` is replaced.

    The texts are read twice and shuffled at most once, by a hash of the text:
    copies drop the same lines, so positions are found once per distinct text.
    """
    frequent = frequent_lines(docs, text, min_docs, min_length, key)
    a, b = f"{KEY}_a", f"{KEY}_b"
    body = F.coalesce(F.col(text), F.lit(""))
    keys = (F.xxhash64(body).alias(a), F.xxhash64(F.lit(1), body).alias(b))
    part = salt(F.struct(F.col(key)) if key else body).alias("part")
    positions = docs.select(*keys, part, F.posexplode(line_hashes(text_lines(F.col(text)), min_length)).alias("pos", "h"))
    # The places of a line are dealt to parts, and the line is told to each of them.
    told = frequent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dropped = (
        positions.where(F.col("h").isNotNull())
        .select(a, b, "pos", "part", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
        .join(told, ["a", "b", "part"], "left_semi")
        .groupBy(a, b)
        .agg(F.array_sort(F.collect_set("pos")).alias(KEY))  # copies give the same positions
    )
    keyed = docs.drop("n_lines", "n_dropped").select("*", *keys)
    joined = keyed.join(dropped, [a, b], "left")
    lines = text_lines(F.col(text))
    count = F.coalesce(F.size(KEY), F.lit(0))
    kept = F.when(count == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(
        F.array_join(kept_lines(lines, F.col(KEY)), "\n")
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[kept.alias(text) if c == text else F.col(f"`{c}`") for c in names],
        F.size(lines).cast("long").alias("n_lines"),
        count.cast("long").alias("n_dropped"),
    )
