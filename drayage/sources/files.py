"""File sources: CSV, Parquet, JSON, text and file listings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_line"


@dataclass(frozen=True)
class Preview:
    """A bounded read: ``truncated`` tells that at least one more row exists."""

    rows: DataFrame
    truncated: bool
    total_rows: int | None = None

    def annotated(self) -> DataFrame:
        """The rows with the facts about the read as columns."""
        out = self.rows.withColumn("truncated", F.lit(self.truncated))
        return out if self.total_rows is None else out.withColumn("total_rows", F.lit(self.total_rows).cast("long"))


def preview(df: DataFrame, max_rows: int, order_by: Sequence[Column | str] = (), count: bool = False) -> Preview:
    """The first ``max_rows`` rows, as a top-k by ``order_by`` where given."""
    if count:
        total = df.count()
        truncated = total > max_rows
    else:
        total = None
        truncated = df.limit(max_rows + 1).count() > max_rows
    ordered = df.orderBy(*order_by) if order_by else df
    return Preview(ordered.limit(max_rows), truncated, total)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """CSV with a header. Without a schema Spark reads the data once to infer it."""
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with ``schema`` and ``_corrupt_line``: the text of a bad line.

    Blank lines are skipped.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).filter("trim(value) <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.select(F.from_json("value", full, options).alias("r")).select("r.*")


def good_lines(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_lines(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files that each hold one JSON array or object; array items become rows."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_text_prefix(spark: SparkSession, path: str, max_bytes: int = 1_000_000, glob: str | None = None) -> DataFrame:
    """The first bytes of each file as UTF-8, bad bytes replaced: ``path, text, truncated``.

    Files of any size: they are read as lines, split by split, and of a file
    only the lines of splits that begin within ``max_bytes`` go on, up to there. Files
    of no bytes are not listed, as Spark plans none of them.
    """
    options = {"pathGlobFilter": glob} if glob else {}
    listed = spark.read.format("binaryFile").options(**options).load(path)
    files = listed.select("path", F.col("length"), F.col("_metadata.file_path").alias("_file"))
    lines = spark.read.option("lineSep", "\n").options(**options).text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    order = W.partitionBy("_file").orderBy("_block", "_line").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("value") + 1).over(order), F.lit(0))
    near = lines.filter(F.col("_block") < max_bytes).withColumn("_before", before).filter(F.col("_before") < max_bytes)
    heads = near.groupBy("_file").agg(F.array_sort(F.collect_list(F.struct("_before", "value"))).alias("_lines"))
    whole = F.concat(F.array_join(F.transform("_lines", lambda x: x["value"]), "\n"), F.lit("\n")).cast("binary")
    kept = F.least(F.col("length"), F.lit(max_bytes)).cast("int")  # the last line may have no end
    head = F.substring(F.coalesce("_head", F.lit(bytearray())), F.lit(1), kept)
    return files.join(heads.select("_file", whole.alias("_head")), "_file", "left").select(
        "path", F.make_valid_utf8(head.cast("string")).alias("text"), (F.col("length") > max_bytes).alias("truncated")
    )


def file_inventory(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Name, size and time of each file; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
    )


def file_schema(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Type, NULL count and a sample value per column of a file read.

    ``sample_rows`` limits the profile to the first rows of the read.
    """
    from drayage.functions.canonical import canonical_text
    from drayage.operators.quality import unpivot_aggregates

    rows = df.limit(sample_rows) if sample_rows else df
    fields = rows.schema.fields
    texts = [canonical_text(F.col(f"`{f.name}`"), f.dataType) for f in fields]
    counted = rows.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(x).alias(f"_n{i}") for i, x in enumerate(texts)],
        *[F.min(x).alias(f"_v{i}") for i, x in enumerate(texts)],
    )
    return unpivot_aggregates(
        counted,
        [
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(f.nullable).alias("is_nullable"),
                F.col("_rows").alias("row_count"),
                (F.col("_rows") - F.col(f"_n{i}")).alias("null_count"),
                F.substring(F.col(f"_v{i}"), 1, 200).alias("sample"),
            )
            for i, f in enumerate(fields)
        ],
    )
