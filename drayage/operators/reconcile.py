"""Source against target by key: missing, extra, duplicate and changed rows.

No pass joins the tables with each other. The first deals keys to a fixed
number of buckets, twice over and each time by another hash, and shuffles a
digest per bucket: counts and sums that add up over files, tasks and batches. A
key whose bucket has the same digest on both sides is settled. Only keys whose
buckets differ both times go on: keys and an 8-byte row hash are combined on the
map side, so that a key with a third of the rows leaves each map task as one
record. The third pass reads the rows of keys that differ and compares their
cells as text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.functions.canonical import canonical_text, raw_cell, row_hash
from drayage.session import materialise


def compared_cells(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Cells of ``columns`` as text; a column ``df`` lacks counts as empty text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [
        canonical_text(F.col(f"`{c}`"), types[c]).alias(c) if c in types else F.lit("").alias(c) for c in columns
    ]


# Digests per bucketing. With fewer differing keys than that, a key that does
# not differ goes on with the square of their share as its chance.
BUCKETS = 1 << 16
BUCKETINGS = 2
DIGEST_SUMS = ("a", "b", "c")


def bucket_of(keys: Sequence[str], bucketing: int, buckets: int = BUCKETS) -> Column:
    """The bucket of a row's key; NULL keys have one too."""
    cells = [F.col(f"`{k}`") for k in keys]
    return F.pmod(row_hash([F.lit(bucketing), *cells]), F.lit(buckets)).cast("int")


def table_digest(rows: DataFrame, keys: Sequence[str], hashed: str, buckets: int = BUCKETS) -> DataFrame:
    """``bucketing, bucket, n, a, b, c``: rows and sums over parts of the 64-bit hash of their keys and cells.

    Digests of parts of a table add up to that of the whole, so they can be kept
    per batch and merged by :func:`merged_digests`. The sums are of 21 or 22
    bits each and hold for 2^41 rows to a bucket.
    """
    parts = _bucketed(rows, keys, hashed, buckets)
    return parts.groupBy("bucketing", "bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in DIGEST_SUMS])


def _bucketed(rows: DataFrame, keys: Sequence[str], hashed: str, buckets: int, *kept: str) -> DataFrame:
    """Each row once per bucketing, its 64-bit hash in three parts."""
    whole, low = F.col("_w"), F.lit((1 << 21) - 1).cast("long")
    parts = (whole.bitwiseAND(low), F.shiftrightunsigned(whole, 21).bitwiseAND(low), F.shiftrightunsigned(whole, 42))
    hashes = row_hash([F.col(f"`{k}`") for k in keys] + [F.col(hashed)]).alias("_w")
    places = F.array(*[F.struct(F.lit(i).alias("bucketing"), bucket_of(keys, i, buckets).alias("bucket")) for i in range(BUCKETINGS)])
    return rows.select(*kept, hashes, F.inline(places)).select(*kept, "bucketing", "bucket", *[x.alias(c) for c, x in zip(DIGEST_SUMS, parts)])


def merged_digests(digests: DataFrame) -> DataFrame:
    """The digest of a table from those of its parts."""
    return digests.groupBy("bucketing", "bucket").agg(*[F.sum(c).alias(c) for c in ("n", *DIGEST_SUMS)])


def compared_digests(source: DataFrame, target: DataFrame) -> DataFrame:
    """``bucketing, bucket, n_source, n_target, differs`` of every bucket of two digests."""
    none = F.lit(0).cast("long")
    sides = [source.withColumns({"_s": F.col("n"), "_t": none}), target.withColumns({"_s": none, "_t": F.col("n")})]
    return _compared(sides[0].unionAll(sides[1]))


def _compared(parts: DataFrame) -> DataFrame:
    """Buckets compared: ``_s`` and ``_t`` are the rows of either side behind a part, the sums count for the side that has some."""
    sign = F.when(F.col("_s") > 0, 1).otherwise(-1)
    summed = parts.groupBy("bucketing", "bucket").agg(
        F.sum("_s").alias("n_source"), F.sum("_t").alias("n_target"), *[F.sum(sign * F.col(c)).alias(c) for c in DIGEST_SUMS]
    )
    differs = F.col("n_source") != F.col("n_target")
    for c in DIGEST_SUMS:
        differs = differs | (F.col(c) != 0)
    return summed.select("bucketing", "bucket", "n_source", "n_target", differs.alias("differs"))


def in_differing_buckets(rows: DataFrame, keys: Sequence[str], digests: DataFrame, buckets: int, inside: bool = True) -> DataFrame:
    """``rows`` whose key lies in differing buckets every time, or the others.

    The buckets are broadcast: there are at most ``BUCKETINGS * buckets``.
    """
    columns = [f"`{c}`" for c in rows.columns]
    hit = F.lit(True)
    for i in range(BUCKETINGS):
        found = digests.filter(f"differs AND bucketing = {i}").select(F.col("bucket").alias(f"_b{i}"))
        rows = rows.join(F.broadcast(found), bucket_of(keys, i, buckets) == F.col(f"_b{i}"), "left_semi" if inside else "left")
        hit = hit & F.col(f"_b{i}").isNotNull()
    return rows if inside else rows.filter(~hit).select(*columns)


SUMMARY = (
    "source_count", "target_count", "missing_in_target", "extra_in_target", "duplicate_source_keys",
    "duplicate_target_keys", "differing_keys", "value_mismatches", "unmatched_rows",
)


@dataclass(frozen=True)
class Reconciliation:
    """Results of one comparison.

    ``rows`` are those of both sides, told apart by ``_s`` and ``_t``, ``digests`` holds the compared buckets, ``states`` the keys of differing
    buckets that are missing, extra, duplicate or different, with their row
    counts on each side.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    digests: DataFrame
    states: DataFrame
    buckets: int

    def missing(self) -> DataFrame:
        """Keys of the source that the target lacks."""
        return self.states.filter("n_target = 0").select(*self.keys)

    def extra(self) -> DataFrame:
        """Keys of the target that the source lacks."""
        return self.states.filter("n_source = 0").select(*self.keys)

    def duplicates(self) -> DataFrame:
        """Keys with several rows on a side.

        In buckets of one digest both sides hold the same rows, so only the
        source's keys are counted there.
        """
        found = self.states.filter("n_source > 1 OR n_target > 1").select(*self.keys, "n_source", "n_target")
        source = self.rows.filter("_s = 1").select(*self.keys)
        settled = in_differing_buckets(source, self.keys, self.digests, self.buckets, inside=False)
        counts = settled.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n_source")).filter("n_source > 1")
        return found.unionAll(counts.withColumn("n_target", F.col("n_source")))

    @cached_property
    def surplus(self) -> DataFrame:
        """Rows of differing keys that one side has more often: ``_cells`` and ``_more``, below 0 for the target.

        Written once, for all results that need it.
        """
        suspects = self.states.filter("differs").select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        # Rows of settled buckets go first, and only rows of differing keys are made into text.
        rows = in_differing_buckets(self.rows, self.keys, self.digests, self.buckets)
        condition = F.lit(True)
        for k in self.keys:
            condition = condition & rows[k].eqNullSafe(suspects[f"_{k}"])
        rows = rows.join(suspects, condition, "left_semi")
        both = rows.select(*self.keys, F.struct(*compared_cells(rows, self.columns)).alias("_cells"), (F.col("_s") - F.col("_t")).alias("_more"))
        found = both.groupBy(*self.keys, "_cells").agg(F.sum("_more").alias("_more")).filter("_more <> 0")
        return materialise(found, "surplus")

    def _paired(self) -> DataFrame:
        """Per differing key: its unmatched rows per side, and the cells of one on each."""
        more = F.col("_more")
        return self.surplus.groupBy(*self.keys).agg(
            F.sum(F.greatest(more, F.lit(0))).alias("_n_s"),
            F.sum(F.greatest(-more, F.lit(0))).alias("_n_t"),
            F.max(F.when(more > 0, F.col("_cells"))).alias("_s"),
            F.max(F.when(more < 0, F.col("_cells"))).alias("_t"),
        )

    def mismatches(self) -> DataFrame:
        """One row per key and differing cell: ``column_name, source, target``.

        Rows of a key that both sides have are taken away first. What is left
        can be told apart by cell if it is one row on each side; the rows of
        other keys are in :meth:`unmatched_rows`.
        """
        cells = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.col("_s").getField(c).alias("source"),
                    F.col("_t").getField(c).alias("target"),
                )
                for c in self.columns
            ]
        )
        changed = F.filter(cells, lambda x: ~x["source"].eqNullSafe(x["target"]))
        pairs = self._paired().filter("_n_s = 1 AND _n_t = 1")
        return pairs.select(*self.keys, F.explode(changed).alias("_cell")).select(*self.keys, "_cell.*")

    def unmatched_rows(self) -> DataFrame:
        """Rows that a side has more often, of keys that cannot be compared row by row.

        ``side`` and ``row_count`` tell where and by how many; cells are text.
        """
        apart = self._paired().filter("_n_s <> 1 OR _n_t <> 1").select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        surplus = self.surplus
        condition = F.lit(True)
        for k in self.keys:
            condition = condition & surplus[k].eqNullSafe(apart[f"_{k}"])
        rows = surplus.join(apart, condition, "left_semi")
        side = F.when(F.col("_more") > 0, "source").otherwise("target")
        return rows.select(*self.keys, side.alias("side"), F.abs("_more").alias("row_count"), "_cells.*")

    def summary(self) -> DataFrame:
        """One row of totals."""
        paired = (F.col("_n_s") == 1) & (F.col("_n_t") == 1)
        cells = F.array(*[F.struct(F.col("_s").getField(c).alias("s"), F.col("_t").getField(c).alias("t")) for c in self.columns])
        changed = F.size(F.filter(cells, lambda x: ~x["s"].eqNullSafe(x["t"])))
        parts = [
            self.digests.filter("bucketing = 0").agg(
                *[F.coalesce(F.sum(f"n_{s}"), F.lit(0).cast("long")).alias(f"{s}_count") for s in ("source", "target")]
            ),
            self.states.agg(
                F.count_if(F.col("n_target") == 0).alias("missing_in_target"),
                F.count_if(F.col("n_source") == 0).alias("extra_in_target"),
                F.count_if("differs").alias("differing_keys"),
            ),
            self.duplicates().agg(
                F.count_if(F.col("n_source") > 1).alias("duplicate_source_keys"),
                F.count_if(F.col("n_target") > 1).alias("duplicate_target_keys"),
            ),
            self._paired().agg(
                F.coalesce(F.sum(F.when(paired, changed.cast("long"))), F.lit(0).cast("long")).alias("value_mismatches"),
                F.coalesce(F.sum(F.when(~paired, F.col("_n_s") + F.col("_n_t"))), F.lit(0).cast("long")).alias("unmatched_rows"),
            ),
        ]
        # Each part is one row with its own columns; adding them up is one row.
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        return rows.agg(*[F.sum(c).alias(c) for c in SUMMARY])

    def samples(self, kind: str, limit: int = 50) -> DataFrame:
        """The first ``limit`` rows of a result by key, for a report."""
        rows = {"missing": self.missing, "extra": self.extra, "mismatches": self.mismatches}[kind]()
        order = [*self.keys, "column_name"] if kind == "mismatches" else list(self.keys)
        return rows.orderBy(*order).limit(limit)


def reconcile(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, buckets: int = BUCKETS
) -> Reconciliation:
    """Compare two tables on typed key columns, NULL keys being equal.

    ``columns`` defaults to the source's columns without the keys. Two rows
    are taken as equal when their 64-bit hashes agree. Columns of one type on
    both sides are hashed as they are, the others as text.
    """
    compared = [c for c in (columns or source.columns) if c not in keys]
    source_types = {f.name: f.dataType for f in source.schema.fields}
    target_types = {f.name: f.dataType for f in target.schema.fields}

    alike = [c for c in compared if c in source_types and source_types[c] == target_types.get(c)]

    def side(df: DataFrame, is_source: bool) -> DataFrame:
        sides = [F.lit(int(is_source)).cast("long").alias("_s"), F.lit(int(not is_source)).cast("long").alias("_t")]
        texts = {c: text for c, text in zip(compared, compared_cells(df, compared))}
        return df.select(*keys, *[F.col(f"`{c}`") if c in alike else texts[c] for c in compared], *sides)

    # The union gives both sides one type per key; cells of one type stay as they are.
    rows = side(source, True).unionAll(side(target, False))
    cells = [raw_cell(c, rows.schema[c].dataType) for c in compared]
    hashed = rows.select(*keys, "_s", "_t", row_hash(cells).alias("_h"))
    compared_buckets = materialise(_compared(_bucketed(hashed, keys, "_h", buckets, "_s", "_t")), "digests")
    suspects = in_differing_buckets(hashed, keys, compared_buckets, buckets)
    wide = F.col("_h").cast(T.DecimalType(28, 0))  # no number of rows can overflow the sum
    balance = F.sum(F.when(F.col("_s") == 1, wide).otherwise(-wide))
    states = (
        suspects.groupBy(*keys)
        .agg(F.sum("_s").alias("n_source"), F.sum("_t").alias("n_target"), balance.alias("_balance"))
        .withColumn("differs", (F.col("n_source") > 0) & (F.col("n_target") > 0) & (F.col("_balance") != 0))
        .drop("_balance")
        .filter("n_source <> 1 OR n_target <> 1 OR differs")
    )
    return Reconciliation(rows, tuple(keys), tuple(compared), compared_buckets, materialise(states, "reconcile"), buckets)


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks, once each, NULL keys being equal."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(other[f"_{k}"])
    return left.select(*keys).distinct().join(other, condition, "left_anti")


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` for each table, counted exactly."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionAll(part)
    return out


def count_compare(source_tables: Mapping[str, DataFrame], target_tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts per table on both sides; a table absent on a side counts NULL."""
    source = table_counts(source_tables).withColumnRenamed("row_count", "source_count")
    target = table_counts(target_tables).withColumnRenamed("row_count", "target_count")
    joined = source.join(target, "table_name", "full_outer")
    diff = F.coalesce("target_count", F.lit(0)) - F.coalesce("source_count", F.lit(0))
    return joined.select(
        "table_name",
        "source_count",
        "target_count",
        diff.alias("difference"),
        F.col("source_count").eqNullSafe(F.col("target_count")).alias("matches"),
    )
