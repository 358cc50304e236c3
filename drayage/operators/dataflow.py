"""The dataflow vocabulary: each step takes and returns DataFrames.

Steps are lazy, so a chain of them is one Spark plan: Catalyst pushes filters
and column lists down to the scan in whatever order the steps are written.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drayage.functions.canonical import raw_cells, row_hash
from drayage.operators.keys import surrogate_key

Expr = Column | str
KeyPairs = Sequence[tuple[str, str]] | Sequence[str]


def as_column(value: Expr) -> Column:
    """Text is a Spark SQL expression."""
    return F.expr(value) if isinstance(value, str) else value


def key_pairs(on: KeyPairs) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in on]


def total_order(df: DataFrame, order_by: Sequence[Expr]) -> list[Column]:
    """``order_by`` made total: rows that still tie are equal in every column."""
    order = [F.col(o) if isinstance(o, str) else o for o in order_by]
    return [*order, row_hash(raw_cells(df, df.columns))]


def filter_rows(df: DataFrame, condition: Expr) -> DataFrame:
    return df.filter(as_column(condition))


def derive(df: DataFrame, columns: Mapping[str, Expr]) -> DataFrame:
    """Add or replace columns. Every expression sees the incoming columns."""
    return df.withColumns({name: as_column(e) for name, e in columns.items()})


def select_map(df: DataFrame, mapping: Sequence[tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """Project ``(source, target)`` pairs, then the columns in ``keep``.

    A source or a target that was already used is skipped.
    """
    sources: set[str] = set()
    targets: set[str] = set()
    out: list[Column] = []
    for source, target in [*mapping, *((k, k) for k in keep)]:
        if source in sources or target in targets:
            continue
        sources.add(source)
        targets.add(target)
        out.append(F.col(f"`{source}`").alias(target))
    return df.select(*out)


def rename_derive(df: DataFrame, mapping: Sequence[tuple[str, str]], derived: Mapping[str, Expr]) -> DataFrame:
    """Rename first, then derive by *target* names, then project.

    The result holds the mapped columns and the derived ones not among them.
    """
    renamed = df.withColumnsRenamed({s: t for s, t in mapping if s != t})
    out = derive(renamed, derived)
    targets = list(dict.fromkeys(t for _, t in mapping))
    return out.select(*[f"`{c}`" for c in [*targets, *(d for d in derived if d not in targets)]])


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Expr]) -> DataFrame:
    """The first row of each key in a total order.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so
    that each map task sends one row per key however hot the key is.
    """
    if not keys:
        return df.orderBy(*total_order(df, order_by)).limit(1)
    window = W.partitionBy(*keys).orderBy(*total_order(df, order_by))
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def lookup_first(
    df: DataFrame,
    right: DataFrame,
    on: KeyPairs,
    order_by: Sequence[Expr],
    columns: Mapping[str, str] | Sequence[str],
) -> DataFrame:
    """Left join with at most one match per row: the first by ``order_by``.

    The right side is cut to one row per key before the join. Without keys
    every row gets the first right row. ``columns`` names the right columns to
    add, with new names if given as a mapping. Spark broadcasts the right side
    when its measured size allows.
    """
    names = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    pairs = key_pairs(on)
    right_keys = [r for _, r in pairs]
    for key in right_keys:
        right = right.filter(F.col(key).isNotNull())
    reduced = first_per_key(right, right_keys, order_by).select(
        *[F.col(r).alias(f"_key{i}") for i, r in enumerate(right_keys)],
        *[F.col(source).alias(target) for source, target in names.items()],
    )
    if not pairs:  # one row by construction, so its broadcast is bounded
        one = F.broadcast(reduced.withColumn("_key0", F.lit(1)))
        return df.withColumn("_left", F.lit(1)).join(one, F.col("_left") == F.col("_key0"), "left").drop("_left", "_key0")
    condition = F.lit(True)
    for i, (left_key, _) in enumerate(pairs):
        condition = condition & (df[left_key] == reduced[f"_key{i}"])
    return df.join(reduced, condition, "left").drop(*[f"_key{i}" for i in range(len(pairs))])


def exists(df: DataFrame, other: DataFrame, on: KeyPairs, negate: bool = False) -> DataFrame:
    """Rows of ``df`` with a match in ``other``, or without one if ``negate``.

    The other side is reduced to its distinct keys, which costs no shuffle of
    its own and keeps a key with many rows there from filling one task.
    """
    pairs = key_pairs(on)
    keys = other.select(*[F.col(r).alias(f"_key{i}") for i, (_, r) in enumerate(pairs)])
    keys = keys.distinct()
    condition = F.lit(True)
    for i, (left_key, _) in enumerate(pairs):
        condition = condition & (df[left_key] == keys[f"_key{i}"])
    return df.join(keys, condition, "left_anti" if negate else "left_semi")


def aggregate(df: DataFrame, group_by: Sequence[str], columns: Mapping[str, Expr]) -> DataFrame:
    return df.groupBy(*group_by).agg(*[as_column(e).alias(name) for name, e in columns.items()])


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows, columns matched by name; a missing column is NULL."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def split(
    df: DataFrame,
    conditions: Mapping[str, Expr],
    default: str = "default",
    disjoint: bool = False,
    column: str = "route",
) -> DataFrame:
    """Add ``column``: the stream each row goes to.

    The first condition that holds wins and the remainder goes to ``default``.
    With ``disjoint`` a row is copied to every stream whose condition holds.
    """
    if disjoint:
        hits = F.filter(
            F.array(*[F.when(as_column(c), F.lit(name)) for name, c in conditions.items()]), lambda x: x.isNotNull()
        )
        return df.withColumn(column, F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))))
    chain = None
    for name, condition in conditions.items():
        test = as_column(condition)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return df.withColumn(column, F.lit(default) if chain is None else chain.otherwise(F.lit(default)))


def split_streams(df: DataFrame, conditions: Mapping[str, Expr], default: str = "default") -> dict[str, DataFrame]:
    """The streams of :func:`split` as separate DataFrames."""
    routed = split(df, conditions, default, column="_route")
    return {name: routed.filter(F.col("_route") == name).drop("_route") for name in [*conditions, default]}


def alter_row(
    df: DataFrame,
    insert_if: Expr | None = None,
    update_if: Expr | None = None,
    upsert_if: Expr | None = None,
    delete_if: Expr | None = None,
    column: str = "row_action",
) -> DataFrame:
    """Mark each row insert, update, upsert or delete; NULL if nothing holds.

    Where several hold, delete wins over upsert, update and insert.
    """
    chain = None
    policies = [("delete", delete_if), ("upsert", upsert_if), ("update", update_if), ("insert", insert_if)]
    for action, condition in policies:
        if condition is None:
            continue
        test = as_column(condition)
        chain = F.when(test, F.lit(action)) if chain is None else chain.when(test, F.lit(action))
    return df.withColumn(column, F.lit(None).cast("string") if chain is None else chain)


def check_violations(df: DataFrame, rules: Mapping[str, Expr], columns: Sequence[str]) -> DataFrame:
    """One row per row and broken rule. As in SQL, a NULL test is no violation."""
    broken = F.filter(
        F.array(*[F.when(~as_column(rule), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull()
    )
    return df.select(*columns, F.explode(broken).alias("rule"))


def self_fk_orphans(df: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows whose non-NULL reference to the same table has no target."""
    return exists(df.filter(F.col(fk).isNotNull()), df, [(fk, pk)], negate=True)


@dataclass(frozen=True)
class Lookup:
    right: DataFrame
    on: KeyPairs
    order_by: Sequence[Expr]
    columns: Mapping[str, str] | Sequence[str]


@dataclass(frozen=True)
class SurrogateKey:
    name: str
    order_by: Sequence[Expr]
    start_at: int = 1


@dataclass(frozen=True)
class Dataflow:
    """Source, filter, lookups, surrogate key, derive, select, in this order.

    Derived columns see source names. Those not among the mapped targets are
    kept after them, as is the surrogate key.
    """

    source: DataFrame
    mapping: Sequence[tuple[str, str]]
    filter: Expr | None = None
    lookups: Sequence[Lookup] = ()
    key: SurrogateKey | None = None
    derived: Mapping[str, Expr] = field(default_factory=dict)

    def run(self) -> DataFrame:
        df = self.source
        if self.filter is not None:
            df = filter_rows(df, self.filter)
        for step in self.lookups:
            df = lookup_first(df, step.right, step.on, step.order_by, step.columns)
        key = self.key
        if key is not None and not self._key_comes_last():
            df, key = surrogate_key(df, key.order_by, key.name, key.start_at), None
        if self.derived:
            df = derive(df, self.derived)
        if key is None:
            keep = [self.key.name] if self.key is not None else []
            return select_map(df, self.mapping, keep=[*keep, *self.derived])
        # Numbering writes its input: only what the result and the order need.
        order = {f"_order{i}": F.col(o) for i, o in enumerate(key.order_by)}
        slim = select_map(df.withColumns(order), self.mapping, keep=[*self.derived, *order])
        kept = [c for c in slim.columns if c not in order]
        mapped = [c for c in kept if c not in self.derived]
        keyed = surrogate_key(slim, list(order), key.name, key.start_at)
        return keyed.select(*[f"`{c}`" for c in [*mapped, key.name, *(c for c in kept if c not in mapped)]])

    def _key_comes_last(self) -> bool:
        """Whether nothing else names the key, and it is ordered by plain columns."""
        word = re.compile(rf"\b{re.escape(self.key.name)}\b")
        named = any(word.search(str(e)) for e in self.derived.values()) or any(self.key.name in pair for pair in self.mapping)
        return not named and all(isinstance(o, str) for o in self.key.order_by)
