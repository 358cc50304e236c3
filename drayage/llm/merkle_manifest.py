"""A Merkle manifest of a dataset, stored as blocks of subtrees in van Emde Boas order.

Rows are hashed to leaves, leaves are numbered per group, and aligned runs of
``3 ** height`` leaves form the blocks of the lowest layer. A task builds one
block: its digests lie in one byte string, the subtrees of the lower half of the
levels each after the subtree of the upper half, recursively. The roots of the
blocks are the leaves of the next layer, until one root per group is left; the
groups' roots are the leaves of the top tree, built alike. Proofs go the
other way: siblings are read from a block by address arithmetic, and every
block hands the path above its root down to the blocks below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.llm.numbering import numbered, same
from drayage.operators.ordering import in_order
from drayage.session import materialise

FAN = 3
DIGEST = 64  # characters of a digest in hexadecimal
BLOCK_HEIGHT = 6  # 729 leaves to a block


# ---- hashing rows


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- one block


@cache
def nodes_in(levels: int) -> int:
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` at ``depth`` below the root stand in a tree of so many levels.

    The upper half of the levels is one subtree and stands first. Each of its
    leaves' children is the root of a subtree of the lower half; they follow
    from left to right. All are stored the same way.
    """
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    lower = levels - upper
    if depth < upper:
        return address(upper, depth, index)
    below = FAN ** (depth - upper)
    return nodes_in(upper) + index // below * nodes_in(lower) + address(lower, depth - upper, index % below)


@cache
def addresses(levels: int) -> list[list[int]]:
    """Per level from the leaves up, the place of each of its nodes."""
    return [address(levels, d, np.arange(FAN**d)).tolist() for d in range(levels - 1, -1, -1)]


@cache
def build_order(levels: int) -> list[tuple[int, int]]:
    """The inner nodes (level above the leaves, number), each lower subtree before the upper one it belongs to."""

    def order(height: int, depth: int, index: int) -> Iterator[tuple[int, int]]:
        if height == 1:
            yield levels - 1 - depth, index
            return
        upper = height // 2
        for k in range(FAN**upper):
            yield from order(height - upper, depth + upper, index * FAN**upper + k)
        yield from order(upper, depth, index)

    return [(level, number) for level, number in order(levels, 0, 0) if level]


class Block:
    """The digests of a subtree over ``count`` leaves and ``levels`` levels, in van Emde Boas order.

    Nodes without a leaf below them are empty.
    """

    def __init__(self, levels: int, count: int, stored: list[str]):
        self.levels, self.count, self.stored = levels, count, stored

    @classmethod
    def build(cls, leaves: Sequence[str], levels: int) -> "Block":
        at = addresses(levels)
        stored = [""] * nodes_in(levels)
        for place, leaf in zip(at[0], leaves):
            stored[place] = leaf
        for level, number in build_order(levels):
            low = FAN * number
            if low * FAN ** (level - 1) < len(leaves):
                stored[at[level][number]] = digest([stored[p] for p in at[level - 1][low : low + FAN]])
        return cls(levels, len(leaves), stored)

    @classmethod
    def read(cls, levels: int, count: int, data: bytes) -> "Block":
        full = bytes(DIGEST // 2)
        hexes = (data[i : i + DIGEST // 2] for i in range(0, len(data), DIGEST // 2))
        return cls(levels, count, ["" if h == full else h.hex() for h in hexes])

    def bytes(self) -> bytes:
        return b"".join(bytes.fromhex(d) if d else bytes(DIGEST // 2) for d in self.stored)

    @property
    def root(self) -> str:
        return self.stored[0]

    def path(self, leaf: int) -> list[tuple[str, str]]:
        """Per level from the leaf up, the siblings to its left and to its right as one text each."""
        out, at = [], addresses(self.levels)
        for level in range(self.levels - 1):
            low = leaf - leaf % FAN
            run = [self.stored[p] for p in at[level][low : low + FAN]]
            out.append(("".join(run[: leaf - low]), "".join(run[leaf - low + 1 :])))
            leaf //= FAN
        return out


def levels_for(count: int) -> int:
    """Levels until one node is left."""
    levels = 1
    while count > 1:
        count = -(-count // FAN)
        levels += 1
    return levels


def folded(start: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that follows from one node and its siblings."""
    for left, right in path:
        start = digest([left, start, right])
    return start


# ---- the layers of a forest, one tree per group


PATH_TYPE = "array<struct<left: string, right: string>>"
PATH_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def block_batches(height: int) -> Callable:
    """Blocks of gathered leaves: ``digests`` in order, ``total`` leaves in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("total").to_pylist()
            roots, stored, levels = [], [], []
            for leaves, of_group in zip(batch.column("digests"), total):
                size = levels_for(of_group) if of_group <= FAN**height else height + 1
                block = Block.build(leaves.as_py(), size)
                roots.append(block.root)
                stored.append(block.bytes())
                levels.append(size)
            kept = [batch.column(c) for c in ("grp", "block", "total")]
            counts = [len(x) for x in batch.column("digests")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(counts, pa.int32()), pa.array(levels, pa.int32()), pa.array(roots), pa.array(stored, pa.binary())],
                names=["grp", "block", "total", "count", "levels", "root", "stored"],
            )

    return run


BLOCK_TYPE = "grp string, block long, total long, count int, levels int, root string, stored binary"


def built_layer(leaves: DataFrame, height: int, label: str) -> DataFrame:
    """The blocks over ``leaves``: grp, pos, total and digest; no task holds more than a block's leaves at once."""
    blocks = (
        leaves.withColumn("block", F.expr(f"pos div {FAN**height}"))
        .groupBy("grp", "block")
        .agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("run"))
        .select("grp", "block", "total", F.col("run.digest").alias("digests"))
    )
    return materialise(blocks.mapInArrow(block_batches(height), BLOCK_TYPE), label)


def layers(leaves: DataFrame, height: int, label: str) -> list[DataFrame]:
    """All layers of blocks, the lowest first; the last has one block per group."""
    out = []
    while True:
        built = built_layer(leaves, height, f"{label}-{len(out)}")
        out.append(built)
        if built.where("block > 0").isEmpty():
            return out
        leaves = built.select(
            "grp", F.col("block").alias("pos"), F.expr(f"(total + {FAN**height - 1}) div {FAN**height}").alias("total"),
            F.col("root").alias("digest"),
        )


def child_batches(height: int) -> Callable:
    """Of each block with the path above its root, the block numbers below and the paths above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                row = whole.slice(at, 1).to_pylist()[0]
                above = [(p["left"], p["right"]) for p in row["above"]]
                block = Block.read(row["levels"], row["count"], row["stored"])
                paths = [[{"left": a, "right": b} for a, b in block.path(i) + above] for i in range(block.count)]
                count, first = block.count, row["block"] * FAN**height
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["grp"]] * count, pa.string()), pa.array(range(first, first + count), pa.int64()),
                        pa.array([row["subroot"]] * count, pa.string()), pa.array([row["root"]] * count, pa.string()),
                        pa.array(paths, PATH_ARROW),
                    ],
                    names=["grp", "pos", "subroot", "root", "above"],
                )

    return run


CHILD_TYPE = f"grp string, pos long, subroot string, root string, above {PATH_TYPE}"


def below(blocks: DataFrame, above: DataFrame, height: int, label: str) -> DataFrame:
    """Paths above the nodes one layer down; ``above`` has those of ``blocks`` by grp and pos."""
    wanted = with_path(blocks, above).select("grp", "block", "count", "levels", "stored", "subroot", "root", "above")
    return materialise(wanted.mapInArrow(child_batches(height), CHILD_TYPE), label)


def with_path(blocks: DataFrame, above: DataFrame) -> DataFrame:
    on = same("b", "a", "grp") & (F.col("b.block") == F.col("a.pos"))
    kept = [f"b.{c}" for c in blocks.columns if c != "root"]
    return blocks.alias("b").join(above.alias("a"), on).select(*kept, "a.subroot", "a.root", "a.above")


# ---- the manifest


@dataclass(frozen=True)
class Manifest:
    """The stored layers: ``trees`` of the groups, ``top`` over their roots, lowest first, and the numbered leaves.

    ``leaves`` has the group as ``grp``, the place in it as ``pos``, the key,
    ``digest`` and what else was carried along; ``groups`` a row per group with
    its place in the top tree.
    """

    leaves: DataFrame
    trees: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]
    height: int

    @property
    def root(self) -> DataFrame:
        """One row: the root. An empty table has none."""
        return self.top[-1].select("root")

    def block_paths(self) -> DataFrame:
        """``grp``, ``pos`` of every block of the lowest layer with the path above it, its group's root and the root."""
        top = self.top[-1].select(
            F.lit(None).cast("string").alias("grp"), F.col("block").alias("pos"), F.lit(None).cast("string").alias("subroot"),
            "root", F.expr(f"cast(array() as {PATH_TYPE})").alias("above"),
        )
        for number, layer in enumerate(reversed(self.top)):
            top = below(layer, top, self.height, f"top-paths-{number}")
        paths = (
            self.groups.alias("g").join(top.alias("t"), F.col("g.pos") == F.col("t.pos"))
            .select("g.grp", F.lit(0).cast("long").alias("pos"), F.col("g.digest").alias("subroot"), "t.root", "t.above")
        )
        for number, layer in enumerate(reversed(self.trees[1:])):
            paths = below(layer, paths, self.height, f"tree-paths-{number}")
        return paths

    def proofs(self, key: str, claim: str | None = None) -> DataFrame:
        """A row per leaf: key, leaf, subroot, root, the siblings' digest, the root folded from ``claim`` and if it is the root.

        ``claim`` is a column of the leaves: the hash of the row as it is found
        now. Without it the leaf itself is folded.
        """
        own = self.leaves.select(
            "grp", F.expr(f"pos div {FAN**self.height}").alias("block"), "pos", F.col(key).alias("key"), "digest",
            F.col(claim or "digest").alias("claim"),
        )
        members = own.groupBy("grp", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "claim"))).alias("members"))
        blocks = self.trees[0].drop("root", "total")
        on = same("b", "m", "grp") & (F.col("b.block") == F.col("m.block"))
        joined = blocks.alias("b").join(members.alias("m"), on).select("b.*", F.col("m.members.key").alias("keys"), F.col("m.members.claim").alias("claims"))
        wanted = with_path(joined, self.block_paths())
        kind = own.schema["key"].dataType.simpleString()
        schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return wanted.mapInArrow(proof_batches, schema).withColumnRenamed("key", key)


def proof_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(whole.num_rows):
            row = whole.slice(at, 1)
            plain = row.select(["count", "levels", "stored", "subroot", "root", "above", "claims"]).to_pylist()[0]
            block = Block.read(plain["levels"], plain["count"], plain["stored"])
            above = [(p["left"], p["right"]) for p in plain["above"]]
            after = "".join(a + b for a, b in above)
            ends: dict[str, str] = {}  # the root that follows from each root of this block
            leaves, proofs, roots = [], [], []
            places = addresses(block.levels)[0]
            for number, claim in enumerate(plain["claims"]):
                path = block.path(number)
                leaves.append(block.stored[places[number]])
                proofs.append(digest(["".join(a + b for a, b in path), after]))
                mine = folded(claim, path)
                if mine not in ends:
                    ends[mine] = folded(mine, above)
                roots.append(ends[mine])
            count = block.count
            yield pa.RecordBatch.from_arrays(
                [
                    row.column("keys").flatten(), pa.array(leaves, pa.string()), pa.array([plain["subroot"]] * count, pa.string()),
                    pa.array([plain["root"]] * count, pa.string()), pa.array(proofs, pa.string()), pa.array(roots, pa.string()),
                    pa.array([r == plain["root"] for r in roots], pa.bool_()),
                ],
                names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


def build_manifest(
    docs: DataFrame,
    fields: Sequence[str],
    key: str,
    group: str,
    carried: Mapping[str, Column] | None = None,
    height: int = BLOCK_HEIGHT,
) -> Manifest:
    """The manifest of ``docs``: a leaf per row over ``fields``, in the order of ``key`` within each value of ``group``.

    Rows without a key stand first, rows with one key in the order of their
    leaves; rows that are equal in all fields are interchangeable. Rows without
    a group are a group of their own, the first. Groups are compared as UTF-8
    bytes. An empty table has no root and no proofs. A null differs
    from an empty text. Only ``fields`` and what ``carried`` needs are
    read; its columns (named unlike ``grp``, ``digest``, ``pos``, ``total`` and
    ``key``) are kept next to the leaves.
    """
    extra = dict(carried or {})
    hashed = docs.select(
        F.col(group).cast("string").alias("grp"), F.col(key).alias(key), leaf_of([F.col(f) for f in fields]).alias("digest"),
        *[c.alias(name) for name, c in extra.items()],
    )
    order = [F.col("grp").asc_nulls_first(), F.col(key).asc_nulls_first(), F.col("digest")]
    leaves = numbered(in_order(materialise(hashed, "leaves"), order, "ordered-leaves"), "group-sizes")
    trees = layers(leaves.select("grp", "pos", "total", "digest"), height, "tree")
    roots = trees[-1].select("grp", F.col("root").alias("digest"))
    none = F.lit(None).cast("string")
    ranked = in_order(roots.withColumn("name", F.col("grp")).withColumn("grp", none), [F.col("name").asc_nulls_first()], "ordered-groups")
    groups = materialise(numbered(ranked, "group-count"), "groups")
    top = layers(groups.select("grp", "pos", "total", "digest"), height, "top")
    return Manifest(leaves, trees, groups.select(F.col("name").alias("grp"), "pos", "digest"), top, height)
