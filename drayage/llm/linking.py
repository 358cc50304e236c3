"""Clusters of sets whose Jaccard similarity reaches a threshold.

Sets that may be similar share a key of an index. The links are verified on
the whole sets. Components are wanted, not all pairs: ids are first compared
with a few leaders, round by round; then every pair of ids that share a key and
are still in different components is verified. So no link that the index leads
to is lost, while a group of thousands of copies costs a few comparisons each.

``members`` of a set may leave out those that no other set has; ``n`` is its
whole size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.llm.components import components, partly_joined
from drayage.llm.second_pass import Seen
from drayage.session import materialise

# Leaders that an id is compared with in a round.
LEADERS = 3

# Rounds end once the pairs left are no more than the rows of the index, or a round has left more than this share of them.
WORTH = 0.7

# Sets outside that one task holds at a time, by their bit maps.
TOGETHER = 5_000

# Sets of so many members at most are sent whole next to their bit map, so that a task can tell their links itself.
FEW = 32


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``a``, ``b`` whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    both = pairs.join(right, "b").join(left, "a").withColumn("common", F.size(F.array_intersect("ma", "mb")))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def may_link(na: str, ma: str, nb: str, mb: str, percent: int) -> Column:
    """Whether two sets can be similar, given their sizes n and how many members m other sets have too."""
    common = F.least(ma, mb)
    return 100 * common >= percent * (F.col(na) + F.col(nb) - common)


def labelled(index: DataFrame, found: DataFrame) -> DataFrame:
    """The index with each id's component so far, only keys that hold several components."""
    named = index.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return named.join(open_keys.where("x <> y").select("key"), "key", "left_semi")


def with_leaders(index: DataFrame, percent: int, round_no: int) -> DataFrame:
    """Pairs of each id and its leaders, where their components differ.

    An order of all ids by a hash gives each key its leader, and each id the
    first of its keys' leaders; there are as many orders as leaders.
    """
    orders = range(round_no * LEADERS, (round_no + 1) * LEADERS)
    member = F.struct("id", "n", "m", "component")
    own = F.col("n") - F.col("m")  # in a group of copies, those with few members of their own are its middle
    leads = index.groupBy("key").agg(
        *[F.min(F.struct(F.shiftright(own, i % LEADERS).alias("own"), F.xxhash64(F.lit(i), "id").alias("hash"), member.alias("lead"))).alias(f"l{i}")
          for i in orders]
    )
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"l{i}").alias("l")) for i in orders]))
    met = index.join(leads, "key").select("id", "n", "m", "component", each.alias("x"))
    fit = met.where(
        (F.col("component") != F.col("x.l.lead.component")) & may_link("n", "m", "x.l.lead.n", "x.l.lead.m", percent)
    )
    first = fit.groupBy("id", "x.i").agg(F.min("x.l").alias("l"))
    return first.select(F.col("l.lead.id").alias("a"), F.col("id").alias("b")).distinct()


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each row as a bit map of ``bits`` bits, their number, and few members themselves."""
    for batch in batches:
        bits, members = batch.column("bits").to_pylist(), batch.column("members")
        out, sizes, few = [], [], []
        for i, size in enumerate(bits):
            held = members[i].values
            held = np.zeros(0, np.int64) if held is None else held.to_numpy()
            marks = np.zeros(size, np.uint8)
            marks[((held.view(np.uint64) >> np.uint64(20)) % np.uint64(size)).astype(np.int64)] = 1
            out.append(np.packbits(marks, bitorder="little").tobytes())
            sizes.append(len(held))
            few.append(held.tobytes() if len(held) <= FEW else None)
        names = [c for c in batch.schema.names if c not in ("bits", "members")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(out, pa.binary()), pa.array(few, pa.binary())],
            names=[*names, "m", "sketch", "few"],
        )


def members_of(few: bytes | None) -> frozenset | None:
    return None if few is None else frozenset(np.frombuffer(few, np.int64).tolist())


class Outside:
    """Sets by their bit maps, which tell how many members two sets have in common at most.

    A common member sets one bit in both maps. Members that share a bit of their
    own set's map are counted on top, so the bound is never too low. Links of
    sets whose members are here are certain: the components they join are one
    from then on, and no more pairs of them are listed.
    """

    def __init__(self, rows: list[tuple], percent: int):
        self.percent = percent
        self.ids, components, sizes, members, sketches, few = (list(x) for x in zip(*rows))
        self.root, self.sizes, self.members = (np.array(x, np.int64) for x in (components, sizes, members))
        self.maps = np.stack([np.frombuffer(x, np.uint64) for x in sketches])
        self.doubled = self.members - np.bitwise_count(self.maps).sum(axis=1)
        self.few = [members_of(x) for x in few]
        self.joined: dict[int, int] = {}  # a component and the one it is part of

    def find(self, component: int) -> int:
        while component in self.joined:
            component = self.joined[component]
        return component

    def join(self, component: int, other: int) -> None:
        self.joined[other] = component
        self.root[self.root == other] = component

    def may_link(self, size: int, members: int, sketch: bytes) -> np.ndarray:
        """Whether each set may be similar to this one."""
        bits = np.frombuffer(sketch, np.uint64)
        doubled = members - int(np.bitwise_count(bits).sum())
        common = np.bitwise_count(self.maps & bits).sum(axis=1) + np.minimum(self.doubled, doubled)
        common = np.minimum(common, np.minimum(self.members, members)).astype(np.int64)
        return 100 * common >= self.percent * (self.sizes + size - common)

    def links(self, component: int, size: int, members: int, sketch: bytes, few: bytes | None) -> list[int]:
        """Numbers of sets to pair with this one: those that join components for certain, and those that may."""
        found, mine, own = [], self.find(component), members_of(few)
        left = np.flatnonzero(self.may_link(size, members, sketch) & (self.root != mine))
        while len(left):
            i, left = int(left[0]), left[1:]
            if own is None or self.few[i] is None:
                found.append(i)
                continue
            common = len(own & self.few[i])
            if 100 * common >= self.percent * (int(self.sizes[i]) + size - common):
                found.append(i)
                self.join(mine, int(self.root[i]))
                left = left[self.root[left] != mine]
        return found


def candidate_batches(percent: int) -> Callable:
    """Pairs of rows sorted so that, of each group, the sets outside come before all sets; holds those outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, gathered, outside, seen = None, [], None, Seen()  # a pair may share many keys
        for batch in batches:
            pairs: list[tuple[int, int]] = []
            columns = ("key", "part", "side", "id", "component", "n", "m", "sketch", "few")
            for key, part, side, id_, component, n, m, sketch, few in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (key, part) != group:
                    group, gathered, outside = (key, part), [], None
                if side == 0:
                    gathered.append((id_, component, n, m, sketch, few))
                    continue
                if outside is None and gathered:
                    outside = Outside(gathered, percent)
                if outside is not None:
                    for i in outside.links(component, n, m, sketch, few):
                        pair = (min(outside.ids[i], id_), max(outside.ids[i], id_))
                        if seen.new(pair):
                            pairs.append(pair)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], names=["a", "b"])

    return run


def across(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ids that share a key, have different components and may be similar.

    One of two such ids lies outside the key's largest component. Those
    outside, in parts of bounded size, meet all ids of the key in one task by
    bit maps of their members, so that only pairs near the threshold and above
    are listed, and large sets are not sent whole. Of small sets a task lists no
    more pairs than it takes to join their components.
    """
    sizes = index.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    main = F.max_by(F.struct("component", "c"), F.struct("c", "component"))
    keys = sizes.groupBy("key").agg(main.alias("main"), F.sum("c").alias("all")).select(
        "key", F.col("main.component").alias("main"), F.ceil((F.col("all") - F.col("main.c")) / TOGETHER).alias("parts")
    )
    keyed = index.join(materialise(keys.where("parts > 0"), "keys"), "key")
    outside = F.col("component") != F.col("main")
    mine = F.pmod(F.xxhash64("id"), F.col("parts"))
    asked = F.when(outside, F.array(F.struct(F.lit(0).alias("side"), mine.alias("part"))))
    offered = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(F.lit(1).alias("side"), p.alias("part")))
    sides = F.concat(F.coalesce(asked, F.array().cast("array<struct<side:int,part:bigint>>")), offered)
    full = keyed.select("key", "id", "component", "bits", sides.alias("sides")).join(sets.select("id", "n", "members"), "id")
    schema = "key long, id long, component long, sides array<struct<side:int,part:bigint>>, n long, m long, sketch binary, few binary"
    drawn = full.select("key", "id", "component", "bits", "sides", "n", "members").mapInArrow(sketch_batches, schema)
    met = drawn.select("key", "id", "component", "n", "m", "sketch", "few", F.explode("sides").alias("s"))
    met = met.select("key", "s.part", "s.side", "id", "component", "n", "m", "sketch", "few")
    sorted_ = met.repartition("key", "part").sortWithinPartitions("key", "part", "side", "id")
    return sorted_.mapInArrow(candidate_batches(percent), "a long, b long").distinct()


def pairs_left(index: DataFrame) -> int:
    """A bound on the pairs that ``across`` would make."""
    sizes = index.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    keys = sizes.groupBy("key").agg(F.sum("c").alias("all"), F.max("c").alias("top"))
    found = keys.agg(F.sum(((F.col("all") - F.col("top")) * F.col("all")).cast("double"))).first()
    return int(found[0] or 0)


def cluster(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``id``, ``component`` of every id linked to a smaller one.

    ``index`` has ``key``, ``id``, ``n`` (the set's size), ``m`` (how many of
    its members other sets have too, or ``n`` if that is not known) and ``bits``
    (of the bit maps, for all rows of a key the same multiple of 64); ``sets``
    has ``id``, ``n``, ``members``. Both should be tables, as they are read
    several times. Ids that can link with no size found under a key leave it.
    """
    keys = index.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low")).where("c > 1").select("key", "low")
    union = F.col("n") + F.greatest(F.col("low"), F.col("m")) - F.col("m")
    able = index.join(keys, "key").where(100 * F.col("m") >= percent * union)
    left = materialise(able.select("key", "id", "n", "m", "bits", F.col("id").alias("component")), "index")
    sets = materialise(sets.join(left.select("id").distinct(), "id", "left_semi"), "sets")
    kept, rows = left.drop("component"), left.count()
    links, round_no, before, now = None, 0, math.inf, pairs_left(left)
    while rows < now <= WORTH * before:
        new = verified(with_leaders(left, percent, round_no), sets, percent)
        links = materialise(new if links is None else links.unionByName(new), "links")
        left = materialise(labelled(kept, partly_joined(links)), "left")
        round_no, before, now = round_no + 1, now, pairs_left(left)
    if links is not None:  # what the rounds have joined needs no comparing
        left = materialise(labelled(kept, components(links)), "left")
    new = verified(across(left, sets, percent), sets, percent)
    return components(new if links is None else links.unionByName(new))
