"""N-gram Jaccard join of whole documents.

A document is the set of its five-word shingles. Two documents can only be
similar if they share signatures: rare shingles of a prefix count singly,
frequent ones in combinations of k. All candidates are verified on whole sets.

1. Sets are hashed, equal sets become one class.
2. A first prefix, in the order of the hashes, is shuffled once; classes that
   share too few of its shingles with any other cannot have a partner.
3. The rest are read again; their shingles' frequencies give the order and the
   frequency classes of the signatures.
4. Classes that share signatures are verified and clustered.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm import texts
from drayage.llm.linking import cluster
from drayage.llm.second_pass import Counted, Seen, Shared, bit_map, in_map
from drayage.session import materialise

# From these numbers of documents on, a shingle counts in combinations of k.
FREQUENT = ((64, 2), (4096, 3))

# The first prefix is longer than what a similar set may lack by the size over this; as many must be shared.
MORE = 8

# Bits of a set's map per shingle.
SKETCH = 16

# In sets of fewer shingles all count singly.
COMBINED_FROM = 32


def shingle_sets(batch: pa.RecordBatch, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sorted distinct shingle hashes of each text."""
    offsets, words = texts.word_list(texts.strings(batch.column(text)), lower=True)
    return texts.distinct_sorted(*texts.shingles(offsets, texts.hash_words(words), width))


def set_hashes(offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return texts.sums(offsets, members), texts.sums(offsets, texts.mix(members * texts.GOLDEN))


def profile_batches(text: str, width: int, percent: int) -> Callable:
    """Per text a row with ``info``, and a row per hash of its first prefix; copies met in the task have no prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen = TaskContext.get().partitionId() << 40, Seen()
        for batch in texts.chunks(batches, text):
            offsets, members = shingle_sets(batch, text, width)
            sizes = np.diff(offsets)
            f1, f2 = set_hashes(offsets, members)
            lacking = sizes - -(-percent * sizes // 100)
            length = np.minimum(sizes, lacking + np.maximum(sizes // MORE, 1))
            fresh = np.fromiter(map(seen.new, zip(f1.tolist(), f2.tolist())), bool, len(f1))
            length = np.where(fresh, length, 0)
            ends = np.concatenate([[0], np.cumsum(length)])
            picked = np.repeat(offsets[:-1] - ends[:-1], length) + np.arange(ends[-1])
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            columns = [batch.column("key"), batch.column("text_key"), pa.array(sizes), texts.signed(f1), texts.signed(f2)]
            info = pa.StructArray.from_arrays(columns, names=["key", "text_key", "n", "f1", "f2"])
            yield pa.RecordBatch.from_arrays([texts.signed(f1), pa.array(rows), info], names=["h", "row", "info"])
            yield pa.RecordBatch.from_arrays(
                [texts.signed(members[picked]), pa.array(np.repeat(rows, length)), pa.nulls(len(picked), info.type)],
                names=["h", "row", "info"],
            )

    return run


def count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``h``: per ``row``, how many of its hashes other rows have too; rows with ``info`` pass."""
    shared = Shared()
    for batch in batches:
        told = pc.is_valid(batch.column("info"))
        passed, plain = batch.filter(told), batch.filter(pc.invert(told))
        _, rows = shared.add(plain.column("h").to_numpy(), plain.column("row").to_numpy())
        ids, hits = np.unique(rows, return_counts=True)
        info = pa.concat_arrays([passed.column("info"), pa.nulls(len(ids), batch.schema.field("info").type)])
        rows = np.concatenate([passed.column("row").to_numpy(), ids])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(np.concatenate([np.zeros(passed.num_rows, np.int64), hits])), info],
            names=["row", "hits", "info"],
        )


def count_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``h``: those whose hash several ids have, with how many; beyond the last class it is one number."""
    counted = Counted(FREQUENT[-1][0])

    def taken() -> pa.RecordBatch:
        h, ids, counts = counted.taken()
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h), pa.array(counts)], names=["id", "h", "c"])

    for batch in batches:
        counted.add(batch.column("h").to_numpy(), batch.column("id").to_numpy())
        yield taken()
    counted.end()
    yield taken()


def refill_batches(text: str, width: int, bits: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            wanted = batch.filter(pa.array(in_map(bits, batch.column("text_key").to_numpy())))
            for part in texts.chunks([wanted], text):
                offsets, members = shingle_sets(part, text, width)
                f1, f2 = set_hashes(offsets, members)
                fresh = np.fromiter(map(seen.new, zip(f1.tolist(), f2.tolist())), bool, len(f1))
                yield pa.RecordBatch.from_arrays(
                    [texts.signed(f1), texts.signed(f2), texts.lists(offsets, texts.signed(members))],
                    names=["f1", "f2", "members"],
                ).filter(pa.array(fresh))

    return run


def size_classes(growth: float = 1.15, top: int = 1 << 40) -> list[int]:
    """The least size of each class: single sizes first, then sizes that differ by a seventh at most."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * growth)))
    return out


LEAST = size_classes()


def signatures(
    n: int, hashes: np.ndarray, counts: np.ndarray, percent: int, frequent=FREQUENT
) -> Iterator[tuple[int, int]]:
    """Keys, and the size their class begins with, of a set of ``n``, given those of its members that other sets have too.

    Similar sets are met class by class of their size, which bounds what they
    may lack. Members that no other set has come first; then the rare ones by
    frequency, then the frequent classes. In a class that counts k members
    together, members are dealt to groups by their hash, and a group with m
    members of the prefix stands for m - k + 1 single ones. The prefix ends as
    soon as this makes one more than a similar set may lack: so a similar set
    shares k members in at least one group, whose combination both emit.
    """
    order = np.lexsort((hashes, counts))
    hashes, counts = hashes[order].tolist(), counts[order].tolist()
    own = bisect_right(LEAST, n) - 1
    smallest, largest = -(-percent * n // 100), 100 * n // percent
    for other in range(bisect_right(LEAST, smallest) - 1, bisect_right(LEAST, largest)):
        common = -(-percent * (n + max(LEAST[other], smallest)) // (100 + percent))
        need = len(hashes) - common + 1
        if need <= 0:
            continue
        low, high = min(own, other), max(own, other)
        size, groups = LEAST[low], {}
        for h, count in zip(hashes, counts):
            k = 1
            if size >= COMBINED_FROM:
                for least, together in frequent:
                    k = together if count >= least else k
            if k == 1:
                yield hash((low, high, h)), size
                need -= 1
            else:
                mates = groups.setdefault((k, (h >> 7) % (size >> k)), [])
                for some in combinations(mates, k - 1):
                    yield hash((low, high, *sorted((*some, h)))), size
                mates.append(h)
                need -= len(mates) >= k
            if need <= 0:
                break


def signature_batches(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, id_ = batch.column("n")[i].as_py(), batch.column("id")[i].as_py()
                shared = batch.column("shared")[i].values
                h, c = shared.field("h").to_numpy(), shared.field("c").to_numpy()
                found = dict(signatures(n, h, c, percent))
                if found:
                    keys, sizes = (np.fromiter(x, np.int64, len(found)) for x in (found.keys(), found.values()))
                    bits = -(-SKETCH * sizes // 64) * 64
                    columns = [keys, *(np.full(len(found), x) for x in (id_, n, len(shared))), bits]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "id", "n", "m", "bits"])

    return run


def similar_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest key reachable by links of at least
    ``percent`` / 100 Jaccard similarity. Texts with fewer words than ``width``
    have their whole sequence as one shingle; null and empty texts have none and
    are linked with nothing. Rows with a null key are linked, but name no
    component. Repeated rows and copies are one class of the join and appear
    each in the result. The keys are whole numbers; other columns of ``docs`` are
    not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    read = docs.select(F.col(text).alias("text"), F.col(key).alias("key"), texts.text_key(F.col(text)).alias("text_key"))
    long = T.LongType()
    info = T.StructType(
        [T.StructField("key", kind), *[T.StructField(c, long) for c in ("text_key", "n", "f1", "f2")]]
    )
    entry = T.StructType([T.StructField("h", long), T.StructField("row", long), T.StructField("info", info)])
    met = T.StructType([T.StructField("row", long), T.StructField("hits", long), T.StructField("info", info)])
    entries = read.mapInArrow(profile_batches("text", width, percent), entry).repartition("h").sortWithinPartitions("h")
    first = materialise(entries.mapInArrow(count_shared, met), "shingles")  # one pass over the texts gives both
    profile = first.where(F.col("info").isNotNull()).select("row", "info.*")
    hits = first.where(F.col("info").isNull()).groupBy("row").agg(F.sum("hits").alias("hits"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / MORE))
    met_again = hits.join(profile, "row").where(F.col("hits") >= least)
    classes = materialise(
        met_again.groupBy("f1", "f2").agg(F.min("row").alias("id"), F.min_by("text_key", "row").alias("text_key"), F.first("n").alias("n")),
        "classes",
    )

    bits = bit_map(classes.select(F.col("text_key").alias("key")))
    again = read.select("text", "text_key")
    refilled = again.mapInArrow(refill_batches("text", width, bits), "f1 long, f2 long, members array<long>")
    sets = materialise(
        refilled.join(classes.drop("text_key"), ["f1", "f2"]).groupBy("id").agg(F.first("n").alias("n"), F.first("members").alias("members")),
        "sets",
    )

    members = sets.select("id", F.explode("members").alias("h")).repartition("h").sortWithinPartitions("h")
    shared = members.mapInArrow(count_members, "id long, h long, c long").groupBy("id").agg(F.collect_list(F.struct("h", "c")).alias("shared"))
    described = materialise(sets.select("id", "n").join(shared, "id"), "shared")  # what no other set has matters by its number
    index = materialise(described.mapInArrow(signature_batches(percent), "key long, id long, n long, m long, bits long"), "signatures")
    sets = described.select("id", "n", F.col("shared.h").alias("members"))
    linked = cluster(index, sets, percent)

    grouped = profile.where("n > 0").groupBy("f1", "f2").agg(
        F.min("row").alias("first"), F.min("key").alias("low"), F.count(F.lit(1)).alias("copies")
    )
    by_class = grouped.join(classes.select("f1", "f2", "id"), ["f1", "f2"], "left").join(linked, "id", "left")
    named = materialise(
        by_class.select("f1", "f2", "low", "copies", F.coalesce("component", "id", "first").alias("component"),
                        F.col("component").isNotNull().alias("moved")),
        "classes",
    )
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    names = materialise(named.join(lowest, "component").select("f1", "f2", "component_id"), "components")
    out = profile.join(names, ["f1", "f2"], "left")
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id")
    )
