"""Passages that repeat word for word, wherever they stand in a text.

Of every ``WINDOW`` neighbouring runs of ``RUN`` words the one with the least
hash is an anchor, so the anchors inside a passage hang on its words alone: not
on marks, lines or what precedes it. Any passage of ``RUN + WINDOW - 1`` = 51
words has one in each of its places. An anchor that stands earlier too is
extended word by word, as far as an earlier place of it goes on alike.

Whoever has the longest match to the left need not have the one to the right.
So a span is made of runs of ``RUN`` words and more that stand earlier each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm import texts
from drayage.llm.second_pass import SEEN, bit_map, in_map

RUN = 26
WINDOW = 26

# Words around an anchor that a passage without a second anchor may take in.
AROUND = WINDOW - 1

# Bits of the map of repeated anchors: 16 MB. There is one for each 13 words of what repeats.
ANCHOR_BITS = 27

# Rows compared at once; a single anchor's rows are always compared together.
TOGETHER = 20_000

ODD = 0xD6E8FEB86659FD93


def running(values: np.ndarray, size: int, take: Callable) -> np.ndarray:
    """``take`` (minimum or maximum) of ``size`` values from each place on; a few places shorter than ``values``."""
    done = 1
    while done < size:
        step = min(done, size - done)
        values = take(values[:-step], values[step:])
        done += step
    return values


def anchors(offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the anchors of all texts, and their hashes."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(words) < RUN + WINDOW - 1:
        return none
    count = len(words) - RUN + 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(words), ODD, np.uint64))
        back = np.cumprod(np.full(count, pow(ODD, -1, 1 << 64), np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
        runs = np.maximum(texts.mix((total[RUN:] - total[:-RUN]) * back), np.uint64(1))
    least = running(runs, WINDOW, np.minimum)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    least[np.arange(len(least)) + RUN + WINDOW - 1 > ends] = 0  # windows lie within a text
    edge = np.zeros(WINDOW - 1, np.uint64)
    chosen = np.flatnonzero(running(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == runs)
    return chosen, runs[chosen]


class Anchored:
    """The words and anchors of some texts."""

    def __init__(self, column: pa.Array):
        self.column = texts.strings(column)
        self.offsets, words = texts.word_list(self.column, lower=True)
        self.words = texts.hash_words(words)
        self.at, self.hash = anchors(self.offsets, self.words)


def anchor_batches(text: str) -> Callable:
    """Rows ``key``: the anchors; one met again in the task only once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for batch in texts.chunks(batches, text):
            found, counts = np.unique(Anchored(batch.column(text)).hash, return_counts=True)
            before = np.fromiter((met.get(h, 0) for h in found.tolist()), np.int64, len(found))
            after = np.minimum(before + counts, 2)
            new = after > before
            met.update(zip(found[new].tolist(), after[new].tolist()))
            if len(met) > SEEN:
                met.clear()
            yield pa.RecordBatch.from_arrays([texts.signed(np.repeat(found, after - before))], names=["key"])

    return run


def around(chosen: np.ndarray, a: Anchored, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Per anchor the words to its left and right, the nearest first, then how many code points off they begin and end.

    A word is a 32-bit hash, 0 where the text has none left.
    """
    hashes = (a.words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = []
    step = np.arange(1, AROUND + 1)
    left, right = chosen[:, None] - step, chosen[:, None] + RUN - 1 + step
    for place, inside in ((left, left >= a.offsets[text][:, None]), (right, right < a.offsets[text + 1][:, None])):
        out.append(np.where(inside, hashes[np.where(inside, place, 0)], np.uint32(0)))
    far = [
        np.where(out[0] > 0, begin[chosen][:, None] - begin[np.maximum(left, 0)], 0),
        np.where(out[1] > 0, end[np.minimum(right, len(end) - 1)] - end[chosen + RUN - 1][:, None], 0),
    ]
    size = np.uint16 if max(int(x.max(initial=0)) for x in far) < 1 << 16 else np.uint32
    parts = [x.view(np.uint8) for x in out] + [np.ascontiguousarray(x.astype(size)).view(np.uint8) for x in far]
    rows = np.ascontiguousarray(np.concatenate(parts, axis=1))
    marks = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(marks), pa.py_buffer(rows)])


def place_batches(text: str, bits: np.ndarray) -> Callable:
    """Rows of the anchors in the bit map, with their place and surroundings."""
    from drayage.llm.passages import word_places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.chunks(batches, text, texts.CHUNK_BYTES // 2):
            a = Anchored(batch.column(text))
            wanted = in_map(bits, a.hash.view(np.int64))
            if not wanted.any():
                continue
            chosen = a.at[wanted]
            _, begin, end, _ = word_places(a.column)
            owner = np.searchsorted(a.offsets, chosen, side="right") - 1
            docs = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [texts.signed(a.hash[wanted])]
                + [batch.column(c).take(docs) for c in ("key", "a", "b")]
                + [pa.array(x.astype(np.int64)) for x in (chosen - a.offsets[owner], begin[chosen], end[chosen + RUN - 1])]
                + [around(chosen, a, owner, begin, end)],
                names=["h", "key", "a", "b", "word", "begin", "end", "around"],
            )

    return run


def unpacked(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What ``around`` has packed: words and distances of the left and the right."""
    words = [np.zeros((len(column), AROUND), np.uint32) for _ in range(2)]
    far = [np.zeros((len(column), AROUND), np.int64) for _ in range(2)]
    lengths = np.asarray(pa.compute.binary_length(column))
    for size, kind in ((2, np.uint16), (4, np.uint32)):
        mine = np.flatnonzero(lengths == 2 * AROUND * (4 + size))
        if len(mine) == 0:
            continue
        raw = b"".join(column.take(pa.array(mine)).to_pylist())
        rows = np.frombuffer(raw, np.uint8).reshape(len(mine), -1)
        for side in range(2):
            low = 4 * AROUND * side
            words[side][mine] = np.ascontiguousarray(rows[:, low : low + 4 * AROUND]).view(np.uint32)
            low = 8 * AROUND + size * AROUND * side
            far[side][mine] = np.ascontiguousarray(rows[:, low : low + size * AROUND]).view(kind)
    return words, far


def alike(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per row, how many of its words some earlier row of its group begins with too."""
    out = np.zeros(len(group), np.int64)
    rows, prefix = np.arange(len(group)), group.view(np.uint64)
    for k in range(AROUND):
        inside = words[rows, k] > 0
        rows = rows[inside]
        if len(rows) == 0:
            break
        with np.errstate(over="ignore"):
            prefix = texts.mix(prefix[inside] * texts.GOLDEN + words[rows, k])
        _, first, named, counts = np.unique(prefix, return_index=True, return_inverse=True, return_counts=True)
        later = np.ones(len(rows), bool)
        later[first] = False
        out[rows[later]] = k + 1
        shared = counts[named] > 1
        rows, prefix = rows[shared], prefix[shared]
    return out


def repeats(rows: pa.RecordBatch | pa.Table) -> dict[str, pa.Array]:
    """Of rows sorted by anchor, document and word: what stands in an earlier one, extended."""
    h, a, b, word, begin, end = (rows.column(c).to_numpy() for c in ("h", "a", "b", "word", "begin", "end"))
    again = np.zeros(len(h), bool)  # rows that repeat key and text are one document
    again[1:] = (h[1:] == h[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (word[1:] == word[:-1])
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    leader = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    sizes = np.bincount(leader, weights=~again, minlength=len(h))[leader]
    own = np.flatnonzero(~again & (sizes > 1))
    picked = rows.column("around").take(pa.array(own))
    words, far = unpacked(picked.combine_chunks() if isinstance(picked, pa.ChunkedArray) else picked)
    before, after = (alike(h[own], x) for x in words)
    lead = leader[own]
    same = (a[own] == a[lead]) & (b[own] == b[lead])
    room = np.where(same, word[own] - word[lead] - RUN, AROUND)  # what repeats itself without a gap keeps its first words
    later = (own != lead) & (room >= 0)
    own, lead, before, after = own[later], lead[later], np.minimum(before, room)[later], after[later]
    far = [np.concatenate([np.zeros((len(own), 1), np.int64), x[later]], axis=1) for x in far]
    at = np.arange(len(own))
    start, stop = begin[own] - far[0][at, before], end[own] + far[1][at, after]
    out = {c: rows.column(c).take(pa.array(own)) for c in ("key", "a", "b")}
    out |= {"word": word[own] - before, "n_words": before + RUN + after, "start": start, "length": stop - start}
    out["kept_key"] = rows.column("key").take(pa.array(lead))
    out["class_id"] = h[own] | np.int64(-(1 << 63))  # classes of paragraphs are not negative
    return {c: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else pa.array(x) for c, x in out.items()}


def repeat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``repeats`` of rows that come sorted, part by part; all rows of an anchor at once."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            out = repeats(pa.Table.from_batches(held))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        h = batch.column("h").to_numpy()
        if n >= TOGETHER and h[-1] != last:
            cut = int(np.argmax(h != last))
            held.append(batch.slice(0, cut))
            yield from done()
            held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n, last = n + batch.num_rows, h[-1]
    yield from done()


def exact_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Places that stand earlier too: key, a, b, word, n_words, start, length, kept_key, class_id. They overlap."""
    from drayage.llm.passages import identified

    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = read.select("text").mapInArrow(anchor_batches("text"), "key long")
    shared = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    bits = bit_map(shared, ANCHOR_BITS)
    kind = docs.schema[key].dataType

    def longs(*names: str) -> list[T.StructField]:
        return [T.StructField(c, T.LongType()) for c in names]

    places = T.StructType([
        *longs("h"), T.StructField("key", kind), *longs("a", "b", "word", "begin", "end"), T.StructField("around", T.BinaryType())
    ])
    placed = identified(read, "key", "text").mapInArrow(place_batches("text", bits), places)
    out = T.StructType([
        T.StructField("key", kind), *longs("a", "b", "word", "n_words", "start", "length"), T.StructField("kept_key", kind), *longs("class_id")
    ])
    return placed.repartition("h").sortWithinPartitions("h", "key", "a", "b", "word").mapInArrow(repeat_batches, out)
