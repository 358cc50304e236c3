"""Packing documents into sequences of one length.

Documents are tokenised in the tasks; only the histogram of piece lengths, at
most one count per length, reaches the driver. There, patterns of a few
lengths that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded down, and
what is left is packed best fit first, by length and count. The plan has a row
per pattern and length, whatever the number of pieces. Pieces find their places
by their rank among those of their length.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm import texts
from drayage.session import materialise

# Parts of words whose ids a worker remembers.
KNOWN_PARTS = 1_000_000

# What may be cut off a word's end: the tokenizer cuts there anyway.
MARKS = ".,;:!?%$#*&|+=-_()[]{}/\\~^@\""

# Patterns of three lengths and more are too many to list: of each number of lengths so many are drawn.
DRAWN = 12_000
FEW = range(3, 7)
MOST = 64  # lengths to a pattern, for short texts


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


BYTES = byte_characters()

# Small Latin letters that no normalisation changes: a word of them is one piece of text to the model.
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0x180)) if chr(c).islower() and unicodedata.normalize("NFC", chr(c)) == chr(c)]
SPELT = {ord(c): "".join(BYTES[b] for b in c.encode()) for c in LETTERS}
ONE_PIECE = re.compile(f"[{''.join(LETTERS)}]+|[{re.escape(MARKS)}]+")


def parts_of(word: str) -> tuple[str, str]:
    """A word as what comes before its closing marks, ASCII in small letters, and the marks.

    For tokenizers that fold case and cut between letters and marks. Words
    that may hold special tokens, and letters that could change into letter and
    mark when they are normalised, stay whole.
    """
    core = word.rstrip(MARKS)
    if "<|" in word or (core != word and not (core and core[-1].isalpha() and core[-1] <= "\u017f" and core[-1] != "\u0130")):
        return word, ""
    return (core.lower() if core.isascii() else core), word[len(core) :]


class WordTokenizer:
    """Token ids of texts, each distinct part of a word encoded once.

    For byte-level tokenizers that fold case, split at white space and drop it,
    and cut between letters and marks, so that a text's ids are those of its words.
    """

    _loaded: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    @classmethod
    def load(cls, path: str) -> "WordTokenizer":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.starts = np.zeros(2, np.int64)  # of each known part's ids, and their end
        self.ids = np.zeros(0, np.uint32)

    def learn(self, parts: list[str]) -> None:
        """Remember the ids of new parts; those of one piece go straight to the model."""
        model, found = self.tokenizer.model, {}
        rest = [p for p in parts if not ONE_PIECE.fullmatch(p)]
        found.update(zip(rest, (e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
        for part in parts:
            if part not in found:
                found[part] = [t.id for t in model.tokenize(part if part.isascii() else part.translate(SPELT))]
        ids = [found[p] for p in parts]
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in ids])])
        base = len(self.known)
        self.known.update((w, base + i) for i, w in enumerate(parts))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and all ids."""
        offsets, words = texts.word_list(texts.strings(column), lower=False)
        if len(words) == 0:
            return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint32)
        coded = words.dictionary_encode()
        parts = [p for w in coded.dictionary.to_pylist() for p in parts_of(w)]
        if len(self.known) > KNOWN_PARTS:
            self.forget()
        known = self.known
        fresh = list(dict.fromkeys(p for p in parts if p not in known))
        if fresh:
            self.learn(fresh)
        pairs = np.fromiter((known[p] for p in parts), np.int64, len(parts)).reshape(-1, 2)
        at = pairs[coded.indices.to_numpy()].ravel()
        counts = self.starts[at + 1] - self.starts[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(self.starts[at] - ends[:-1], counts) + np.arange(ends[-1])
        return ends[2 * offsets], self.ids[places]


def with_end(offsets: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text's ids."""
    count = len(offsets) - 1
    later = offsets + np.arange(count + 1)
    out = np.full(len(ids) + count, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[later[1:] - 1] = False
    out[keep] = ids
    return later, out


def piece_batches(text: str, path: str, capacity: int, end_id: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.load(path)
        for batch in texts.chunks(batches, text):
            offsets, ids = with_end(*tokenizer.encode(batch.column(text)), end_id)
            pieces = -(-np.diff(offsets) // capacity)
            owner = np.repeat(np.arange(batch.num_rows), pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            low = offsets[:-1][owner] + start
            high = np.minimum(low + capacity, offsets[1:][owner])
            raw = np.ascontiguousarray(ids.astype("<u4"))
            crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(low, high)), np.int64, len(low))
            columns = {
                "key": batch.column("key").take(pa.array(owner)),
                "piece": pa.array(number.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(high - low),
                "ids_crc32": pa.array(crc),
            }
            if with_ids:  # pieces follow each other without gaps
                columns["ids"] = texts.lists(np.append(low, offsets[-1]), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def pieces_of(
    docs: DataFrame, tokenizer: str, key: str, text: str, capacity: int, end_id: int, with_ids: bool
) -> DataFrame:
    fields = [
        T.StructField("key", docs.schema[key].dataType),
        T.StructField("piece", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")],
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(piece_batches("text", tokenizer, capacity, end_id, with_ids), T.StructType(fields))


# ---- the plan, from the histogram of lengths


@dataclass(frozen=True)
class Pattern:
    """The content of ``repeats`` sequences: lengths, the longest first, and how many pieces of each."""

    kinds: tuple[tuple[int, int], ...]
    repeats: int


def enumerate_patterns(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of a few lengths, 0 for none, that occur and sum up to ``capacity``.

    All single lengths and pairs. Of three to six lengths, and of about as many
    as fill a sequence where texts are shorter than that, some are drawn with a
    fixed seed: all but one length in proportion to the histogram, so that each
    length has patterns enough, the last one such that they fill the sequence.
    """
    held = histogram > 0
    usual = -(-capacity * int(histogram.sum()) // max(1, int((histogram * np.arange(len(histogram))).sum())))
    depths = sorted({*FEW, *(d for d in range(usual - 1, usual + 3) if 2 < d <= MOST)})
    width = max(depths)
    b = np.arange(1, capacity // 2 + 1)
    b = b[held[b] & held[capacity - b]]
    pairs = np.zeros((len(b), width), np.int64)
    pairs[:, 0], pairs[:, 1] = b, capacity - b
    parts = [pairs]
    shorter = np.flatnonzero(held[:capacity])
    if len(shorter):
        rng = np.random.default_rng(0)
        share = histogram[shorter] / histogram[shorter].sum()
        for depth in depths:
            some = rng.choice(shorter, (DRAWN, depth - 1), p=share)
            rest = capacity - some.sum(axis=1)
            fits = (rest > 0) & held[np.maximum(rest, 0)]
            found = np.zeros((int(fits.sum()), width), np.int64)
            found[:, : depth - 1], found[:, depth - 1] = some[fits], rest[fits]
            parts.append(found)
    if held[capacity]:
        parts.append(np.array([[capacity] + [0] * (width - 1)]))
    return np.unique(np.sort(np.concatenate(parts), axis=1), axis=0)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts whose lengths come close to the histogram.

    Accelerated projected gradient on the squared error, each length's error
    weighed by one over its count, so that rare lengths are not overdrawn.
    """
    held = patterns > 0
    lengths, owner = patterns[held], np.nonzero(held)[0]
    scale = np.zeros(len(histogram))
    scale[histogram > 0] = 1 / np.sqrt(histogram[histogram > 0])

    def times(x):
        return np.bincount(lengths, weights=x[owner], minlength=len(histogram)) * scale

    def back(r):
        return np.bincount(owner, weights=(r * scale)[lengths], minlength=len(patterns))

    x = np.ones(len(patterns))
    for _ in range(20):  # power iteration for the step
        x = back(times(x))
        norm = np.linalg.norm(x)
        x /= norm
    target, step = histogram * scale, 1 / (1.05 * norm)
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(patterns: np.ndarray, fitted: np.ndarray, left: np.ndarray) -> list[Pattern]:
    """Whole repeat counts, no more than ``left`` has; takes them from ``left``."""
    out = []
    for i in np.argsort(-fitted, kind="stable"):
        if fitted[i] < 1:
            break
        kinds = Counter(int(x) for x in patterns[i][::-1] if x)
        repeats = min(int(fitted[i]), *(int(left[x]) // c for x, c in kinds.items()))
        if repeats:
            for x, c in kinds.items():
                left[x] -= repeats * c
            out.append(Pattern(tuple(kinds.items()), repeats))
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns for what is left, longest first, each into the fullest sequence that has room.

    Pieces of one length are placed together: sequences of one content are a
    pattern with a count, and each takes as many of the pieces as it has room for, one
    sequence after another. So the work hangs on the lengths, not on the pieces.
    """
    rooms: list[int] = []  # sorted
    open_: dict[int, list[tuple[tuple, int]]] = {}  # room: contents and their counts
    closed: list[Pattern] = []

    def put(kinds: tuple[tuple[int, int], ...], room: int, count: int) -> None:
        if count == 0:
            return
        if room == 0:
            closed.append(Pattern(kinds, count))
            return
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append((kinds, count))

    for length in np.flatnonzero(left)[::-1].tolist():
        pieces = int(left[length])
        while pieces:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                kinds, count = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                kinds, room, count = (), capacity, pieces  # as many new ones as there may be need of
            each = room // length
            full = min(count, pieces // each)
            put((*kinds, (length, each)), room - each * length, full)
            pieces -= full * each
            if full < count and pieces:  # fewer are left than one more takes
                put((*kinds, (length, pieces)), room - pieces * length, 1)
                full, pieces = full + 1, 0
            if kinds:
                put(kinds, room, count - full)
    return closed + [Pattern(kinds, count) for groups in open_.values() for kinds, count in groups]


def make_plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns whose repeats hold exactly ``counts`` pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    if not left.any():
        return []
    patterns = enumerate_patterns(left, capacity)
    plan = rounded(patterns, fit_repeats(patterns, left.astype(float)), left) if len(patterns) else []
    return plan + best_fit(left, capacity)


def places(plan: list[Pattern]) -> dict[str, np.ndarray]:
    """Per length, which ranks go to which sequences: a row for each length of a pattern."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern in plan:
        at = 0
        for length, copies in pattern.kinds:
            rank = used.get(length, 0)
            rows.append((length, rank, base, at, pattern.repeats))
            used[length] = rank + copies * pattern.repeats
            at += copies * length
        base += pattern.repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    names = ("length", "rank", "sequence", "offset", "repeats")
    return {"key": (table[:, 0] << 44) + table[:, 1]} | {n: table[:, i] for i, n in enumerate(names)}


def place_batches(where: dict[str, np.ndarray]) -> Callable:
    """Ranks to places: the first pieces of a row of the plan go to its sequences in turn, so do the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(where["key"], (length << 44) + rank, side="right") - 1
            copy, sequence = np.divmod(rank - where["rank"][at], where["repeats"][at])
            kept = [i for i, c in enumerate(batch.schema.names) if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.columns[i] for i in kept]
                + [pa.array(where["sequence"][at] + sequence), pa.array(where["offset"][at] + copy * length)],
                names=[batch.schema.names[i] for i in kept] + ["sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece: ``key``, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A document is the ids of its whole text, then ``end_id``; a null or empty
    text is ``end_id`` alone. Only documents longer than ``capacity`` are cut.
    Every row is a document of its own, also rows that repeat or whose key is
    null. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = materialise(pieces_of(docs, tokenizer, key, text, capacity, end_id, with_ids), "pieces")
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per length at most
    where = places(make_plan({r["length"]: r["n"] for r in counted}, capacity))

    # Rank within a length: many rows may share one, so each length is dealt to groups, counted group by group.
    groups = 4 * texts.spread(spark)
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = dealt.groupBy("length", "deal").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(sizes.select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    within = Window.partitionBy("length", "deal").orderBy("key", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("rank", F.row_number().over(within).cast("long") - 1)
        .join(bases, ["length", "deal"])
        .withColumn("rank", F.col("rank") + F.col("base"))
        .select(*pieces.columns, "rank")
    )
    schema = T.StructType([*pieces.schema.fields, *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]])
    return ranked.mapInArrow(place_batches(where), schema).withColumnRenamed("key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and the ids of each sequence, from ``pack(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
