"""Substring dedup: paragraphs that repeat, by MinHash banding, and passages that repeat word for word.

A text is cut into paragraphs at line ends and sentence ends; short ones are
joined with the next, so a passage may be cut otherwise after other words.
Paragraphs that collide in a band are verified by exact Jaccard similarity of
their shingles and clustered; of each cluster the first occurrence stays.
Neighbouring repeats make a span; spans of enough words go. Copied passages
that are no paragraphs are found by anchors (``exact_spans``); what overlaps or
touches is one span.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm import texts
from drayage.llm.exact_spans import exact_repeats
from drayage.llm.linking import cluster
from drayage.llm.second_pass import SEEN, Shared, bit_map, in_map
from drayage.session import materialise

SPANS = "__spans"


def tune_bands(percent: int, recall: float, rows: int = 2) -> int:
    """Bands of ``rows`` MinHashes that make a pair at the threshold collide with at least ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


def word_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of all texts: first code point and end within its text, whether a sentence or line ends with it.

    Also the offsets of each text's words.
    """
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    border = np.zeros(len(raw) + 1, bool)
    border[ends] = True
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    before = np.concatenate([[False], word])
    after = np.concatenate([word, [False]])
    first = np.flatnonzero(after & (~before | border))
    last = np.flatnonzero(before & (~after | border))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    offsets = np.searchsorted(first, ends)
    owner = np.searchsorted(ends, first, side="right") - 1
    base = points[ends[owner]]
    newlines = np.concatenate([[0], np.cumsum(raw == 10)])
    closing = np.isin(raw[last - 1], np.frombuffer(b".!?", np.uint8))
    if len(first):
        closing[:-1] |= newlines[first[1:]] > newlines[last[:-1]]
    return offsets, points[first] - base, points[last] - base, closing


def paragraph_borders(offsets: np.ndarray, closing: np.ndarray, min_words: int) -> np.ndarray:
    """Word numbers at which paragraphs begin, and the number of words."""
    stops = closing.copy()
    text_ends = offsets[1:][np.diff(offsets) > 0]
    stops[text_ends - 1] = True
    final = np.zeros(len(closing), bool)
    final[text_ends - 1] = True
    out, start = [0], 0
    places = np.flatnonzero(stops)
    for end, is_final in zip((places + 1).tolist(), final[places].tolist()):
        if is_final or end - start >= min_words:
            out.append(end)
            start = end
    return np.array(out, np.int64)


class Paragraphs:
    """The paragraphs of at least ``min_words`` words of some texts, as arrays."""

    def __init__(self, column: pa.Array, min_words: int, width: int):
        column = texts.strings(column)
        offsets, begin, end, closing = word_places(column)
        _, words = texts.word_list(column, lower=True)
        self.words = texts.hash_words(words)
        borders = paragraph_borders(offsets, closing, min_words)
        low, high = borders[:-1], borders[1:]
        self.text = np.searchsorted(offsets, low, side="right") - 1
        self.number = np.arange(len(low)) - np.searchsorted(low, offsets)[self.text]
        self.word = low - offsets[self.text]
        self.n_words = high - low
        self.begin, self.end = begin[low], end[high - 1]
        place = np.arange(len(self.words)) - np.repeat(low, self.n_words)
        with np.errstate(over="ignore"):
            at = place.astype(np.uint64) * texts.GOLDEN
            self.h1 = texts.sums(borders, texts.mix(self.words + at))
            self.h2 = texts.sums(borders, texts.mix(self.words * texts.GOLDEN ^ at))
        self.shingle_offsets, self.shingles = texts.shingles(borders, self.words, width)
        self.long = self.n_words >= min_words

    def bands(self, count: int, rows: int) -> np.ndarray:
        """A key per paragraph and band, of the minima of ``rows`` permutations each."""
        numbers = texts.odd_numbers(2 * count * rows, 5)
        out = np.zeros((len(self.n_words), count), np.uint64)
        if len(self.n_words) == 0:
            return out
        with np.errstate(over="ignore"):
            for band in range(count):
                key = np.full(len(self.n_words), band + 1, np.uint64)
                for k in range(band * rows, (band + 1) * rows):
                    least = np.minimum.reduceat((self.shingles ^ numbers[2 * k]) * numbers[2 * k + 1], self.shingle_offsets[:-1])
                    key = texts.mix(key * texts.GOLDEN + least)
                out[:, band] = key
        return out


def band_batches(text: str, min_words: int, width: int, count: int, rows: int) -> Callable:
    """Rows ``key``, ``h1``: a paragraph's bands; of one met again in the task only the first band, once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for batch in texts.chunks(batches, text):
            p = Paragraphs(batch.column(text), min_words, width)
            bands = p.bands(count, rows)
            take = np.zeros(len(p.h1), np.int64)
            for i in np.flatnonzero(p.long).tolist():
                h = int(p.h1[i])
                times = met.get(h, 0)
                take[i] = count if times == 0 else int(times == 1)
                if times < 2:
                    met[h] = times + 1
            if len(met) > SEEN:
                met.clear()
            wanted = np.arange(count)[None, :] < take[:, None]
            owner = np.nonzero(wanted)[0]
            yield pa.RecordBatch.from_arrays(
                [texts.signed(bands[wanted]), texts.signed(p.h1[owner])], names=["key", "h1"]
            )

    return run


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared = Shared()
    for batch in batches:
        keys, rows = shared.add(batch.column("key").to_numpy(), batch.column("h1").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rows)], names=["key", "h1"])


def paragraph_batches(text: str, min_words: int, width: int, bits: np.ndarray) -> Callable:
    """Rows of the paragraphs in the bit map; the members of one met again in the task are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in texts.chunks(batches, text):
            p = Paragraphs(batch.column(text), min_words, width)
            chosen = np.flatnonzero(p.long & in_map(bits, p.h1.view(np.int64)))
            if len(chosen) == 0:
                continue
            members = []
            for i in chosen.tolist():
                h = int(p.h1[i])
                members.append(
                    None if h in met else np.unique(p.shingles[p.shingle_offsets[i] : p.shingle_offsets[i + 1]]).view(np.int64)
                )
                met.add(h)
            if len(met) > SEEN:
                met.clear()
            owner = pa.array(p.text[chosen])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(owner) for c in ("key", "a", "b")]
                + [pa.array(x[chosen].astype(np.int64)) for x in (p.number, p.word, p.n_words, p.begin, p.end)]
                + [texts.signed(p.h1[chosen]), texts.signed(p.h2[chosen]), pa.array(members, pa.list_(pa.int64()))],
                names=["key", "a", "b", "number", "word", "n_words", "begin", "end", "h1", "h2", "members"],
            )

    return run


def identified(docs: DataFrame, key: str, text: str, a: str = "a", b: str = "b") -> DataFrame:
    """``docs`` with a 128-bit identity ``a``, ``b`` of key and text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({a: F.xxhash64(F.col(key), body), b: F.xxhash64(F.lit(1), F.col(key), body)})


def repeated_spans(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_words: int = 10,
    min_span_words: int = 25,
    width: int = 5,
    percent: int = 75,
    recall: float = 0.98,
) -> DataFrame:
    """The spans of paragraphs that repeat what stands earlier: a row per span.

    Columns: key, a, b (the document's identity), word (its first word's
    number), start and length (code points), n_words, kept_key (the document whose
    occurrence of the first paragraph stays), class_id. Earlier means a smaller
    key, then an earlier place. Rows that repeat key and text are one document.
    Null and empty texts have no paragraphs. Null keys come first.
    """
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    count = tune_bands(percent, recall)
    bands = read.select("text").mapInArrow(band_batches("text", min_words, width, count, 2), "key long, h1 long")
    sorted_bands = bands.repartition("key").sortWithinPartitions("key")
    met = materialise(sorted_bands.mapInArrow(shared_rows, "key long, h1 long").distinct(), "bands")
    wanted = met.select("h1").distinct()

    bits = bit_map(wanted.withColumnRenamed("h1", "key"))
    fields = [T.StructField("key", docs.schema[key].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("a", "b", "number", "word", "n_words", "begin", "end", "h1", "h2")]
    schema = T.StructType([*fields, T.StructField("members", T.ArrayType(T.LongType()))])
    again = identified(read, "key", "text").mapInArrow(paragraph_batches("text", min_words, width, bits), schema)
    found = materialise(again.join(wanted, "h1", "left_semi"), "paragraphs")

    sets = found.groupBy("h1", "h2").agg(F.max("members").alias("members"))
    classes = materialise(
        sets.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", F.size("members").cast("long").alias("n"), "members"),
        "classes",
    )
    index = materialise(met.join(classes.select("h1", "id", "n"), "h1").select("key", "id", "n", F.col("n").alias("m"), F.lit(256).cast("long").alias("bits")), "bands")
    linked = cluster(index, classes.select("id", "n", "members"), percent)
    named = materialise(
        classes.select("id", "h1", "h2").join(linked, "id", "left")
        .select("h1", "h2", F.coalesce("component", "id").alias("class_id")),
        "classes",
    )
    placed = materialise(found.drop("members").join(named, ["h1", "h2"]).drop("h1", "h2").distinct(), "paragraphs")

    place = F.struct("key", "a", "b", "number")
    first = placed.groupBy("class_id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialise(first.select("class_id", "first"), "first")
    repeats = placed.join(first, "class_id").where(~place.eqNullSafe(F.col("first")))
    document = Window.partitionBy("a", "b", "key").orderBy("number")
    runs = repeats.withColumn("run", F.col("number") - F.row_number().over(document))
    spans = runs.groupBy("key", "a", "b", "run").agg(
        F.min("word").alias("word"),
        F.min("begin").alias("start"),
        (F.max("end") - F.min("begin")).alias("length"),
        F.sum("n_words").alias("n_words"),
        F.min_by(F.col("first.key"), "number").alias("kept_key"),
        F.min_by("class_id", "number").alias("class_id"),
    )
    return spans.where(F.col("n_words") >= min_span_words).drop("run")


def all_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans of ``repeated_spans`` and the passages that repeat word for word, where they meet as one.

    Every passage of 51 words or more that stands earlier too lies in one,
    wherever it begins. kept_key and class_id are those of the first part.
    """
    parts = repeated_spans(docs, key, text).unionByName(exact_repeats(docs, key, text))
    stop = F.col("word") + F.col("n_words")
    document = Window.partitionBy("a", "b", "key").orderBy("word", F.desc("n_words"), "class_id")
    before = F.max(stop).over(document.rowsBetween(Window.unboundedPreceding, -1))
    begins = parts.withColumn("new", F.coalesce((F.col("word") > before).cast("long"), F.lit(1).cast("long")))
    named = begins.withColumn("span", F.sum("new").over(document.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("word", F.negative("n_words"), "class_id")
    return named.groupBy("key", "a", "b", "span").agg(
        F.min("word").alias("word"),
        F.min("start").alias("start"),
        (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length"),
        (F.max(stop) - F.min("word")).alias("n_words"),
        F.min_by("kept_key", at).alias("kept_key"),
        F.min_by("class_id", at).alias("class_id"),
    ).drop("span")


def cut_batches(text: str) -> Callable:
    def cut(body: str | None, spans: list | None) -> str | None:
        if body is None or not spans:
            return body
        out, at = [], 0
        for start, length in spans:
            out.append(body[at:start])
            at = start + length
        return "".join([*out, body[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [None if s is None else [(x["start"], x["length"]) for x in s] for s in batch.column(SPANS).to_pylist()]
            column = batch.column(text)
            if any(spans):
                column = pa.array(map(cut, column.to_pylist(), spans), column.type)
            names = [c for c in batch.schema.names if c != SPANS]
            yield pa.RecordBatch.from_arrays([column if c == text else batch.column(c) for c in names], names=names)

    return run


def without_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the spans; all columns stay. The white space around a span stays too."""
    a, b = "__doc_a", "__doc_b"
    listed = spans.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias(SPANS))
    listed = materialise(listed.withColumnsRenamed({"a": a, "b": b}), "spans")
    joined = identified(docs, key, text, a, b).join(listed, [a, b], "left").select(*[F.col(f"`{c}`") for c in docs.columns], SPANS)
    return joined.mapInArrow(cut_batches(text), docs.schema)
