"""Vectorised words and shingles of Arrow batches, and helpers the operators share.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``; A-Z are
lower-cased where an operator says so, other letters are kept.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Text handled at once by one task; a longer text is handled alone.
CHUNK_BYTES = 4 << 20

# Rows sent to Python at once. Texts may be long, so it is far below Spark's default.
BATCH_ROWS = 500

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession) -> SparkSession:
    """Keep the Arrow batches of text columns small, and let Python workers find this package where the driver did.

    On a cluster whose machines do not have it there, ship it with ``--py-files``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, *known]))
    return spark


def spread(spark: SparkSession) -> int:
    """Partitions for an explicit shuffle: the session's number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit hangs on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(count: int, seed: int) -> np.ndarray:
    """``count`` fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed)) | np.uint64(1)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds at most ``limit`` bytes, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def strings(column: pa.Array) -> pa.Array:
    """The column as strings with 64-bit offsets, null as the empty text."""
    if column.offset:  # Arrow lower-cases a slice with the offsets of the whole
        column = pa.concat_arrays([column, column.slice(0, 0)])
    return pc.fill_null(column.cast(pa.large_string()), "")


def word_list(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words, and the words of all texts."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = split.flatten()
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat).to_numpy(zero_copy_only=False)) > 0  # white space at the ends leaves empty ones
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        offsets = kept[offsets]
        flat = flat.filter(pa.array(full))
    return offsets, flat


# Words are hashed in blocks of so many bytes, those from LONG_WORD bytes on one by one.
HASH_BLOCK = 1 << 18
LONG_WORD = 1 << 8


@cache
def hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number per byte, and the powers of an odd number and of its inverse for each place in a block."""
    odd = 0xD6E8FEB86659FD93
    with np.errstate(over="ignore"):
        count = HASH_BLOCK + LONG_WORD
        return odd_numbers(256, 29), *(np.cumprod(np.full(count, pow(odd, e, 1 << 64), np.uint64)) for e in (1, -1))


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes and its length alone.

    Sums of the bytes' numbers times powers, taken as differences of one running
    sum over a block, so that no word is looked at by itself.
    """
    words = words.cast(pa.large_string())
    out = np.empty(len(words), np.uint64)
    if len(words) == 0:
        return out
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    of_byte, powers, back = hash_tables()
    low = 0
    with np.errstate(over="ignore"):
        while low < len(words):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + HASH_BLOCK, side="right")) - 1)
            base, size = offsets[low], min(int(offsets[high] - offsets[low]), HASH_BLOCK)  # a word beyond a block is alone
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(of_byte[raw[base : base + size]] * powers[:size], out=total[1:])
            at = np.minimum(offsets[low : high + 1] - base, size)
            out[low:high] = (total[at[1:]] - total[at[:-1]]) * back[at[:-1]]
            low = high
        out = mix(out + lengths.astype(np.uint64) * GOLDEN)
    for i in np.flatnonzero(lengths >= LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[offsets[i] : offsets[i + 1]])
    return out


def shingles(offsets: np.ndarray, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each sequence's shingles, and a hash of each shingle.

    A sequence of fewer than ``width`` words is one shingle; an empty one has
    none.
    """
    lengths = np.diff(offsets)
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    out = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = offsets[:-1][owner] + np.arange(out[-1]) - out[:-1][owner]
    size = np.minimum(lengths, width)[owner]
    numbers = odd_numbers(width, 17)
    with np.errstate(over="ignore"):
        total = size.astype(np.uint64) * GOLDEN
        padded = np.concatenate([words, np.zeros(width, np.uint64)])
        for k in range(width):
            part = padded[first + k] * numbers[k]
            total += part if k == 0 else np.where(size > k, part, np.uint64(0))
        return out, mix(total)


def distinct_sorted(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each sequence in ascending order."""
    values = values.copy()
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        values[low:high].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.concatenate([[0], np.cumsum(new)])[offsets], values[new]


def sums(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of each sequence modulo 2^64."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[offsets[1:]] - total[offsets[:-1]]


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def text_key(text: Column) -> Column:
    """A hash of the raw text that Spark computes before any text goes to Python."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
