"""What a second pass over the texts needs to know of the first.

The first pass shuffles hashes only. Hashes that several rows have are told to
the second by a bit map of fixed size, which may say yes too often, never no.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of the map: 2 MB, whatever the input. Beyond some ten million keys it says
# yes to most rows, and the join after it has more to drop.
MAP_BITS = 24

# Items a task remembers.
SEEN = 500_000


class Seen:
    """Tells what this task has met lately, so that copies are not shuffled again."""

    def __init__(self):
        self.held: set = set()

    def new(self, item) -> bool:
        if item in self.held:
            return False
        if len(self.held) >= SEEN:
            self.held.clear()
        self.held.add(item)
        return True


class Shared:
    """Finds values that occur twice or more in pairs that come sorted by value, part by part.

    Holds one pending pair; a value that many rows have streams by.
    """

    def __init__(self):
        self.value = self.row = None
        self.told = False  # whether the pending pair was given out

    def add(self, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs now known to share their value."""
        if len(values) == 0:
            return values, rows
        same = values[1:] == values[:-1]
        continued = self.value is not None and values[0] == self.value
        shared = np.concatenate([[continued], same])
        shared[:-1] |= same
        found, found_rows = values[shared], rows[shared]
        if continued and not self.told:
            found, found_rows = np.append(found, self.value), np.append(found_rows, self.row)
        self.value, self.row, self.told = values[-1], rows[-1], bool(shared[-1])
        return found, found_rows


class Counted:
    """Counts how often values occur in pairs that come sorted by value, part by part.

    Gives out the pairs of values that occur twice or more, with the count, but
    no more than ``cap``; holds fewer than ``cap`` pending pairs.
    """

    def __init__(self, cap: int):
        self.cap, self.value, self.over = cap, None, False
        self.rows: list[np.ndarray] = []
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def give(self, value: int, rows: np.ndarray, count: int) -> None:
        self.out.append((np.full(len(rows), value), rows, np.full(len(rows), min(count, self.cap))))

    def extend(self, rows: np.ndarray) -> None:
        if self.over:
            self.give(self.value, rows, self.cap)
            return
        self.rows.append(rows)
        if sum(map(len, self.rows)) >= self.cap:
            self.give(self.value, np.concatenate(self.rows), self.cap)
            self.rows, self.over = [], True

    def end(self) -> None:
        count = sum(map(len, self.rows))
        if count > 1:
            self.give(self.value, np.concatenate(self.rows), count)
        self.rows, self.value, self.over = [], None, False

    def add(self, values: np.ndarray, rows: np.ndarray) -> None:
        borders = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
        if len(values) == 0:
            return
        if self.value is None or values[0] != self.value:
            self.end()
            self.value = values[0]
        self.extend(rows[: borders[1]])
        if len(borders) == 2:
            return
        self.end()
        low, high = borders[1], borders[-2]
        counts = np.diff(borders[1:-1])
        each = np.repeat(counts, counts)
        twice = each > 1
        self.out.append((values[low:high][twice], rows[low:high][twice], np.minimum(each[twice], self.cap)))
        self.value = values[high]
        self.extend(rows[high:])

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What was found since the last call: values, rows, counts."""
        empty = np.zeros(0, np.int64)
        found = [np.concatenate([empty, *x]) for x in zip(*self.out)] if self.out else [empty] * 3
        self.out = []
        return tuple(found)


def bit_map(keys: DataFrame, size: int = MAP_BITS) -> np.ndarray:
    """The map of the column ``key`` of longs, of ``2 ** size`` bits."""
    slot = F.col("key").bitwiseAND((1 << size) - 1)
    filled = (
        keys.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()  # 2 ** (size - 6) rows at most
    )
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[filled.column("at").to_numpy()] = filled.column("bits").to_numpy()
    return bits.view(np.uint64)


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
