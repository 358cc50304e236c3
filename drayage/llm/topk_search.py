"""Exact top-k by integer inner product, on a bit-sliced index.

Rows are dealt to blocks. A block holds, for each bit of each component, one
bitmap over its rows. A query's products are sums of shifted bitmaps, added by
carry-save adders, so a score is again a set of bitmaps. The best rows are taken
from the most significant bitmap downward; rows tied at the border are taken in
the order of their ids. The best of the blocks are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drayage.session import materialise

# Rows of a block, and queries that are sent to a block together.
BLOCK_ROWS = 32_768
GROUP_QUERIES = 512


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, null for vectors that take no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # The products of two such vectors are below 2^62.
    grown = F.transform(vector, lambda x: F.pow(F.abs(x.cast("double") * scale) + 1, F.lit(2.0)))
    fits = F.aggregate(grown, F.lit(0.0), lambda total, x: total + x) < float(1 << 62)
    return F.when(vector.isNotNull() & finite & fits, whole)


def signed_digits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Component, exponent and sign of every non-zero digit, no two neighbours of a value being non-zero."""
    at, exponents, signs, rest, exponent = [], [], [], values.astype(np.int64), 0
    while rest.any():
        digit = np.where(rest & 1, 2 - (rest & 3), 0)
        found = np.flatnonzero(digit)
        at.append(found)
        exponents.append(np.full(len(found), exponent))
        signs.append(digit[found])
        rest = (rest - digit) >> 1
        exponent += 1
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (at, exponents, signs))


class Block:
    """A block of the index: ``planes`` has the bitmaps of all components, then their complements."""

    def __init__(self, ids: np.ndarray, bits: int, width: int, body: bytes, number: int = 0):
        self.ids, self.bits, self.width, self.number = ids, bits, width, number
        words = -(-len(ids) // 64)
        plain = np.frombuffer(body, np.uint64).reshape(width * bits, words)
        self.planes = np.concatenate([plain, ~plain])
        valid = np.zeros(words * 64, np.uint8)
        valid[: len(ids)] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    @staticmethod
    def body(values: np.ndarray) -> tuple[int, int, bytes]:
        """Bits, width and bitmaps of a matrix of whole numbers, a row per id."""
        rows, width = values.shape
        bits = int(np.abs(values).max(initial=0)).bit_length() + 1
        raised = values + (1 << (bits - 1))
        padded = np.zeros((width, -(-rows // 64) * 64), np.int64)
        padded[:, :rows] = raised.T
        planes = [np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)]
        return bits, width, np.stack(planes, axis=1).tobytes()

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the scores, least significant first, and what must be added to them."""
        query = query[: self.width].astype(np.int64)
        at, exponents, signs = signed_digits(query)
        # A component is held raised by half its range; a negative digit adds the complement.
        base = -(1 << (self.bits - 1)) * int(query.sum()) - ((1 << self.bits) - 1) * int((1 << exponents[signs < 0]).sum())
        slices = np.arange(self.bits)
        place = (exponents[:, None] + slices).ravel()
        plane = ((at * self.bits)[:, None] + slices + np.where(signs < 0, self.width * self.bits, 0)[:, None]).ravel()
        order = np.argsort(place, kind="stable")
        place, plane = place[order], plane[order]
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        position, last = 0, int(place[-1]) if len(place) else -1
        while position <= last or carried:
            low, high = np.searchsorted(place, [position, position + 1])
            column = np.concatenate([self.planes[plane[low:high]], *carried])
            carried = []
            while len(column) >= 3:
                third = len(column) // 3
                a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
                either = a ^ b
                carried.append((a & b) | (either & c))
                column = np.concatenate([either ^ c, column[3 * third :]])
            if len(column) == 2:
                carried.append((column[0] & column[1])[None])
                column = column[:1] ^ column[1:]
            out.append(column[0] if len(column) else np.zeros_like(self.valid))
            position += 1
        return out, base

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows but those with the query's id; ties go to the smaller id."""
        slices, base = self.scores(query)
        tied, sure, n_sure = self.valid.copy(), np.zeros_like(self.valid), 0
        low, high = np.searchsorted(self.ids, [query_id, query_id + 1])
        for i in range(low, high):
            tied[i >> 6] &= ~np.uint64(1 << (i & 63))
        for plane in reversed(slices):
            upper = tied & plane
            count = int(np.bitwise_count(upper).sum())
            if n_sure + count > k:
                tied = upper
            else:
                sure, n_sure = sure | upper, n_sure + count
                tied = tied & ~plane
            if n_sure == k:
                break
        rows = np.concatenate([self.rows(sure), self.rows(tied)[: k - n_sure]])  # ids ascend within a block
        total = np.full(len(rows), base, np.int64)
        for b, plane in enumerate(slices):
            total += ((plane[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
        return self.ids[rows], total

    @staticmethod
    def rows(bitmap: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[used].view(np.uint8), bitorder="little").reshape(-1, 64)
        word, bit = np.nonzero(bits)
        return used[word] * 64 + bit


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1], sizes)] = flat
    return out


def build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block, from rows sorted by block and id; holds one block."""
    held: list[pa.RecordBatch] = []

    def built() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, values = table.column("id").to_numpy(), matrix(table.column("vector").chunk(0))
        bits, width, body = Block.body(values)
        row = {"block": int(table.column("block")[0].as_py()), "bits": bits, "width": width, "ids": ids.tobytes(), "body": body}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema(
        [("block", pa.int64()), ("bits", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("body", pa.binary())]
    )
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                part = batch.slice(low, high - low)
                if held and held[0].column("block")[0] != part.column("block")[0]:
                    yield built()
                    held = []
                held.append(part)
    if held:
        yield built()


def search_batches(k: int):
    """Answers from rows sorted so that a block comes before its queries; holds one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = None
        for batch in batches:
            query, found_for, ids, scores = [], [], [], []
            for i in range(batch.num_rows):
                body = batch.column("body")[i].as_py()
                if batch.column("bits")[i].as_py() is not None:
                    block = Block(
                        np.frombuffer(batch.column("ids")[i].as_py(), np.int64), batch.column("bits")[i].as_py(),
                        batch.column("width")[i].as_py(), body, batch.column("block")[i].as_py(),
                    )
                    continue
                if block is None or block.number != batch.column("block")[i].as_py():
                    continue  # no row was dealt to that block
                query_id = batch.column("id")[i].as_py()
                best, score = block.best(query_id, np.frombuffer(body, np.int64), k)
                query.append(np.full(len(best), batch.column("row")[i].as_py()))
                found_for.append(np.full(len(best), query_id))
                ids.append(best)
                scores.append(score)
            if ids:
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (query, found_for, ids, scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "query_id", "id", "score"])

    return run


def pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [np.array(x, np.int64).tobytes() for x in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("id"), pa.array(bodies, pa.binary())], names=["row", "id", "body"]
        )


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The bit-sliced index of ``id``, ``vector``, as a table with a row per block."""
    blocks = max(1, -(-vectors.count() // block_rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    ordered = dealt.repartition("block").sortWithinPartitions("block", "id")
    return materialise(
        ordered.mapInArrow(build_blocks, "block long, bits int, width int, ids binary, body binary"), "bit_slices"
    )


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``row``, ``query_id``, ``rank``, ``id``, ``score`` of each query's best rows.

    ``queries`` has ``row`` (any unique number), ``id`` and ``vector``. Each
    group of queries meets each block once: the index is sent once per group.
    """
    sent = queries.mapInArrow(pack_vectors, "row long, id long, body binary")
    packed = materialise(sent, "queries")
    groups = max(1, -(-packed.count() // GROUP_QUERIES))
    last = index.agg(F.max("block")).first()[0]
    blocks = F.array().cast("array<long>") if last is None else F.sequence(F.lit(0), F.lit(last)).cast("array<long>")
    grouped = packed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)))
    asked = grouped.select(
        F.explode(blocks).alias("block"),
        "part", "row", "id", F.lit(None).cast("int").alias("bits"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("binary").alias("ids"), "body",
    )
    offered = index.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")).alias("part"),
        F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("id"), "bits", "width", "ids", "body",
    )
    met = offered.unionByName(asked).repartition("block", "part").sortWithinPartitions("block", "part", F.col("bits").desc_nulls_last())
    found = met.mapInArrow(search_batches(k), "row long, query_id long, id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows of ``vectors`` that ``is_query`` picks.

    Components become floor(scale * x). Rows with a null key, and vectors that
    are null or hold null or non-finite components, take no part; nor do vectors
    whose squared length comes to 2^62 or more, each scaled component counted
    one larger, as their scores may not fit 64 bits. A shorter
    vector's missing components are zero. Every row is searched but those with
    the query's own key; repeated rows are rows of their own, as queries as well.
    """
    whole = vectors.select(
        F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    table = materialise(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")
    index = build_index(table.select("id", "vector"))
    found = search(index, table.where("asks").select("row", "id", "vector"), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
