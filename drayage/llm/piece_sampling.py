"""Distinct sampled segmentations into pieces, and decoding.

A text's segmentations are the paths of a lattice. Each path has a Gumbel
noise added to its log probability; the k best are a sample without
replacement. They are found top down, without listing paths: the best path of a
set of paths is drawn from the conditional probabilities, and the best of those
that leave it at some node has a truncated Gumbel value. So the search always
goes on where the value that is left is largest, as A* does with an exact bound.
Noise comes from a hash of the row's key and the place in the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm import texts

SPACE = 0x2581  # stands for a space
LITERAL = 0x110000  # the character that stands for a space, where a text itself has it
NEWLINE = 10
CODE_BITS = 21
NONE = -np.inf


class Pieces:
    """The pieces of a SentencePiece model as a trie over code points, and their bytes.

    A piece's weight falls with its rank in the model, as ranks of words do:
    ``-alpha * log(rank + 2)``. Characters without a piece are spelt in bytes.
    """

    _loaded: dict[tuple, "Pieces"] = {}

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int64)
        weight: dict[str, tuple[int, float]] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                self.bytes.append(piece.replace(chr(SPACE), " ").encode())
                weight[piece] = (i, -alpha * float(np.log(min(-model.get_score(i), size) + 2)))
        self.byte_weight = -alpha * float(np.log(size + 2))
        go: dict[int, int] = {}
        ids, weights = [-1], [0.0]
        for piece, (i, w) in weight.items():
            node = 0
            for ch in piece:
                step = node << CODE_BITS | ord(ch)
                if step not in go:
                    go[step] = len(ids)
                    ids.append(-1)
                    weights.append(0.0)
                node = go[step]
            ids[node], weights[node] = i, w
        self._hashed(np.array(list(go), np.int64), np.array(list(go.values()), np.int64))
        self.ids, self.weights = np.array(ids, np.int64), np.array(weights)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _hashed(self, steps: np.ndarray, nodes: np.ndarray) -> None:
        """The trie's steps in an open hash table, four times as large."""
        bits = int(len(steps) * 4).bit_length()
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.step_at, self.node_at = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        slots = self._slot(steps)
        for step, node, slot in zip(steps.tolist(), nodes.tolist(), slots.tolist()):
            while self.step_at[slot] >= 0:
                slot = slot + 1 & self.mask
            self.step_at[slot], self.node_at[slot] = step, node

    def _slot(self, steps: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (steps.view(np.uint64) * texts.GOLDEN >> self.shift).astype(np.int64)

    def follow(self, steps: np.ndarray) -> np.ndarray:
        """The node after each step, -1 if there is none."""
        slot = self._slot(steps)
        held = self.step_at[slot]
        out = np.where(held == steps, self.node_at[slot], -1)
        look = np.flatnonzero((held != steps) & (held >= 0))
        while len(look):
            slot[look] = slot[look] + 1 & self.mask
            held = self.step_at[slot[look]]
            hit = held == steps[look]
            out[look[hit]] = self.node_at[slot[look[hit]]]
            look = look[~hit & (held >= 0)]
        return out

    @classmethod
    def load(cls, path: str, alpha: float = 1.0) -> "Pieces":
        if (path, alpha) not in cls._loaded:
            cls._loaded[path, alpha] = cls(path, alpha)
        return cls._loaded[path, alpha]

    def spelt(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and where each id's begin."""
        counts = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[np.repeat(self.starts[ids] - ends[:-1], counts) + np.arange(ends[-1])], ends

    def spells(self, offsets: np.ndarray, ids: np.ndarray, rows: list[str]) -> np.ndarray:
        """Whether each sequence of ids decodes to its text. Only those whose bytes are others are decoded."""
        raw, ends = self.spelt(ids)
        borders = ends[offsets].tolist()
        whole = raw.tobytes()
        good = np.array([whole[a:b] == (b" " + t.encode() if t else b"") for a, b, t in zip(borders, borders[1:], rows)], bool)
        for i in np.flatnonzero(~good).tolist():
            good[i] = self.decode(np.array([0, offsets[i + 1] - offsets[i]]), ids[offsets[i] : offsets[i + 1]])[0] == rows[i]
        return good

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of sequences of ids."""
        flat, ends = self.spelt(ids)
        raw = flat.tobytes()
        borders = ends[offsets]
        found = [raw[a:b].decode("utf-8", "replace") for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
        return [t[1:] if t.startswith(" ") else t for t in found]


class Lattice:
    """Edges of the distinct units of some texts, with conditional probabilities.

    A unit is a run of spaces and what follows up to the next, or a newline: no
    piece reaches over its border, so the units of a text are independent.
    """

    def __init__(self, pieces: Pieces, codes: np.ndarray, starts: np.ndarray):
        """``codes`` of all texts, and where units start in them."""
        ends = np.append(starts[1:], len(codes))
        place = np.arange(len(codes)) - np.repeat(starts, ends - starts)
        seed = np.uint64(1)
        while True:
            with np.errstate(over="ignore"):
                mixed = texts.mix(codes.astype(np.uint64) * texts.GOLDEN + place.astype(np.uint64) * seed)
                borders = np.append(starts, len(codes))
                h1, h2 = texts.sums(borders, mixed), texts.sums(borders, texts.mix(mixed + seed))
                seed = seed * texts.GOLDEN + np.uint64(2)
            _, first, unit = np.unique(h1, return_index=True, return_inverse=True)  # the seed changes if two units collide
            if (h2[first][unit] == h2).all():
                break
        lengths = (ends - starts)[first]
        base = np.concatenate([[0], np.cumsum(lengths + 1)])  # first place of each distinct unit
        owner = np.repeat(np.arange(len(first)), lengths + 1)
        step = np.arange(base[-1]) - base[:-1][owner]
        left = lengths[owner] - step  # characters up to the unit's end
        code = np.full(len(left), -1, np.int64)
        code[left > 0] = codes[(starts[first][owner] + step)[left > 0]]
        # Nodes are numbered by the characters left, so those of one distance, and their edges, lie together.
        order = np.argsort(left.astype(np.int16) if lengths.max(initial=0) < 32_000 else left, kind="stable")
        self.node_of = np.empty(len(left), np.int64)
        self.node_of[order] = np.arange(len(left))
        self.begin = base[:-1][unit]  # of each occurrence: its first place, whose node is in node_of
        self._edges(pieces, code, left)
        self._probabilities(np.searchsorted(left[order], np.arange(1, lengths.max(initial=0) + 2)))

    def _edges(self, pieces: Pieces, code: np.ndarray, left: np.ndarray) -> None:
        """Edges by node: the length, the id (or -1 - the character, if it is spelt in bytes) and the weight."""
        found = []
        at = np.flatnonzero(left > 0)
        state, depth = np.zeros(len(at), np.int64), 0
        single = left == 0
        while len(at):
            state = pieces.follow(state << CODE_BITS | code[at + depth])
            hit = state >= 0
            at, state, depth = at[hit], state[hit], depth + 1
            final = pieces.ids[state] >= 0
            found.append((at[final], depth, pieces.ids[state[final]], pieces.weights[state[final]]))
            if depth == 1:
                single[at[final]] = True
            go_on = left[at] > depth
            at, state = at[go_on], state[go_on]
        spelt = np.flatnonzero(~single)
        c = np.where(code[spelt] == LITERAL, SPACE, code[spelt])
        width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        found.append((spelt, 1, -1 - c, width * pieces.byte_weight))
        degree = np.zeros(len(left), np.int64)
        found = [(self.node_of[places], self.node_of[places + depth], depth, ids, weights) for places, depth, ids, weights in found]
        for node, *_ in found:
            degree[node] += 1
        self.first = np.concatenate([[0], np.cumsum(degree)])
        self.length, self.ids = np.zeros(self.first[-1], np.int64), np.zeros(self.first[-1], np.int64)
        self.weights, self.target = np.zeros(self.first[-1]), np.zeros(self.first[-1], np.int64)
        free = self.first[:-1].copy()
        for node, target, depth, ids, weights in found:
            slot = free[node]
            free[node] = slot + 1
            self.length[slot], self.ids[slot], self.weights[slot], self.target[slot] = depth, ids, weights, target

    def _probabilities(self, borders: np.ndarray) -> None:
        """Of each edge the chance given its node; ``borders`` has the first node of each distance from 1 on."""
        total = np.zeros(len(self.first) - 1)  # log of the summed weights of all ways from a node to the unit's end
        for low, high in zip(borders[:-1], borders[1:]):
            if low < high:
                a, b = self.first[low], self.first[high]
                value = self.weights[a:b] + total[self.target[a:b]]
                total[low:high] = np.logaddexp.reduceat(value, self.first[low:high] - a)
        degree = np.diff(self.first)
        self.log_p = self.weights + total[self.target] - np.repeat(total, degree)
        self.p = np.exp(self.log_p)
        ends = np.concatenate([[0.0], np.cumsum(self.p)])
        self.until = ends[1:] - np.repeat(ends[self.first[:-1]], degree)  # cumulative within a node
        self.until[self.first[1:][degree > 0] - 1] = 2.0  # a draw never runs past a node's edges

    def draw(self, nodes: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """An edge of each node, by its probability."""
        edge = self.first[nodes]
        short = np.flatnonzero(uniform > self.until[edge])
        while len(short):
            edge[short] += 1
            short = short[uniform[short] > self.until[edge[short]]]
        return edge


def uniforms(seeds: np.ndarray, counter: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1), a function of seed, counter and stream."""
    with np.errstate(over="ignore"):
        bits = texts.mix(seeds + texts.mix(counter.astype(np.uint64) * texts.GOLDEN + np.uint64(stream)))
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def log_rest(p: np.ndarray) -> np.ndarray:
    """log(1 - p), of a probability that may be rounded to 1."""
    with np.errstate(divide="ignore"):
        return np.log1p(-np.minimum(p, 1.0))


def truncated(location: np.ndarray, bound: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """Gumbel values at ``location`` that stay below ``bound``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        value = location - np.log(np.exp(np.minimum(location - bound, 700)) - np.log(uniform))
        return np.where(np.isneginf(location), NONE, np.minimum(value, bound))


FIRST = 2  # the stream of the values left on the first path


@dataclass
class Path:
    """A path per text: its edge at each character (-1 inside an edge) and, node by node, what is kept about it.

    ``ends`` borders the nodes of each text, ``before`` is the log probability up
    to a node, ``left`` the value left there, ``total`` the log probability per text.
    """

    edge_at: np.ndarray
    used: np.ndarray
    edge: np.ndarray
    text: np.ndarray
    ends: np.ndarray
    before: np.ndarray
    left: np.ndarray
    total: np.ndarray


class Sampler:
    """Draws the ``k`` best perturbed paths of each of some texts."""

    def __init__(self, pieces: Pieces, rows: list[str], seeds: np.ndarray, k: int):
        self.pieces, self.seeds, self.k = pieces, seeds, k
        parts = []
        for t in rows:
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            if len(c):
                c = np.where(c == SPACE, LITERAL, c)
                parts.append(np.concatenate([[SPACE], np.where(c == 32, SPACE, c)]))
            else:
                parts.append(c)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.text = np.repeat(np.arange(len(rows)), np.diff(self.offsets))
        self.place = np.arange(len(codes)) - self.offsets[:-1][self.text]
        self.size = len(codes)
        if self.size:
            begins = np.zeros(len(codes), bool)
            begins[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
            begins[1:] |= (codes[1:] == SPACE) & (codes[:-1] != SPACE)
            begins[1:] |= (codes[1:] == NEWLINE) | (codes[:-1] == NEWLINE)
            self.starts = np.flatnonzero(begins)
            self.lattice = Lattice(pieces, codes, self.starts)
            # Node of each character: the node of its unit's start and the steps since.
            unit_of = np.cumsum(begins) - 1
            self.node = self.lattice.node_of[self.lattice.begin[unit_of] + np.arange(len(codes)) - self.starts[unit_of]]
            self.ends = np.append(self.starts[1:], len(codes))[unit_of]

    def walk(self, edge_at: np.ndarray, at: np.ndarray, stream: int) -> None:
        """Draw edges from the characters ``at`` up to the ends of their units."""
        while len(at):
            edge = self.lattice.draw(self.node[at], uniforms(self.seeds[self.text[at]], self.place[at], stream))
            edge_at[at] = edge
            after = at + self.lattice.length[edge]
            at = after[after < self.ends[at]]

    def path(self, edge_at: np.ndarray, begin: np.ndarray, bound: np.ndarray, stream: int) -> "Path":
        """A path per text, with the value left at each of its nodes from ``begin`` on."""
        used = np.flatnonzero(edge_at >= 0)
        edge, text = edge_at[used], self.text[used]
        ends = np.searchsorted(used, self.offsets)
        log_p = self.lattice.log_p[edge]
        before = np.cumsum(log_p) - log_p
        counts = np.diff(ends)
        before -= np.repeat(before[ends[:-1][counts > 0]], counts[counts > 0])
        mine = slice(None) if stream == FIRST else np.flatnonzero(used >= begin[text])
        where, node = text[mine], self.node[used[mine]]
        several = self.lattice.first[node + 1] - self.lattice.first[node] > 1
        location = np.where(several, before[mine] + log_rest(self.lattice.p[edge[mine]]), NONE)
        left = np.full(len(used), NONE)
        left[mine] = truncated(location, bound[where], uniforms(self.seeds[where], self.place[used[mine]], stream))
        total = np.bincount(text, weights=log_p, minlength=len(bound))
        return Path(edge_at, used, edge, text, ends, before, left, total)

    def samples(self) -> list[dict]:
        """Per round: the texts that have a path left, its edges, log probability and perturbed value."""
        count = len(self.offsets) - 1
        found: list[dict] = []
        every = np.arange(count)
        value = -np.log(-np.log(uniforms(self.seeds, np.full(count, 1 << 40), 0)))
        if self.size == 0:
            return [{"texts": every, "path": None, "log_p": np.zeros(count), "value": value}]
        edges = np.full(self.size, -1, np.int64)
        self.walk(edges, self.starts, 1)
        paths = [self.path(edges, self.offsets[:-1], value, FIRST)]
        found.append({"texts": every, "path": paths[0], "log_p": paths[0].total, "value": value})
        used: dict[tuple, list[int]] = {}  # edges taken at a path's node
        for round_no in range(1, self.k + 1):
            best, path, at = np.full(count, NONE), np.zeros(count, np.int64), np.zeros(count, np.int64)
            for r, taken_path in enumerate(paths):
                held = np.flatnonzero(np.diff(taken_path.ends) > 0)
                top = np.maximum.reduceat(taken_path.left, taken_path.ends[:-1][held]) if len(held) else np.zeros(0)
                better = top > best[held]
                chosen = held[better]
                best[chosen], path[chosen] = top[better], r
            for r, taken_path in enumerate(paths):
                if ((path == r) & (best > NONE)).any():
                    hit = np.flatnonzero(taken_path.left == best[taken_path.text])
                    hit = hit[path[taken_path.text[hit]] == r]
                    at[taken_path.text[hit][::-1]] = taken_path.used[hit[::-1]]
            self.next_best = best
            chosen = np.flatnonzero(best > NONE)
            if round_no == self.k or len(chosen) == 0:
                break
            edges = np.full(self.size, -1, np.int64)
            uniform = uniforms(self.seeds[chosen], self.place[at[chosen]], 3 * round_no + 1)
            go_on = []
            for t, r, c, u in zip(chosen.tolist(), path[chosen].tolist(), at[chosen].tolist(), uniform.tolist()):
                low = int(self.offsets[t])
                edges[low:c] = paths[r].edge_at[low:c]
                taken = used.setdefault((t, r, c), [int(paths[r].edge_at[c])])
                node = int(self.node[c])
                options = [e for e in range(int(self.lattice.first[node]), int(self.lattice.first[node + 1])) if e not in taken]
                weights = np.cumsum(self.lattice.p[options])
                edge = options[min(int(np.searchsorted(weights, u * weights[-1])), len(options) - 1)]
                taken.append(edge)
                edges[c] = edge
                rest = len(options) - 1
                mass = float(sum(self.lattice.p[e] for e in options if e != edge))
                place = int(np.searchsorted(paths[r].used, c))
                location = paths[r].before[place] + np.log(mass) if rest and mass > 0 else NONE
                again = uniforms(self.seeds[t : t + 1], self.place[c : c + 1], 3 * round_no + 2)
                paths[r].left[place] = truncated(np.array([location]), best[t : t + 1], again)[0]
                after = c + int(self.lattice.length[edge])
                if after < self.ends[c]:
                    go_on.append(after)
            begin = np.where(best > NONE, at + 1, self.size)
            later = self.starts[self.starts >= begin[self.text[self.starts]]]
            self.walk(edges, np.concatenate([np.array(go_on, np.int64), later]), 3 * round_no + 3)
            paths.append(self.path(edges, begin, best, 1000 + round_no))
            found.append({"texts": chosen, "path": paths[-1], "log_p": paths[-1].total[chosen], "value": best[chosen]})
        return found

    def ids(self, path: "Path | None") -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a path of each text."""
        if path is None:
            return np.zeros_like(self.offsets), np.zeros(0, np.int64)
        ids = self.lattice.ids[path.edge]
        spelt = np.flatnonzero(ids < 0)
        counts = np.ones(len(ids), np.int64)
        spellings = [chr(-1 - int(i)).encode("utf-8", "surrogatepass") for i in ids[spelt].tolist()]
        counts[spelt] = [len(b) for b in spellings]
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.repeat(ids, counts)
        if len(spelt):
            places = np.repeat(ends[spelt] - np.concatenate([[0], np.cumsum(counts[spelt])])[:-1], counts[spelt])
            out[places + np.arange(len(places))] = self.pieces.byte_ids[np.frombuffer(b"".join(spellings), np.uint8)]
        return ends[path.ends], out


def sample_batches(model: str, k: int, alpha: float, seed: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model, alpha)
        for batch in texts.chunks(batches, "text", 2 << 20):
            rows = texts.strings(batch.column("text")).to_pylist()
            with np.errstate(over="ignore"):
                seeds = texts.mix(batch.column("seed").to_numpy().view(np.uint64) + np.uint64(seed) * texts.GOLDEN)
            sampler = Sampler(pieces, rows, seeds, k)
            rounds = sampler.samples()
            border = getattr(sampler, "next_best", np.full(len(rows), NONE))
            for number, x in enumerate(rounds):
                offsets, ids = sampler.ids(x["path"])
                chosen = x["texts"]
                good = pieces.spells(offsets, ids, rows)
                with np.errstate(divide="ignore"):
                    gap = x["log_p"] - border[chosen]
                    score = np.where(np.isposinf(gap), 0.0, np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700))))))
                plain = ids.astype("<u4")
                spans = [(int(offsets[t]), int(offsets[t + 1])) for t in chosen]
                columns = {
                    "key": batch.column("key").take(pa.array(chosen)),
                    "sample": pa.array(np.full(len(chosen), number + 1, np.int32)),
                    "n_pieces": pa.array([b - a for a, b in spans], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(plain[a:b].tobytes()) for a, b in spans], pa.int64()),
                    "log_prob": pa.array(x["log_p"]),
                    "perturbed": pa.array(x["value"]),
                    "log_inclusion": pa.array(score),
                    "round_trip": pa.array(good[chosen], pa.bool_()),
                }
                if with_ids:
                    columns["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def sampled_segmentations(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", k: int = 2, alpha: float = 1.0, seed: int = 0, with_ids: bool = False
) -> DataFrame:
    """Up to ``k`` distinct segmentations of every row: a row per sample, the best first.

    Columns: key, sample (from 1), n_pieces, ids_crc32 (little-endian unsigned
    32-bit ids), log_prob, perturbed (log_prob and Gumbel noise, falling from
    sample to sample), log_inclusion (log of the chance to be among the ``k``,
    given the value next to them), round_trip (whether the ids decode to the
    text), and ids if asked for. A text with fewer segmentations has fewer
    rows, all certain; a null or empty text has one, without pieces. The noise
    depends on ``seed`` and key only: rows with one key and text have the same
    samples, whatever their partition. ``model`` is a path on every executor.
    Other columns are not read.
    """
    fields = [
        T.StructField("key", docs.schema[key].dataType), T.StructField("sample", T.IntegerType()), T.StructField("n_pieces", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("log_prob", "perturbed", "log_inclusion")],
        T.StructField("round_trip", T.BooleanType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("seed"))
    return read.mapInArrow(sample_batches(model, k, alpha, seed, with_ids), T.StructType(fields)).withColumnRenamed("key", key)


def decode_batches(model: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for batch in batches:
            column = batch.column("ids")
            flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            counts = np.nan_to_num(np.asarray(pc.fill_null(pc.list_value_length(column), 0)))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            decoded = pa.array(pieces.decode(offsets, flat), pa.string(), mask=np.asarray(column.is_null()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), decoded], names=["key", "text"])

    return run


def decoded(rows: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of rows of ids; null ids give null, control ids nothing."""
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("text", T.StringType())])
    read = rows.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return read.mapInArrow(decode_batches(model), schema).withColumnsRenamed({"key": key})
