"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

How far a merge can reach back from the end of a text is bounded by the merge
list itself. From that bound, the sufficient lookahead, follows when a token is
stable: as soon as so many bytes are known from its start on, whatever comes
later. So a text of any length is encoded from a window of fixed size, and a
token leaves the window once it is stable. Decoding keeps the bytes of at most
one unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm import texts

# How byte-level vocabularies cut a text before merging.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# Characters after a piece that may change where it ends, a contraction's at most.
AFTER_PIECE = 4

# The classes of the pattern, each with a character that stands for it.
CLASSES = {"letter": "é", "number": "٣", "space": " ", "other": "€"}
RUNS = {
    "letter": regex.compile(r"\p{L}*"),
    "number": regex.compile(r"\p{N}*"),
    "space": regex.compile(r"\s*"),
    "other": regex.compile(r"[^\s\p{L}\p{N}]*"),
}

BLOCK_CHARS = 1 << 18  # of a text, taken at once
LONG_PIECE = 1 << 12  # characters from which a piece is encoded by a window and not remembered
WINDOW_BYTES = 1 << 13  # beyond the lookahead
KNOWN_PIECES, KNOWN_IDS = 800_000, 8_000_000  # what a worker remembers


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes from a token's start on that settle the token.

    Encode a text and a longer one side by side, merge by merge. Both agree up
    to a common border, at first the end of the shorter one. A merge ``u + v``
    moves the border back by ``u``, if one of the two has ``v`` at the border.
    What begins at the border after that is ``u`` or a token that starts with
    ``u + v``; so a later merge can move it on only if its right part starts,
    down the left sides of the merges that made it, with that ``u``. The longest
    such chain bounds how far the border moves; the token before it is settled.
    """
    reach: dict[bytes, int] = {}  # by left part: the longest chain whose last merge has it
    lefts: dict[bytes, set[bytes]] = {}
    for u, v in merges:
        starts, todo = {v}, [v]
        while todo:
            for left in lefts.get(todo.pop(), ()):
                if left not in starts:
                    starts.add(left)
                    todo.append(left)
        reach[u] = max(reach.get(u, 0), len(u) + max(reach.get(s, 0) for s in starts))
        lefts.setdefault(u + v, set()).add(u)
    return max(reach.values(), default=0) + 1


class Model:
    """A byte-level vocabulary with its merges, read from a tokenizer file.

    Refused are files that cut texts in another way, and merge lists that use a
    token before it is made: for them the lookahead does not hold.
    """

    _loaded: dict[str, "Model"] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        flags = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if (
            model["type"] != "BPE" or any(model.get(f) for f in flags) or spec.get("normalizer")
            or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True)
            or any(t[f] for t in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip"))
        ):
            raise ValueError(f"{path} is not a plain byte-level merge list")
        chars = byte_characters()

        def as_bytes(token: str) -> bytes:
            return bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()

        vocabulary = model["vocab"]
        self.bytes_of = {i: as_bytes(t) for t, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update((i, as_bytes(t)) for t, i in self.special.items())
        self.byte_ids = [0] * 256
        for char, byte in chars.items():
            self.byte_ids[byte] = vocabulary[char]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank_of: dict[tuple[int, int], int] = {}
        self.whole_of: list[int] = []  # by rank
        made = set(self.byte_ids)
        for rank, (u, v) in enumerate(pairs):
            left, right, whole = vocabulary[u], vocabulary[v], vocabulary[u + v]
            if left not in made or right not in made:
                raise ValueError(f"merge {rank} of {path} uses a token before it is made")
            made.add(whole)
            self.rank_of.setdefault((left, right), rank)
            self.whole_of.append(whole)
        self.lookahead = sufficient_lookahead([(as_bytes(u), as_bytes(v)) for u, v in pairs])
        self.hold = AFTER_PIECE + max(map(len, self.special), default=0)
        some = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("|".join(map(regex.escape, some))) if some else None
        self.pieces = Pieces(self)
        self.classes = Classes(path)

    @classmethod
    def load(cls, path: str) -> "Model":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merged(self, data: bytes) -> list[int]:
        """The ids of ``data``: the first merge of the list that applies, leftmost first, until none does."""
        ids = [self.byte_ids[b] for b in data]
        return self._merged_short(ids) if len(ids) <= 40 else self._merged_long(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        rank_of, whole_of, none = self.rank_of.get, self.whole_of, len(self.whole_of)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = whole_of[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        count, rank_of = len(ids), self.rank_of.get
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = [(r, i, *p) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank_of(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else count
            if j >= count or ids[j] != right:
                continue  # one of the two is part of another token by now
            ids[i], ids[j] = self.whole_of[rank], -1
            k, h = after[j], before[i]
            after[i] = k
            if k < count:
                before[k] = i
                if (r := rank_of((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if h >= 0 and (r := rank_of((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]


class Window:
    """The merges of one piece of any length, in memory of fixed size."""

    def __init__(self, model: Model):
        self.model, self.data = model, b""

    def feed(self, data: bytes) -> list[int]:
        """Take bytes, give the ids that are stable by now."""
        out: list[int] = []
        lookahead = self.model.lookahead
        for low in range(0, len(data), WINDOW_BYTES):
            self.data += data[low : low + WINDOW_BYTES]
            if len(self.data) < lookahead + WINDOW_BYTES:
                continue
            start = 0
            for token in self.model.merged(self.data):
                if start + lookahead > len(self.data):
                    break
                out.append(token)
                start += len(self.model.bytes_of[token])
            self.data = self.data[start:]
        return out

    def finish(self) -> list[int]:
        data, self.data = self.data, b""
        return self.model.merged(data)


class Pieces(dict):
    """The number of each piece seen lately; its ids lie in one array."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new_ids: list[int] = []
        self.new_counts: list[int] = []
        self.ids, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.filled = 0  # pieces whose ids are in the arrays

    def __missing__(self, piece: str) -> int:
        if len(piece) > LONG_PIECE:
            window = Window(self.model)
            found = window.feed(piece.encode()) + window.finish()
        else:
            found = self.model.merged(piece.encode())
        self.new_ids += found
        self.new_counts.append(len(found))
        self[piece] = at = self.filled + len(self.new_counts) - 1
        return at

    def learn(self) -> None:
        """Move what is new to the arrays, which double as they grow."""
        base, count = int(self.starts[self.filled]), len(self.new_counts)
        if base + len(self.new_ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(self.new_ids)), np.uint32)])
        if self.filled + count >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), count), np.int64)])
        self.ids[base : base + len(self.new_ids)] = self.new_ids
        self.starts[self.filled + 1 : self.filled + count + 1] = base + np.cumsum(self.new_counts)
        self.filled += count
        self.new_ids, self.new_counts = [], []

    def encode(self, pieces: list[str]) -> np.ndarray:
        """The ids of all pieces, one after another."""
        if len(self) > KNOWN_PIECES or self.starts[self.filled] > KNOWN_IDS:
            self.forget()
        at = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.new_counts:
            self.learn()
        low = self.starts[at]
        counts = self.starts[at + 1] - low
        ends = np.cumsum(counts)
        return self.ids[np.repeat(low - ends + counts, counts) + np.arange(ends[-1])]


class Classes:
    """Which class the tokenizer puts a character in, where the pattern's engine takes another.

    The two know different versions of Unicode. Characters are looked up once,
    as they come.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.known = set(map(chr, range(128)))
        self.other: dict[int, str] = {}

    def learn(self, found: set[str]) -> None:
        new = sorted(found - self.known)
        self.known.update(new)
        for c in new:
            shape = f"a{c}1{c}!{c}!"
            mine = [m.span() for m in PIECE.finditer(shape)]
            if mine != (spans := [s for _, s in self.cut(shape)]):
                borders = {low for low, _ in spans}
                name = "letter" if 1 not in borders else "number" if 3 not in borders else "space" if 5 in borders else "other"
                self.other[ord(c)] = CLASSES[name]

    def seen(self, text: str) -> str:
        """``text`` as the pattern has to see it, character for character."""
        if not text.isascii():
            self.learn(set(text))
            if self.other:
                return text.translate(self.other)
        return text


class Encoder:
    """Ids of one text that comes in parts, in memory of fixed size."""

    def __init__(self, model: Model):
        self.model = model
        self.held = ""
        self.run: str | None = None  # the class of a long piece that is not at its end
        self.window = Window(model)

    def feed(self, part: str) -> np.ndarray:
        """Take a part, give the ids that are stable by now."""
        return self._encode(self.held + part, False)

    def finish(self) -> np.ndarray:
        return self._encode(self.held, True)

    def _encode(self, text: str, last: bool) -> np.ndarray:
        self.held = ""
        out: list[np.ndarray] = []
        at = 0
        for m in self.model.special_at.finditer(text) if self.model.special_at else ():
            self._segment(text[at : m.start()], True, out)
            out.append(np.array([self.model.special[m[0]]], np.uint32))
            at = m.end()
        self._segment(text[at:] if at else text, last, out)
        return np.concatenate(out) if len(out) != 1 else out[0]

    def _segment(self, text: str, last: bool, out: list[np.ndarray]) -> None:
        """Encode ``text`` up to where it is settled; what is not is held back."""
        seen = self.model.classes.seen(text)
        stop = len(text) if last else max(0, len(text) - self.model.hold)
        at = 0
        if self.run:
            end = RUNS[self.run].match(seen).end()
            if not last and end > stop:
                self._long(text[:stop], False, out)
                self.held = text[stop:]
                return
            if self.run == "space" and 0 < end < len(text):
                end -= 1  # the last blank goes with what follows
            self._long(text[:end], True, out)
            at, self.run = end, None
        if last:
            if seen is text:
                pieces = PIECE.findall(text, at)
            else:
                pieces = [text[m.start() : m.end()] for m in PIECE.finditer(seen, at)]
            out.append(self.model.pieces.encode(pieces) if pieces else np.zeros(0, np.uint32))
            return
        pieces = []
        for m in PIECE.finditer(seen, at):
            if m.end() > stop:
                break
            pieces.append(text[at : m.end()])
            at = m.end()
        out.append(self.model.pieces.encode(pieces) if pieces else np.zeros(0, np.uint32))
        if len(text) - at > LONG_PIECE + self.model.hold:
            first = seen[at + 1] if seen[at] == " " and not seen[at + 1].isspace() else seen[at]
            self.run = next(name for name, run in RUNS.items() if run.match(first).end())
            self._long(text[at:stop], False, out)
            at = stop
        self.held = text[at:]

    def _long(self, text: str, done: bool, out: list[np.ndarray]) -> None:
        found = self.window.feed(text.encode())
        out.append(np.array(found + self.window.finish() if done else found, np.uint32))


class Decoder:
    """Text of ids that come in parts; bytes that are no character become U+FFFD, unknown ids nothing.

    The state is the bytes of at most one unfinished character.
    """

    def __init__(self, model: Model):
        self.bytes_of = model.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        of = self.bytes_of
        try:
            data = b"".join(map(of.__getitem__, ids))
        except KeyError:
            data = b"".join(of.get(i, b"") for i in ids)
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encoded(model: Model, text: str) -> Iterator[np.ndarray]:
    """The ids of one text, block by block."""
    encoder = Encoder(model)
    if len(text) <= BLOCK_CHARS:
        encoder.held = text
    else:
        for low in range(0, len(text), BLOCK_CHARS):
            yield encoder.feed(text[low : low + BLOCK_CHARS])
    yield encoder.finish()


def id_batches(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(path)
        for batch in texts.chunks(batches, "text"):
            found = []
            for text in batch.column("text").to_pylist():
                found.append(np.concatenate(list(encoded(model, text or ""))))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            ids = texts.lists(offsets, pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids], names=["key", "ids"])

    return run


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``, an array of integers, of every row of ``docs``; no shuffle.

    ``tokenizer`` is the path of a byte-level tokenizer file, at the same place
    on every executor. Strings of its special tokens become their ids, as the
    library does by default. Null and empty texts have no ids, repeated rows
    are encoded alike, an empty table gives no rows, other columns are not read.
    """
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return read.mapInArrow(id_batches(tokenizer), schema).withColumnRenamed("key", key)


def text_batches(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(path)
        for batch in batches:
            found = []
            for ids in batch.column("ids"):
                decoder = Decoder(model)
                found.append(decoder.feed(() if not ids.is_valid else ids.values.to_numpy(zero_copy_only=False).tolist()) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.string())], names=["key", "text"])

    return run


def decode(encoded_docs: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of rows with ids; null or no ids are the empty text, unknown ids are left out."""
    read = encoded_docs.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    schema = T.StructType([T.StructField("key", encoded_docs.schema[key].dataType), T.StructField("text", T.StringType())])
    return read.mapInArrow(text_batches(tokenizer), schema).withColumnRenamed("key", key)


def digest_batches(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(path)
        for batch in texts.chunks(batches, "text"):
            counts, ids_of, texts_of = [], [], []
            for value in batch.column("text"):
                of_ids, of_text, decoder, count = hashlib.sha256(), hashlib.sha256(), Decoder(model), 0
                for ids in encoded(model, value.as_py() or ""):
                    count += len(ids)
                    of_ids.update(ids.astype("<u4", copy=False))
                    of_text.update(decoder.feed(ids.tolist()).encode())
                of_text.update(decoder.finish().encode())
                counts.append(count)
                ids_of.append(of_ids.hexdigest())
                texts_of.append(of_text.hexdigest())
            columns = [batch.column("key"), pa.array(counts, pa.int64()), pa.array(ids_of), pa.array(texts_of)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens`` and SHA-256 of the ids and of the text decoded from them, block by block.

    Ids are hashed as little-endian unsigned 32-bit integers, texts in UTF-8.
    The rules of :func:`encode` hold.
    """
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(n, t) for n, t in names.items()]])
    return read.mapInArrow(digest_batches(tokenizer), schema).withColumnRenamed("key", key)
