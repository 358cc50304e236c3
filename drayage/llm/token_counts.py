"""Token counts by greedy longest match, with a linear automaton.

The vocabulary is a trie with failure links. A node that cannot go on hands
over to the node of what is left after the tokens that must be popped; how many
those are is computed beforehand. So each byte is read once, and no piece is
ever built.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm import texts

START = b" "  # stands before a word; no word holds it
KNOWN_WORDS = 400_000


class Automaton:
    """Counts the longest-match tokens of words.

    ``tokens`` are byte strings. Those that begin with a space match at the
    start of a word, the others after it. A word that cannot be cut into tokens
    is one unknown token.
    """

    def __init__(self, tokens: Iterable[bytes]):
        go: dict[int, int] = {}
        is_token, depth, parent, by = [False], [0], [0], [0]
        for token in tokens:
            node = 0
            for byte in token:
                step = node << 8 | byte
                if step not in go:
                    go[step] = len(depth)
                    is_token.append(False)
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    by.append(byte)
                node = go[step]
            is_token[node] = node != 0
        # fail: the node after the tokens are popped, -1 where none can be; popped: how many those are.
        fail, popped = [-1] * len(depth), [0] * len(depth)
        for node in sorted(range(1, len(depth)), key=depth.__getitem__):
            if is_token[node]:
                fail[node], popped[node] = 0, 1
                continue
            at, count = fail[parent[node]], popped[parent[node]]
            while at >= 0 and (at << 8 | by[node]) not in go:
                count += popped[at]
                at = fail[at]
            if at >= 0:
                fail[node], popped[node] = go[at << 8 | by[node]], count
        final = [0] * len(depth)  # tokens of what a node still holds, -1 if it cannot be cut
        for node in sorted(range(1, len(depth)), key=depth.__getitem__):
            rest = final[fail[node]] if fail[node] >= 0 else -1
            final[node] = popped[node] + rest if rest >= 0 else -1
        self.go, self.fail, self.popped, self.final = go, fail, popped, final

    def count(self, word: bytes) -> int:
        """Tokens of one word without the space before it."""
        go, fail, popped = self.go, self.fail, self.popped
        node = n = 0
        for byte in START + word:
            step = go.get(node << 8 | byte)
            while step is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                step = go.get(byte | node << 8)
            node = step
        return n + self.final[node] if self.final[node] >= 0 else 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Counter:
    """An automaton and the words it has counted lately, one per worker and vocabulary."""

    _loaded: dict[str, "Counter"] = {}

    def __init__(self, path: str):
        self.automaton = Automaton(read_ranks(path))
        self.known: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> "Counter":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def counts(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known, count = self.known, self.automaton.count
        out = np.empty(len(coded.dictionary), np.int64)
        for i, word in enumerate(coded.dictionary.to_pylist()):
            n = known.get(word)
            if n is None:
                n = known[word] = count(word.encode())
            out[i] = n
        return out[coded.indices.to_numpy()]


def count_batches(text: str, path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.load(path)
        for batch in texts.chunks(batches, text):
            offsets, words = texts.word_list(texts.strings(batch.column(text)), lower=False)
            total = np.concatenate([[0], np.cumsum(counter.counts(words))]) if len(words) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets]))],
                names=["key", "n_words", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_tokens`` of every row of ``docs``, no shuffle.

    ``vocabulary`` is the path of a file of base64 tokens, at the same place on
    every executor. Words are parted by white space and matched with a space
    before them. Null and empty texts have no words; repeated rows are counted
    alike; other columns are not read.
    """
    schema = T.StructType(
        [T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(count_batches("text", vocabulary), schema).withColumnRenamed("key", key)
