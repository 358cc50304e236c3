"""Token counts and sampled segmentations against brute force."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import brute
import cases
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from drayage.llm import piece_sampling as S
from drayage.llm import texts
from drayage.llm import token_counts as C

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def longest_match(word: bytes, tokens: set) -> int:
    rest, n, longest = b" " + word, 0, max(map(len, tokens))
    while rest:
        size = next((k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in tokens), 0)
        if not size:
            return 1
        rest, n = rest[size:], n + 1
    return n


def test_small_vocabularies():
    rng = random.Random(2)
    for _ in range(200):
        tokens = {bytes(rng.choice(b" abc") for _ in range(1)) for _ in range(3)}
        tokens |= {(b" " if rng.random() < 0.4 else b"") + bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(12)}
        automaton = C.Automaton(tokens)
        for word in map(bytes, itertools.chain.from_iterable(itertools.product(b"abc", repeat=n) for n in range(1, 6))):
            assert automaton.count(word) == longest_match(word, tokens), (tokens, word)


@pytest.mark.parametrize("extra", [False, True])
def test_token_counts(make, extra):
    rows = [r for r in cases.corpus() if r[1] is None or len(r[1]) < 50_000] + [(900, "ab" * 20_000)]
    tokens = set(C.read_ranks(VOCABULARY))
    want = [(d, len(w), sum(longest_match(x.encode(), tokens) for x in w)) for d, t in rows for w in [brute.WORD.findall(t or "")]]
    got = map(tuple, C.token_counts(make(rows, extra), VOCABULARY).collect())
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert C.token_counts(make([]), VOCABULARY).count() == 0


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def all_paths(text: str, model) -> dict[tuple, float]:
    """Every segmentation of a short text and its probability."""
    size = model.get_piece_size()
    weight = {
        model.id_to_piece(i): -math.log(min(-model.get_score(i), size) + 2)
        for i in range(size)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    }
    found: dict[tuple, float] = {}

    def walk(rest: str, ids: tuple, total: float) -> None:
        if not rest:
            found[ids] = total
            return
        for n in range(1, len(rest) + 1):
            if rest[:n] in weight:
                walk(rest[n:], (*ids, model.piece_to_id(rest[:n])), total + weight[rest[:n]])
        if rest[0] not in weight:
            raw = rest[0].encode()
            walk(rest[1:], (*ids, *(model.piece_to_id(f"<0x{b:02X}>") for b in raw)), total - len(raw) * math.log(size + 2))

    walk("▁" + text.replace(" ", "▁"), (), 0.0)
    norm = math.log(sum(map(math.exp, found.values())))
    return {k: v - norm for k, v in found.items()}


def sampled(rows, k, seeds=None):
    pieces = S.Pieces.load(MODEL)
    seeds = texts.mix(np.arange(len(rows), dtype=np.uint64) * np.uint64(77) + np.uint64(1)) if seeds is None else seeds
    sampler = S.Sampler(pieces, rows, seeds, k)
    out = [[] for _ in rows]
    for x in sampler.samples():
        offsets, ids = sampler.ids(x["path"])
        for n, t in enumerate(x["texts"].tolist()):
            out[t].append((tuple(ids[offsets[t] : offsets[t + 1]].tolist()), float(x["log_p"][n]), float(x["value"][n])))
    return out


@pytest.mark.parametrize("text", ["the", "on it", " a  b", "né\nin", "\U0001f600x"])
def test_samples_are_paths_with_their_probabilities(model, text):
    paths = all_paths(text, model)
    for found in sampled([text] * 40, 4):
        assert len({ids for ids, *_ in found}) == len(found) == min(4, len(paths))
        assert all(abs(p - paths[ids]) < 1e-6 for ids, p, _ in found)
        assert all(a > b for a, b in zip([v for *_, v in found], [v for *_, v in found][1:]))


def test_few_segmentations_are_all_found(model):
    paths = all_paths("an", model)
    assert {frozenset(ids for ids, *_ in found) for found in sampled(["an"] * 5, 50)} == {frozenset(paths)}


def test_samples_follow_the_probabilities_without_replacement(model):
    paths = all_paths("ning", model)
    rows = 20_000
    found = sampled(["ning"] * rows, 2)
    p = {k: math.exp(v) for k, v in paths.items()}
    first = Counter(x[0][0] for x in found)
    second = Counter(x[1][0] for x in found)
    top = sorted(p, key=p.get, reverse=True)[:6]
    for ids in top:
        assert abs(first[ids] / rows - p[ids]) < 4 * math.sqrt(p[ids] / rows) + 1e-3
        want = sum(p[o] * p[ids] / (1 - p[o]) for o in p if o != ids)
        assert abs(second[ids] / rows - want) < 4 * math.sqrt(want / rows) + 1e-3


@pytest.mark.parametrize("extra", [False, True])
def test_round_trip_and_the_same_samples_in_any_partition(make, extra):
    rows = [r for r in cases.corpus() if r[1] is None or len(r[1]) < 20_000] + [(901, "▁ literal ▁▁ x"), (902, " \t\r\n ")]
    got = S.sampled_segmentations(make(rows, extra), MODEL, k=3, with_ids=True)
    table = got.collect()
    assert all(r["round_trip"] for r in table)
    assert all(r["log_inclusion"] <= 0 for r in table)
    again = S.sampled_segmentations(make(rows, extra, partitions=7), MODEL, k=3).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["sample"], r["ids_crc32"])
    assert sorted(map(key, table)) == sorted(map(key, again))
    back = S.decoded(got.where("sample = 1"), MODEL).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((d, t or "") for d, t in rows)
    assert S.sampled_segmentations(make([]), MODEL).count() == 0


def test_ids_decode_as_the_library_does(model):
    pieces = S.Pieces.load(MODEL)
    for text in ("Hello world", " two  spaces", "né\n\U0001f600 x"):
        ids = model.encode(text)
        assert pieces.decode(np.array([0, len(ids)]), np.array(ids)) == [text]
