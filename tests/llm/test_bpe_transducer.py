"""Byte-pair encoding by windows against the library, and the lookahead against random merge lists."""

from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from drayage.llm import bpe_transducer as bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return bpe.Model.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def hard_texts():
    r = random.Random(1)
    parts = [*"aabcdeeé th' \n\t  .,!'srtvemdl019²٣", "　", "\x85", "\xa0", " ", "𝔘", "<|endoftext|>", "<|endof", "|>"]
    parts += ["՘", "࢏", "\x1c", "ing", "the", " the", "guarante", "\U00010940"]
    for _ in range(250):
        yield "".join(r.choice(parts) for _ in range(r.randint(0, 400)))
    for unit in ["x", "ab", "aaab", " ", "\n", " \n", "!", "=-", "1", "é", "guaranteeing", "﷽", " é", " ", "<|"]:
        for count in (1, 50, 9000):
            run = unit * count
            yield from (run, f"hi {run} there", f"{run}<|endoftext|>{unit}", f"{run}\n x")
    for _ in range(4):
        yield "".join(r.choice("abcdeéthin") for _ in range(r.randint(3000, 40000))) + r.choice(["", " x", "\n"])


@pytest.mark.parametrize("block", [1 << 18, 7000, 97])
def test_ids_and_text_are_those_of_the_library(model, library, block, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
    for text in hard_texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = np.concatenate(list(bpe.encoded(model, text))).tolist()
        assert got == want, (text[:60], len(text))
        decoder = bpe.Decoder(model)
        assert "".join(decoder.feed(got[i : i + 50]) for i in range(0, len(got), 50)) + decoder.finish() == text


def test_any_ids_are_decoded_as_by_the_library(model, library):
    r = random.Random(2)
    for _ in range(2000):
        ids = [r.randrange(50300) for _ in range(r.randint(0, 30))]
        decoder = bpe.Decoder(model)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def test_state_stays_small(model):
    encoder, most = bpe.Encoder(model), 0
    for part in ["ab" * 5000] * 40 + [" " * 9000] * 40 + ["9"] * 5000:
        encoder.feed(part)
        most = max(most, len(encoder.held) + len(encoder.window.data))
    assert most <= model.lookahead + 2 * bpe.WINDOW_BYTES + bpe.LONG_PIECE


def random_merges(r):
    """Merges of tokens made before, no token made twice."""
    made, merges = [b"a", b"b", b"c"][: r.randint(1, 3)], []
    for _ in range(r.randint(1, 12)):
        u, v = r.choice(made), r.choice(made)
        if u + v not in made and len(u + v) < 24:
            merges.append((u, v))
            made.append(u + v)
    return merges


def plain_merge(merges, data):
    tokens = [data[i : i + 1] for i in range(len(data))]
    for u, v in merges:
        out, i = [], 0
        while i < len(tokens):
            if tokens[i : i + 2] == [u, v]:
                out.append(u + v)
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
    return tokens


def test_lookahead_is_sufficient_for_any_merge_list():
    r = random.Random(3)
    for _ in range(1500):
        merges = random_merges(r)
        ahead = bpe.sufficient_lookahead(merges)
        for _ in range(12):
            data = bytes(r.choice(b"aabc") for _ in range(r.randint(1, 3 * ahead + 20)))
            tokens, start = plain_merge(merges, data), 0
            for token in tokens:
                assert plain_merge(merges, data[start : start + ahead])[0] == token or start + ahead > len(data)
                start += len(token)


def test_a_list_out_of_order_is_refused(tmp_path):
    import json

    spec = json.load(open(PATH))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="before it is made"):
        bpe.Model(str(tmp_path / "t.json"))


def test_tables(make, library):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "x" * 20_000), (4, "é <|endoftext|> \n\n z")]
    docs = make(rows, extra=True)
    got = bpe.encode(docs, PATH)
    want = sorted((repr(d), library.encode(t or "", add_special_tokens=False).ids) for d, t in rows)
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got.collect()) == want
    assert sorted((repr(r["doc_id"]), r["text"]) for r in bpe.decode(got, PATH).collect()) == sorted((repr(d), t or "") for d, t in rows)
    whole = bpe.round_trip(docs, PATH).collect()
    plain = sorted(
        (repr(d), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for d, t in rows for ids in [library.encode(t or "", add_special_tokens=False).ids]
    )
    assert sorted((repr(r[0]), *r[1:]) for r in whole) == plain
    assert bpe.round_trip(make([]), PATH).count() == 0


def test_query(spark, folder, library):
    from drayage.llm.queries import load_all

    got = {r["doc_id"]: r for r in load_all()["op13_bpe_transducer"].run(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert (got[d["doc_id"]]["n_tokens"], got[d["doc_id"]]["ids_sha256"]) == (len(ids), digest)
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
