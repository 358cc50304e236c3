"""Passages that repeat word for word, at any place in any text."""

from __future__ import annotations

import random
from collections import defaultdict

import brute
import cases
import numpy as np
import pyarrow as pa

from drayage.llm import exact_spans, passages, texts

PASSAGE = 51


def unlike(count: int, seed: int) -> list[str]:
    """Words without marks that no other text has in this order."""
    r = random.Random(seed)
    return [r.choice(cases.WORDS) for _ in range(count)]


def planted():
    """Passages of 51 words at every offset from 0 to 39 of texts without marks and of texts with short sentences."""
    rows = [(k, " ".join(unlike(30 + k, k) + unlike(PASSAGE, 500 + k) + unlike(25, 600 + k))) for k in range(40)]
    for k in range(40):
        host = unlike(k, 1000 + k), unlike(40 - k, 2000 + k)
        rows.append((100 + k, " ".join(host[0] + unlike(PASSAGE, 500 + k) + host[1])))
    for k in range(40):
        shared = cases.sentences(30, 3000 + k)
        for copy in range(2):
            before, after = (cases.sentences(3, s + 40 * copy + k).split() for s in (4000, 5000))
            body = shared.split()[k : k + PASSAGE]
            rows.append((200 + 100 * copy + k, " ".join(before[: 5 + k * (1 + copy) % 20] + body + after)))
    return rows


def removed(rows, got):
    """Per document the words that lie in a span."""
    out = defaultdict(set)
    for r in got:
        text = rows[r["key"]]
        places = [i for i, m in enumerate(brute.WORD.finditer(text)) if r["start"] <= m.start() and m.end() <= r["start"] + r["length"]]
        assert len(places) == r["n_words"] and places[0] == r["word"]
        out[r["key"]].update(places)
    return out


def test_passages_are_found_at_any_offset_and_without_marks(make):
    rows = planted()
    bodies = dict(rows)
    got = passages.all_spans(make(rows)).collect()
    found = removed(bodies, got)
    for k in range(40):
        assert found[100 + k] == set(range(k, k + PASSAGE)), k
        want = cases.sentences(30, 3000 + k).split()[k : k + PASSAGE]
        words = bodies[300 + k].split()
        low = next(i for i in range(len(words)) if words[i : i + PASSAGE] == want)
        assert set(range(low, low + PASSAGE)) <= found[300 + k] and len(found[300 + k]) <= PASSAGE + 2
    assert not any(found[k] for k in [*range(40), *range(200, 240)])


def covered_plainly(rows, least):
    """Words in a run of ``least`` words that stands earlier too, all runs listed."""
    seen, out = set(), defaultdict(set)
    for doc, text in sorted(set(rows)):
        w = tuple(brute.WORD.findall(brute.lowered(text)))
        mine = [w[i : i + least] for i in range(len(w) - least + 1)]
        for i, x in enumerate(mine):
            seen.update(mine[i - least : i - least + 1] if i >= least else [])
            if x in seen:
                out[doc].update(range(i, i + least))
        seen.update(mine)
    return out


def test_spans_against_all_runs(make):
    """Longer matches with a later document, pieces of several documents, copies, repeated rows."""
    r = random.Random(11)
    source = [unlike(400, 7000 + i) for i in range(4)]
    rows = []
    for doc in range(60):
        parts = unlike(r.randrange(40), 8000 + doc)
        for _ in range(r.randint(1, 4)):
            s, low = r.choice(source), r.randrange(300)
            parts += s[low : low + r.randint(20, 200)] + unlike(r.randrange(30), r.randrange(10**9))
        rows.append((doc, "é " + "  ".join(parts)))
    rows += rows[:5]
    got = removed(dict(rows), exact_spans.exact_repeats(make(rows)).collect())
    sure, may = covered_plainly(rows, PASSAGE), covered_plainly(rows, exact_spans.RUN)
    for doc, _ in rows:
        assert sure[doc] <= got[doc] <= may[doc], doc


def test_hosts_and_self_repeating_texts_keep_their_words(make):
    rows = [(1, "ha " * 500), (2, " ".join(unlike(300, 1))), (3, None), (4, ""), (5, " ".join(unlike(60, 2)) + " x" * 70000)]
    got = passages.all_spans(make(rows)).collect()
    assert {(r["key"], r["word"], r["n_words"]) for r in got} == {(1, 26, 474), (5, 86, 69974)}


def test_anchors_do_not_hang_on_neighbours():
    r = np.random.default_rng(3)
    words = [r.integers(1, 1 << 63, n).astype(np.uint64) for n in (200, 30, 51, 0, 400)]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    at, hashes = exact_spans.anchors(offsets, np.concatenate(words))
    alone = []
    for low, w in zip(offsets, words):
        found, h = exact_spans.anchors(np.array([0, len(w)]), w)
        alone += zip((found + low).tolist(), h.tolist())
    assert list(zip(at.tolist(), hashes.tolist())) == alone


def test_words_of_a_slice():
    rows = [f"Ünlike {cases.WORDS[i % 900]} É{i}" * (1 + i % 5) for i in range(3000)]
    _, words = texts.word_list(texts.strings(pa.array(rows).slice(1001, 700)), lower=True)
    assert words.to_pylist() == [w for t in rows[1001:1701] for w in brute.WORD.findall(brute.lowered(t))]
