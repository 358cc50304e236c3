"""Line dedup, n-gram join and substring dedup against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import brute
import cases
import numpy as np
import pyarrow as pa
import pytest

from drayage.llm import line_dedup, linking, ngram_join, passages, second_pass, texts
from drayage.llm.components import components
from drayage.llm.linking import cluster


def key_of(line: str) -> str:
    return brute.lowered(line.strip(" \t\n\x0b\x0c\r"))


def lines_left(rows, min_docs):
    held = defaultdict(set)
    for doc, text in rows:
        for key in {key_of(x) for x in (text or "").split("\n")}:
            held[key].add(doc)
    holders = {key: len(docs) for key, docs in held.items()}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key_of(x) and holders[key_of(x)] >= min_docs)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_rows_of_one_document_count_once(make):
    rows = [(1, "often\nshared")] * 12 + [(2, "shared\nelse")] + [(10 + i, f"in ten\nown {i}") for i in range(9)] + [(None, "in ten")] * 2
    got = line_dedup.dedup_lines(make(rows)).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(lines_left(rows, 10), key=repr)
    assert {r["n_dropped"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert {r["n_dropped"] for r in got if r["doc_id"] not in (1, 2)} == {1}
    each = line_dedup.dedup_lines(make(rows), key=None)
    assert {r["n_dropped"] for r in each.where("doc_id = 1").collect()} == {2}


@pytest.mark.parametrize("extra", [False, True])
def test_line_dedup(make, extra):
    rows = cases.corpus()
    got = line_dedup.dedup_lines(make(rows, extra), min_docs=10).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(lines_left(rows, 10), key=repr)


def test_line_dedup_of_nothing(make):
    assert line_dedup.dedup_lines(make([])).count() == 0


def test_line_dedup_keeps_a_line_below_the_threshold(make):
    rows = [(i, "shared") for i in range(9)]
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(make(rows)).collect()} == {0}
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(make(rows + [(9, " SHARED")])).collect()} == {1}


@pytest.mark.parametrize("extra", [False, True])
def test_ngram_join(make, extra):
    rows = cases.corpus()
    got = ngram_join.similar_documents(make(rows, extra)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.components_of(rows), key=repr)


def test_ngram_join_of_the_given_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute.components_of([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, ngram_join.similar_documents(docs).collect())) == sorted(want)


def test_ngram_join_of_nothing(make):
    assert ngram_join.similar_documents(make([])).count() == 0
    assert ngram_join.similar_documents(make([(1, None)])).collect() == [(1, 0, 1)]


@pytest.mark.parametrize("frequent", [((2, 2),), ((2, 3),), ((2, 2), (5, 3)), ()])
def test_similar_sets_share_a_signature(frequent):
    """Whatever counts as frequent, no similar pair goes without a common key."""
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 90)
        x = set(rng.sample(range(1, 400), n))
        y = set(rng.sample(sorted(x), max(1, n - rng.randint(0, n // 5)))) | set(rng.sample(range(1, 400), rng.randint(0, n // 7)))
        if not brute.similar(x, y):
            continue
        count = {h: 2 + h % 7 for h in x | y}
        shared = x & y | {h for h in x | y if h % 3 == 0}  # the others have some of these too
        keys = []
        for s in (x, y):
            h = np.array(sorted(s & shared), np.int64)
            keys.append({k for k, _ in ngram_join.signatures(len(s), h, np.array([count[v] for v in h.tolist()]), 75, frequent)})
        assert keys[0] & keys[1]


def test_combinations_stay_few():
    for n in (40, 300, 3000):
        h = np.arange(1, n + 1, dtype=np.int64) * 7919
        for least in (64, 4096):
            keys = list(ngram_join.signatures(n, h, np.full(n, least), 75))
            assert 0 < len(keys) < 12 * n


def test_components_and_clusters(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    sets = [frozenset(e) for e in edges]
    want = {}
    for s, low in zip(sets, brute.clusters(sets, [min(e) for e in edges], lambda a, b: bool(a & b))):
        for x in s:
            want[x] = min(want.get(x, low), low)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


def test_bit_maps_never_hide_a_link():
    rng = random.Random(4)
    for bits in (64, 256):
        sets = [set(rng.sample(range(1, 60), rng.randint(1, 40))) for _ in range(120)]
        hashed = [np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in sets]
        batch = pa.RecordBatch.from_pydict({
            "id": list(range(120)), "bits": [bits] * 120, "members": pa.array([h.view(np.int64) for h in hashed], pa.list_(pa.int64()))})
        drawn = next(linking.sketch_batches(iter([batch]))).to_pylist()
        rows = [(r["id"], r["id"], len(sets[r["id"]]), r["m"], r["sketch"], r["few"]) for r in drawn]
        outside = linking.Outside(rows, 75)
        for r in drawn:
            found = set(np.flatnonzero(outside.may_link(len(sets[r["id"]]), r["m"], r["sketch"])).tolist())
            assert {i for i in range(120) if i != r["id"] and brute.similar(sets[i], sets[r["id"]])} <= found


def test_pairs_of_small_sets_join_what_they_must_and_no_more():
    """Groups of small sets that are all alike, with large ones between: links of whole groups from few pairs."""
    rng = random.Random(6)
    sets = []
    for group in range(6):
        base = rng.sample(range(100 * group, 100 * group + 100), 40 if group == 0 else 16)
        sets += [frozenset(base) - {base[i % 3]} for i in range(40)]
    hashed = [np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in sets]
    members = pa.array([np.sort(h.view(np.int64)) for h in hashed], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_pydict({"id": list(range(240)), "bits": [256] * 240, "members": members})
    drawn = next(linking.sketch_batches(iter([batch]))).to_pylist()
    rows = [(r["id"], r["id"], len(sets[r["id"]]), r["m"], r["sketch"], r["few"]) for r in drawn]
    sent = [{"key": 1, "part": 0, "side": side, "id": r[0], "component": r[1], "n": r[2], "m": r[3], "sketch": r[4], "few": r[5]} for side in (0, 1) for r in rows]
    out = [p for b in linking.candidate_batches(75)(iter([pa.RecordBatch.from_pylist(sent)])) for p in zip(*b.to_pydict().values())]
    small = [(a, b) for a, b in out if a >= 40]
    assert len(small) == 5 * 39 and all(brute.similar(sets[a], sets[b]) for a, b in small)
    assert {(a, b) for a in range(40) for b in range(a) if brute.similar(sets[a], sets[b])} <= {(max(p), min(p)) for p in out if max(p) < 40}
    parent = list(range(240))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in out:
        parent[root(a)] = root(b)
    assert all((root(a) == root(b)) == (a // 40 == b // 40) for a in range(240) for b in range(240))


def test_cluster_finds_links_between_members_that_no_leader_has(spark):
    """A chain under one key: only neighbours are similar."""
    members = {i: list(range(i * 2, i * 2 + 20)) for i in range(40)}
    sets = spark.createDataFrame([(i, 20, m) for i, m in members.items()], "id long, n long, members array<long>")
    index = spark.createDataFrame([(1, i, 20, 20, 64) for i in members], "key long, id long, n long, m long, bits long")
    got = {r["id"]: r["component"] for r in cluster(index, sets, 75).collect()}
    assert got == {i: 0 for i in range(1, 40)}


def cut_plainly(text: str, min_words: int):
    """Paragraphs (start, end, words) of a text, by a regular expression per step."""
    out, start, count, end = [], None, 0, 0
    matches = list(brute.WORD.finditer(text))
    for i, m in enumerate(matches):
        start = m.start() if start is None else start
        count, end = count + 1, m.end()
        final = i + 1 == len(matches)
        gap = "" if final else text[m.end() : matches[i + 1].start()]
        if final or ((m[0][-1] in ".!?" or "\n" in gap) and count >= min_words):
            out.append((start, end, count))
            start, count = None, 0
    return out


def test_paragraphs():
    rows = [t for _, t in cases.corpus() if t is None or len(t) < 50_000]
    p = passages.Paragraphs(pa.array(rows, pa.string()).slice(1), 10, 5)
    got = sorted(zip(p.text.tolist(), p.begin.tolist(), p.end.tolist(), p.n_words.tolist()))
    want = sorted((i, *x) for i, t in enumerate(rows[1:]) for x in cut_plainly(t or "", 10))
    assert got == want
    by_hash = defaultdict(set)
    for i, (t, b, e) in enumerate(zip(p.text.tolist(), p.begin.tolist(), p.end.tolist())):
        by_hash[int(p.h1[i]), int(p.h2[i])].add(tuple(brute.WORD.findall(brute.lowered(rows[1 + t][b:e]))))
    assert all(len(x) == 1 for x in by_hash.values())
    assert len(by_hash) == len(set().union(*by_hash.values()))


def spans_plainly(rows, min_words=10, min_span=25):
    """Spans of what repeats, all pairs of paragraphs compared."""
    found = []
    for doc, text in set(rows):
        for number, (b, e, n) in enumerate(cut_plainly(text or "", min_words)):
            if n >= min_words:
                found.append((doc, text, number, b, e, n))
    found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
    sets = [brute.shingle_set(x[1][x[3] : x[4]]) for x in found]
    classes = brute.clusters(sets, list(range(len(sets))), brute.similar)
    runs = defaultdict(list)
    for i, x in enumerate(found):
        if classes[i] != i:
            last = runs[x[0], x[1]]
            if last and last[-1][-1][2] == x[2] - 1:
                last[-1].append(x)
            else:
                last.append([x])
    return sorted(
        ((doc, r[0][3], r[-1][4] - r[0][3], sum(x[5] for x in r)) for (doc, _), rs in runs.items() for r in rs
         if sum(x[5] for x in r) >= min_span), key=repr)


@pytest.fixture(scope="module")
def with_passages():
    rows = [r for r in cases.corpus() if r[0] is None or r[0] < 400]
    for k in range(12):  # passages amid other text, not at a line's start
        shared = cases.sentences(6, 9000 + k % 3)
        rows.append((700 + k, " ".join(cases.words(20, 800 + k)) + " " + shared + " " + cases.sentences(5, 900 + k)))
    return rows


def test_substring_dedup(make, with_passages):
    got = passages.repeated_spans(make(with_passages, extra=True))
    got = sorted(map(tuple, got.select("key", "start", "length", "n_words").collect()), key=repr)
    want = spans_plainly(with_passages)
    missing, wrong = set(want) - set(got), set(got) - set(want)
    assert len(missing) <= 0.02 * len(want) and len(wrong) <= 0.02 * len(want)  # bands may miss a pair at the threshold
    assert {d for d, *_ in got if d and d >= 700} == set(range(703, 712))


def test_cutting_spans(make, with_passages):
    docs = make(with_passages, extra=True)
    spans = passages.repeated_spans(docs)
    cuts = defaultdict(list)
    for r in spans.collect():
        cuts[r["key"], r["a"]].append((r["start"], r["length"]))
    out = passages.without_spans(docs, spans)
    assert out.columns == docs.columns and out.count() == docs.count()
    after = defaultdict(list)
    for r in out.collect():
        after[r["doc_id"]].append(r["text"])
    for r in passages.identified(docs.select("doc_id", "text"), "doc_id", "text").collect():
        text = r["text"]
        for start, length in sorted(cuts[r["doc_id"], r["a"]], reverse=True):
            text = text[:start] + text[start + length :]
        assert text in after[r["doc_id"]]
    again = passages.repeated_spans(out)
    assert again.count() < 0.2 * spans.count() + 2


def test_clean_texts_are_left_alone(make):
    rows = [(i, cases.sentences(10, 30_000 + i) + "\nAll rights reserved by nobody at all.") for i in range(20)]
    assert passages.repeated_spans(make(rows)).count() == 0
    assert passages.repeated_spans(make([])).count() == 0


def test_bands_reach_their_recall():
    assert 1 - (1 - 0.75**2) ** passages.tune_bands(75, 0.98) >= 0.98


def test_words_are_those_of_the_pattern():
    rows = ["", " a  b\x0b\x0cC\r\n", " x y", "Éa É\x1cb", "x" * 10, None]
    offsets, words = texts.word_list(texts.strings(pa.array(rows)), lower=True)
    got = [words[a:b].to_pylist() for a, b in zip(offsets, offsets[1:])]
    assert got == [brute.WORD.findall(brute.lowered(t or "")) for t in rows]


@pytest.mark.parametrize("size", [1, 2, 3, 100])
@pytest.mark.parametrize("cap", [2, 3, 50])
def test_runs_of_sorted_values(size, cap):
    values = np.array([1, 2, 2, 3, 3, 3, 3, 9, 10, 10])
    rows = np.arange(10)
    shared, counted, found, numbers = second_pass.Shared(), second_pass.Counted(cap), [], {}
    for at in range(0, 10, size):
        h, r = shared.add(values[at : at + size], rows[at : at + size])
        found += list(zip(h.tolist(), r.tolist()))
        counted.add(values[at : at + size], rows[at : at + size])
    counted.end()
    for h, r, c in zip(*counted.taken()):
        numbers[int(h), int(r)] = int(c)
    want = {(h, i): min(cap, values.tolist().count(h)) for i, h in enumerate(values.tolist()) if values.tolist().count(h) > 1}
    assert sorted(found) == sorted(want) and numbers == want
