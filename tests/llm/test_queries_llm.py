"""The registered queries of this subpackage, and the pipeline stage by stage."""

from __future__ import annotations

import brute
import corpus_pipeline
import pytest
from oracle import connect, differences
from test_dedup import lines_left, spans_plainly
from test_exact_spans import PASSAGE, covered_plainly

import __spark_entry__ as entry_points
from drayage.llm import exact_spans
from drayage.llm.queries import load_all
from drayage.session import materialise

QUERIES = load_all()


def test_all_are_registered():
    names = [n for n in entry_points.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_points.queries()


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_agrees_with_sql(spark, folder, name):
    assert differences(QUERIES[name].run(spark, folder), connect(folder), QUERIES[name].sql) == []


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_has_rows(spark, folder, name):
    assert not QUERIES[name].run(spark, folder).isEmpty()


def words_left(texts, covered):
    """Per document the words outside its repeated paragraphs and the ``covered`` ones."""
    spans = {}
    for d, start, length, _ in spans_plainly(list(texts.items())):
        spans.setdefault(d, []).append((start, start + length))
    out = {}
    for d, text in texts.items():
        found = enumerate(brute.WORD.finditer(text))
        out[d] = [m[0] for i, m in found if i not in covered[d] and not any(a <= m.start() < b for a, b in spans.get(d, []))]
    return out


def in_order(words, text):
    """Whether ``text`` has these words, in this order."""
    rest = iter(brute.WORD.findall(text))
    return all(w in rest for w in words)


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, folder), "test")
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        if name == "quality rules":
            assert all(after[d] == before[d] for d in after)
            failing = {d for d, t in before.items() for s in [brute.text_statistics(t)]
                       if s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]}
            assert not failing & set(after)
        elif name == "line dedup":
            assert after == {d: t for d, _, _, t in lines_left(list(before.items()), 10)}
        elif name == "n-gram Jaccard join":
            kept = {d for d, _, c in brute.components_of(list(before.items())) if d == c}
            assert after == {d: before[d] for d in kept}
        else:
            assert set(after) == set(before)
            most, least = (words_left(before, covered_plainly(list(before.items()), run)) for run in (PASSAGE, exact_spans.RUN))
            # Every word outside what must go stays but for what may go; bands may miss a paragraph at the threshold.
            right = [in_order(least[d], after[d]) and in_order(brute.WORD.findall(after[d]), " ".join(most[d])) for d in before]
            assert sum(right) >= 0.98 * len(before)
        docs, before = out, after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(before)
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_near_duplicates_go_by_row_where_ids_repeat(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(reversed(words))
    rows = [(1, text), (1, text), (2, near), (2, other), (None, text), (None, "only here"), (None, "only here"), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.STAGES[2][1](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, text), (2, other), (None, "only here"), (3, None)], key=repr)
    plain = docs.where("doc_id = 2 AND text LIKE 'w0%'").unionAll(docs.where("doc_id = 1").limit(1))
    assert [r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, plain, "").collect()] == [1]
    assert corpus_pipeline.STAGES[2][1](spark, docs.limit(0), "").count() == 0
