"""Quality rules: statistics against brute force, rules on held-out rows."""

from __future__ import annotations

import random

import brute
import cases
import pytest

from drayage.llm import quality_rules as Q
from pyspark.sql import functions as F


@pytest.mark.parametrize("extra", [False, True])
def test_statistics(make, extra):
    rows = cases.corpus()
    got = Q.judged(make(rows, extra), []).select("doc_id", *Q.BASE, "base_failed", "kept").collect()
    want = []
    for doc, text in rows:
        s = brute.text_statistics(text)
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        want.append((doc, *(s[k] for k in Q.BASE), failed, not failed))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def labelled(seed: int, count: int):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(count):
        words = cases.words(r.randint(60, 200), seed * 1000 + i)
        bad = i % 4 == 0
        if bad:
            words = [w + " #" for w in words] if i % 8 else [w.upper() + "!" for w in words]
        elif i % 3 == 0:
            words[5] = "#1"
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_rules_hold_on_other_rows(spark, make):
    docs, labels = labelled(1, 400)
    rules = Q.learn_rules(make(docs), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert 1 <= len(rules) <= 4 and all(len(r) <= 3 for r in rules)
    docs, labels = labelled(2, 200)
    verdicts = {r["doc_id"]: r["kept"] for r in Q.judged(make(docs), rules).collect()}
    assert all(verdicts[d] for d, q in labels if q == 1)
    assert sum(not verdicts[d] for d, q in labels if q == 0) >= 48
    kept = Q.keep_good(make(docs, extra=True), rules)
    assert kept.columns == make(docs, extra=True).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, v in verdicts.items() if v)


def test_rules_without_usable_labels(spark, make):
    docs, _ = labelled(3, 20)
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1), (9999, 0)], "doc_id long, quality int")
    good = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    for labels in (none, odd, good):
        assert Q.learn_rules(make(docs), labels) == []
    assert Q.learn_rules(make([]), good) == []


def test_the_sample_of_labels_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert Q.labelled_sample(labels, "doc_id", "quality", 10**6).count() == 5000
    assert 350 < Q.labelled_sample(labels, "doc_id", "quality", 500).count() < 650


def test_no_python_in_the_plan(make):
    from frames import plan

    text = plan(Q.judged(make(cases.corpus()), [(Q.Condition("symbols", True, 9),)]))
    assert "Python" not in text and "Arrow" not in text
