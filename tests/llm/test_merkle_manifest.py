"""The manifest against plain trees, whatever the height of the blocks."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from drayage.llm import merkle_manifest as merkle

FIELDS = ["doc_id", "source", "text"]
SCHEMA = "doc_id long, source string, text string, grp int, digest string, pos string, total int, root string, _part int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """Root and, per leaf, its (left, right) siblings from the bottom up."""
    paths, spans, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        up, up_spans = [], []
        for low in range(0, len(nodes), 3):
            run = nodes[low : low + 3]
            for k in range(len(run)):
                for i in spans[low + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            up_spans.append([i for s in spans[low : low + 3] for i in s])
        nodes, spans = up, up_spans
    return nodes[0], paths


def plain_proofs(rows, changed):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], plain_leaf(r), plain_leaf((r[0], r[1], changed(r[2])))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for name in names:
        members = sorted(groups[name], key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        trees.append((members, *plain_tree([m[1] for m in members])))
    root, above = plain_tree([t[1] for t in trees])
    out = []
    for (members, subroot, paths), top in zip(trees, above):
        for (doc, leaf, claim), path in zip(members, paths):
            for left, right in path + top:
                claim = sha(left + claim + right)
            out.append((doc, leaf, subroot, root, sha("".join(a + b for a, b in path + top)), claim, claim == root))
    return sorted(out, key=repr)


def changed(text):
    return text and text.replace("\n", "")


def some_rows(seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["big"] * 4 + ["b", "é", "", "Z", None]), r.choice(["a\nb", "", None, f"text {i}", "ü\n\n"])) for i in range(150)]
    return rows + [rows[3], rows[3], (7, "big", "other"), (None, "big", "no id"), (None, None, None), (5000, "alone", "x" * 50_000)]


@pytest.mark.parametrize("height", [1, 2, merkle.BLOCK_HEIGHT])
def test_proofs(spark, height):
    rows = some_rows(height)
    docs = spark.createDataFrame([(*r, 1, "d", "p", 2, "r", 3) for r in rows], SCHEMA).repartition(3)
    found = merkle.leaf_of([F.col("doc_id"), F.col("source"), F.replace("text", F.lit("\n"), F.lit(""))])
    manifest = merkle.build_manifest(docs, FIELDS, "doc_id", "source", {"found": found}, height)
    want = plain_proofs(rows, changed)
    assert sorted(map(tuple, manifest.proofs("doc_id", "found").collect()), key=repr) == want
    assert [r["root"] for r in manifest.root.collect()] == [want[0][3]]
    assert all(r["verified"] for r in manifest.proofs("doc_id").collect())
    assert max(r["count"] for r in manifest.trees[0].collect()) <= 3**height


def test_no_rows_and_one_row(spark):
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")
    assert merkle.build_manifest(docs.limit(0), FIELDS, "doc_id", "source").proofs("doc_id").count() == 0
    (row,) = merkle.build_manifest(docs, FIELDS, "doc_id", "source").proofs("doc_id").collect()
    leaf = plain_leaf((1, None, None))
    assert tuple(row) == (1, leaf, leaf, leaf, sha(""), leaf, True)


@pytest.mark.parametrize("levels", range(1, 8))
def test_addresses(levels):
    places = merkle.addresses(levels)
    assert sorted(p for level in places for p in level) == list(range(merkle.nodes_in(levels)))
    if levels > 1:  # a subtree of the lower half lies in one stretch
        upper = levels // 2
        lower = levels - upper
        for k in range(3**upper):
            mine = [p for level in range(lower) for p in places[level][k * 3 ** (lower - 1 - level) : (k + 1) * 3 ** (lower - 1 - level)]]
            assert max(mine) - min(mine) + 1 == len(mine) == merkle.nodes_in(lower)


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 80, 81])
def test_one_block(count):
    leaves = [sha(str(i)) for i in range(count)]
    block = merkle.Block.build(leaves, merkle.levels_for(count))
    again = merkle.Block.read(block.levels, count, block.bytes())
    root, paths = plain_tree(leaves)
    assert again.stored == block.stored and block.root == root
    assert [again.path(i) for i in range(count)] == paths
    assert all(merkle.folded(leaf, p) == root for leaf, p in zip(leaves, paths))
    assert np.array_equal(merkle.address(2, 1, np.arange(3)), [1, 2, 3])
