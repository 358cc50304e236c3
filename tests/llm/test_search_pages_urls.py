"""Top-k search, page text and URL filters against brute force."""

from __future__ import annotations

import datetime
import html
import math
import random
import time

import numpy as np
import pytest

from drayage.llm import html_text as H
from drayage.llm import topk_search as K
from drayage.llm import url_filter as U
from pyspark.sql import functions as F


def scored(rows, k, modulus):
    """(query_id, rank, vec_id, score) by all pairs."""
    valid = [
        (i, [math.floor(64 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
        and sum((abs(64.0 * x) + 1) ** 2 for x in v) < 2**62
    ]
    out = []
    for q, a in valid:
        if q % modulus == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in valid if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [7, 64, 32_768])
def test_top_k(spark, monkeypatch, block_rows):
    monkeypatch.setattr(K, "GROUP_QUERIES", 5)
    monkeypatch.setattr(K.build_index, "__defaults__", (block_rows,))
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(40)]  # ties over a border
    rows += [(400, None), (401, [float("nan")] * 8), (402, [None] + [0.1] * 7), (403, [float("inf")] * 8), (None, [0.1] * 8)]
    rows += [(404, []), (405, [0.5, -0.5]), (406, [100.0] * 8), (407, [-100.0] * 8), (408, [1e30] * 8), (440, [-1e17] + [0.0] * 7),
             (409, [2.0**23, -(2.0**22)]), (460, [-(2.0**23), 2.0**22]), (420, [0.0] * 8), (500, rows[7][1]), (500, rows[8][1])]
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, "x") for i, v in rows], "vec_id long, embedding array<double>, row int, block int, id int, vector int, body string")
    got = sorted(tuple(x) for x in K.top_k(df, F.col("vec_id") % 20 == 0, k=9).collect())
    assert got == scored(rows, 9, 20)


def test_top_k_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(0, [1.0])], [(1, [1.0]), (2, [2.0])], [(0, [1.0]), (1, [1.0])]):
        got = [tuple(x) for x in K.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0, k=3).collect()]
        assert got == scored(rows, 3, 20)


def test_signed_digits():
    values = np.arange(-200, 201)
    at, exponents, signs = K.signed_digits(values)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, at, signs << exponents)
    assert (total == values).all()
    places = set(zip(at.tolist(), exponents.tolist()))
    assert not any((a, e + 1) in places for a, e in places)


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 30))] for _ in range(2))
        found = H.common_lines(a, b)
        rest = iter(b)
        assert found == sorted(set(found)) and len(found) == lcs(a, b) and all(a[i] in rest for i in found)
    long = list(range(3000)) + [1] * 3000
    assert len(H.common_lines(long, long[1:] + [5])) == 5999


SHELL = """<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>if (a < b) "</p>"</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<!-- <p>gone</p> --><div class="ad-box">Buy {n}</div>{main}<aside>Side {n}</aside>
<section id="comments"><article class="comment">A reader says {n}</article></section>
<form><label>Mail</label><input name=x><button>Go</button></form><footer>&copy; {n}</footer></body></html>"""


def page(n, body, tag="article"):
    return SHELL.format(n=n, main=f"<{tag}>{body}</{tag}>")


def texts_of(spark, rows, ranges=None):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, key int")
    out = H.extract_text(df, ranges=ranges).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in out) and len(out) == len(rows)
    return {r["page_id"]: r["text"] for r in out}


def test_article_text(spark):
    body = "<h1>Title &amp; more</h1><p>One<b>two</b> three<br>four\n  five<p>Six &lt;7&gt; &eacute;&#233;&#xe9;</p><ul><li>a<li>b</ul>"
    want = "Title & more Onetwo three four five Six <7> ééé a b"
    rows = [(i, f"http://a.example/{i}", page(i, body)) for i in range(3)]
    rows += [(10, "http://a.example/x", page(10, body.replace("Six", "<span class='share'>Share</span>Six"))), (11, "http://b.example/", page(1, body)[:-60])]
    rows += [(20, None, None), (21, None, ""), (22, "no url", "plain < text & more"), (23, "", "<p>unclosed <b"), (24, "http://c.example/", "<!-- open")]
    rows += [(25, "http://d.example/", page(3, "<div>bare text</div>"))]
    got = texts_of(spark, rows)
    assert [got[i] for i in (0, 1, 2, 10, 11)] == [want] * 5
    assert [got[i] for i in (20, 21, 24)] == ["", "", ""]
    assert got[22] == "plain < text & more" and got[25] == "bare text"


def test_shared_lines_of_pages_without_an_article(spark):
    """What the neighbours share goes, what is a page's own stays."""
    def plain(n):
        return f"<html><body><div>Welcome to the site</div><div>Read more below</div><div>Own text {n}.</div><p>More of {n}</p><div>All contact data</div></body></html>"

    rows = [(i, f"http://a.example/news/{i}", plain(i)) for i in range(6)] + [(9, "http://lone.example/", plain(9))]
    rows += [(7, "http://copy.example/1", plain(1)), (8, "http://copy.example/2", plain(1))]
    got = texts_of(spark, rows, ranges=1)
    whole = "Welcome to the site Read more below Own text {0}. More of {0} All contact data"
    assert [got[i] for i in range(6)] == [f"Own text {i}. More of {i}" for i in range(6)]
    assert got[9] == whole.format(9) and got[7] == got[8] == whole.format(1)


def test_the_given_pages(spark, folder):
    import re

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())


def test_hostile_pages_take_linear_time():
    for text in ("<" * 200_000, "<a " * 60_000, "<a b='" * 40_000, "<div>" * 50_000, "<p class=" + '"x' * 50_000, "<script>" * 30_000, "&" * 100_000,
                 "<!" * 100_000, "<div>" * 30_000 + "</section>" * 30_000, "<b>" * 50_000 + "</b>" * 50_000, "<b>" * 50_000 + "<p></p>" * 50_000, "<p><div>" + "<b>" * 50_000 + "<li>" * 30_000):
        start = time.time()
        H.page_lines(text)
        assert time.time() - start < 5


DAY = datetime.datetime(2024, 1, 1)


def active_by_scan(captures, events):
    out = []
    for key, url, at in captures:
        host = ""
        if url and "://" in url:
            host = url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
        path = "/".join([host, *[s for s in (url or "").split("://")[-1].split("?")[0].split("#")[0].split("/")[1:] if s]])
        last = {}
        for list_, effect, kind, pattern, action, when in sorted((e for e in events if None not in e), key=lambda e: (e[5], e[4])):
            match = host == pattern if kind == "host" else (host == pattern or host.endswith("." + pattern)) if kind == "domain" else (
                path == pattern or path.startswith(pattern + "/"))
            if host and at is not None and when <= at and match:
                last[list_, effect, kind, pattern] = action
        on = [k for k, v in last.items() if v == "add"]
        blocks = [k for k in on if k[1] == "block"]
        allows = len(on) - len(blocks)
        names = [" ".join((k[0], k[2], k[3])) for k in blocks]
        out.append((key, len(blocks), allows, min(names) if names else None, bool(blocks) and not allows))
    return sorted(out, key=repr)


def test_url_filters(spark):
    r = random.Random(6)
    hosts = ["a.x.example", "b.x.example", "x.example", "y.example", "deep.a.x.example"]
    urls = [f"HTTP://{'u@' * (i % 2)}{h}{':80' * (i % 3 == 0)}/{'/'.join(r.choice('pqr') for _ in range(i % 4))}?x=/p" for i, h in enumerate(hosts * 6)]
    captures = [(i, u, DAY + datetime.timedelta(hours=r.randint(0, 400))) for i, u in enumerate(urls)]
    captures += [(50, None, DAY), (51, "", DAY), (52, "no host", DAY), (53, urls[0], None), captures[0], (None, urls[1], DAY), (54, "http://x.example/" + "p/" * 3000, DAY)]
    events = []
    for _ in range(120):
        kind = r.choice(["host", "domain", "prefix"])
        pattern = r.choice(hosts) + ("/p" * r.randint(0, 2) if kind == "prefix" else "")
        when = DAY + datetime.timedelta(hours=r.randint(0, 300) // 10 * 10)
        events.append((r.choice(["l1", "l2"]), r.choice(["block", "block", "allow"]), kind, pattern, r.choice(["add", "remove"]), when))
    events += [events[0], (None, "block", "host", "y.example", "add", DAY), ("l1", "block", "host", None, "add", DAY), ("l1", "block", "host", "y.example", "add", None)]
    schema = "list string, effect string, kind string, pattern string, action string, at timestamp_ntz"
    df = spark.createDataFrame([(*c, 1, "k") for c in captures], "page_id long, url string, fetched_at timestamp_ntz, row int, kind string")
    for some in (events, []):
        got = U.judge(df, U.validity(spark.createDataFrame(some, schema))).select("page_id", "n_block", "n_allow", "first_block", "blocked")
        assert sorted(map(tuple, got.collect()), key=repr) == active_by_scan(captures, some)
    assert U.judge(df.limit(0), U.validity(spark.createDataFrame(events, schema))).count() == 0
