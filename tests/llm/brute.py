"""Plain Python versions that the operators are tested against."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall(lowered(text or ""))
    if 0 < len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def similar(a, b, percent: int = 75) -> bool:
    common = len(a & b)
    return bool(a) and bool(b) and 100 * common >= percent * (len(a) + len(b) - common)


def clusters(sets: list, names: list, linked) -> list:
    """The smallest name in each item's component; pairs come from an inverted index."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    places, first = defaultdict(list), {}
    for i, s in enumerate(sets):
        if not s:
            continue
        if s in first:  # equal sets
            parent[root(i)] = root(first[s])
            continue
        first[s] = i
        for other in {j for x in s for j in places[x]}:
            if linked(s, sets[other]):
                parent[root(i)] = root(other)
        for x in s:
            places[x].append(i)
    low = {}
    for i, name in enumerate(names):
        if name is not None:
            low[root(i)] = min(low.get(root(i), name), name)
    return [low.get(root(i)) if s else names[i] for i, s in enumerate(sets)]


def components_of(rows: list[tuple], width: int = 5, percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [shingle_set(t, width) for _, t in rows]
    names = clusters(sets, [d for d, _ in rows], lambda a, b: similar(a, b, percent))
    return [(d, len(s), c) for (d, _), s, c in zip(rows, sets, names)]


def text_statistics(text: str | None) -> dict[str, int]:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }
