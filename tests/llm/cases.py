"""Texts that are hard for one operator or another."""

from __future__ import annotations

import random

rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(900)]


def words(count: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(count)]


def sentences(count: int, seed: int) -> str:
    """Sentences of 3 to 24 words, some ending a line."""
    r = random.Random(seed)
    out = []
    for _ in range(count):
        s = " ".join(r.choice(WORDS) for _ in range(r.randint(3, 24))).capitalize() + "."
        out.append(s + ("\n" if r.random() < 0.3 else " "))
    return "".join(out).strip()


def edited(text: str, changes: int, seed: int) -> str:
    r, w = random.Random(seed), text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


ODD = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "One",
    "one two three four",
    "ONE  two\tthree\x0bfour",
    "one two three four five",
    "  nobreak   space",
    "É é É é É é É é",
    "a b c " * 40,
    "same line\nsame line\n  SAME line \nother",
    "# $ % & | < > *" * 3,
    "\U0001f600 " * 12,
    "x" * 5000,
    "word " * 30_000,
]


def corpus() -> list[tuple]:
    """(doc_id, text): odd texts, copies, near copies of many degrees, shared lines, repeated rows, null ids."""
    out = [(i, t) for i, t in enumerate(ODD)]
    base = [sentences(14, s) for s in range(30)]
    out += [(100 + i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):
        for k in range(5):
            out.append((200 + 10 * i + k, edited(t, k * 2, 77 * i + k)))
    for k in range(40):  # one large group, each with its own change
        out.append((400 + k, edited(base[20], 3, 1000 + k)))
    for k in range(15):
        out.append((500 + k, "A line that many hold\n" + sentences(5, 5000 + k) + "\nAnother shared line here  "))
    out += [(600 + k, base[21]) for k in range(25)]
    out += [(100, base[0]), (3, ODD[3]), (None, base[0]), (None, "only here without an id at all, yes"), (None, None)]
    return out
