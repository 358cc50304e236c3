"""Repairs against a plain search over whole audits, whatever the size of the segments."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from drayage.llm import conversation_repair as repair
from drayage.llm.conversation_repair_query import damaged

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"
NEXT = {"": "user", "system": "user", "user": "assistant", "assistant": "user"}


def plain_repair(rows):
    """(cost, audit, rows) of (role, text, fault) rows, from the last one back."""
    best = {
        "": (0, "", []),
        "system": (6, "II", [("user", ""), ("assistant", "")]),
        "user": (3, "I", [("assistant", "")]),
        "assistant": (0, "", []),
    }
    for role, text, fault in reversed(rows):
        direct = {}
        for state in best:
            ways = [(best[state][0] + 4, "D" + best[state][1], best[state][2])]
            if fault not in ("blank", "duplicate"):
                extra, to = 3 * (fault == "truncated"), NEXT[state]
                ways.append((best[to][0] + 3 + extra, "R" + best[to][1], [(to, text), *best[to][2]]))
                kept = {"s": "system" if state == "" else None, "u": "user", "a": "assistant"}.get(role[:1])
                if kept and (kept == to or kept == "system"):
                    ways.append((best[kept][0] + extra, "K" + best[kept][1], [(role, text), *best[kept][2]]))
            direct[state] = min(ways)
        new = {}
        for state in best:
            ways, at, added = [], state, []
            for inserts in range(3):
                cost, audit, rest = direct[at]
                ways.append((cost + 3 * inserts, "I" * inserts + audit, [*added, *rest]))
                at = NEXT[at]
                added = [*added, (at, "")]
            new[state] = min(ways)
        best = new
    return best[""]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_report(rows, ids):
    """Reports of (conv, turn, role, text) rows; rows of one turn must be equal."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv in ids:
        mine = sorted(held[conv], key=lambda r: (r[0] is not None, r[0] or 0))
        seen, judged = set(), []
        for _, role, text in mine:
            core = text.strip(BLANKS)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            judged.append((role, text, fault))
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        cost, audit, left = plain_repair(judged)
        out.append(
            (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
             *[sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")],
             sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
             sha("\n".join(f"{r}:{t}" for r, t in left)))
        )
    return sorted(out, key=repr)


def some_rows(seed, sizes):
    r = random.Random(seed)
    rows = []
    for conv, size in enumerate(sizes):
        role = r.choice(["system", "user"])
        for turn in range(size):
            odd = r.random() < 0.15
            text = r.choice(["", " \n", None, "cut off", "again.", "again."]) if odd else f"text {turn}{r.choice('.!?')}" + r.choice(["", " \n"])
            shown = r.choice(["system", "user", "assistant", "tool", "", None, "student"]) if r.random() < 0.2 else role
            rows += [(conv, turn + 2 * (turn > 4), shown, text)] * (2 if r.random() < 0.1 else 1)
            role = "assistant" if role == "user" else "user"
    return rows


@pytest.mark.parametrize("segment, fan", [(1, 2), (3, 2), (7, 3), (repair.SEGMENT, repair.FAN)])
def test_reports(spark, segment, fan):
    rows = some_rows(segment, [0, 1, 2, 3, 5, 8, 13, 40, 64, 3, 6])
    rows += [(None, 1, "user", "Without an id."), (None, None, "assistant", "Without a turn."), (77, None, None, None)]
    ids = [*range(11), None, 77, 5000]
    docs = spark.createDataFrame([(*r, 1, "x", 2, "k") for r in rows], SCHEMA + ", pos long, codes string, seg int, kind string")
    known = spark.createDataFrame([(i, "x") for i in ids + ids], "conv_id long, grp string")
    got = repair.repair(docs.repartition(3), known, segment=segment, fan=fan)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_report(rows, ids)


def test_halves_meet_as_a_plain_search_says():
    r = random.Random(5)
    for _ in range(3000):
        kinds = [(r.choice("suax"), r.choice(["", "", "blank", "truncated"])) for _ in range(r.randint(0, 14))]
        codes = "".join(chr(repair.BASE + "suax".index(i) + 4 * repair.FAULTS.index(f)) for i, f in kinds)
        cost, audit, _ = plain_repair([(i, "t", f) for i, f in kinds])
        assert repair.solved(codes, repair.START, None, True) == (cost, audit)
        cut = r.randint(1, 5)
        steps = repair.Steps([repair.as_step(repair.summary(repair.Rows(codes[k : k + cut]))) for k in range(0, len(codes), cut)])
        states = repair.crossings(steps, repair.START, repair.best_exit(steps))
        parts = [
            repair.solved(codes[k * cut : (k + 1) * cut], states[k], states[k + 1], k == len(steps) - 1) for k in range(len(steps))
        ]
        if parts:
            assert (sum(c for c, _ in parts), "".join(a for _, a in parts)) == (cost, audit)


def test_rows_of_one_turn_have_an_order_and_long_conversations_pass(spark):
    rows = [(1, 0, "user", f"Text {k}.") for k in range(20)] + [(2, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(9000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    first = sorted(map(tuple, repair.repair(docs.repartition(5)).collect()))
    assert first == sorted(map(tuple, repair.repair(docs.orderBy("text").repartition(2)).collect()))
    assert first[1][1:8] == (0, 0, 0, 0, 0, 0, "K" * 9000)
    assert first[1][8] == sha("\n".join(f"{r}:{t}" for _, _, r, t in rows[20:]))


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again?"), (1, 2, "assistant", ""), (2, 0, "assistant", "Yes.")]
    got = repair.repaired_rows(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == [
        (1, 0, "user", "Hello.", "K"), (1, 1, "assistant", "Again?", "R"),
        (2, 0, "user", "", "I"), (2, 1, "assistant", "Yes.", "K"),
    ]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).count() == 0 and repair.repaired_rows(none).count() == 0
    (row,) = repair.repair(none, spark.createDataFrame([(4,)], "conv_id long")).collect()
    assert tuple(row) == (4, 0, 0, 0, 0, 0, 0, "", sha(""))


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in [(0, "system", "A. b!"), (None, None, None), (3, "assistant", "C?")]]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = damaged(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
