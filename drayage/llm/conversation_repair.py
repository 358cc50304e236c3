"""Repair of the turn structure of conversations by cheapest edits.

The rows of a conversation shall read ``s?(ua)+``, or nothing is left of them.
Between two rows a repair is in one of four states: nothing yet, after the
system row, after a user row, after an assistant row. A row's edits, with the
insertions before it, lead from state to state and are written as one word,
``I*`` and then ``K``, ``R`` or ``D``: no word begins another, so audits of the
same rows compare word by word. Forward vectors hold, per state, the least cost
and the rank of its least audit, backward vectors the least cost to the end.
They meet in the middle, the least audit among the cheapest crossings is taken,
and both halves are solved alike. So a conversation takes linear space.

Long conversations are cut into segments that are solved in different tasks.
A segment is summed up by its costs and ranks from every state to every
state; these compose, and the same crossing of vectors, over segments in place
of rows, tells in which states a repair enters and leaves each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drayage.llm.line_dedup import BLANKS
from drayage.llm.numbering import numbered, same
from drayage.operators.ordering import in_order
from drayage.session import materialise

# Costs of the edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by a user or an assistant row
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}  # insertions after the last row
NEVER = 1 << 40

# A row's code: its role's initial and its fault.
INITIALS = "sua"
OTHER = 3
FAULTS = ("", "blank", "duplicate", "truncated")
CODES = len(FAULTS) * 4
BASE = ord("a")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

SEGMENT = 4096  # rows
FAN = 256  # segments, or groups of them, composed at once

# A step leads over a row or a segment: per exit state, (entry, cost, rank of the audit among those of one entry).
Step = tuple[tuple[tuple[int, int, int], ...], ...]
# Per state the least cost and the rank of the least audit; None where the state cannot be reached.
Vector = tuple[tuple[int, int] | None, ...]


# ---- one row


@cache
def words(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest, then least word from entry to exit over a row."""
    initial, fault = code % 4, FAULTS[code // 4]
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for entry in STATES:
        state = entry
        for inserts in range(3):  # more only go round
            cost, word = inserts * INSERT, "I" * inserts
            found = [(state, cost + DELETE, word + "D")]
            if fault not in ("blank", "duplicate"):
                stays = cost + (TRUNCATED if fault == "truncated" else 0)
                found.append((NEXT[state], stays + REROLE, word + "R"))
                role = (SYSTEM, USER, ASSISTANT, None)[initial]
                if role == NEXT[state] or (role == SYSTEM and state == START):
                    found.append((role, stays, word + "K"))
            for leaves, total, text in found:
                out[entry, leaves] = min(out.get((entry, leaves), (NEVER, "")), (total, text))
            state = NEXT[state]
    return out


ALL_WORDS = sorted({w for code in range(CODES) for _, w in words(code).values()})


@cache
def row_step(code: int) -> Step:
    rank = {w: i for i, w in enumerate(ALL_WORDS)}
    return tuple(
        tuple((entry, cost, rank[w]) for (entry, at), (cost, w) in sorted(words(code).items()) if at == leaves) for leaves in STATES
    )


# ---- vectors


def starting(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in STATES)


def forward(vector: Vector, step: Step) -> Vector:
    found = []
    for ways in step:
        best = None
        for entry, cost, rank in ways:
            if vector[entry] is not None:
                way = (vector[entry][0] + cost, vector[entry][1], rank)
                best = way if best is None else min(best, way)
        found.append(best)
    order = {audit: i for i, audit in enumerate(sorted(b[1:] for b in found if b))}
    return tuple(None if b is None else (b[0], order[b[1:]]) for b in found)


def backward(costs: tuple[int, ...], step: Step) -> tuple[int, ...]:
    out = [NEVER] * 4
    for leaves, ways in enumerate(step):
        for entry, cost, _ in ways:
            out[entry] = min(out[entry], costs[leaves] + cost)
    return tuple(out)


class Rows:
    """A run of row codes; steps over it are looked up, as few vectors occur once costs are taken from the least."""

    _forward: dict = {}
    _backward: dict = {}

    def __init__(self, codes: str):
        self.codes = [ord(c) - BASE for c in codes]

    def __len__(self) -> int:
        return len(self.codes)

    def forward(self, vector: Vector, low: int, high: int) -> Vector:
        base = min(v[0] for v in vector if v)
        now = tuple(v and (v[0] - base, v[1]) for v in vector)
        known = self._forward
        for code in self.codes[low:high]:
            if (step := known.get((now, code))) is None:
                new = forward(now, row_step(code))
                more = min(v[0] for v in new if v)
                step = known[now, code] = tuple(v and (v[0] - more, v[1]) for v in new), more
            now = step[0]
            base += step[1]
        return tuple(v and (v[0] + base, v[1]) for v in now)

    def backward(self, costs: tuple[int, ...], low: int, high: int) -> tuple[int, ...]:
        known = self._backward
        now, base = costs, 0
        for code in reversed(self.codes[low:high]):
            if (step := known.get((now, code))) is None:
                new = backward(now, row_step(code))
                less = min(new)
                step = known[now, code] = tuple(c if c >= NEVER else c - less for c in new), less
            now = step[0]
            base += step[1]
        return tuple(c if c >= NEVER else c + base for c in now)


class Steps:
    """A run of segments, each given as a step."""

    def __init__(self, steps: Sequence[Step]):
        self.steps = steps

    def __len__(self) -> int:
        return len(self.steps)

    def forward(self, vector: Vector, low: int, high: int) -> Vector:
        for step in self.steps[low:high]:
            vector = forward(vector, step)
        return vector

    def backward(self, costs: tuple[int, ...], low: int, high: int) -> tuple[int, ...]:
        for step in reversed(self.steps[low:high]):
            costs = backward(costs, step)
        return costs


def summary(run: Rows | Steps) -> list[int]:
    """Costs and ranks from every state to every state: a segment as a step, flat; -1 where there is no way."""
    out = []
    for entry in STATES:
        for v in run.forward(starting(entry), 0, len(run)):
            out += v or (-1, -1)
    return out


def as_step(flat: Sequence[int]) -> Step:
    return tuple(
        tuple((e, flat[8 * e + 2 * x], flat[8 * e + 2 * x + 1]) for e in STATES if flat[8 * e + 2 * x] >= 0) for x in STATES
    )


def best_exit(run: Rows | Steps) -> int:
    """The state in which the cheapest repair of a whole conversation leaves its last row."""
    found = run.forward(starting(START), 0, len(run))
    return min((v[0] + ENDS[s] * INSERT, v[1], s) for s, v in enumerate(found) if v)[2]


def crossings(run: Rows | Steps, entry: int, leaves: int) -> list[int]:
    """The states before, between and after the items of ``run``: halves meet where cost, then audit are least."""
    out = [entry] + [leaves] * len(run)
    todo = [(0, len(run))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        left = run.forward(starting(out[low]), low, middle)
        right = run.backward(tuple(0 if s == out[high] else NEVER for s in STATES), middle, high)
        out[middle] = min((v[0] + right[s], v[1], s) for s, v in enumerate(left) if v)[2]
        todo += [(low, middle), (middle, high)]
    return out


def solved(codes: str, entry: int, leaves: int | None, last: bool) -> tuple[int, str]:
    """Cost and audit of a segment; ``leaves`` is None for a whole conversation."""
    run = Rows(codes)
    states = crossings(run, entry, best_exit(run) if leaves is None else leaves)
    found = [words(code)[a, b] for code, a, b in zip(run.codes, states, states[1:])]
    inserts = ENDS[states[-1]] if last else 0
    return sum(c for c, _ in found) + inserts * INSERT, "".join(w for _, w in found) + "I" * inserts


# ---- segments


def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The step of every segment of a conversation that has several."""
    for batch in batches:
        steps = [summary(Rows(codes)) for codes in batch.column("codes").to_pylist()]
        columns = [batch.column("grp"), batch.column("pos"), pa.array(steps, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["grp", "pos", "step"])


def compose_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        steps = [summary(Steps([as_step(s) for s in run])) for run in batch.column("steps").to_pylist()]
        columns = [batch.column("grp"), batch.column("pos"), batch.column("steps"), pa.array(steps, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["grp", "pos", "steps", "step"])


def cross_batches(fan: int) -> Callable:
    """The states at the ends of each part of a group, from those at the group's ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, entry, leaves = [], [], [], []
            for i, row in enumerate(batch.select(["pos", "steps", "entry", "leaves"]).to_pylist()):
                parts = Steps([as_step(s) for s in row["steps"]])
                states = crossings(parts, row["entry"], best_exit(parts) if row["leaves"] is None else row["leaves"])
                owner += [i] * len(parts)
                place += range(row["pos"] * fan, row["pos"] * fan + len(parts))
                entry += states[:-1]
                leaves += states[1:]
            keys = batch.column("grp").take(pa.array(owner, pa.int64()))
            columns = [keys, pa.array(place, pa.int64()), pa.array(entry, pa.int32()), pa.array(leaves, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "pos", "entry", "leaves"])

    return run


def segment_borders(segments: DataFrame, kind: str, segment: int, fan: int) -> DataFrame | None:
    """``grp``, ``pos``, ``entry``, ``leaves`` of the segments of conversations that have several; None if there are none."""
    several = segments.where(F.col("total") > segment).select("grp", "pos", "codes")
    if several.isEmpty():
        return None
    part = materialise(several.mapInArrow(sum_batches, f"grp {kind}, pos long, step array<bigint>"), "segment-steps")
    layers = []
    while True:
        groups = (
            part.withColumn("up", F.expr(f"pos div {fan}")).groupBy("grp", "up")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "step"))).alias("run"))
            .select("grp", F.col("up").alias("pos"), F.col("run.step").alias("steps"))
        )
        schema = f"grp {kind}, pos long, steps array<array<bigint>>, step array<bigint>"
        layers.append(materialise(groups.mapInArrow(compose_batches, schema), f"segment-groups-{len(layers)}"))
        if layers[-1].where("pos > 0").isEmpty():
            break
        part = layers[-1].select("grp", "pos", "step")
    none = F.lit(None).cast("int")
    above = layers[-1].select("grp", "pos", F.lit(START).alias("entry"), none.alias("leaves"))
    for layer in reversed(layers):
        on = same("l", "a", "grp") & (F.col("l.pos") == F.col("a.pos"))
        known = layer.alias("l").join(above.alias("a"), on).select("l.grp", "l.pos", "steps", "entry", "leaves")
        above = materialise(known.mapInArrow(cross_batches(fan), f"grp {kind}, pos long, entry int, leaves int"), "segment-borders")
    return above


def audit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.select(["last", "codes", "entry", "leaves"]).to_pylist()
        costs, audits, illegal, faults = [], [], [], {f: [] for f in FAULTS[1:]}
        for row in rows:
            cost, audit = solved(row["codes"], row["entry"] or START, row["leaves"], row["last"])
            costs.append(cost)
            audits.append(audit)
            codes = [ord(c) - BASE for c in row["codes"]]
            for number, fault in enumerate(FAULTS[1:], 1):
                faults[fault].append(sum(c // 4 == number for c in codes))
            initials = [(INITIALS + "-")[c % 4] for c in codes]
            illegal.append(sum(p not in LEGAL for p in zip(initials, initials[1:])))
        numbers = {"cost": costs, **faults, "illegal": illegal}
        yield pa.RecordBatch.from_arrays(
            [batch.column("grp"), batch.column("pos"), batch.column("codes"), pa.array(audits, pa.string()), *[pa.array(v, pa.int64()) for v in numbers.values()]],
            names=["grp", "pos", "codes", "audit", *numbers],
        )


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def audited_segments(rows: DataFrame, kind: str, segment: int, fan: int) -> DataFrame:
    """Segments with their audit, cost and counts; ``rows`` has grp, turn, role, h1, h2, initial, blank, truncated."""
    order = [F.col("grp").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    placed = materialise(numbered(in_order(materialise(rows, "turns"), order, "ordered-turns"), "conversation-sizes"), "numbered-turns")
    # Rows seen earlier: counted first, so that only texts that recur in a conversation are joined.
    again = placed.groupBy("grp", "h1", "h2").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    on = same("p", "d", "grp") & (F.col("p.h1") == F.col("d.h1")) & (F.col("p.h2") == F.col("d.h2"))
    marked = placed.alias("p").join(again.alias("d"), on, "left").select("p.*", (F.col("p.pos") > F.col("d.first")).alias("later"))
    fault = F.when(F.col("blank"), 1).when(F.col("later"), 2).when(F.col("truncated"), 3).otherwise(0)
    code = F.chr(F.lit(BASE) + F.col("initial") + 4 * fault)
    segments = (
        marked.select("grp", F.expr(f"pos div {segment}").alias("seg"), "pos", "total", code.alias("code"))
        .groupBy("grp", "seg")
        .agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("run"))
        .select("grp", F.col("seg").alias("pos"), "total", F.array_join("run.code", "").alias("codes"))
    )
    segments = materialise(segments, "segments")
    borders = segment_borders(segments, kind, segment, fan)
    if borders is None:
        none = F.lit(None).cast("int")
        known = segments.select("*", none.alias("entry"), none.alias("leaves"))
    else:
        on = same("s", "b", "grp") & (F.col("s.pos") == F.col("b.pos"))
        known = segments.alias("s").join(borders.alias("b"), on, "left").select("s.*", "entry", "leaves")
    known = known.withColumn("last", (F.col("pos") + 1) * segment >= F.col("total"))
    schema = f"grp {kind}, pos long, codes string, audit string, cost long, blank long, duplicate long, truncated long, illegal long"
    return materialise(known.mapInArrow(audit_batches, schema), "audits")


def between_segments(audits: DataFrame) -> DataFrame:
    """``audits`` with the illegal pairs of neighbouring segments counted as well."""

    def initial(character):
        return F.pmod(F.ascii(character) - BASE, F.lit(4))

    before = F.lag(F.right("codes", F.lit(1))).over(Window.partitionBy("grp").orderBy("pos"))  # a row per segment
    a, b = initial(before), initial(F.left("codes", F.lit(1)))
    legal = F.lit(False)
    for x, y in LEGAL:
        legal = legal | ((a == INITIALS.index(x)) & (b == INITIALS.index(y)))
    return audits.withColumn("illegal", F.col("illegal") + F.when(before.isNotNull() & ~legal, 1).otherwise(0))


# ---- rebuilding


class Rebuilt:
    """Rows of one conversation, taken in order and given back repaired."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield ROLE[self.state], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        self.state = SYSTEM if edit == "K" and role[:1] == "s" else NEXT[self.state]
        yield (role if edit == "K" else ROLE[self.state]), text, edit


HEAD, AUDIT, ROW = range(3)


def conversations_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Events of the sorted rows: a conversation begins, a repaired row, it ends. Holds one audit at a time."""
    key: tuple | None = None
    parts: list[str] = []
    rebuilt: Rebuilt | None = None

    def rest() -> Iterator[tuple]:
        if key is not None:
            for row in (rebuilt or Rebuilt("".join(parts))).inserted():
                yield ROW, row
            yield AUDIT, rebuilt.audit if rebuilt else "".join(parts)

    for batch in batches:
        for number, line in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grp", "kind", "audit", "role", "text")))):
            grp, kind, audit, role, text = line
            if kind == HEAD:
                yield from rest()
                key, parts, rebuilt = (grp,), [], None
                yield HEAD, (grp, batch, number)
            elif kind == AUDIT:
                parts.append(audit)
            else:
                rebuilt = rebuilt or Rebuilt("".join(parts))
                for row in rebuilt.row(role, text):
                    yield ROW, row
    yield from rest()


def report_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, its repaired rows hashed as they come."""
    names = ["gaps", *COUNTS]
    found: list[tuple] = []
    head, hashed, empty = (), hashlib.sha256(), True

    def out() -> pa.RecordBatch:
        numbers = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(names))]
        keys = pa.concat_arrays([f[3] for f in found])
        columns = [keys, *numbers, pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["grp", *names, "audit", "repaired_sha256"])

    for event, value in conversations_in(batches):
        if event == HEAD:
            _, batch, number = value
            head = [batch.column(n)[number].as_py() or 0 for n in names], batch.column("grp").slice(number, 1)
            hashed, empty = hashlib.sha256(), True
        elif event == ROW:
            role, text, _ = value
            hashed.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
        else:
            found.append((head[0], value, hashed.hexdigest(), head[1]))
            if len(found) == 1000:
                yield out()
                found = []
    if found:
        yield out()


def row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows themselves."""
    found: list[tuple] = []
    key, place = None, 0
    for event, value in conversations_in(batches):
        if event == HEAD:
            key, place = value[1].column("grp").slice(value[2], 1), 0
        elif event == ROW:
            found.append((key, place, *value))
            place += 1
            if len(found) == 1000:
                yield rebuilt_rows(found)
                found = []
    if found:
        yield rebuilt_rows(found)


def rebuilt_rows(found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.concat_arrays([f[0] for f in found]), pa.array([f[1] for f in found], pa.int64())]
    return pa.RecordBatch.from_arrays(
        columns + [pa.array([f[i] for f in found], pa.string()) for i in (2, 3, 4)], names=["grp", "place", "role", "text", "edit"]
    )


def _streamed(
    rows: DataFrame, conversations: DataFrame | None, conv: str, turn: str, role: str, text: str, segment: int, fan: int
) -> tuple[DataFrame, str]:
    """Heads, audits and texts of each conversation, one after another in one task."""
    kind = rows.schema[conv].dataType.simpleString()
    blank_as_space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text)}
    key = F.struct(blank_as_space[role].alias("r"), blank_as_space[text].alias("t"))
    trimmed = F.btrim(blank_as_space[text], F.lit(BLANKS))
    initial = F.left(blank_as_space[role], F.lit(1))
    number = F.lit(OTHER)
    for i, letter in enumerate(INITIALS):
        number = F.when(initial == letter, i).otherwise(number)
    order = [
        F.col(conv).alias("grp"), F.col(turn).alias("turn"), blank_as_space[role].alias("role"),
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"),
    ]
    slim = rows.select(
        *order, number.alias("initial"), (F.length(trimmed) == 0).alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    audits = audited_segments(slim, kind, segment, fan)
    counts = between_segments(audits).groupBy("grp").agg(*[F.sum(c).alias(c) for c in COUNTS])
    turns = rows.select(F.col(conv).alias("grp"), F.col(turn).cast("long").alias("turn"))
    gaps = turns.groupBy("grp").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    all_ids = (rows if conversations is None else conversations).select(F.col(conv).alias("grp")).distinct()
    with_gaps = all_ids.alias("i").join(gaps.alias("g"), same("i", "g", "grp"), "left").select("i.grp", "gaps")
    heads = with_gaps.alias("i").join(counts.alias("c"), same("i", "c", "grp"), "left").select("i.grp", "gaps", *COUNTS)
    parts = [
        heads.withColumn("kind", F.lit(HEAD)),
        audits.select("grp", F.col("pos").alias("seg"), "audit").withColumn("kind", F.lit(AUDIT)),
        rows.select(*order, blank_as_space[text].alias("text")).withColumn("kind", F.lit(ROW)),
    ]
    whole = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    sorting = [F.col("grp"), F.col("kind"), F.col("seg"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]
    ordered = whole.repartition("grp").sortWithinPartitions(*sorting)
    return ordered.select("grp", "kind", "audit", "role", "text", "gaps", *COUNTS), kind


def repair(
    rows: DataFrame,
    conversations: DataFrame | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    segment: int = SEGMENT,
    fan: int = FAN,
) -> DataFrame:
    """A row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand by ``turn``, those without one first; rows of one turn by role,
    then by a hash of role and text, and rows that are equal in all are
    interchangeable. A null role or text is one space. A null conversation id
    is a conversation as any other. ``conversations`` lists the ids to report;
    one without rows has zeros, no audit and the hash of the empty text.
    Without it the ids of ``rows`` are reported; an empty table gives no rows.
    Other columns are not read.

    A conversation's codes and audits are worked on in segments of so many rows
    by different tasks, ``fan`` segments or groups of them composed at once. Its text is hashed in one task, row by row, as the hash is defined
    one byte after another; that task holds the audit and no text.
    """
    ordered, kind = _streamed(rows, conversations, conv, turn, role, text, segment, fan)
    numbers = ", ".join(f"{c} long" for c in ["gaps", *COUNTS])
    return ordered.mapInArrow(report_batches, f"grp {kind}, {numbers}, audit string, repaired_sha256 string").withColumnRenamed("grp", conv)


def repaired_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: ``conv``, place from 0, role, text and the edit (K kept, R role changed, I inserted)."""
    ordered, kind = _streamed(rows, None, conv, turn, role, text, SEGMENT, FAN)
    schema = f"grp {kind}, place long, role string, text string, edit string"
    return ordered.mapInArrow(row_batches, schema).withColumnRenamed("grp", conv)
