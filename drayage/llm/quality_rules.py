"""Quality rules learned as an ordered decision list.

Statistics of whole texts are DataFrame expressions. Sequential covering grows
a conjunction of thresholds on one part of the labelled rows, prunes it on the
other, takes the rows it covers away and goes on. Only counts per feature and
bin reach the driver. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.session import materialise

BLANK = r"[\x20\x09-\x0D]"
STATS = "__stats"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_exclaims")


@dataclass(frozen=True)
class Condition:
    """``feature <= limit``, or ``feature > limit`` if ``above``."""

    feature: str
    above: bool
    limit: int

    def on(self, column: Column) -> Column:
        return column > self.limit if self.above else column <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit}"


Rule = tuple[Condition, ...]


def letters_of(text: Column, kind: str) -> Column:
    """How many code points of the class ``kind`` (a regular expression's) the text has."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that the array holds at least twice.

    Windows are compared by a 64-bit hash. They are sorted, those equal to a
    neighbour are taken, and the union of their places is measured.
    """
    last = F.size(words) - 3
    windows = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
        ),
    )

    def places(s: Column) -> Column:
        twice = F.transform(
            s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["p"])
        )
        return F.sort_array(F.filter(twice, lambda p: p.isNotNull()))

    sorted_once = F.transform(F.array(F.sort_array(windows)), places)[0]
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(
        sorted_once,
        start,
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    return F.coalesce(covered, F.lit(0))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct of statistics of each whole text; null has no words.

    The struct comes from a generator, so later filters cannot make Spark
    compute it twice.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, BLANK + "+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measured(x: Column) -> Column:
        w, ls = x["w"], x["l"]
        values = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": letters_of(body, "#*$%&|<>"),
            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
            "n_repeat_words": repeated_words(w),
            "n_lines": F.size(ls),
            "n_upper": letters_of(body, r"\p{Lu}"),
            "n_exclaims": letters_of(body, "!"),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    named = F.array(F.struct(words.alias("w"), lines.alias("l")))
    return docs.select("*", F.explode(F.transform(named, measured)).alias(STATS))


def features() -> dict[str, Column]:
    """Whole-number rates of the statistics; a text without words has zeros."""
    s = {k: F.col(f"{STATS}.{k}") for k in (*BASE, *EXTRA)}
    words, chars, lines = (F.greatest(s[k], F.lit(1)) for k in ("n_words", "word_chars", "n_lines"))
    rate = lambda top, of, unit=1000: F.floor(top * unit / of).cast("long")
    return {
        "words": s["n_words"],
        "mean_length": rate(s["word_chars"], words, 100),
        "symbols": rate(s["n_symbols"], words),
        "dup_lines": rate(s["n_dup_lines"], lines),
        "repeats": rate(s["n_repeat_words"], words),
        "upper": rate(s["n_upper"], chars),
        "exclaims": rate(s["n_exclaims"], words),
    }


def base_failed() -> Column:
    s = lambda k: F.col(f"{STATS}.{k}")
    return (s("n_words") < 50) | (100 * s("n_repeat_words") > 50 * s("n_words"))


def labelled_sample(labels: DataFrame, key: str, label: str, max_rows: int) -> DataFrame:
    """Keys with one undisputed label, thinned evenly by a hash to about ``max_rows``."""
    clear = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key)
        .agg(F.min(label).alias("__low"), F.max(label).alias("__high"))
        .where(F.col("__low") == F.col("__high"))
        .select(key, (F.col("__low") > 0).alias("__good"))
    )
    total = clear.count()
    share = 1_000_000 if total <= max_rows else math.floor(1_000_000 * max_rows / total)
    return clear.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share)


def information_gain(p0: float, n0: float, p1: float, n1: float) -> float:
    """What a condition that leaves p1, n1 of p0, n0 rows gains, after Quinlan."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def matches(rule: Rule, cuts: dict[str, list[int]]) -> Column:
    """A rule over bin numbers: a value lies above limit i if its bin is above i."""
    return reduce(lambda a, b: a & b, [
        (F.col(c.feature) > cuts[c.feature].index(c.limit)) if c.above else (F.col(c.feature) <= cuts[c.feature].index(c.limit))
        for c in rule
    ])


def grow(rows: DataFrame, cuts: dict[str, list[int]], max_conditions: int) -> Rule:
    """The conjunction that greedy growth reaches on the bins of ``rows``."""
    rule: Rule = ()
    while len(rule) < max_conditions:
        left = rows.where(matches(rule, cuts)) if rule else rows
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in cuts]))
        counted = (
            left.select(cells.alias("c"), "__good")
            .groupBy("c.f", "c.b")
            .agg(F.count_if(~F.col("__good")).alias("p"), F.count_if("__good").alias("n"))
            .collect()  # features times bins at most
        )
        by_feature: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counted:
            by_feature.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
        p0, n0 = (sum(x[i] for x in next(iter(by_feature.values()), {}).values()) for i in (0, 1))
        if p0 == 0 or n0 == 0:
            break
        best, gain = None, 1e-9
        for feature in cuts:
            bins, p, n = by_feature.get(feature, {}), 0, 0
            for i, limit in enumerate(cuts[feature]):
                p, n = p + bins.get(i, (0, 0))[0], n + bins.get(i, (0, 0))[1]
                for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                    if (g := information_gain(p0, n0, p1, n1)) > gain and (p1, n1) != (p0, n0):
                        best, gain = Condition(feature, above, limit), g
        if best is None:
            break
        rule += (best,)
    return rule


def prefix_counts(rows: DataFrame, rule: Rule, cuts: dict[str, list[int]]) -> list[tuple[int, int]]:
    """Rejected and good rows that each prefix of the rule covers, shortest first."""
    columns = []
    for i in range(1, len(rule) + 1):
        hit = matches(rule[:i], cuts)
        columns += [F.count_if(hit & ~F.col("__good")), F.count_if(hit & F.col("__good"))]
    found = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [(found[2 * i], found[2 * i + 1]) for i in range(len(rule))]


def centred(rule: Rule, rows: DataFrame) -> Rule:
    """The rule with each limit halfway between what it covers and the good rows beyond it.

    A limit taken from the data lies right beside one kind; halfway, texts that
    resemble the good rows, but exceed them a little, pass. Of the covered rows
    the twentieth part nearest the limit is left out of account.
    """
    columns = []
    for c in rule:
        inside = reduce(lambda a, b: a & b, [x.on(F.col(x.feature)) for x in rule]) & ~F.col("__good")
        outside = ~c.on(F.col(c.feature)) & F.col("__good")
        beyond = F.max if c.above else F.min
        columns.append(beyond(F.when(outside, F.col(c.feature))))
        columns.append(F.percentile_approx(F.when(inside, F.col(c.feature)), 0.05 if c.above else 0.95, 10_000))
    found = rows.agg(*[x.alias(f"c{i}") for i, x in enumerate(columns)]).first()
    out = []
    for i, c in enumerate(rule):
        good, bad = found[2 * i], found[2 * i + 1]
        wide = good is not None and bad is not None and (good < bad if c.above else bad < good)
        out.append(Condition(c.feature, c.above, (good + bad) // 2) if wide else c)
    return tuple(out)


def learn_rules(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_labelled: int = 20_000,
    n_cuts: int = 40,
    max_rules: int = 12,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_covered: int = 3,
) -> list[Rule]:
    """Ordered rules for texts that pass the base checks; a text that one of them covers is rejected.

    Fitted on about ``max_labelled`` labelled rows, chosen by a hash of the
    key. ``label`` is positive for good rows. Rows with a null key or label, and
    keys with labels that disagree, are not used; repeated rows count each. No
    labels, or labels of one kind only, give no rules.
    """
    sample = labelled_sample(labels, key, label, max_labelled)
    chosen = docs.select(F.col(key), F.col(text)).join(F.broadcast(sample), key)  # the sample's size is bounded
    rates = features()
    measured = materialise(
        with_statistics(chosen, text).where(~base_failed()).select(
            "__good", *[v.alias(k) for k, v in rates.items()], (F.pmod(F.xxhash64(F.lit(7), key), F.lit(3)) > 0).alias("__grow")
        ),
        "labelled",
    )
    points = [i / (n_cuts + 1) for i in range(1, n_cuts + 1)]
    found = measured.agg(*[F.percentile_approx(k, points, 10_000).alias(k) for k in rates]).first()
    cuts = {k: sorted(set(found[k] or [])) for k in rates}
    cuts = {k: v for k, v in cuts.items() if v}
    if not cuts:
        return []
    bins = {k: reduce(lambda a, b: a + b, [(F.col(k) > t).cast("int") for t in v]) for k, v in cuts.items()}
    left = materialise(measured.select("__good", "__grow", *[v.alias(k) for k, v in bins.items()]), "binned")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule = grow(left.where("__grow"), cuts, max_conditions)
        if not rule:
            break
        held_out = prefix_counts(left.where("NOT __grow"), rule, cuts)
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in held_out]
        size = max(range(len(rule)), key=lambda i: (worth[i], -i))  # of equal ones the shortest
        if max(worth) < 0:
            size = len(rule) - 1  # too few rows held out to prune by
        rule = rule[: size + 1]
        p, n = prefix_counts(left, rule, cuts)[-1]
        if p < min_covered or (p + 1) / (p + n + 2) < min_precision:
            break
        rules.append(centred(rule, measured))
        left = left.where(~matches(rule, cuts))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: one conditional expression, in the order of the rules."""
    rates = features()
    decision = None
    for rule in rules:
        hit = reduce(lambda a, b: a & b, [c.on(rates[c.feature]) for c in rule])
        decision = F.when(hit, F.lit(False)) if decision is None else decision.when(hit, F.lit(False))
    return F.lit(True) if decision is None else decision.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with the base statistics (long), ``base_failed`` and ``kept``.

    Null and empty texts have no words, and so fail. Every row is judged on
    its own, repeated rows alike. A column of ``docs`` that bears the name of a
    new one is replaced.
    """
    new = {k: F.col(f"{STATS}.{k}") for k in BASE}
    new |= {"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules)}
    plain = docs.drop(*[c for c in new if c != text], STATS)
    return with_statistics(plain, text).select(
        *[F.col(f"`{c}`") for c in plain.columns], *[v.alias(k) for k, v in new.items()]
    )


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    names = [c for c in docs.columns if c != STATS]
    passed = with_statistics(docs.select(*[F.col(f"`{c}`") for c in names]), text).where(~base_failed() & verdict(rules))
    return passed.select(*[F.col(f"`{c}`") for c in names])
