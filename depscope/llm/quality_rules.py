"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Each text is reduced to counts by DataFrame functions in one pass, without a shuffle. The learner
works on the counts of labelled texts only. It grows one rule at a time: the condition with the
best information gain joins the conjunction until no good text is covered or nothing is gained.
Edges are then set anew, each with the other conditions given.
It prunes the rule on texts held out for that, keeps it if it is still right there, takes the
texts it covers away and goes on. Every step is one Spark aggregate that returns a count per
(statistic, interval, label), a table bounded by the edges. All labelled rows count. Edges come from the labelled
statistics themselves: quantiles of good and of bad texts first, then ever finer ones around the best, until no value lies between.
The threshold is the roundest number between the two values it parts. Neither rules nor their conditions are limited in number; a
rule that fails on the held-out texts ends the list.

The result is an ordered list of threshold conjunctions that reject, with "keep" at its end, and
becomes one conditional expression.

Defined results: null text has no words; documents under 20 words, or with more than 30 % repeated
words, fail the base checks whatever the list says; without labels of both kinds the list is empty
and keeps the rest; several labels of one document count as the lowest; null labels do not count.
Two windows of eight words are taken as equal when their 64-bit hashes are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from depscope.llm.common import SPACES, fresh, words_of
from depscope.scratch import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30

# Quantiles of each kind of text that edges are taken from.
QUANTILES = 32
MIN_COVERED, MIN_PRECISION = 3, 0.9


def with_statistics(docs: DataFrame, text: str = "text", stats: str = "stats") -> DataFrame:
    """Add a struct of counts of each whole text, under a name that must be free."""
    words, windows, sorted_, starts, places = fresh(docs, "_words", "_windows", "_sorted", "_starts", "_places")
    whole = F.coalesce(F.col(text), F.lit(""))
    count = F.size(words)
    hashes = F.when(
        count >= WINDOW, F.transform(F.sequence(F.lit(1), count - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    # Most texts repeat no window; only the others are sorted.
    in_order = F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.array_sort(pairs)).otherwise(F.slice(pairs, 1, 0))
    beside = lambda p, i: (F.get(sorted_, i - 1)["h"] == p["h"]) | (F.get(sorted_, i + 1)["h"] == p["h"])
    repeated = F.filter(sorted_, lambda p, i: F.coalesce(beside(p, i), F.lit(False)))
    step = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1), p + WINDOW) - p))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    removed = lambda pattern: F.length(whole) - F.length(F.regexp_replace(whole, pattern, ""))
    full = (
        docs.withColumn(words, words_of(F.col(text))).withColumn(windows, hashes).withColumn(sorted_, in_order)
        .withColumn(starts, repeated).withColumn(places, F.array_sort(F.transform(starts, lambda p: p["i"])))
    )
    longs = {
        "n_words": count,
        "word_chars": F.length(F.translate(whole, SPACES, "")),
        "n_symbols": F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.aggregate(step, F.lit(0), lambda a, x: a + x),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_upper": removed(r"\p{Lu}+"),
        "n_marks": F.length(whole) - F.length(F.replace(whole, F.lit("!"), F.lit(""))),
    }
    counted = F.struct(*[c.cast("long").alias(name) for name, c in longs.items()])
    return full.withColumn(stats, counted).drop(words, windows, sorted_, starts, places)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEATED * stats["n_words"])


def _part(above: Column, below: Column, scale: int = 1000) -> Column:
    return F.when(below > 0, F.floor(above * scale / below)).otherwise(0).cast("long")


def features(stats: Column) -> dict[str, Column]:
    """Whole numbers that conditions compare: sizes, and parts per thousand."""
    return {
        "words": stats["n_words"],
        "word_length_x100": _part(stats["word_chars"], stats["n_words"], 100),
        "symbols": _part(stats["n_symbols"], stats["word_chars"]),
        "upper": _part(stats["n_upper"], stats["word_chars"]),
        "marks": _part(stats["n_marks"], stats["n_words"]),
        "dup_lines": _part(stats["n_dup_lines"], stats["n_lines"]),
        "repeated": _part(stats["n_repeat_words"], stats["n_words"]),
        "distinct": _part(stats["n_distinct"], stats["n_words"]),
        "line_words": _part(stats["n_words"], stats["n_lines"], 1),
    }


@dataclass(frozen=True)
class Condition:
    """One comparison of a statistic with an edge."""

    feature: str
    least: bool
    edge: int

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] >= self.edge if self.least else values[self.feature] < self.edge

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.least else '<'} {self.edge}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects, and what none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self, values: dict[str, Column]) -> Column:
        out = None
        for rule in self.rules:
            holds = all_of(rule, values)
            out = F.when(holds, False) if out is None else out.when(holds, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        lines = [f"reject if {' and '.join(map(str, rule))}" for rule in self.rules]
        return "\n".join([*lines, "keep"])


def all_of(rule: Sequence[Condition], values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out &= condition.column(values)
    return out


def _entropy_gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def edges_of(labelled: DataFrame, names: Sequence[str], bad: str) -> dict[str, list[int]]:
    """Ascending edges of every statistic: QUANTILES of either kind of text."""
    at = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    found: dict[str, set[int]] = {name: set() for name in names}
    # Two rows.
    for row in labelled.groupBy(bad).agg(*[F.percentile_approx(name, at, 10_000).alias(name) for name in names]).collect():
        for name in names:
            found[name] |= set(row[name] or ())
    return {name: sorted(values) for name, values in found.items()}


def _counted(rows: DataFrame, edges: dict[str, list[int]], bad: str) -> dict[tuple[str, int], list[int]]:
    """Counts of (good, bad) by statistic and interval."""
    interval = lambda n: F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges[n]]), lambda e: e <= F.col(n)))
    listed = F.array(*[F.struct(F.lit(n).alias("name"), interval(n).alias("at")) for n in edges])
    counts: dict[tuple[str, int], list[int]] = {}
    for row in rows.select(bad, F.explode(listed).alias("x")).groupBy("x.name", "x.at", bad).count().collect():
        counts.setdefault((row["name"], row["at"]), [0, 0])[row[bad]] = row["count"]
    return counts


def roundest(below: int, above: int) -> int:
    """The roundest whole number of (below, above], nearest to their middle."""
    step = 10 ** len(str(max(abs(below), abs(above), 1)))
    while step > 1:
        for size in (step, step // 2):
            first, last = (below // size + 1) * size, above // size * size
            if first <= last:
                middle = (below + above) / 2
                return min(max(round(middle / size) * size, first), last)
        step //= 10
    return min(max(-(-(below + above) // 2), below + 1), above)


def _refined(rows: DataFrame, condition: Condition, edges: list[int], bad: str) -> Condition:
    """The condition with its best edge among all values near the given one, moved to the roundest number that parts the rows alike."""
    name, column, known = condition.feature, F.col(condition.feature), list(edges)
    while True:
        at = known.index(condition.edge)
        low, high = known[at - 1] if at else None, known[at + 1] if at + 1 < len(known) else None
        inside = rows.select(name)
        inside = inside.where(column > low) if low is not None else inside
        inside = inside.where(column < high) if high is not None else inside
        values = [r[0] for r in inside.distinct().limit(2 * QUANTILES + 1).collect()]
        whole = len(values) <= 2 * QUANTILES
        if not whole:
            steps = F.array(*[F.lit(i / (2 * QUANTILES)) for i in range(2 * QUANTILES + 1)])
            values = inside.agg(F.percentile_approx(name, steps, 10_000)).first()[0]
        known = sorted({*values, *(v for v in (low, condition.edge, high) if v is not None)})
        found = _best(_counted(rows, {name: known}, bad), {name: known})[1]
        settled = whole or found is None or (found.edge == condition.edge and set(values) <= {condition.edge, *edges})
        condition, edges = found or condition, known
        if settled:
            break
    near = rows.agg(F.max(F.when(column < condition.edge, column)), F.min(F.when(column >= condition.edge, column))).first()
    if near[0] is None or near[1] is None:
        return condition
    return Condition(name, condition.least, roundest(near[0], near[1]))


def _best(counts: dict[tuple[str, int], list[int]], edges: dict[str, list[int]]) -> tuple[float, Condition | None, int, int]:
    """The condition with most gain from counts of (good, bad) by statistic and interval; ties: the first."""
    found: tuple[float, Condition | None, int, int] = (1e-9, None, 0, 0)
    for name, own in edges.items():
        cells = [counts.get((name, i), [0, 0]) for i in range(len(own) + 1)]
        n0, p0 = (sum(c[k] for c in cells) for k in (0, 1))
        if not p0:
            continue
        n_low = p_low = 0
        for i, edge in enumerate(own):
            n_low, p_low = n_low + cells[i][0], p_low + cells[i][1]
            for least, n, p in ((True, n0 - n_low, p0 - p_low), (False, n_low, p_low)):
                gain = _entropy_gain(p, n, p0, n0)
                if gain > found[0] + 1e-9:
                    found = (gain, Condition(name, least, edge), n, p)
    return found


def learn(labelled: DataFrame, names: Sequence[str], bad: str, held_out: str) -> DecisionList:
    """Rules for rows where `bad` is 1. Columns: the named statistics, bad (0 or 1), held_out (boolean)."""
    values = {name: F.col(name) for name in names}
    edges = edges_of(labelled, names, bad)
    rules: list[tuple[Condition, ...]] = []
    while True:
        left = labelled
        for rule in rules:
            left = left.where(~all_of(rule, values))
        rule: list[Condition] = []
        while True:
            rows = left.where(~F.col(held_out)).where(all_of(rule, values)).select(bad, *names)
            _, condition, _, right = _best(_counted(rows, edges, bad), edges)
            if condition is None or right < MIN_COVERED:
                break
            condition = _refined(rows, condition, edges[condition.feature], bad)
            rule.append(condition)
            if not rows.where(condition.column(values)).where(F.col(bad) == 0).limit(1).count():
                break
        if not rule:
            break
        # An edge that was best before the others joined need not be now.
        for k, condition in enumerate(rule if len(rule) > 1 else ()):
            rows = left.where(~F.col(held_out)).where(all_of([c for i, c in enumerate(rule) if i != k], values)).select(bad, *names)
            rule[k] = _refined(rows, condition, sorted({*edges[condition.feature], condition.edge}), bad)
        tried = [rule[: k + 1] for k in range(len(rule))]
        sums = [F.sum(F.when(all_of(r, values) & (F.col(bad) == y), 1).otherwise(0)) for r in tried for y in (1, 0)]
        got = [x or 0 for x in left.where(held_out).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        scored = [(p, n) for p, n in zip(got[::2], got[1::2], strict=True)]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in scored]
        k = max(range(len(worth)), key=lambda i: (worth[i], -i))
        p, n = scored[k]
        if p + n == 0 or p / (p + n) < MIN_PRECISION:
            break
        rules.append(tuple(tried[k]))
    return DecisionList(tuple(rules))


def learn_from(counted: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stats: str = "stats") -> DecisionList:
    """The list for documents with counts, from `labels` (doc_id, quality: 1 good, 0 bad)."""
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.select(F.col("doc_id").alias("_labelled"), (F.col("quality") == 0).cast("int").alias("_bad"))
    values = features(F.col(stats))
    rows = counted.where(~base_failed(F.col(stats))).select(F.col(doc_id).alias("_doc"), *[c.alias(n) for n, c in values.items()])
    joined = rows.join(known, F.col("_doc") == F.col("_labelled")).withColumn("_held", F.pmod(F.xxhash64("_doc"), F.lit(3)) == 0)
    return learn(materialize(joined.drop("_doc", "_labelled"), "labelled"), list(values), "_bad", "_held")


def judged(counted: DataFrame, rules: DecisionList, stats: str = "stats") -> tuple[Column, Column]:
    """(base_failed, kept) for documents with counts."""
    failed = base_failed(F.col(stats))
    return failed, ~failed & rules.keeps(features(F.col(stats)))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents: their counts, whether the base checks failed, and the verdict of the learned list."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = materialize(with_statistics(docs).select("doc_id", "stats"), "statistics")
    rules = learn_from(counted, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    failed, kept = judged(counted, rules)
    return counted.select(
        "doc_id", *[f"stats.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), kept.alias("kept"))


def keep_by_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that pass the base checks and the list learned from the labels, all columns kept."""
    stats = fresh(docs, "stats")[0]
    counted = materialize(with_statistics(docs, stats=stats), "statistics")
    rules = learn_from(counted, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), stats=stats)
    return counted.where(judged(counted, rules, stats)[1]).drop(stats)
