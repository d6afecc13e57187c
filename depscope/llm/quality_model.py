"""Quality classifier from weak labels: no hand label is needed to train it.

Ten heuristic labellers vote good, bad or abstain on every text. How often each pattern of votes
occurs is counted over all documents. Expectation-maximisation on these counts estimates, per
labeller and class, how it votes (with a prior that it is better than chance), and so the chance
that a text with a given pattern is good. Bad texts are several classes, one per kind, because a
labeller of symbols says nothing of stutter. These posterior labels train a linear scorer on hashed
class n-grams of the bytes and on word repetition. It is fitted on a uniform sample of documents,
TRAIN_ROWS as expected (all, if there are fewer), drawn and dealt over TRAIN_TASKS tasks by a hash of the row, so that neither
the order of the table nor its partitions matter; rows of equal number and text count once there. The tasks' weights are averaged. The
scorer then judges every text, by its whole length.

Driver data: one count per vote pattern that occurs (at most 3 ** 10, whatever the input) and one
weight vector per training task.

Defined results: null text is empty; texts without words are kept, as nothing speaks against them;
an empty table gives a scorer that keeps all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from depscope.llm.common import fresh
from depscope.scratch import materialize

# Names of the labellers, in the order of their votes, and the kinds of bad text they are meant to see.
LABELLERS = ("symbols", "symbol_words", "upper", "marks", "shouting", "bars", "stutter", "distinct", "letters", "top_word")
KINDS = (("symbols", "symbol_words", "letters"), ("upper", "marks", "shouting"), ("bars", "symbols"), ("stutter", "distinct", "top_word"))
PRIOR_GOOD, PRIOR_STRENGTH, ROUNDS = 0.85, 10.0, 60

# Hashed features: n-grams of this many byte classes, folded into 2 ** FEATURE_BITS weights.
GRAM, FEATURE_BITS = 4, 14
# The sample the scorer is fitted on, and the tasks that share it; passes over it, or as many steps at least.
TRAIN_ROWS, TRAIN_TASKS = 20_000, 4
BATCH, PASSES, STEPS, RATE, DECAY, SEED = 256, 4, 200, 0.5, 1e-5, 11

_CLASSES = np.full(256, 6, dtype=np.uint8)  # 6: other punctuation
_CLASSES[list(range(97, 123))] = 0
_CLASSES[list(range(65, 91))] = 1
_CLASSES[list(range(48, 58))] = 2
_CLASSES[[9, 11, 12, 13, 32]] = 3
_CLASSES[10] = 4
_CLASSES[[44, 46]] = 5
for _i, _c in enumerate("!*%$#&|"):
    _CLASSES[ord(_c)] = 7 + _i
_CLASSES[128:160] = 14  # second bytes: of capitals in Latin-1
_CLASSES[160:] = 15
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_MARKED = tuple("#*$%&|<>!")


@dataclass(frozen=True)
class Model:
    """What EM found about the labellers (class 0 is good), and the scorer's weights (the last is the bias)."""

    shares: tuple[float, ...]
    tables: tuple[tuple[tuple[float, ...], ...], ...]
    weights: bytes

    def accuracy(self, labeller: str) -> float:
        """How often the labeller is right when it votes."""
        i = LABELLERS.index(labeller)
        said = [(share, table[i]) for share, table in zip(self.shares, self.tables, strict=True)]
        right = said[0][0] * said[0][1][2] + sum(share * row[0] for share, row in said[1:])
        wrong = said[0][0] * said[0][1][0] + sum(share * row[2] for share, row in said[1:])
        return right / (right + wrong)


def votes(text: str | None) -> bytes:
    """One vote per labeller: 0 bad, 1 abstain, 2 good."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return bytes([1] * len(LABELLERS))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    classes = np.bincount(_CLASSES[data], minlength=16)
    solid = max(1, len(data) - int(classes[3] + classes[4]))
    letters = int(classes[0] + classes[1] + classes[14] + classes[15])
    symbols = int(np.count_nonzero(_SYMBOLS[data])) / solid
    marked = sum(w.endswith(_MARKED) for w in words) / n
    shouting = sum(map(str.isupper, words)) / n
    stutter = sum(map(eq, words, words[1:])) / n
    seen = Counter(words)

    def vote(value: float, good: float, bad: float) -> int:
        return 0 if value > bad else 2 if value < good else 1

    long = n >= 20
    return bytes([
        vote(symbols, 0.01, 0.06), vote(marked, 0.05, 0.25), vote(int(classes[1]) / max(1, int(classes[0] + classes[1])), 0.2, 0.5),
        vote(int(classes[7]) / n, 0.05, 0.25), vote(shouting, 0.15, 0.4), vote(int(classes[13]) / n, 0.02, 0.15), vote(stutter, 0.03, 0.15),
        vote(1 - len(seen) / n, 0.6, 0.75) if long else 1, vote(1 - letters / solid, 0.1, 0.2),
        vote(max(seen.values()) / n, 0.12, 0.2) if long else 1,
    ])


def _start() -> tuple[np.ndarray, np.ndarray]:
    """Shares and vote chances by class to start from, which are the prior too."""
    # Bad, abstained, good: to abstain says nothing of a text, so it counts as 1 in every class.
    fine, poor = (0.06, 1.0, 0.94), (0.85, 1.0, 0.15)
    tables = [[fine] * len(LABELLERS), *[[poor if name in kind else fine for name in LABELLERS] for kind in KINDS]]
    return np.array([PRIOR_GOOD, *[(1 - PRIOR_GOOD) / len(KINDS)] * len(KINDS)]), np.array(tables)


def estimate(patterns: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(share of each class, chance of each vote by class and labeller) by EM; class 0 is good."""
    prior_shares, prior_tables = shares, tables = _start()
    if not patterns:
        return shares, tables
    order = sorted(patterns)
    v = np.array([list(p) for p in order])
    weight = np.array([patterns[p] for p in order], dtype=np.float64)
    seen = np.eye(3)[v]
    seen[:, :, 1] = 0
    for _ in range(ROUNDS):
        held = _posterior(v, shares, tables) * weight[:, None]
        total = held.sum(axis=0)
        shares = (total + PRIOR_STRENGTH * prior_shares) / (weight.sum() + PRIOR_STRENGTH)
        tables = np.einsum("pc,pkv->ckv", held, seen) + PRIOR_STRENGTH * prior_tables
        tables /= tables[:, :, ::2].sum(axis=2, keepdims=True)
        tables[:, :, 1] = 1
    return shares, tables


def _posterior(v: np.ndarray, shares: np.ndarray, tables: np.ndarray) -> np.ndarray:
    each = np.arange(v.shape[1])
    logs = np.log(shares) + np.log(tables)[:, each, v].sum(axis=2).T
    chance = np.exp(logs - logs.max(axis=1, keepdims=True))
    return chance / chance.sum(axis=1, keepdims=True)


def chance_good(v: np.ndarray, shares: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Posterior of patterns (rows of votes)."""
    return _posterior(v, shares, tables)[:, 0]


def feature_row(text: str | None) -> np.ndarray | None:
    """Hashed features of a whole text, with a bias at the end; None without words."""
    text = text or ""
    words = text.split()
    if not words:
        return None
    size = 1 << FEATURE_BITS
    c = _CLASSES[np.frombuffer(text.encode(), dtype=np.uint8)].astype(np.uint32)
    out = np.zeros(size + 1, dtype=np.float32)
    if len(c) >= GRAM:
        m = len(c) - GRAM + 1
        gram = c[:m].copy()
        for k in range(1, GRAM):
            gram = gram * np.uint32(16) + c[k : k + m]
        found = np.bincount(((gram * np.uint32(2654435761)) >> np.uint32(32 - FEATURE_BITS)).astype(np.int64), minlength=size)
        out[:size] = np.sqrt(found / m)
    n = len(words)
    # Three slots for repetition, weighted like several n-grams; hashed ones that fall there share them.
    out[0] += 3 * sum(map(eq, words, words[1:])) / n
    out[1] += 3 * (1 - len(set(words)) / n) if n >= 20 else 0
    out[2] += 3 * max(Counter(words).values()) / n if n >= 20 else 0
    out[size] = 1.0
    return out


def _batches(column: pa.Array) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows of features, a bounded number at a time, with their places in the column."""
    at, rows = [], []
    for i, value in enumerate(column):
        row = feature_row(value.as_py())
        if row is not None:
            at.append(i)
            rows.append(row)
        if len(rows) == BATCH:
            yield at, np.stack(rows)
            at, rows = [], []
    if rows:
        yield at, np.stack(rows)


def count_patterns(docs: DataFrame, text: str) -> dict[bytes, int]:
    """Vote patterns of all documents with their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            found.update(votes(t.as_py()) for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["votes", "n"])

    rows = docs.select(text).mapInArrow(work, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["votes"]): r["n"] for r in rows}


def train(docs: DataFrame, text: str, share: float, shares: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer of the posterior labels, fitted on a share of the documents."""
    size = (1 << FEATURE_BITS) + 1

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for hashed, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = feature_row(value.as_py())
                if row is not None:
                    at = np.nonzero(row)[0]
                    v = np.array([list(votes(value.as_py()))])
                    rows.append((hashed, at.astype(np.int32).tobytes(), row[at].tobytes(), float(chance_good(v, shares, tables)[0])))
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["hashed", "at", "value", "y"])

    def learn(t: pa.Table) -> pa.Table:
        # A bounded number of rows, a task's part of the sample, in an order of its own.
        t = t.sort_by("hashed")
        rows = [(np.frombuffer(a.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32), y.as_py()) for a, v, y in zip(t["at"], t["value"], t["y"], strict=True)]
        w, grad2, order = np.zeros(size, np.float32), np.full(size, 1e-6, np.float32), np.random.default_rng(SEED)
        for _ in range(max(PASSES, -(-STEPS * BATCH // max(len(rows), BATCH)))):
            mixed = order.permutation(len(rows))
            for start in range(0, len(rows), BATCH):
                chosen = [rows[i] for i in mixed[start : start + BATCH]]
                x, y = np.zeros((len(chosen), size), np.float32), np.array([r[2] for r in chosen], np.float32)
                for i, (at, value, _) in enumerate(chosen):
                    x[i, at] = value
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                g = x.T @ (p - y) / np.float32(len(chosen)) + np.float32(DECAY) * w
                grad2 += g * g
                w -= np.float32(RATE) * g / np.sqrt(grad2)
        return pa.table({"n": pa.array([len(rows)], pa.int64()), "w": pa.array([w.astype(np.float64).tobytes()], pa.binary())})

    named = [c for c in docs.columns if c in ("doc_id", text)]
    hashed = docs.select(F.xxhash64(F.lit(SEED), *named).alias("hashed"), text)
    drawn = hashed.where(F.shiftrightunsigned("hashed", 32) < int(min(share, 1.0) * (1 << 32)))
    described = drawn.mapInArrow(describe, "hashed long, at binary, value binary, y double")
    described = materialize(described.dropDuplicates(["hashed"]), "sample")
    dealt = described.groupBy(F.pmod("hashed", F.lit(TRAIN_TASKS)).alias("task"))
    parts = sorted(dealt.applyInArrow(learn, "n long, w binary").collect(), key=lambda r: (r["n"], bytes(r["w"])))
    n = sum(r["n"] for r in parts)
    return sum((r["n"] * np.frombuffer(r["w"], dtype=np.float64) for r in parts), np.zeros(size)) / max(n, 1)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The model of a table of documents: votes of all of them, and a scorer fitted on a sample."""
    patterns = count_patterns(docs, text)
    shares, tables = estimate(patterns)
    weights = train(docs, text, TRAIN_ROWS / max(sum(patterns.values()), 1), shares, tables)
    return Model(tuple(map(float, shares)), tuple(tuple(tuple(map(float, row)) for row in t) for t in tables), weights.tobytes())


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Add the chance that a text is good; the name of the new column must be free. All columns stay."""
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add(score, DoubleType())
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(model.weights, dtype=np.float64)
        for batch in batches:
            out = np.ones(batch.num_rows)
            for places, x in _batches(batch.column(at)):
                out[places] = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, score])

    return docs.mapInArrow(work, schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """All documents with the scorer's chance that they are good, and whether they are kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, fit(docs)).select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("kept"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the scorer trained on them calls good, all columns kept."""
    name = fresh(docs, "score")[0]
    return scored(docs, fit(docs), score=name).where(F.col(name) >= 0.5).drop(name)
