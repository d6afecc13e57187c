"""Length buckets against all possible cuts, and whole batches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from depscope.llm import packing as P


def _padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


@pytest.mark.parametrize("seed", range(12))
def test_bounds_are_optimal(seed):
    r = random.Random(seed)
    lengths = [r.choice((r.randint(0, 30), r.randint(0, 9))) for _ in range(40)]
    cells = sorted(set(lengths))
    counts = [lengths.count(c) for c in cells]
    for buckets in (1, 2, 3, 5):
        bounds = P.best_bounds(counts, [c * n for c, n in zip(cells, counts, strict=True)], cells, buckets)
        best = min(_padding(lengths, [*inner, cells[-1]]) for k in range(buckets) for inner in itertools.combinations(cells[:-1], k))
        assert len(bounds) <= buckets and bounds[-1] == cells[-1] and bounds == sorted(bounds)
        assert _padding(lengths, bounds) == best


def test_batches_hold_their_budget_and_every_row(spark):
    r = random.Random(9)
    rows = [(i, r.choice((0, 1, 5, 50, 700, 3000)), "b") for i in range(500)] + [(499, 5, "b"), (None, 5, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, n long, bucket string")
    got = P.pack(docs.drop("bucket"), "n", ["doc_id"], buckets=3, budget=2000).collect()
    assert len(got) == len(rows)
    groups = {}
    for row in got:
        assert row.padding == row.bucket_length - row.n >= 0
        groups.setdefault((row.bucket, row.batch), []).append(row)
    for (bucket, batch), members in groups.items():
        assert len(members) * members[0].bucket_length <= 2000 or len(members) == 1
        assert sorted(m.place for m in members) == list(range(len(members)))
    for bucket in {b for b, _ in groups}:
        numbers = sorted(n for b, n in groups if b == bucket)
        assert numbers == list(range(len(numbers)))


def test_null_blank_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, " "), (3, "a b"), (3, "a b")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens) for r in P.pack_documents(docs).collect())
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert P.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_long_lengths_are_packed_with_the_least_padding(spark, seed):
    # Neighbouring lengths far above 128, where leading bits do not tell them apart.
    r = random.Random(seed)
    lengths = [r.choice((r.randint(1000, 1023), r.randint(9000, 9100), r.randint(70_000, 70_200))) for _ in range(30)]
    cells = sorted(set(lengths))
    got = P.pack(spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "doc_id long, n long"), "n", ["doc_id"], buckets=5).collect()
    best = min(_padding(lengths, [*inner, cells[-1]]) for k in range(5) for inner in itertools.combinations(cells[:-1], k))
    assert sum(row.padding for row in got) == best


def test_halving_finds_what_trying_all_cuts_finds():
    r = random.Random(1)
    cells = sorted(r.sample(range(20_000), 300))
    counts = [r.randint(1, 50) for _ in cells]
    cost = lambda i, j: sum(counts[x] * (cells[j - 1] - cells[x]) for x in range(i, j))
    costs = [[cost(i, j) for i in range(j)] for j in range(len(cells) + 1)]
    best = [0] + [float("inf")] * len(cells)
    for _ in range(6):
        best = [0] + [min(best[i] + costs[j][i] for i in range(j)) for j in range(1, len(cells) + 1)]
    bounds = P.best_bounds(counts, [c * n for c, n in zip(cells, counts, strict=True)], cells, 6)
    assert sum(n * (min(b for b in bounds if b >= c) - c) for c, n in zip(cells, counts, strict=True)) == best[-1]


def test_columns_made_here_are_replaced(spark):
    names = ["bucket", "Batch", "place", "padding", "bucket_length", "_rank"]
    docs = spark.createDataFrame([(i, i % 7, *(["old"] * 6)) for i in range(50)], "doc_id long, n long, " + ", ".join(f"{c} string" for c in names))
    got = P.pack(docs, "n", ["doc_id"], 3, 20)
    assert got.columns == ["doc_id", "n", "_rank", "bucket", "bucket_length", "batch", "place", "padding"]
    plain = P.pack(docs.select("doc_id", "n"), "n", ["doc_id"], 3, 20)
    assert sorted(map(tuple, got.drop("_rank").collect())) == sorted(map(tuple, plain.collect()))
    with pytest.raises(ValueError, match="place"):
        P.pack(docs, "place", ["doc_id"])
