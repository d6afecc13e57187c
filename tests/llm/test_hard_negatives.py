"""Hard negatives against brute force."""

import heapq
import math
import random

import numpy as np
import pytest

from depscope.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def _vectors(seed, n, pool=None, first=0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    make = lambda: [float(np.float32(c + r.gauss(0, 0.4))) for c in r.choice(centres)]
    kinds = [make() for _ in range(pool)] if pool else None
    return [(i + first, r.choice(kinds) if kinds else make(), r.randrange(3)) for i in range(n)]


def _brute(rows):
    kept = set()
    for i, v, label in rows:
        if label is None or v is None or len(v) != 64 or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, tuple(math.floor(256 * x) for x in v), (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    kept, out = list(kept), []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a in kept:
        if a[0] is None or a[0] % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a[1], b[1], strict=True)), b[0], b[2]) for b in kept if b is not a]
        for ps, pid, _ in sorted((s for s in scored if s[2] == a[2]), key=order)[:5]:
            fit = sorted((s for s in scored if s[2] != a[2] and 80 * ps <= 100 * s[0] <= 100 * ps), key=order)[:5]
            out += [(a[0], pid, k + 1, nid, ps, ns) for k, (ns, nid, _) in enumerate(fit)]
    return sorted(out, key=repr)


def _run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    return sorted(map(tuple, H.op13_hard_negatives(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("n, per_cell, cells, block, asks", [(700, 20, 2, 16, 2), (900, 5, 4, 2048, 1024), (300, 256, 16, 2048, 1024)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, n, per_cell, cells, block, asks):
    for name, value in (("PER_CELL", per_cell), ("FIRST_CELLS", cells), ("BLOCK", block), ("ASKS", asks)):
        monkeypatch.setattr(H, name, value)
    rows = _vectors(n, n)
    expected = _brute(rows)
    assert expected and _run(spark, rows, tmp_path) == expected


def test_few_kinds_nulls_repeats(spark, tmp_path):
    rows = _vectors(1, 420, pool=12) + [(500, None, 1), (600, [], 1), (700, [1.0] * 64, None), (800, [math.nan] * 64, 1), (900, [None] * 64, 2), (901, [1.0] * 63, 2)]
    rows += rows[:40] + [(None, rows[5][1], 1)] + [(-100, rows[7][1], 0), (-7, rows[8][1], 0)]
    # Equal scores are ordered by number, so rows of one number must not tie: none here has two vectors.
    assert _run(spark, rows, tmp_path) == _brute(rows)


def test_empty_and_lonely(spark, tmp_path):
    assert _run(spark, [], tmp_path / "a") == []
    assert _run(spark, [(100, [0.1] * 64, 1)], tmp_path / "b") == []
    assert _run(spark, [(100, [0.1] * 64, 1), (1, [0.1] * 64, 1), (2, [0.1] * 64, 2)], tmp_path / "c") == [(100, 1, 1, 2, 40000, 40000)]


def test_heap_visits_all_pairs_once_by_falling_sum():
    r = np.random.default_rng(1)
    first, second = r.integers(-50, 50, 13), r.integers(-50, 50, 7)
    got = list(H.visits(first, second))
    assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(13) for j in range(7)]
    assert [b for b, *_ in got] == heapq.nlargest(91, [int(x + y) for x in first for y in second])


def test_bounds_hold():
    r = np.random.default_rng(2)
    rows = r.integers(-300, 300, (2000, 32))
    words = H.fit_codebook(rows[:500], 12)
    code, apart = H.nearest_code(rows, words)
    radii = np.array([apart[code == c].max() if (code == c).any() else -1 for c in range(12)])
    for q in r.integers(-300, 300, (20, 32)):
        top, codes = H.bounds(q, words, radii)
        limit = dict(zip(codes.tolist(), top.tolist(), strict=True))
        assert all(s <= limit[c] for s, c in zip((rows @ q).tolist(), code.tolist(), strict=True))
