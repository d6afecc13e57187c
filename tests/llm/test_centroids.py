"""Centroid clustering against plain arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from depscope.llm import centroids as C
from depscope.llm.vectors import prepared

SCHEMA = "vec_id long, embedding array<float>, label int"


def _vectors(seed, n, spread=1.0, pool=None):
    r = random.Random(seed)
    make = lambda: [r.gauss(0, spread) if r.random() < 0.9 else 0.0 for _ in range(64)]
    kinds = [make() for _ in range(pool)] if pool else None
    return [(i, [float(np.float32(x)) for x in (r.choice(kinds) if kinds else make())], i % 10) for i in range(n)]


def _brute(rows):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    words = [v for _, v in named[:40]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), k) for k, c in enumerate(words))
    for _ in range(5 if words else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        words = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(words)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {k: sum(d for _, c, d in found if c == k) for k in range(len(words))}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, words[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def _run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    return sorted(map(tuple, C.op11_centroid_clustering(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("n, pool", [(150, None), (200, 60), (30, None), (120, 3)])
def test_equals_plain_rounds(spark, tmp_path, n, pool):
    rows = _vectors(n, n, pool=pool)
    assert _run(spark, rows, tmp_path) == _brute(rows)


def test_nulls_ties_repeats(spark, tmp_path):
    good = _vectors(5, 60)
    bad = [(100, None, 1), (101, [], 1), (102, [1.0] * 63, 1), (103, [None] + [1.0] * 63, 1), (104, [math.nan] * 64, 1), (105, [math.inf] + [0.0] * 63, 1), (106, [0.5] * 65, 1)]
    rows = good + good[:20] + bad + [(None, good[3][1], None), (7, good[9][1], 2)]
    assert _run(spark, rows, tmp_path) == _brute(rows)


def test_empty_and_too_large(spark, tmp_path):
    assert _run(spark, [], tmp_path / "a") == []
    with pytest.raises(Exception, match="exceeds"):
        _run(spark, [(1, [1e30] * 64, 1)], tmp_path / "b")


def test_extra_columns(spark):
    rows = [(i, v, k, "x", 1.0) for i, v, k in _vectors(8, 50)]
    df = spark.createDataFrame(rows, SCHEMA + ", v string, cluster double")
    assert C.cluster(prepared(df, "vec_id", "embedding", 64), k=3)[0].count() == 50


def test_search_is_exact_and_saves_work():
    r = np.random.default_rng(3)
    to = r.integers(-200, 200, (40, 64))
    rows = np.concatenate([to[r.integers(0, 40, 500)] + r.integers(-20, 20, (500, 64)), np.repeat(to[:1], 5, axis=0), (to[:20] + to[20:]) // 2])
    to = np.concatenate([to, to[:3]])
    best, apart, taken = C.nearest(C.transform(rows), C.transform(to))
    whole = ((rows[:, None, :] - to[None]) ** 2).sum(axis=2)
    assert (best == whole.argmin(axis=1)).all() and (apart == whole.min(axis=1)).all()
    assert taken < whole.size * 64 // 2
    assert (C.transform(np.eye(64, dtype=np.int64)) @ C.transform(np.eye(64, dtype=np.int64)).T == 64 * np.eye(64)).all()
