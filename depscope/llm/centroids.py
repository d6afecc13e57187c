"""Centroid clustering: Lloyd's rounds over whole-number vectors with Walsh-Hadamard progressive search.

Vectors and centroids go through the Walsh-Hadamard transform, which is exact on whole numbers and
keeps squared distances up to the factor SIZE. Its coefficients are taken in order of sequency, so
the coarse shape comes first. For a batch of vectors the squared differences are added up block by
block. What has been added is a lower bound of the whole sum; the whole sum of the centroid that
leads so far is an upper bound of the least one. A centroid whose part is already strictly above
that goes; the others go through all SIZE coefficients, so distances are exact and ties are seen.

A round is one pass over the vectors. Each task adds its vectors up per centroid, Spark adds the
tasks' sums, and the driver gets a row per centroid. Nothing else leaves the executors, and there is
no lineage between rounds but the centroids themselves.

Defined results: rows without a vector, with another number of components than SIZE, or with a null,
NaN or infinite component take no part; repeated rows each count; a row without a number counts
under the name `<seed>:` when starts are drawn; with fewer vectors than `k` each starts one centroid;
equal hashes are ordered by vector; an empty table gives an empty result; components above 2 ** 24
after scaling stop the job, since distances would not fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from depscope.llm.vectors import matrix, prepared
from depscope.scratch import materialize

SIZE, K, ROUNDS, SEED = 64, 40, 5, 2
# Ends of the blocks of coefficients, coarse to fine, and vectors compared at once.
BLOCKS, AT_ONCE = (4, 8, 16, 32, 64), 2048


def _sequency_order(size: int) -> np.ndarray:
    """Rows of the natural transform by their number of sign changes."""
    h = np.array([[1]])
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")


_ORDER = _sequency_order(SIZE)


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of whole-number rows, by sequency."""
    out = rows.astype(np.int64)
    step = 1
    while step < SIZE:
        pairs = out.reshape(len(out), SIZE // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), SIZE)
        step *= 2
    return out[:, _ORDER]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance, coefficient differences taken) of the nearest centroid of each row; both sides are transformed.

    Ties go to the smaller number.
    """
    n, k = len(x), len(centroids)
    part = np.zeros((n, k), dtype=np.int64)
    alive = np.ones((n, k), dtype=bool)
    each, taken, start = np.arange(n), 0, 0
    none = np.iinfo(np.int64).max
    for end in BLOCKS:
        i, j = np.nonzero(alive)
        apart = x[i, start:end] - centroids[j, start:end]
        part[i, j] += np.einsum("ij,ij->i", apart, apart)
        taken += len(i) * (end - start)
        start = end
        if end == SIZE:
            break
        # The leader's whole sum bounds the least one.
        lead = np.where(alive, part, none).argmin(axis=1)
        rest = x[:, end:] - centroids[lead, end:]
        bound = part[each, lead] + np.einsum("ij,ij->i", rest, rest)
        alive &= part <= bound[:, None]
    best = np.where(alive, part, none).argmin(axis=1)
    return best, part[each, best] // SIZE, taken


def _starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the least hashes of their numbers, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [row["v"] for row in vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()]


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    to = transform(np.array(centroids, dtype=np.int64))
    for whole in batches:
        for start in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(start, AT_ONCE)
            rows = matrix(batch.column("v"), SIZE)
            yield batch, rows, *nearest(transform(rows), to)[:2]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floors of the means of their vectors; without vectors they stay."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), SIZE + 1), dtype=np.int64)
        for _, rows, best, _ in _assigned(batches, centroids):
            np.add.at(sums[:, :SIZE], best, rows)
            sums[:, SIZE] += np.bincount(best, minlength=len(centroids))
        used = np.nonzero(sums[:, SIZE])[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(sums[used, i]) for i in range(SIZE + 1)]], names=names)

    names = ["cluster", *[f"s{i}" for i in range(SIZE)], "n"]
    parts = vectors.select("v").mapInArrow(work, "cluster int, " + ", ".join(f"{name} long" for name in names[1:]))
    out = [list(c) for c in centroids]
    # One row per centroid.
    for row in parts.groupBy("cluster").agg(*[F.sum(name).alias(name) for name in names[1:]]).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(SIZE)]
    return out


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, distance in _assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(work, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of rows (vec_id, v: SIZE whole numbers), and the final centroids."""
    centroids = _starts(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids)
    return assign(vectors, centroids), centroids


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    vectors = prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", SIZE)
    near, centroids = cluster(vectors)
    near = materialize(near, "clusters")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    # One row per centroid, at most K.
    sums = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    known = {row["cluster"]: row["cluster_inertia"] for row in sums}
    table = spark.createDataFrame(
        [(i, known.get(i, 0), sum(known.values()), digest) for i, digest in enumerate(digests)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds written out one after another."""
    steps = [f"""
vectors AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256(concat('{SEED}:', vec_id)), v) - 1 AS INTEGER) AS cluster, v AS c
  FROM vectors QUALIFY cluster < {K}
)"""]
    near = """near{i} AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, CAST(min(d) AS BIGINT) AS distance, arg_min(cluster, d * 1000 + cluster) AS cluster
  FROM (SELECT r, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM vectors, c{i}) GROUP BY r
)"""
    for i in range(ROUNDS):
        steps.append(near.format(i=i))
        steps.append(f"""sums{i} AS (
  SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {SIZE + 1})) AS i FROM near{i}) GROUP BY cluster, i
), means{i} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM sums{i} GROUP BY cluster
), c{i + 1} AS (
  SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN means{i} m ON m.cluster = o.cluster
)""")
    steps.append(near.format(i=ROUNDS))
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, n.cluster, distance, CAST(sum(distance) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{ROUNDS} n JOIN c{ROUNDS} o ON o.cluster = n.cluster
"""


ORACLE = _oracle()
