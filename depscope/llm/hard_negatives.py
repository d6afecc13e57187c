"""Hard-negative mining: an exact search for inner products over an inverted multi-index.

Vectors are cut into two halves. Each half has a codebook, and a vector lies in the cell of its two
codewords. For an anchor q and a codeword c with radius r (the largest distance of any vector's half
from it) no half scores more than q.c + |q| r, so the sum of both halves' bounds is above every
score in the cell. The multi-sequence heap visits cells by falling sum without sorting all of them.
A search is certified once what it keeps cannot change: the bound of the next cell is below the
last of its best scores, or below its window.

On Spark, a search is a few rounds. In each round every open anchor asks for its next cells (four times
as many each round); asks and vectors meet by cell; a task scores one block of a cell's vectors
against one block of its asks and emits only the best of each anchor; bests are merged, and anchors
that are certified are done. Cells are cut into blocks by the vectors' own hash, and the asks of a
cell into blocks by the anchors', so a cell that holds a third of all vectors is many tasks. The
first search finds each anchor's positives, the second the negatives of each positive's window.

Codebooks are fitted on the SAMPLE vectors with the least hashes of their numbers; cells and radii cover
all vectors, so the sample touches speed only, never results. Their size follows the number of vectors, up to CODES.

Defined results: rows with a null label or vector, or a null, NaN or infinite component take no part; nor do vectors of
another number of components than SIZE; rows equal in number, label and vector are one; different rows of one number
are rows of their own, anchors each; a null number is no anchor and is ordered last among equal scores; equal rows of a
result are listed as often as they occur; a positive with a negative score has no negatives, because its window is empty;
an empty table gives an empty result; components above 2 ** 24 after scaling stop the job.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from depscope.llm.vectors import matrix, prepared
from depscope.scratch import materialize

SIZE, HALF = 64, 32
POSITIVES, NEGATIVES = 5, 5
# A negative scores at least LOW percent of its positive.
LOW = 80
ANCHORS_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
# Codewords of a half at most, vectors of a cell on average, and rows of the sample that codebooks are fitted on.
CODES, PER_CELL, SAMPLE, FIT_ROUNDS = 512, 256, 8192, 8
# Vectors and asks of a cell that one task compares, and cells of the first round.
BLOCK, ASKS, FIRST_CELLS = 2048, 1024, 16
_NO_ID = (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; by floating point where no sum can lose a digit."""
    if not len(a) or not len(b) or int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] >= 1 << 53:
        return a @ b.T
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def fit_codebook(sample: np.ndarray, codes: int) -> np.ndarray:
    """At most `codes` whole-number codewords by Lloyd's rounds from evenly spread rows."""
    unique = np.unique(sample, axis=0)
    words = unique[np.linspace(0, len(unique) - 1, min(codes, len(unique))).astype(int)]
    for _ in range(FIT_ROUNDS):
        near, _ = nearest_code(sample, words)
        sums, n = np.zeros_like(words), np.bincount(near, minlength=len(words))
        np.add.at(sums, near, sample)
        words = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], words)
    return words


def nearest_code(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest codeword of each row."""
    best, apart = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
    own = (words * words).sum(axis=1)
    for s in range(0, len(rows), 4096):
        part = rows[s : s + 4096]
        d = (part * part).sum(axis=1)[:, None] - 2 * products(part, words) + own[None, :]
        best[s : s + 4096] = d.argmin(axis=1)
        apart[s : s + 4096] = d.min(axis=1)
    return best, apart


def bounds(half: np.ndarray, words: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codewords with vectors, and for each a score that none of their halves exceeds; radii are squared, -1 without vectors.

    Returns (bounds, codewords).
    """
    reach = np.sqrt(float((half * half).sum())) * np.sqrt(np.maximum(radii, 0).astype(np.float64))
    top = words @ half + np.ceil(reach * (1 + 1e-9)).astype(np.int64) + 1
    return top[radii >= 0], np.nonzero(radii >= 0)[0]


def visits(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bound, i, j) of all pairs by falling first[i] + second[j]; only the pairs beside visited ones wait in the heap."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    if not x or not y:
        return
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        # (i, j) waits once: below (i - 1, j) if j is 0, else beside (i, j - 1).
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


class Index:
    """Vectors by cell: rows (row, vec_id, label, v, cell, block), codebooks, and squared radii of every codeword."""

    def __init__(self, rows: DataFrame, label: str = "multi-index"):
        """`rows` has (vec_id, label, v); equal rows become one."""
        spark = rows.sparkSession
        rows = rows.distinct().withColumn("row", F.xxhash64("vec_id", "label", "v"))
        # Bounded by SAMPLE.
        sample = [r["v"] for r in rows.select("v", "row", F.xxhash64("vec_id").alias("h")).orderBy("h", "row").limit(SAMPLE).collect()]
        table = np.array(sample, dtype=np.int64).reshape(len(sample), SIZE)
        codes = max(1, min(CODES, round((rows.count() / PER_CELL) ** 0.5)))
        self.words = [fit_codebook(h, codes) if len(h) else h for h in (table[:, :HALF], table[:, HALF:])]
        words = self.words

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch.column("v"), SIZE)
                (i, r), (j, s) = nearest_code(v[:, :HALF], words[0]), nearest_code(v[:, HALF:], words[1])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(i * CODES + j, pa.int32()), pa.array(r), pa.array(s)], names=[*batch.schema.names, "cell", "r0", "r1"])

        placed = materialize(rows.mapInArrow(place, "vec_id long, label int, v array<int>, row long, cell int, r0 long, r1 long"), label)
        cells = placed.groupBy("cell").agg(F.max("r0").alias("r0"), F.max("r1").alias("r1"), F.count(F.lit(1)).alias("n"))
        self.cells = materialize(cells, f"{label}-cells")
        self.radii = []
        for side, code in enumerate((F.shiftright("cell", CODES.bit_length() - 1), F.col("cell").bitwiseAND(CODES - 1))):
            radii = np.full(len(words[side]), -1, dtype=np.int64)
            # One row per codeword, at most CODES.
            for r in self.cells.groupBy(code.alias("code")).agg(F.max(f"r{side}").alias("r")).collect():
                radii[r["code"]] = r["r"]
            self.radii.append(radii)
        self.rows, self.spark = placed.drop("r0", "r1"), spark

    def next_cells(self, anchors: DataFrame, start: int, count: int) -> DataFrame:
        """Rows of anchors (row, v) with the cells [start, start + count) of their visits and the bound of the cell after them, null at the end."""
        words, radii = self.words, self.radii

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch.column("v"), SIZE)
                for row, q in zip(batch.column("row").to_pylist(), v, strict=True):
                    (first, i), (second, j) = bounds(q[:HALF], words[0], radii[0]), bounds(q[HALF:], words[1], radii[1])
                    cells, after = [], None
                    for at, (bound, a, b) in enumerate(visits(first, second)):
                        if at >= start + count:
                            after = bound
                            break
                        if at >= start:
                            cells.append(int(i[a]) * CODES + int(j[b]))
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([cells], pa.list_(pa.int32())), pa.array([after], pa.int64())], names=["row", "cells", "after"])

        return anchors.select("row", "v").mapInArrow(work, "row long, cells array<int>, after long")

    def meet(self, asks: DataFrame, score, schema: str) -> DataFrame:
        """Score asks (row, cell, ...) against the vectors of their cells, block by block, by `score(asks, vectors) -> table`."""
        load = asks.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).join(self.cells.select("cell", "n"), "cell")
        load = load.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / ASKS).cast("int").alias("lots"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = lambda n: F.pmod(F.xxhash64(F.col("row"), F.lit(n)), F.col(n)).cast("int")
        vectors = self.rows.join(load, "cell").withColumn("block", mine("blocks")).withColumn("lot", every("lots")).drop("blocks", "lots")
        asks = asks.join(load, "cell").withColumn("lot", mine("lots")).withColumn("block", every("blocks")).drop("blocks", "lots")
        keys = ["cell", "block", "lot"]
        return asks.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(score, schema)


def _scores(asks: pa.Table, vectors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    q = matrix(asks.column("v").combine_chunks(), SIZE)
    v = matrix(vectors.column("v").combine_chunks(), SIZE)
    return products(q, v), vectors.column("vec_id").fill_null(_NO_ID).to_numpy()


def _best_of(found: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = zip(*found, strict=True) if found else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _first(df: DataFrame, by: list[str], count: int) -> DataFrame:
    """The `count` best rows of each group; Spark keeps as many per task before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("found_id").asc_nulls_last(), "found")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def search(index: Index, anchors: DataFrame, by: list[str], count: int, score, schema: str, limits: Column) -> DataFrame:
    """(by..., found, found_id, score, rank): the `count` best rows of every group, certified.

    `anchors` has (row, v) and what `score` needs, a row per search; groups of `by` begin with row. `score` emits (by..., found,
    found_id, score) of at least the best rows of a block. An anchor stays open while a cell not visited may hold a score that
    reaches `limits`, a column over (after, anchors' columns, worst: the lowest score that all its groups hold in full, else null).
    """
    names = [f.split()[0] for f in schema.split(", ")]
    best, open_, start, cells = index.spark.createDataFrame([], schema), anchors, 0, FIRST_CELLS
    while True:
        told = materialize(index.next_cells(open_, start, cells), "visits")
        asks = open_.join(told.select("row", F.explode("cells").alias("cell")), "row")
        met = index.meet(asks, score, schema)
        best = materialize(_first(best.select(*names).union(met.select(*names)), by, count), "best")
        full = best.groupBy(*by).agg(F.min("score").alias("lowest"), F.count(F.lit(1)).alias("n"))
        full = full.groupBy("row").agg(F.min("lowest").alias("worst"), F.min("n").alias("least"), F.count(F.lit(1)).alias("groups"))
        left = open_.join(told.where("after IS NOT NULL").select("row", "after"), "row").join(full, "row", "left")
        left = left.withColumn("worst", F.when((F.col("least") >= count) & (F.col("groups") >= F.col("searches")), F.col("worst")))
        open_ = materialize(left.where(limits).select(*open_.columns), "open")
        start, cells = start + cells, cells * 4
        if open_.isEmpty():
            return best


def positives_of(index: Index, anchors: DataFrame, count: int = POSITIVES) -> DataFrame:
    """(row, found, found_id, score, rank): the best other rows of each anchor's label."""

    def score(asks: pa.Table, vectors: pa.Table) -> pa.Table:
        found = []
        if asks.num_rows and vectors.num_rows:
            points, ids = _scores(asks, vectors)
            rows, labels = vectors.column("row").to_numpy(), vectors.column("label").to_numpy()
            for own, label, line in zip(asks.column("row").to_pylist(), asks.column("label").to_pylist(), points, strict=True):
                at = np.nonzero((labels == label) & (rows != own))[0]
                at = at[np.lexsort((rows[at], ids[at], -line[at]))[:count]]
                found += [(own, int(rows[k]), None if ids[k] == _NO_ID else int(ids[k]), int(line[k])) for k in at]
        return _best_of(found, ["row", "found", "found_id", "score"], [pa.int64()] * 4)

    # Equal scores of a cell not visited could have smaller numbers.
    limits = F.col("worst").isNull() | (F.col("after") >= F.col("worst"))
    asked = anchors.withColumn("searches", F.lit(1))
    return search(index, asked, ["row"], count, score, "row long, found long, found_id long, score long", limits)


def negatives_of(index: Index, anchors: DataFrame, positives: DataFrame, count: int = NEGATIVES, low: int = LOW) -> DataFrame:
    """(row, top, found, found_id, score, rank): for each score `top` of an anchor's positives the best rows of other labels in its window."""

    def score(asks: pa.Table, vectors: pa.Table) -> pa.Table:
        found = []
        if asks.num_rows and vectors.num_rows:
            points, ids = _scores(asks, vectors)
            rows, labels = vectors.column("row").to_numpy(), vectors.column("label").to_numpy()
            for own, label, tops, line in zip(asks.column("row").to_pylist(), asks.column("label").to_pylist(), asks.column("tops").to_pylist(), points, strict=True):
                other = np.nonzero((labels != label) & (line <= max(tops)) & (100 * line >= low * min(tops)))[0]
                other = other[np.lexsort((rows[other], ids[other], -line[other]))]
                for top in tops:
                    at = other[(line[other] <= top) & (100 * line[other] >= low * top)][:count]
                    found += [(own, top, int(rows[k]), None if ids[k] == _NO_ID else int(ids[k]), int(line[k])) for k in at]
        return _best_of(found, ["row", "top", "found", "found_id", "score"], [pa.int64()] * 5)

    # The window of a negative score is empty.
    tops = positives.where("score >= 0").groupBy("row").agg(F.array_sort(F.collect_set("score")).alias("tops"))
    asked = materialize(anchors.join(tops, "row").withColumn("searches", F.size("tops")), "windows")
    reaches = 100 * F.col("after") >= low * F.element_at("tops", 1)
    limits = reaches & (F.col("worst").isNull() | (F.col("after") >= F.col("worst")))
    return search(index, asked, ["row", "top"], count, score, "row long, top long, found long, found_id long, score long", limits)


def mine(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, v)."""
    index = Index(vectors)
    anchors = materialize(index.rows.where(is_anchor).select("row", "vec_id", "label", "v"), "anchors")
    positives = positives_of(index, anchors.drop("vec_id"))
    negatives = negatives_of(index, anchors.drop("vec_id"), positives)
    pairs = positives.select("row", F.col("found_id").alias("positive_id"), F.col("score").alias("top"))
    out = pairs.join(negatives, ["row", "top"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        F.col("top").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("int")
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label IS NOT NULL")
    vectors = prepared(table, "vec_id", "embedding", SIZE, label.alias("label")).select("vec_id", "label", "v")
    return mine(vectors, F.col("vec_id") % ANCHORS_EVERY == 0)


ORACLE = f"""
WITH rows_ AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}
), numbered AS (
  SELECT row_number() OVER (ORDER BY vec_id, label, v) AS r, * FROM rows_
), scored AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS found, b.vec_id AS found_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM numbered a JOIN numbered b ON a.r <> b.r WHERE a.vec_id % {ANCHORS_EVERY} = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, found_id NULLS LAST, found) <= {POSITIVES}
)
SELECT p.anchor_id, p.found_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.r, p.found ORDER BY n.score DESC, n.found_id NULLS LAST, n.found) AS INTEGER) AS rank,
  n.found_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.r = p.r AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= {NEGATIVES}
"""
