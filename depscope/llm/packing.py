"""Packing: length buckets with the least padding, and token-budget batches inside each.

Lengths are counted into one global histogram with an entry per distinct length. All tokens are at
least the sum of the distinct lengths, so there are at most sqrt(2 * tokens) + 1 entries. Dynamic
programming over them finds the boundaries with the least padding of all. The cost of a bucket meets
the quadrangle inequality, so best cuts grow with the bucket's end, and halving by that takes
entries * log(entries) steps a bucket.

Inside a bucket every batch has as many rows as its budget holds at the bucket's length. A document
longer than the budget gets a batch of its own; nothing is cut or left out.

Defined results: null and blank texts have length 0 and share the smallest bucket; ties in the order
within a bucket are broken by the document's number, repeated rows stand side by side; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from depscope.llm.common import fresh, ranked, words_of

def best_bounds(counts: list[int], sums: list[int], largest: list[int], buckets: int) -> list[int]:
    """Bucket ends (largest lengths, ascending) with the least padding, at most `buckets` of them.

    Cells come in ascending order. Ties go to fewer buckets, then to the smaller cut.
    """
    m = len(counts)
    if not m:
        return []
    n = np.concatenate([[0], np.cumsum(np.array(counts, dtype=object))])
    tokens = np.concatenate([[0], np.cumsum(np.array(sums, dtype=object))])
    n, tokens, top = n.astype(np.float64), tokens.astype(np.float64), np.array(largest, dtype=np.float64)
    cost = np.full(m + 1, np.inf)
    cost[0] = 0.0
    totals, cuts = [], []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int)
        new[0] = 0.0
        # (first and last end, first and last cut among which theirs lie)
        spans = [(1, m, 0, m - 1)]
        while spans:
            first, last, low, high = spans.pop()
            j = (first + last) // 2
            # The last bucket holds cells i .. j-1.
            i = slice(low, min(high, j - 1) + 1)
            each = cost[i] + top[j - 1] * (n[j] - n[i]) - (tokens[j] - tokens[i])
            at = int(np.argmin(each))
            new[j], cut[j] = each[at], low + at
            if first < j:
                spans.append((first, j - 1, low, int(cut[j])))
            if j < last:
                spans.append((j + 1, last, int(cut[j]), high))
        cost = new
        totals.append(new[m])
        cuts.append(cut)
    k = int(np.argmin(totals))
    bounds, j = [], m
    while j:
        bounds.append(int(largest[j - 1]))
        j, k = int(cuts[k][j]), k - 1
    return bounds[::-1]


def histogram(lengths: DataFrame, column: str) -> list[tuple[int, int, int]]:
    """(count, sum, largest) of every distinct length, ascending."""
    rows = lengths.groupBy(F.col(column).alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()
    return [(r["n"], r["n"] * r["length"], r["length"]) for r in sorted(rows, key=lambda r: r["length"])]


def pack(docs: DataFrame, length: str, order: list[str], buckets: int = 8, budget: int = 16384) -> DataFrame:
    """Add bucket, bucket_length, batch, place and padding to rows with a length, in place of columns of these names.

    `batch` counts from 0 in each bucket. `order` decides who shares a batch, after the length.
    """
    made = ("bucket", "bucket_length", "batch", "place", "padding")
    if taken := {length.lower(), *(o.lower() for o in order)} & set(made):
        raise ValueError(f"the length and the order cannot be among the columns made here: {sorted(taken)}")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    cells = histogram(docs, length)
    bounds = best_bounds([c[0] for c in cells], [c[1] for c in cells], [c[2] for c in cells], buckets)
    bucket, wide, rank = fresh(docs, "bucket", "bucket_length", "_rank")
    number, bound = F.lit(0), F.lit(bounds[0] if bounds else 0).cast("long")
    for i, (low, top) in enumerate(zip(bounds, bounds[1:], strict=False)):
        number = F.when(F.col(length) > low, i + 1).otherwise(number)
        bound = F.when(F.col(length) > low, F.lit(top).cast("long")).otherwise(bound)
    placed = docs.withColumn(bucket, number).withColumn(wide, bound)
    placed = ranked(placed, [bucket], [length, *order], "packing", rank)
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col(wide), F.lit(1)))).cast("long")
    return placed.select(
        *[placed[c] for c in docs.columns], F.col(bucket).alias("bucket"), F.col(wide).alias("bucket_length"),
        F.floor(F.col(rank) / rows).cast("long").alias("batch"), (F.col(rank) % rows).cast("long").alias("place"),
        (F.col(wide) - F.col(length)).alias("padding"))


def pack_documents(docs: DataFrame, buckets: int = 8, budget: int = 16384) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, place, padding) by words of the whole text."""
    lengths = docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"))
    return pack(lengths, "n_tokens", ["doc_id"], buckets, budget)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
